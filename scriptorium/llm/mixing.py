"""Mixing sources to target weights by iterative proportional fitting.

Token counts by cell (source, language, topic) are raked: the cells' weights are scaled to each dimension's target shares in
turn until all three marginals agree. A cell's factor is its weight by its tokens. Documents are then sampled with
probability min(1, c x factor), c calibrated so that the expected tokens are the budget; where a probability is cut at 1,
the document's weight carries the rest, so weighted marginals meet the targets. A document's draw is a hash of its id and
text, so it is the same wherever and whenever it is made.

Cells are counted by partial sums before any shuffle. Their table is raked on the driver when it has at most `max_cells`
rows, and else by DataFrame steps, each checkpointed, with the same rounds, tolerance and bisections. Where the rounds end
before the tolerance is reached, a warning says how far off the marginals were.

Texts of any length are counted whole, in one pass over their words. Null sources and languages are a value of their own, None among targets; null and empty texts have no tokens, a factor like their cell's (1 if
the cell has no tokens), and are drawn like others. Repeated rows are drawn alike. An empty table gives an empty result. Targets for values that do not occur
are left out and the rest scaled to a sum of 1; values without a target keep their share. Extra columns pass through.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import checkpointed, discard

#: Power of the shares that default targets follow; share of the tokens to keep; rounds, tolerance, cells raked on the driver.
TEMPER, BUDGET, ROUNDS, TOLERANCE, MAX_CELLS = 0.7, 0.7, 500, 1e-9, 100_000
#: Halvings of the calibration's interval.
BISECTIONS = 100
DIMENSIONS = ("source", "lang", "topic")
#: Columns that sample() adds or works with.
ADDED = ("mix_source", "mix_lang", "mix_topic", "mix_tokens", "mix_factor", "mix_probability", "mix_weight", "mix_kept")
#: Topics, each with the marks that a text of it has; the first that fits is taken. Fixed values.
TOPICS = (("legal", ("license", "License", "LICENSE", "opyright")), ("contact", ("@", "http://", "https://")), ("settings", ("password", "token = ", "AKIA")), ("table", (" | ",)), ("symbols", ("%%%", "$$$", "###")), ("outcry", ("!!",)))


def topic(text: str = "text") -> Column:
    """The topic of a text, `prose` where no mark is found."""
    found = F.lit("prose")
    for name, marks in reversed(TOPICS):
        has = F.lit(False)
        for m in marks:
            has = has | F.contains(F.col(text), F.lit(m))
        found = F.when(has, name).otherwise(found)
    return found


def n_tokens(text: str = "text") -> Column:
    """White-space words of a text; 0 for null."""
    return F.expr(f"size(filter(split(coalesce(`{text}`, ''), '\\\\s+'), w -> w <> ''))").cast("long")


def targets_of(totals: Mapping[str, float], given: Mapping[str, float] | None, temper: float) -> dict[str, float]:
    """Target shares of a dimension's values: given ones, or tempered own shares."""
    whole = sum(totals.values()) or 1.0
    own = {v: t / whole for v, t in totals.items()}
    share = {v: s**temper if s > 0 else 0.0 for v, s in own.items()} if given is None else {v: given.get(v, s) for v, s in own.items()}
    whole = sum(share.values()) or 1.0
    return {v: s / whole for v, s in share.items()}


def rake(cells: list[tuple], tokens: np.ndarray, targets: list[dict[str, float]], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The cells' weights, of the same sum as their tokens, with the targets' marginals."""
    w, total = tokens.astype(float).copy(), float(tokens.sum())
    if not cells:
        return w
    places = []
    for d, target in enumerate(targets):
        values = {v: i for i, v in enumerate(sorted(target))}
        places.append((np.array([values[c[d]] for c in cells]), np.array([target[v] for v in sorted(target)]) * total))
    for _ in range(rounds):
        worst = 0.0
        for at, goal in places:
            now = np.bincount(at, w, len(goal))
            scale = np.divide(goal, now, out=np.ones_like(goal), where=now > 0)
            worst = max(worst, float(np.abs(scale - 1).max()))
            w *= scale[at]
        if worst < tolerance:
            break
    else:
        _warn(rounds, worst, tolerance)
    return w


def _warn(rounds: int, worst: float, tolerance: float) -> None:
    warnings.warn(f"raking stopped after {rounds} rounds with marginals off by {worst:.3g}, above {tolerance:.3g}", RuntimeWarning, stacklevel=3)


def calibrate(tokens: np.ndarray, factor: np.ndarray, budget: float) -> float:
    """c such that the expected tokens, sum of tokens x min(1, c x factor), are the budget; bisection over c."""
    if not (tokens * factor).sum() > 0:
        return 1.0
    lo, hi = 0.0, 1.0
    while (tokens * np.minimum(1, hi * factor)).sum() < budget and hi < 1e12:
        hi *= 2
    for _ in range(BISECTIONS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (tokens * np.minimum(1, mid * factor)).sum() < budget else (lo, mid)
    return hi


def factors(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, temper: float = TEMPER, budget: float = BUDGET, max_cells: int = MAX_CELLS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, bool]:
    """(source, lang, topic, factor) with the calibrated factor of each cell, and whether the table is small."""
    spark, given = cells.sparkSession, targets or {}
    head = cells.limit(max_cells + 1).collect()
    schema = "source string, lang string, topic string, factor double"
    if len(head) <= max_cells:
        keys = [tuple(r[d] for d in DIMENSIONS) for r in head]
        tokens = np.array([r.tokens for r in head], float)
        goals = []
        for i, d in enumerate(DIMENSIONS):
            totals: dict[str, float] = {}
            for k, t in zip(keys, tokens, strict=True):
                totals[k[i]] = totals.get(k[i], 0.0) + t
            goals.append(targets_of(totals, given.get(d), temper))
        w = rake(keys, tokens, goals, rounds, tolerance)
        f = np.divide(w, tokens, out=np.ones_like(w), where=tokens > 0)
        f *= calibrate(tokens, f, budget * tokens.sum())
        return spark.createDataFrame([(*k, float(x)) for k, x in zip(keys, f, strict=True)], schema), True
    now = checkpointed(cells.withColumn("w", F.col("tokens").cast("double")))
    total = now.agg(F.sum("w")).first()[0] or 0.0
    goals = {}
    for d in DIMENSIONS:
        own = now.groupBy(d).agg((F.sum("w") / total).alias("share"))
        if d in given:
            named = spark.createDataFrame(list(given[d].items()), f"{d} string, wish double")
            own = own.join(named, d, "left").select(d, F.coalesce("wish", "share").alias("share"))
        else:
            own = own.withColumn("share", F.pow("share", F.lit(temper)))
        goals[d] = checkpointed(own.select(d, (F.col("share") / own.agg(F.sum("share")).first()[0] * total).alias("goal")))
    for _ in range(rounds):
        worst = 0.0
        for d in DIMENSIONS:
            scale = goals[d].join(now.groupBy(d).agg(F.sum("w").alias("now")), d).select(d, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(1.0).alias("scale"))
            worst = max(worst, scale.agg(F.max(F.abs(F.col("scale") - 1))).first()[0] or 0.0)
            last, now = now, checkpointed(now.join(scale, d).select(*DIMENSIONS, "tokens", (F.col("w") * F.col("scale")).alias("w")))
            discard(last)
        if worst < tolerance:
            break
    else:
        _warn(rounds, worst, tolerance)
    f = now.select(*DIMENSIONS, "tokens", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0).alias("f"))
    expected = lambda c: f.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("f") * c))).first()[0] or 0.0
    lo, hi = 0.0, 1.0
    while expected(hi) < budget * total and hi < 1e12:
        hi *= 2
    for _ in range(BISECTIONS):
        mid = (lo + hi) / 2
        if mid in (lo, hi):  # no number lies between; further halvings change nothing
            break
        lo, hi = (mid, hi) if expected(mid) < budget * total else (lo, mid)
    return f.select(*DIMENSIONS, (F.col("f") * hi).alias("factor")), False


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, temper: float = TEMPER, budget: float = BUDGET, topic_of: Column | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """The rows, columns of these names aside, with mix_topic, mix_tokens, mix_probability, mix_weight and mix_kept."""
    docs = docs.drop(*ADDED)
    # A mark before values keeps nulls apart from every value.
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    marked = {d: {f"={v}" if d != "topic" and v is not None else v or "": x for v, x in wish.items()} for d, wish in (targets or {}).items()}
    cell = {"source": value("source"), "lang": value("lang"), "topic": F.coalesce(topic_of if topic_of is not None else topic(), F.lit("prose"))}
    counted = docs.select(*(e.alias(c) for c, e in cell.items()), n_tokens().alias("tokens")).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    by_cell, small = factors(counted, marked, temper, budget, max_cells)
    by_cell = by_cell.select(*(F.col(c).alias(f"mix_{c}") for c in DIMENSIONS), F.col("factor").alias("mix_factor"))
    keyed = docs.withColumns({f"mix_{c}": e for c, e in cell.items()})
    p = F.least(F.lit(1.0), F.col("mix_factor"))
    # The hash's 53 upper bits as a number from 0 to 1.
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))), 11) / F.lit(float(1 << 53))
    joined = keyed.join(F.broadcast(by_cell) if small else by_cell, [f"mix_{c}" for c in DIMENSIONS])
    return joined.select(*docs.columns, "mix_topic", n_tokens().alias("mix_tokens"), p.alias("mix_probability"), F.when(p > 0, F.col("mix_factor") / p).otherwise(0.0).alias("mix_weight"), (draw < p).alias("mix_kept"))
