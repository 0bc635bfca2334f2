"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities and numbers of lexicon words (a fixed list, learnt words and learnt word beginnings,
which catch inflected forms, with weights), second-person words near lexicon words, capitals, punctuation, and obfuscated spellings.
All is learnt from at most `fit_rows` labelled rows, those with the smallest hashes of their ids: lexicons from either
half, which give the other half's features, the trees and the calibration from two parts of those, and the final lexicon from all.

Null and empty texts have all features 0 and get a score like any other. Texts of any length are read whole. With no labelled rows of both labels,
trees are left out and lexicon hits alone decide; with fewer than LEAST_GROWN or LEAST_HELD toxic rows in the trees' or the
calibration's part, both take all sampled rows. Tied splits go to the first feature and its lowest bin. Repeated rows score alike; an empty table gives an empty result. Extra
columns are ignored or pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import checkpointed, discard, map_arrow

#: Labelled rows; the score from which a text counts as toxic.
FIT_ROWS, THRESHOLD = 9_000, 0.3
#: Toxic rows that the trees' part and the calibration's part need; with fewer, both take all sampled rows.
LEAST_GROWN, LEAST_HELD = 20, 10
#: Trees, their depth, the learning rate, bins of a feature.
TREES, LEAVES_DEPTH, RATE, BINS = 80, 3, 0.15, 32
#: Common insults. Fixed list.
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers pathetic scum worthless trash clown clowns disgusting dumb imbecile fool garbage vermin filth filthy hate pig "
    "idiota imbécil estúpido estúpida basura asqueroso patético payaso "
    "imbécile crétin stupide ordure minable dégoûtant connard "
    "dumm trottel abschaum idioten widerlich dreck arschloch versager".split()
)
#: Words of the second person. Fixed list.
SECOND = frozenset("you your you're yours u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch ti tú usted tus vosotros".split())
LEET = str.maketrans("01345789@$!|+", "oieastbgasilt")
EDGES = ".,;:!?()[]{}<>\"'`*#%&$~_-…«»¡¿|/\\"
INSULT, LEARNT, BEGINNING, YOU, CAPS, ODD, HIDDEN, LOUD = (1 << i for i in range(8))
#: Above the marks a token has its weight, in eighths, up to this.
WEIGHT_BITS, MOST = 8, 63
FEATURES = 25
#: Lengths of learnt beginnings; keys of the learnt lexicon; least log ratio of a key, of a learnt word and of a marked beginning.
LENGTHS, KEYS, LEAST, WORD, BEGIN = (4, 5, 6, 7, 8), 4_000, 1.2, 3.0, 2.5


@dataclass(frozen=True)
class Lexicon:
    """Weights of learnt words and beginnings: how much more often toxic texts have them, as a natural logarithm."""

    words: dict = field(default_factory=dict)
    beginnings: dict = field(default_factory=dict)

    def weight(self, word: str) -> tuple[float, float]:
        return self.words.get(word, 0.0), max([self.beginnings.get(word[:n], 0.0) for n in LENGTHS if len(word) >= n], default=0.0)


class Marks(dict):
    """Bit marks of tokens met before, bounded."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> int:
        if len(self) > 150_000:
            self.clear()
        core = token.strip(EDGES)
        low = core.lower()
        m = (LOUD if token[-1] in "!?" else 0) | (CAPS if len(core) > 1 and core.isupper() else 0) | (YOU if low in SECOND else 0)
        own, begin = self.lexicon.weight(low)
        m |= (INSULT if low in INSULTS else 0) | (LEARNT if own >= WORD else 0) | (BEGINNING if begin >= BEGIN else 0)
        m |= min(MOST, int(8 * max(own, begin))) << WEIGHT_BITS
        if core and not core.isalpha() and any(map(str.isalpha, core)):
            m |= ODD
            plain = "".join(filter(str.isalpha, low.translate(LEET)))
            if plain in INSULTS or plain in self.lexicon.words or "".join(filter(str.isalpha, low)) in INSULTS:
                m |= HIDDEN
        self[token] = m
        return m


def features(text: str, marks: Marks) -> list[float]:
    """The dense features of a whole text."""
    tokens = text.split()
    if not tokens:
        return [0.0] * FEATURES
    m = np.fromiter(map(marks.__getitem__, tokens), np.uint16, len(tokens))
    n = len(m)
    count = [int(np.count_nonzero(m & bit)) for bit in (INSULT, LEARNT, BEGINNING, YOU, CAPS, ODD, HIDDEN, LOUD)]
    hits = np.flatnonzero(m & (INSULT | LEARNT | BEGINNING | HIDDEN))
    near = 0
    if count[3] and len(hits):
        you = np.flatnonzero(m & YOU)
        at = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(hits - you[np.minimum(at, len(you) - 1)]), np.abs(hits - you[np.maximum(at - 1, 0)]))
        near = int((gap <= 5).sum())
    closest = float(1 / (1 + np.diff(hits).min())) if len(hits) > 1 else 0.0
    marks_ = sum(text.count(c) for c in "!?")
    singles = sum(len(t) == 1 for t in tokens) / n
    w = (m >> WEIGHT_BITS).astype(float) / 8
    heavy = w[w > 0]
    rank = np.sort(heavy)[::-1]
    weights = [float(w.sum()) / n, float(w.sum()), float(rank[0]) if len(rank) else 0.0, float(rank[:3].sum()), len(heavy) / n]
    return [*(c / n for c in count), float(count[0]), float(count[1]), float(count[2]), float(count[6]), len(hits) / n, float(len(hits)), near / max(1, len(hits)), float(near), closest, marks_ / n, float(np.log1p(n)), singles, *weights]


def _words_of_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each half and label a word or beginning is."""
    found: Counter = Counter()
    for b in batches:
        for t, toxic, half in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
            words = {w for x in (t or "").lower().split() if (w := x.strip(EDGES)) and w.isalpha()}
            keys = {"w" + w for w in words} | {"b" + w[:n] for w in words for n in LENGTHS if len(w) >= n}
            found.update((k, int(toxic == 1), half) for k in keys)
    keys = list(found)
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in keys], pa.string()), pa.array([y for _, y, _ in keys], pa.int32()), pa.array([h for _, _, h in keys], pa.int32()), pa.array(list(found.values()), pa.int64())], ["key", "toxic", "half", "n"])


def learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """The lexicons of the first half, the second half, and all rows (text, toxic, half): words and beginnings that toxic
    texts have more often than clean ones, the weightiest by their log ratio times its evidence."""
    size = {(r.toxic, r.half): r["count"] for r in rows.groupBy((F.col("toxic") == 1).cast("int").alias("toxic"), "half").count().collect()}
    counted = map_arrow(rows.select("text", "toxic", "half"), _words_of_rows, "key string, toxic int, half int, n long")
    of = lambda y, h: F.sum(F.when((F.col("toxic") == y) & (F.col("half") == h), F.col("n")).otherwise(0)).alias(f"n{y}{h}")
    table = checkpointed(counted.groupBy("key").agg(*[of(y, h) for y in (0, 1) for h in (0, 1)]).where("n10 + n11 >= 2"))
    out = []
    for halves in ((0,), (1,), (0, 1)):
        toxic, clean = (sum(size.get((y, h), 0) for h in halves) for y in (1, 0))
        t, c = (sum((F.col(f"n{y}{h}") for h in halves), F.lit(0)) for y in (1, 0))
        # A text or so more on either side keeps rare keys modest.
        weight = F.log((t + 0.5) / (toxic + 1) / ((c + 1.0) / (clean + 2)))
        keys = table.select("key", t.alias("t"), weight.alias("w")).where((F.col("t") >= 3) & (F.col("w") >= LEAST)).orderBy((F.col("w") * F.sqrt("t")).desc(), "key").limit(KEYS).collect() if toxic else []
        out.append(Lexicon({r.key[1:]: r.w for r in keys if r.key[0] == "w"}, {r.key[1:]: r.w for r in keys if r.key[0] == "b"}))
    discard(table)
    return out


@dataclass
class Trees:
    """Boosted trees as arrays: feature, threshold and value by node of a full tree."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(LEAVES_DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > t[at])
            out += v[at - (2**LEAVES_DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss over quantile bins; ties go to the first feature and the lowest bin."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    rare = [np.unique(x[x[:, j] > 0, j]) for j in range(x.shape[1])]
    cuts = [np.unique(np.concatenate((c, [0.0], np.quantile(r, np.linspace(0, 1, 9)[1:-1]) if len(r) else []))) for c, r in zip(cuts, rare, strict=True)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    width = max(map(len, cuts)) + 1
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(p0 / (1 - p0)))
    out, inner = np.full(len(x), start), 2**LEAVES_DEPTH - 1
    fs, ts, vs = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-out))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        f, t, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(x), int)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            if len(mine) > 10:
                flat = binned[mine] + np.arange(x.shape[1]) * width
                sums = [np.bincount(flat.ravel(), np.repeat(v[mine], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(axis=1) for v in (g, h)]
                all_g, all_h = g[mine].sum(), h[mine].sum()
                gain = sums[0] ** 2 / (sums[1] + 1) + (all_g - sums[0]) ** 2 / (all_h - sums[1] + 1) - all_g**2 / (all_h + 1)
                gain[(sums[1] < 0.5) | (all_h - sums[1] < 0.5)] = -1
                j, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[j, b] > 1e-6 and b < len(cuts[j]):
                    f[node], t[node] = j, cuts[j][b]
            at[mine] = 2 * node + 1 + (x[mine, f[node]] > t[node])
        leaf = at - inner
        v = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        out += v[leaf]
        fs.append(f), ts.append(t), vs.append(v)
    return Trees(start, np.array(fs), np.array(ts), np.array(vs))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the raw score and calibrated values, with one added case of either label at the prior's share in each pool."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for r, v in zip(raw[order], y[order], strict=True):
        pools.append([float(v), 1.0, float(r), float(r)])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
            s, n, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = hi
    prior = float(y.mean())
    value = np.maximum.accumulate([(s + prior) / (n + 1) for s, n, _, _ in pools])
    return np.array([k for p in pools for k in p[2:]]), np.repeat(value, 2)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        if self.trees is None:
            return np.where(x[:, 13] > 0, 0.9, 0.05)
        raw = self.trees.raw(x)
        # The raw score decides between texts of one pool, by less than pools differ.
        return np.clip(np.interp(raw, self.knots, self.values) * (1 - 1e-6) + 1e-6 / (1 + np.exp(-raw)), 0, 1)


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model of rows (doc_id, text, toxic); rows without a label are left out."""
    rows = labelled.where("toxic is not null").select(F.xxhash64("doc_id").alias("h"), F.col("toxic").cast("int").alias("toxic"), "text")
    limit = rows.select("h").orderBy("h").limit(fit_rows).agg(F.max("h")).first()[0]
    if limit is None:
        return Model(Lexicon(), None, np.zeros(0), np.zeros(0))
    sample = rows.where(F.col("h") <= limit).withColumn("part", F.pmod(F.col("h"), F.lit(10))).withColumn("half", (F.col("part") % 2).cast("int"))
    first, second, whole = learn_lexicons(sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row's features are by the lexicon of the half that it isn't in, which knows nothing of its label.
        marks = [Marks(second), Marks(first)]
        for b in batches:
            x = [features(t or "", marks[h]) for t, h in zip(b.column("text").to_pylist(), b.column("half").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("part"), b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["h", "part", "toxic", "x"])

    got = map_arrow(sample.select("h", "part", "half", "toxic", "text"), run, "h long, part long, toxic int, x array<double>").orderBy("h", "toxic", "x").limit(fit_rows).collect()
    x, y, part = np.array([r.x for r in got]), np.array([float(r.toxic == 1) for r in got]), np.array([r.part for r in got])
    grown, held = part < 7, part >= 7
    if len(got) and (y[grown].sum() < LEAST_GROWN or y[held].sum() < LEAST_HELD):
        grown = held = np.ones(len(y), bool)
    if not len(got) or not 0 < y[grown].sum() < grown.sum():
        return Model(whole, None, np.zeros(0), np.zeros(0))
    trees = boost(x[grown], y[grown])
    knots, values = isotonic(trees.raw(x[held]), y[held])
    return Model(whole, trees, knots, values)


def _scores(model: Model, texts: list[str | None], marks: Marks) -> np.ndarray:
    return model.score(np.array([features(t or "", marks) for t in texts]).reshape(-1, FEATURES))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows (doc_id, held_out, text) as doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(shared.value.lexicon)
        for b in batches:
            s = _scores(shared.value, b.column("text").to_pylist(), marks)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "held_out", "text"), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is under the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(shared.value.lexicon)
        for b in batches:
            yield b.filter(pa.array(_scores(shared.value, b.column("text").to_pylist(), marks) < threshold))

    return map_arrow(docs, run, docs.schema)
