"""Ranked search: exact substring, typo-tolerant, gated, and the two older searches."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions import vocab
from scriptorium.operators.gram_index import GramIndex

#: Fuzzy search runs when exact search finds fewer rows than this, for queries of at least so many characters.
FUZZY_BELOW, FUZZY_LENGTH, FUZZY_MOST = 12, 3, 0.35


def index(rows: DataFrame, weights: Mapping[str, int] = vocab.FIELD_WEIGHTS, tables: Sequence = (vocab.LATIN, vocab.CYRILLIC), composed: bool = False) -> DataFrame:
    """Rows with `fields` (normalized values and weights) and `combined`, the searchable text of all fields in all scripts.

    Write the result as a table once and search it many times. composed=True leaves out composition (the only Python step) for input known to be composed.
    """
    norm = T.fold if composed else T.normalize
    # Each field is composed once; all else is made of that.
    once = rows.withColumns({f"_{f}": norm(F.nullif(F.col(f), F.lit(""))) for f in weights})
    fields, parts = [], []
    for f, w in weights.items():
        raw, v = F.nullif(F.col(f), F.lit("")), F.col(f"_{f}")
        fields.append(F.struct(v.alias("value"), F.lit(w).alias("weight")))
        parts.append(v)
        before: list[Column] = [raw]
        for t in tables:
            x = T.transliterate(v, t)
            parts.append(F.when(~F.array_contains(F.array(*before), x), T.fold(x)))
            before.append(x)
    made = once.withColumns({"fields": F.filter(F.array(*fields), lambda x: x["value"].isNotNull()), "combined": F.trim(F.concat_ws(" ", *parts))})
    return made.drop(*[f"_{f}" for f in weights])


def filters(location: Sequence[str] = (), actors: Sequence[str] = (), language: Sequence[str] = (), duration: str | None = None) -> Column:
    """Any value within a facet, all facets together; an empty facet is no filter. A null duration fails any duration filter."""
    keep = F.lit(True)
    if location:
        keep = keep & F.col("location").isin(list(location))
    if language:
        keep = keep & F.arrays_overlap("languages", F.array(*map(F.lit, language)))
    if actors:
        keep = keep & F.arrays_overlap("actors", F.array(*map(F.lit, actors)))
    if duration:
        s = F.col("durationSec")
        keep = keep & F.coalesce({"<2": s < 120, "2-4": (s >= 120) & (s <= 240), "4+": s > 240}[duration], F.lit(False))
    return keep


def weighted(query: str) -> Column:
    """Sum of the weights of fields with the query, 1 if only the combined text has it."""
    hit = F.filter("fields", lambda x: F.contains(x["value"], F.lit(query)))
    return F.greatest(F.aggregate(hit, F.lit(0), lambda s, x: s + x["weight"]), F.lit(1)).cast("double")


def exact(indexed: DataFrame, query: str, keep: Column | None = None) -> DataFrame:
    """Rows whose combined text has the normalized query, with a score; all rows with score 0 for the empty query."""
    rows = indexed if keep is None else indexed.where(keep)
    if not query:
        return rows.withColumn("score", F.lit(0.0))
    return rows.where(F.contains("combined", F.lit(query))).withColumn("score", weighted(query))


def word_index(indexed: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Distinct (word, key) of the combined text; words are parted by single blanks."""
    # The outer form keeps the optimizer from cutting the text twice, once to see whether there are words; its null falls with the short words.
    return indexed.select(F.explode_outer(F.array_distinct(F.split("combined", " "))).alias("word"), key).where(F.length("word") >= least)


def fuzzy(indexed: DataFrame, query: str, key: str, most: float = FUZZY_MOST, score: Callable[[str, str], Column] = T.near_score) -> DataFrame:
    """(key, near): the least score of a row's words that are near the query.

    Distinct words are scored once; the rows then meet the few that are near. Words that cannot be near are left out
    before any distance is taken: those that are too short, and those without any part of the query, cut in one more part
    than edits are allowed, as an edit spoils one part at most. `score` may be any that is not below the distance to the nearest part.
    The words that are left are written once to the shared folder, so that texts are read and cut once.
    """
    from scriptorium.plans.session import written

    slack = int(most * len(query))
    cuts = [round(i * len(query) / (slack + 1)) for i in range(slack + 2)]
    part = F.lit(False)
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = part | F.contains("word", F.lit(query[a:b]))
    words = written(word_index(indexed, key).where((F.length("word") >= len(query) - slack) & part))
    # The score hangs on the count, so that it does not move to before equal words are one.
    vocabulary = words.groupBy("word").agg(F.count("*").alias("n"))
    near = vocabulary.select("word", F.when(F.col("n") > 0, score("word", query)).alias("near")).where(F.col("near") <= most)
    return words.join(near, "word").groupBy(key).agg(F.min("near").alias("near"))


def normal_query(query: str) -> str:
    """The query as the index has its text."""
    import unicodedata

    return " ".join(unicodedata.normalize("NFC", query.lower()).split())


def with_fuzzy(found: DataFrame, indexed: DataFrame, query: str, key: str, keep: Column | None = None, words: GramIndex | None = None, score: Callable[[str, str], Column] = T.near_score) -> DataFrame:
    """Exact rows, and rows that only fuzzy search finds with a score below any exact one; near words come from a kept index if there is one."""
    near = (words.rows(query, FUZZY_MOST) if words else fuzzy(indexed, query, key, score=score)).where("near < 1")
    rows = indexed if keep is None else indexed.where(keep)
    more = rows.join(near, key).join(found.select(key), key, "left_anti").withColumn("score", (1 - F.col("near")) * 0.5).drop("near")
    return found.unionByName(more)


def ordered(found: DataFrame, query: str, sort: str, views: str, day: str, tie: str, seed: int | None = None) -> DataFrame:
    """Score first if there is a query, then views or day, latest first; or a shuffle."""
    if sort == "random":
        return found.orderBy(F.rand(seed))
    by = F.col(day).desc_nulls_last() if sort == "newest" else F.coalesce(F.col(views), F.lit(0)).desc()
    return found.orderBy(*([F.col("score").desc()] if query else []), by, F.col(tie))


def search(indexed: DataFrame, query: str, keep: Column | None = None, sort: str = "views", key: str = "id", views: str = "viewCount", day: str = "uploadDate", below: int = FUZZY_BELOW, seed: int | None = None, words: GramIndex | None = None, score: Callable[[str, str], Column] = T.near_score) -> DataFrame:
    """Exact search, and fuzzy search where it finds few rows. The gate is one small action: it stops at `below` rows. The index's own columns are not sorted along."""
    q = normal_query(query)
    found = exact(indexed, q, keep)
    if len(q) >= FUZZY_LENGTH and found.limit(below).count() < below:
        found = with_fuzzy(found, indexed, q, key, keep, words, score)
    return ordered(found.drop("fields", "combined"), q, sort, views, day, key, seed)


def page(found: DataFrame, number: int = 1, size: int = 48) -> DataFrame:
    """The first `number` pages of ordered rows."""
    return found.limit(number * size)


def sample_rows(rows: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n random rows, or all if there are fewer; a top-n by a random key, not a full sort."""
    return rows.orderBy(F.rand(seed)).limit(n)


def _said(field: str) -> Column:
    return F.lower(F.coalesce(F.col(field), F.lit("")))


def _texts(rows: DataFrame, fields: Sequence[str], **made: Column) -> DataFrame:
    """(said, ...): the different lower-case texts of some fields, the empty one for null, with columns made of them.

    They are written once to the shared folder, so that no filter on what is made moves to before the texts are told apart.
    """
    from scriptorium.plans.session import scratch

    spark, home = rows.sparkSession, scratch(rows.sparkSession)
    said = rows.select(F.explode(F.array(*map(_said, fields))).alias("said")).distinct()
    said.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(f"{home}/texts")
    made_once = spark.read.schema(said.schema).parquet(f"{home}/texts").withColumns(made)
    made_once.write.parquet(f"{home}/made")
    return spark.read.schema(made_once.schema).parquet(f"{home}/made")


def similarities(rows: DataFrame, field: str, query: str, scorers: Sequence[str] = tuple(T.SCORERS)) -> DataFrame:
    """Rows with a column for each scorer of a field; each different text is scored once."""
    scored = _texts(rows, [field], **{s: T.similarity("said", query, s) for s in scorers})
    return rows.join(scored, _said(field) == F.col("said"), "left").drop("said")


def page_search(rows: DataFrame, query: str, fields: Sequence[str], mode: str = "exact", least: int = 70, scorers: Sequence[str] = tuple(T.SCORERS), location: str | None = None, language: str | None = None, n_actors: tuple[float, float] | None = None, key: str = "id") -> DataFrame:
    """The older page's search: exact is 100 for a substring; fuzzy the best scorer of any field. best_field and best_scorer are the row's own."""
    if location:
        rows = rows.where(F.col("location") == location)
    if language:
        rows = rows.where(F.col("languages") == language)
    if n_actors:
        rows = rows.where(F.expr("coalesce(try_cast(main_actors_count as double), 0)").between(*n_actors))
    if mode == "exact":
        tries = [F.struct(F.when(F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(query.lower())), 100.0).otherwise(0.0).alias("score"), F.lit(-i).alias("i"), F.lit(f).alias("field"), F.lit("exact").alias("scorer")) for i, f in enumerate(fields)]
        least = 100
    else:
        # Each different text is scored once for all fields; only those that reach the least score meet the rows.
        best = F.array_max(F.array(*[F.struct(T.similarity("said", query, s).alias("score"), F.lit(-j).alias("j"), F.lit(s).alias("scorer")) for j, s in enumerate(scorers)]))
        near = _texts(rows, fields, _b=best).where(F.col("_b.score") >= least)
        for i, f in enumerate(fields):
            rows = rows.join(near.select(F.col("said").alias(f"_k{i}"), F.col("_b").alias(f"_b{i}")), F.col(f"_k{i}") == _said(f), "left")
        tries = [F.when(F.col(f"_b{i}").isNotNull(), F.struct(F.col(f"_b{i}.score").alias("score"), F.lit(-i).alias("i"), F.lit(f).alias("field"), F.col(f"_b{i}.scorer").alias("scorer"))) for i, f in enumerate(fields)]
    scored = rows.withColumn("_best", F.array_max(F.array(*tries)))
    scored = scored.withColumns({"score": F.col("_best.score"), "best_field": F.col("_best.field"), "best_scorer": F.col("_best.scorer")}).drop("_best", *(f"_{x}{i}" for x in "kb" for i in range(len(fields))))
    return scored.where(F.col("score") >= least).orderBy(F.col("score").desc(), key)


def union_search(branches: Sequence[tuple[str, DataFrame]], link: str, key: str, limit: int = 5) -> DataFrame:
    """Branches of (link, key, score), each cut to its best; of equal links the first branch's stays, then the best by score."""
    parts = [b.orderBy(F.col("score").desc(), key).limit(limit).withColumns({"branch": F.lit(i), "kind": F.lit(name)}) for i, (name, b) in enumerate(branches)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    one = every.withColumn("r", F.row_number().over(Window.partitionBy(link).orderBy("branch", F.col("score").desc(), key))).where("r = 1")
    return one.drop("r").orderBy(F.col("score").desc(), "branch", key).limit(limit)


def bot_search(rows: DataFrame, query: str, kind: str = "all", limit: int = 5, score=T.similarity) -> DataFrame:
    """The older bot's search over titles, texts and main_actors of rows with links; `score` may be any column scorer from 0 to 100."""
    branches = []
    if kind in ("all", "title"):
        branches.append(("title", rows.withColumn("score", score("titles", query)).where("score > 50")))
    if kind in ("all", "text"):
        has = F.contains(F.lower("text"), F.lit(query.lower()))
        branches.append(("text", rows.where(has).withColumn("score", score("text", query)).where("score > 40")))
    if kind in ("all", "actors"):
        branches.append(("actors", rows.withColumn("score", score("main_actors", query)).where("score > 60")))
    cut = [(n, b.select("links", "titles", "main_actors", T.preview("text").alias("text"), "score")) for n, b in branches]
    return union_search(cut, "links", "titles", limit)
