"""Precomputed statistics. Inputs are rows or bridge tables with named columns; null numbers count as 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions import vocab
from scriptorium.operators.ranges import placed


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def mean_of(c: str) -> Column:
    """Mean over all rows, nulls as 0, rounded half to even."""
    return F.bround(F.avg(zero(c)), 0).cast("long")


def totals(rows: DataFrame, seconds: str, views: str, day: str, bridge: DataFrame | None = None, actor: str = "actor") -> DataFrame:
    """Rows, hours, views, first and last day, and distinct actors if a bridge is given."""
    out = rows.agg(F.count("*").alias("n"), F.bround(F.sum(zero(seconds)) / 3600, 1).alias("hours"), F.sum(zero(views)).alias("views"), F.min(F.nullif(F.col(day).cast("string"), F.lit(""))).alias("first"), F.max(F.nullif(F.col(day).cast("string"), F.lit(""))).alias("last"))
    return out if bridge is None else out.crossJoin(F.broadcast(bridge.agg(F.countDistinct(actor).alias("actors"))))  # one row to one row


def top_counts(bridge: DataFrame, value: str, item: str, top: int = 8) -> DataFrame:
    """Values with most items, an item counted once for a value."""
    return bridge.select(value, item).distinct().groupBy(value).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), value).limit(top)


def means_by(rows: DataFrame, value: str, views: str, least: int = 1, without: Sequence[str] = ()) -> DataFrame:
    """Mean views by value, for values with at least so many rows."""
    kept = rows.where(~F.col(value).isin(list(without))) if without else rows
    return kept.groupBy(value).agg(F.count("*").alias("n"), mean_of(views).alias("avg_views")).where(F.col("n") >= least)


def buckets(rows: DataFrame, value: Column, edges: Sequence[float], labels: Sequence[str], views: str) -> DataFrame:
    """Count and mean by half-open bucket of a value, null as 0; buckets without rows are left out; in order."""
    at = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        at = F.when(F.coalesce(value, F.lit(0)) < edges[i], i).otherwise(at)
    named = F.array(*map(F.lit, labels))
    return rows.select(at.alias("ord"), views).groupBy("ord").agg(F.count("*").alias("n"), mean_of(views).alias("avg_views")).select("ord", F.get(named, F.col("ord")).alias("bucket"), "n", "avg_views")


def histogram(rows: DataFrame, value: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Rows by half-open bin of a value, null as 0; bins without rows have 0. One pass, one row out of it."""
    bounds = [None, *edges, None]
    v = zero(value)
    counts = [F.count_if((F.lit(True) if lo is None else v >= lo) & (F.lit(True) if hi is None else v < hi)) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    one = rows.agg(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(b).alias("bin"), c.alias("n")) for i, (b, c) in enumerate(zip(labels, counts, strict=True))]).alias("x"))
    return one.select(F.inline("x"))


def by_sequence(rows: DataFrame, seq: str, views: str, chunks: int = 8) -> DataFrame:
    """Mean views by stretches of rows in order of their number; stretches have max(1, n // chunks) rows, so there may be one more of them.

    Positions come from ranges with about equal numbers of rows, so no task sorts all rows.
    """
    used = rows.where(F.col(seq).isNotNull() & (F.col(seq) != 0)).select(F.col(seq).alias("seq"), zero(views).alias("views"))
    n = used.count()
    size = max(1, n // chunks)
    placed_ = placed(used, "seq", "views")
    chunk = F.floor(F.col("_place") / size)
    return placed_.groupBy(chunk.alias("chunk")).agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), mean_of("views").alias("avg_views")).select("chunk", F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")).alias("label"), "avg_views")


def top_viewed(rows: DataFrame, views: str, key: str, top: int = 5) -> DataFrame:
    return rows.orderBy(F.col(views).desc_nulls_last(), key).limit(top)


def extremes(rows: DataFrame, value: str, key: str) -> DataFrame:
    """The rows with least and most of a value, null as 0; ties to the lower key."""
    v = zero(value)
    return rows.agg(F.min(F.struct(v.alias("v"), F.col(key).alias("k"), F.col(value).alias("x"))).alias("a"), F.min(F.struct((-v).alias("v"), F.col(key).alias("k"), F.col(value).alias("x"))).alias("b")).select(F.col("a.k").alias("shortest"), F.col("a.x").alias("shortest_value"), F.col("b.k").alias("longest"), F.col("b.x").alias("longest_value"))


def co_occurrence(bridge: DataFrame, value: str, item: str, top: int | None = 7) -> DataFrame:
    """(a, b, n): items that two values share, both ways round, among the values with most items.

    An item's values meet in an array, so a value with very many items costs no more than its rows.
    """
    used = bridge.select(item, value).distinct()
    if top:
        used = used.join(F.broadcast(top_counts(bridge, value, item, top).select(value)), value)
        held = used.groupBy(item).agg(F.array_sort(F.collect_set(value)).alias("vs"))  # at most `top` values
        pairs = held.select(F.explode("vs").alias("a"), "vs").select("a", F.explode("vs").alias("b"))
    else:
        other = used.select(item, F.col(value).alias("b"))
        pairs = used.select(item, F.col(value).alias("a")).join(other, item).select("a", "b")
    return pairs.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def word_counts(rows: DataFrame, text: Column, pattern: str = vocab.ANY_WORD, least: int = 4, stop: Sequence[str] = tuple(vocab.STOP_WORDS), top: int | None = 18) -> DataFrame:
    """The most frequent words of at least so many characters that are not stop words."""
    w = rows.select(F.explode(T.words(text, pattern)).alias("word")).where(F.length("word") >= least)
    if stop:
        w = w.where(~F.col("word").isin(list(stop)))
    n = w.groupBy("word").agg(F.count("*").alias("n"))
    return n.orderBy(F.col("n").desc(), "word").limit(top) if top else n


def bigram_counts(rows: DataFrame, text: Column, pattern: str = vocab.ANY_WORD, least: int = 3, stop: Sequence[str] = tuple(vocab.STOP_WORDS), top: int | None = 12) -> DataFrame:
    """The most frequent pairs of neighbours after one-letter words are dropped; both of at least so many characters and no stop word."""
    w = rows.select(F.filter(T.words(text, pattern), lambda x: F.length(x) > 1).alias("w"))
    # Neither a test of the number of words nor the inner explode, which has one, stands here: either would cut each text again.
    n = F.greatest(F.size("w") - 1, F.lit(0))
    p = w.select(F.explode_outer(F.arrays_zip(F.slice("w", F.lit(1), n).alias("a"), F.slice("w", F.lit(2), n).alias("b"))).alias("p")).select("p.*")
    p = p.where((F.length("a") >= least) & (F.length("b") >= least))
    if stop:
        p = p.where(~F.col("a").isin(list(stop)) & ~F.col("b").isin(list(stop)))
    n = p.groupBy(F.concat_ws(" ", "a", "b").alias("phrase")).agg(F.count("*").alias("n"))
    return n.orderBy(F.col("n").desc(), "phrase").limit(top) if top else n


def composition(rows: DataFrame, actors: str, leads: Sequence[str]) -> DataFrame:
    """Rows by cast: none, one, exactly the leads, or others."""
    a = F.array_sort(F.array_distinct(actors))
    n = F.size(a)
    kind = F.when(n == 0, "uncurated").when(a == F.array(*map(F.lit, sorted(leads))), "duo").when(n == 1, "solo").otherwise("ensemble")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def name_mentions(rows: DataFrame, text: Column, names: Sequence[str], suffixes: Sequence[str] = vocab.NAME_SUFFIXES, pattern: str = vocab.ANY_WORD) -> DataFrame:
    """(name, n): rows that have a word of the name; one pass for all names."""
    counts = F.array(*[F.struct(F.lit(n).alias("name"), F.count_if(T.name_hit(text, n.lower(), suffixes, pattern)).alias("n")) for n in names])
    return rows.agg(counts.alias("x")).select(F.inline("x"))


def name_suggestions(rows: DataFrame, text: Column, candidates: Sequence[str], top: int = 6, **how) -> DataFrame:
    return name_mentions(rows, text, candidates, **how).where("n > 0").orderBy(F.col("n").desc(), "name").limit(top)


def facet_counts(rows: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """(facet, value, n) of several facets in one pass; arrays count each value, blanks do not count."""

    def entries(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))

    return rows.select(F.explode(F.concat(*[entries(n, c) for n, c in facets.items()])).alias("e")).select("e.*").where("value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def hero_figures(rows: DataFrame, text: str, views: str, seconds: str) -> DataFrame:
    """Rows with text, views, and hours rounded half up."""
    return rows.agg(F.count_if(F.col(text) != "").alias("with_text"), F.sum(zero(views)).alias("views"), F.floor(F.sum(zero(seconds)) / 3600 + 0.5).alias("hours"))


def value_counts(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("n"))


def summary(rows: DataFrame, value: str, text: str, number: str) -> DataFrame:
    """Distinct values, rows with text, mean number and the most frequent value (the smallest of equals)."""
    most = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("m")).agg(F.min(F.struct((-F.col("m")).alias("m"), F.col(value).alias("v"))).alias("x"))
    return rows.agg(F.countDistinct(value).alias("n_values"), F.count(text).alias("n_text"), F.avg(number).alias("mean_number")).crossJoin(F.broadcast(most.select(F.col("x.v").alias("mode_value"))))  # one row to one row


def build_stats(rows: DataFrame, leads: Sequence[str], candidates: Sequence[str] = (), pattern: str = vocab.ARCHIVE_WORD, other: str = vocab.OTHER_PLACE) -> dict[str, DataFrame]:
    """All sections over catalogue rows, each a small DataFrame; cache the rows first, as all sections read them."""
    bridge = rows.select("id", F.explode(F.array_distinct("actors")).alias("actor"), "viewCount")
    spoken = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("textCommon", F.lit("")))
    by_views = [250e3, 500e3, 1e6, 2e6]
    return {
        "totals": totals(rows, "durationSec", "viewCount", "uploadDate", bridge),
        "byActorCount": top_counts(bridge, "actor", "id"),
        "byActorAvgViews": means_by(bridge, "actor", "viewCount", least=8).orderBy(F.col("avg_views").desc(), "actor"),
        "byLocationCount": value_counts(rows, "location").orderBy(F.col("n").desc(), "location").limit(8),
        "byLocationAvgViews": means_by(rows, "location", "viewCount", without=[other]).orderBy(F.col("avg_views").desc(), "location"),
        "byDuration": buckets(rows, F.col("durationSec") / 60, [2, 3, 4, 5], ["<2", "2-3", "3-4", "4-5", "5+"], "viewCount"),
        "topViewed": top_viewed(rows.select("id", "title", "viewCount"), "viewCount", "id"),
        "coOccurrence": co_occurrence(bridge, "actor", "id"),
        "topWords": word_counts(rows, spoken, pattern),
        "topPhrases": bigram_counts(rows, spoken, pattern),
        "composition": composition(rows, "actors", leads),
        "viewsHistogram": histogram(rows, "viewCount", by_views, ["<250K", "250-500K", "500K-1M", "1-2M", "2M+"]),
        "viewsBySeq": by_sequence(rows, "seq", "viewCount"),
        "extremes": extremes(rows, "durationSec", "id"),
        "nameSuggestions": name_suggestions(rows, spoken, candidates or ["Անի"], pattern=pattern),
    }
