"""Discovery: related rows, names, people and phrases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions import vocab
from scriptorium.operators.phrases import tiles


def related(rows: DataFrame, bridge: DataFrame, target, key: str, value: str, place: str, views: str, other: str | None = vocab.OTHER_PLACE, limit: int = 6) -> DataFrame:
    """Rows related to one: shared values weighted by rarity, and 0.05 for the same place; filled with the most viewed.

    The target's values are few; their frequencies and the rows that share them come from one pass over the bridge.
    """
    mine = bridge.where(F.col(key) == F.lit(target)).select(value).distinct()
    at = rows.where(F.col(key) == F.lit(target)).select(F.col(place).alias("_at")).limit(1)
    shared = bridge.select(key, value).distinct().join(F.broadcast(mine), value)  # one row's values
    freq = shared.groupBy(value).agg(F.count("*").alias("f"))
    weights = shared.join(freq, value).groupBy(key).agg(F.sum(1 / F.col("f")).alias("w"))
    scored = rows.where(F.col(key) != F.lit(target)).join(weights, key, "left").crossJoin(F.broadcast(at))  # one row
    near = F.when((F.col(place) == F.col("_at")) & ((F.col(place) != other) if other is not None else F.lit(True)), 0.05).otherwise(0.0)
    scored = scored.withColumn("score", F.round(F.coalesce("w", F.lit(0.0)) + near, 6)).drop("w", "_at")
    return scored.orderBy((F.col("score") > 0).desc(), F.col("score").desc(), F.coalesce(F.col(views), F.lit(0)).desc(), key).limit(limit)


def find_by_name(rows: DataFrame, name: str, views: str, key: str, actors: Column, roles: Column, spoken: Column, lines: str, text: str, catchphrase: str, suffixes: Sequence[str] = vocab.NAME_SUFFIXES, pattern: str = vocab.ANY_WORD) -> DataFrame:
    """Rows with a name: `actor` if the cast has it, else `mention` with a snippet; nothing for a blank name."""
    n = " ".join(name.lower().split())
    if not n:
        return rows.limit(0).withColumns({"kind": F.lit(""), "snippet": F.lit("")})
    hit = lambda c: T.name_hit(c, n, suffixes, pattern)
    kind = F.when(hit(actors) | hit(roles), "actor").when(hit(spoken), "mention")
    found = rows.withColumn("kind", kind).where(F.col("kind").isNotNull())
    found = found.withColumn("snippet", F.when(F.col("kind") == "mention", T.snippet(lines, text, catchphrase, n, suffixes, pattern)))
    return found.orderBy(F.coalesce(F.col(views), F.lit(0)).desc(), key)


def actor_names(bridge: DataFrame, actor: str) -> DataFrame:
    return bridge.select(actor).distinct().orderBy(actor)


def rows_of_actor(rows: DataFrame, actors: str, name: str) -> DataFrame:
    return rows.where(F.array_contains(actors, name))


def co_stars(bridge: DataFrame, name: str, key: str, actor: str, top: int | None = None) -> DataFrame:
    """How often others share a row with one name."""
    mine = bridge.where(F.col(actor) == name).select(key).distinct()
    n = bridge.select(key, actor).distinct().where(F.col(actor) != name).join(mine, key, "left_semi").groupBy(actor).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), actor)
    return n.limit(top) if top else n


def actor_profile(rows: DataFrame, bridge: DataFrame, name: str, key: str, actor: str, views: str) -> DataFrame:
    """Rows, views and mean views (rounded half up) of one name."""
    own = rows.join(bridge.where(F.col(actor) == name).select(key).distinct(), key, "left_semi")
    v = F.coalesce(F.col(views), F.lit(0))
    return own.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(v).alias("views"), F.floor(F.avg(v) + 0.5).alias("avg_views"))


def catchphrases(rows: DataFrame, phrase: str, order: str, top: int = 4) -> DataFrame:
    """The first non-empty catchphrases in order."""
    return rows.where(F.col(phrase) != "").orderBy(order).limit(top).select(order, phrase)


def phrase_tiles(phrases: DataFrame, phrase: str, docs: DataFrame, text: str, key: str, views: str) -> DataFrame:
    """For each phrase the most viewed document that contains it (the least key of equals); phrases without one are left out.

    All phrases, of any length, are looked for in one reading of the texts.
    """
    return tiles(docs, text, key, views, phrases, phrase)
