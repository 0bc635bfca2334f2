"""Joins, upserts and deduplication of the ingest layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.ranges import placed


def enrich(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left join that takes some columns; several matches fan out. The optimizer broadcasts the right side if its size allows."""
    return left.join(right.select(key, *columns), key, "left")


def checked_key(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows with a derived key; a null key fails the query with a message, in the same pass."""
    return rows.withColumn(name, F.when(key.isNotNull(), key).otherwise(F.raise_error(F.lit(f"{name}: a row has no key")).cast("string")))


def missing_keys(rows: DataFrame, key: str) -> int:
    """How many rows have no key."""
    return rows.agg(F.count_if(F.col(key).isNull())).first()[0]


def todo(seen: DataFrame, done: DataFrame, key: str, order: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows that aren't done yet."""
    rest = seen.join(done.select(key).distinct(), key, "left_anti")
    if order:
        rest = rest.orderBy(order)
    return rest.limit(limit) if limit is not None else rest


def picks(rows: DataFrame, wanted: Sequence[str], key: str, sequence: str) -> DataFrame:
    """Rows whose key or sequence number, as text, is among the wanted; all rows if nothing is wanted."""
    if not wanted:
        return rows
    return rows.where(F.col(key).cast("string").isin(list(wanted)) | F.col(sequence).cast("string").isin(list(wanted)))


def captioned(seen: DataFrame, files: DataFrame, key: str, file: str = "file") -> DataFrame:
    """Rows with `captions`: `kept` where a caption file has the row's id before its language, `none` where only the marker of an
    earlier look without captions has it, `todo` where nothing has."""
    name = F.regexp_extract(file, r"([^/]*)$", 1)
    marker = F.endswith(name, F.lit(".no_captions"))
    at = F.when(marker, F.regexp_extract(name, r"_([A-Za-z0-9_-]{11})\.no_captions$", 1)).otherwise(F.regexp_extract(name, r"_([A-Za-z0-9_-]{11})\.[^.]*\.[^.]*$", 1))
    known = files.select(at.alias(key), marker.alias("_marker")).where(F.col(key) != "").groupBy(key).agg(F.min("_marker").alias("_marker"))
    return seen.join(known, key, "left").withColumn("captions", F.when(F.col("_marker").isNull(), "todo").when(F.col("_marker"), "none").otherwise("kept")).drop("_marker")


def succeeded(rows: DataFrame, error: str) -> DataFrame:
    """Rows without an error; blank and null are none."""
    return rows.where(F.coalesce(F.col(error), F.lit("")) == "")


def available(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Public rows (null is public), with their place from 1 in order."""
    kept = rows.where(F.coalesce(F.col(column), F.lit("public")) == "public")
    return placed(kept, order).withColumn("file_seq", F.col("_place") + 1).drop("_place")


def lookup(rows: DataFrame, names: DataFrame, key: str, value: str, default: str = "") -> DataFrame:
    """A value by key, the default where there is none."""
    return rows.join(names.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def upsert(base: DataFrame, changes: DataFrame, key: str, stamp: str, tie: str) -> DataFrame:
    """The latest row of each key of both tables; the larger tie wins among equal stamps. Whole rows are compared by partial aggregates, so no key's rows are sorted."""
    both = base.unionByName(changes, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, stamp, tie)]
    best = both.groupBy(key).agg(F.max_by(F.struct(stamp, tie, *rest), F.struct(stamp, tie)).alias("r"))
    return best.select(key, "r.*").select(*both.columns)


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.min_by(F.struct(order, *rest), F.col(order)).alias("r")).select(key, "r.*").select(*rows.columns)


def compare(ids: DataFrame, sources: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """A value of several sources side by side, null where a source has none."""
    out = ids.select(key).distinct()
    for name, s in sources.items():
        out = out.join(s.groupBy(key).agg(F.max(value).alias(name)), key, "left")
    return out


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys by where they are: left, right or both."""
    l, r = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return l.join(r, key, "full").groupBy(F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both").alias("where_found")).agg(F.count("*").alias("n"))


def migrate(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of a later schema in its order, missing ones as null text."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])
