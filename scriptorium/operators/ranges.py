"""Positions of rows in order, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a row's number within its task in monotonically_increasing_id().
_ROW = 33


def placed(rows: DataFrame, order: str, *ties: str) -> DataFrame:
    """Rows with `_place`, their position from 0 in order of a number and then the ties; null numbers come first.

    Rows are dealt by ranges, sorted within them and written once to the shared folder, each with its task and its place there; a row's position
    is then the rows of all tasks before and its own place. Rows that are alike in number and ties may lie in several ranges.
    """
    from pyspark.sql.types import StructType

    from scriptorium.plans.session import scratch

    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    laid = spread.repartitionByRange(F.col(order).asc_nulls_first(), *ties, "_tie").sortWithinPartitions(F.col(order).asc_nulls_first(), *ties, "_tie")
    at = F.monotonically_increasing_id()
    numbered = laid.withColumn("_part", F.shiftright(at, _ROW).cast("int")).withColumn("_i", at.bitwiseAND(F.lit((1 << _ROW) - 1))).drop("_tie")
    home = scratch(rows.sparkSession)
    numbered.write.parquet(home)
    kept = rows.sparkSession.read.schema(StructType(numbered.schema.fields)).parquet(home)
    counts = kept.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each task
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return kept.join(F.broadcast(before), "_part").withColumn("_place", F.col("_i") + F.col("_before")).drop("_part", "_i", "_before")
