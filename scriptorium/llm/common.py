"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bits of filters on ids; more ids than that only let more rows pass on to the join behind.
FILTER_BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow with batches of few rows and bytes, so that a batch of long texts stays small in a worker's memory.

    The settings hold when the plan runs, so of several calls in one plan the last one's count.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return df.mapInArrow(fn, schema)


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, mod n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir if set; one of its own only in local mode, as in tests.

    On a cluster no folder of one machine would do, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(found or f"/tmp/checkpoints/{os.getpid()}")
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept as a table in the shared folder, so that a lost executor costs a read and not a recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Deletes the tables of DataFrames that checkpointed() returned and that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _hash(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FILTER_BITS))


def _bitmap(ids: DataFrame, id_col: str, place: Column | None = None, mark: str = "") -> DataFrame:
    """The bits of the ids' hashes (or places), FILTER_BITS in all, as a table of at most FILTER_BITS / 32768 + 1 rows; `mark` goes before its columns' names."""
    h = ids.where(F.col(id_col).isNotNull()).select((_hash(id_col) if place is None else place).alias("h"))
    return h.groupBy(F.expr("bitmap_bucket_number(h)").alias(f"{mark}_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias(f"{mark}_bits"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that a table does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while any(c.startswith(name) for c in taken):
        name += "_"
    return name


def bits_of(ids: DataFrame, id_col: str = "doc_id", place: Column | None = None) -> np.ndarray:
    """A filter of fixed size on ids: whether some id has a hash, or a place from 0 to FILTER_BITS - 1. Ids that share one
    pass too, so a join must follow."""
    out = np.zeros(FILTER_BITS + 32_768 + 1, bool)
    for r in _bitmap(ids, id_col, place).collect():
        part = np.unpackbits(np.frombuffer(bytes(r._bits), np.uint8), bitorder="little").astype(bool)
        at = (r._bucket - 1) * len(part) + 1 if r._bucket else 0
        out[at : at + len(part)] |= part[: len(out) - at]
    return out[:FILTER_BITS]


def split_by(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """df in two: rows whose id is surely not among ids (null ids too), and rows whose id may be. No row of df is shuffled."""
    m = fresh(df, "_met")
    bitmap = F.broadcast(_bitmap(ids, id_col, mark=m))  # of fixed size
    keyed = df.withColumn(f"{m}_h", _hash(id_col)).withColumn(f"{m}_bucket", F.expr(f"bitmap_bucket_number({m}_h)")).withColumn(f"{m}_place", F.expr(f"bitmap_bit_position({m}_h)"))
    met = keyed.join(bitmap, f"{m}_bucket", "left")
    byte = f"cast(conv(hex(substring({m}_bits, cast({m}_place div 8 as int) + 1, 1)), 16, 10) as int)"
    marked = met.withColumn(f"{m}_may", F.expr(f"coalesce((shiftright({byte}, cast({m}_place % 8 as int)) & 1) = 1, false)"))
    return marked.where(f"not {m}_may").select(*df.columns), marked.where(f"{m}_may").select(*df.columns)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A text column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]
