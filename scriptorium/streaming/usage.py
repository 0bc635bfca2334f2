"""The usage log as a stream: micro-batches from landed files to a partitioned table, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.usage import parse


def source(spark: SparkSession, path: str, schema: str, kind: str = "json", files: int = 50) -> DataFrame:
    """Landed request files as a stream, at most so many a batch."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).load(path)


def write_log(requests: DataFrame, path: str, checkpoint: str, seconds: int = 2, once: bool = False) -> StreamingQuery:
    """Parsed events appended to a table by day; the checkpoint makes each batch count once."""
    events = parse(requests).withColumn("day", F.to_date("ts"))
    writer = events.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def windowed(events: DataFrame, stamp: str, key: str, group: str, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Events by window and group, each key once; rows later than the watermark are left to the batch report."""
    timed = events.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late)
    return timed.dropDuplicatesWithinWatermark([key]).groupBy(F.window(stamp, width).alias("w"), group).agg(F.count("*").alias("n"))


def upsert_batches(events: DataFrame, write, checkpoint: str) -> StreamingQuery:
    """Calls write(batch, number) for every micro-batch, for sinks that take rows in transactions."""
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
