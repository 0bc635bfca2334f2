"""Writers: JSON documents, tables by partition, checkpointed upserts and Markdown reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.relational import upsert


def json_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON, nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def json_document(sections: dict[str, DataFrame], path: str, most: int = 10_000) -> None:
    """Small sections as one JSON document; a section beyond the bound is an error, not a cut."""
    if not sections:
        raise ValueError("no sections")
    out = {}
    for name, df in sections.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name}: more than {most} rows; write it as a table")
        out[name] = [r.asDict(recursive=True) for r in rows]
    spark = next(iter(sections.values())).sparkSession
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)  # any file system that Spark can write to
    try:
        stream.write(json.dumps(out, ensure_ascii=False, default=str).encode("utf-8"))
    finally:
        stream.close()


def by_partition(rows: DataFrame, path: str, *columns: str) -> None:
    """A table in folders by columns; rows of a folder are gathered by size and not by key, so a large one has many files."""
    rows.hint("rebalance", *columns).write.mode("overwrite").partitionBy(*columns).parquet(path)


def transcripts(rows: DataFrame, path: str) -> None:
    by_partition(rows, path, "source_lang")


def event_log(events: DataFrame, path: str) -> None:
    """Events by day; the type is left to file statistics."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def clustered_log(events: DataFrame, path: str, row_group: int = 8 << 20) -> None:
    """The log in order of (type, ts), so that files and their row groups hold few types and short stretches of time, with Bloom
    filters on sessions and sketches, which are spread over all of them. Readers skip row groups by these; see served_log()."""
    laid = events.repartitionByRange("type", "ts").sortWithinPartitions("type", "ts")
    writer = laid.write.mode("errorifexists").option("parquet.block.size", row_group)
    for c in ("session_id", "sketch_id"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{c}", "true")
    # Time stamps have statistics only where they are written as numbers.
    conf, name = events.sparkSession.conf, "spark.sql.parquet.outputTimestampType"
    before = conf.get(name)
    conf.set(name, "TIMESTAMP_MICROS")
    try:
        writer.parquet(path)
    finally:
        conf.set(name, before)


def upsert_table(base_path: str | None, changes: DataFrame, path: str, key: str, stamp: str, tie: str) -> None:
    """The upserted table under a new path, which the caller then names the current one; the old table stays until then."""
    spark = changes.sparkSession
    rows = changes if base_path is None else upsert(spark.read.parquet(base_path), changes, key, stamp, tie)
    rows.write.mode("errorifexists").parquet(path)


def markdown(rows: DataFrame, title: str, most: int = 1_000) -> str:
    """A small table as Markdown."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"{title}: more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([f"## {title}", "", line(rows.columns), line(["---"] * len(rows.columns)), *map(line, got), ""])
