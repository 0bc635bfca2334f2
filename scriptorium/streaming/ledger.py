"""Exactly-once ingest: every micro-batch lands in two tables, the log and the quarantine, that become visible together.

A batch's rows are written beside the tables' own, in folders of the attempt's own name; then one file in the ledger, put
in place by a rename, names the folders. Readers read only folders that the ledger names, so a batch is in both tables or
in neither. A batch that the ledger has is not written again; one that failed before is, and the folders of the failed
attempt are nobody's. Event ids go on from the ledger's last one, so a replay never gives an id twice.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.usage import AGENT, classified

LOG = "id long, ts timestamp, session_id string, type string, query string, mode string, filters string, result_count int, sketch_id string, source string, ua string, request string, batch long"
QUARANTINE = "request string, body string, status string, ua string, ts timestamp, batch long"


@dataclass(frozen=True)
class Commit:
    """A batch of the ledger: its number, folders by table, first free event id, and rows by table."""

    batch: int
    folders: dict[str, str]
    next_id: int
    rows: dict[str, int]


class Ledger:
    """The ledger and its tables under a folder of any file system that Spark writes to. One stream writes at a time."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.home).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.home}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.home}/{name}"))
        try:
            return bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def commits(self) -> list[Commit]:
        """The batches in order; each is one small file."""
        return [Commit(**json.loads(self._text(f"ledger/{n}"))) for n in self._names("ledger") if n.endswith(".json")]

    def has(self, batch: int) -> bool:
        return self._fs.exists(self._path(f"{self.home}/ledger/{batch:020}.json"))

    def last(self) -> Commit | None:
        names = [n for n in self._names("ledger") if n.endswith(".json")]
        return Commit(**json.loads(self._text(f"ledger/{names[-1]}"))) if names else None

    def commit(self, c: Commit) -> None:
        """Puts a batch's file in place; a rename is one step."""
        at = self._path(f"{self.home}/ledger/{c.batch:020}.json")
        if self._fs.exists(at):
            raise ValueError(f"batch {c.batch} is in the ledger already")
        draft = self._path(f"{self.home}/ledger/.{c.batch}-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(json.dumps(c.__dict__).encode())
        finally:
            stream.close()
        if not self._fs.rename(draft, at):
            raise OSError(f"batch {c.batch} could not be put into the ledger")

    def table(self, name: str) -> DataFrame:
        """The committed rows of `log` or `quarantine`."""
        schema = {"log": LOG, "quarantine": QUARANTINE}[name]
        paths = [f"{self.home}/{c.folders[name]}" for c in self.commits() if c.rows[name]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def sweep(self) -> int:
        """Deletes folders of attempts that no batch names; gives their number. Not to be run beside a writing stream."""
        named = {f for c in self.commits() for f in c.folders.values()}
        stray = [f"{t}/{n}" for t in ("log", "quarantine", "draft") for n in self._names(t) if f"{t}/{n}" not in named]
        for f in stray:
            self._fs.delete(self._path(f"{self.home}/{f}"), True)
        return len(stray)


def take(requests: DataFrame, batch: int, ledger: Ledger, request: str = "request", body: str = "body", agent: str = "ua", before_commit=None) -> None:
    """One micro-batch into the log and the quarantine; nothing if the ledger has it. before_commit() runs between writing and committing."""
    if ledger.has(batch):
        return
    spark, home, attempt = requests.sparkSession, ledger.home, f"{batch:020}-{uuid.uuid4().hex}"
    last = ledger.last()
    first = last.next_id if last else 1
    sorted_out = classified(requests.select(F.col(request).cast("string").alias("request"), F.col(body).alias("body"), F.substring(agent, 1, AGENT).alias("ua")), "body")
    # A draft settles what each task has, so that ids can follow each other without gaps.
    now = F.current_timestamp()
    sorted_out.select("request", "body", "ua", "status", "events", now.alias("ts"), F.lit(batch).cast("long").alias("batch"), F.spark_partition_id().alias("part")).write.parquet(f"{home}/draft/{attempt}")
    draft = spark.read.parquet(f"{home}/draft/{attempt}")
    bad = draft.where("status in ('broken', 'failed')").select("request", "body", "status", "ua", "ts", "batch")
    bad.write.parquet(f"{home}/quarantine/{attempt}")
    events = draft.where("status = 'kept'").select("part", "request", "batch", "ts", "ua", F.posexplode("events").alias("at", "e"))
    counts = {r.part: r.n for r in events.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one number a task
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = first + total, total + counts[part]
    if counts:
        from pyspark.sql import Window

        offsets = spark.createDataFrame(sorted(before.items()), "part int, before long")
        place = F.row_number().over(Window.partitionBy("part").orderBy("request", "at", F.xxhash64("e"))) - 1
        numbered = events.join(F.broadcast(offsets), "part").withColumn("id", F.col("before") + place)  # one row a task
        numbered.select("id", "ts", "e.*", "ua", "request", "batch").write.parquet(f"{home}/log/{attempt}")
    if before_commit:
        before_commit()
    states = {r.status: r.n for r in draft.groupBy("status").agg(F.count("*").alias("n")).collect()}
    rows = {"log": total, "quarantine": states.get("broken", 0) + states.get("failed", 0), "requests": sum(states.values())}
    ledger.commit(Commit(batch, {"log": f"log/{attempt}", "quarantine": f"quarantine/{attempt}"}, first + total, rows))
    ledger._fs.delete(ledger._path(f"{home}/draft/{attempt}"), True)


def ingest(requests: DataFrame, ledger: Ledger, before_commit=None, **columns: str) -> StreamingQuery:
    """A stream of requests into the ledger's tables, run to the end of what there is. Its own checkpoint lies beside them."""
    step = lambda rows, n: take(rows, n, ledger, before_commit=before_commit, **columns)
    return requests.writeStream.foreachBatch(step).option("checkpointLocation", f"{ledger.home}/checkpoint").trigger(availableNow=True).start()
