"""Tables in versions: a new one lies beside the old, and one small file makes it the current one.

Rows lie in folders by a bucket of their key. A version is a list of folders, one for each bucket, in a numbered file that
a rename puts in place; so a reader sees one version whole, a writer that lost a race gets an error, and an upsert writes
only the buckets that its changes touch and names the old folders for the rest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.relational import upsert

BUCKETS = 64

#: Most changed rows whose keys and digests a refresh broadcasts (some 40 bytes each); how many times the files of its base a derived table may have.
BROADCAST, FILES = 500_000, 4


class Conflict(RuntimeError):
    """Another writer's version came first."""


class Versions:
    """A versioned table under a folder of any file system that Spark writes to. Rows with a null key are in no version."""

    def __init__(self, spark: SparkSession, home: str, key: str, buckets: int = BUCKETS):
        self.spark, self.home, self.key, self.buckets = spark, home.rstrip("/"), key, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.home).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.home}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at) if not f.getPath().getName().startswith(".")) if self._fs.exists(at) else []

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("versions")]

    def version(self, number: int | None = None) -> dict:
        """A version's `number`, `folders` by bucket, `schema`, and the `source` folders that it was derived from; the current one by default, number 0 where there is none."""
        numbers = self.numbers()
        if not numbers:
            return {"number": 0, "folders": {}, "schema": "", "source": {}}
        number = numbers[-1] if number is None else number
        stream = self._fs.open(self._path(f"{self.home}/versions/{number:020}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()) | {"number": number}
        finally:
            stream.close()

    def read(self, number: int | None = None, only: set[str] | None = None) -> DataFrame:
        """The rows of a version, of some buckets only if asked for."""
        v = self.version(number)
        if not v["number"]:
            raise FileNotFoundError(f"{self.home} has no version")
        some = sorted(f for b, f in v["folders"].items() if only is None or b in only)
        return self.spark.read.schema(v["schema"]).parquet(*[f"{self.home}/data/{f}" for f in some]) if some else self.spark.createDataFrame([], v["schema"])

    def bucket(self) -> Column:
        return F.pmod(F.crc32(F.col(self.key).cast("string").cast("binary")), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, deal: bool = True) -> dict[str, str]:
        """Rows into a folder of their own; the folders by bucket. Rows that come from buckets' files need not be dealt, that is shuffled, to lie in few files."""
        attempt = uuid.uuid4().hex
        own = rows.where(F.col(self.key).isNotNull()).withColumn("_bucket", self.bucket())
        (own.hint("rebalance", "_bucket") if deal else own).write.partitionBy("_bucket").parquet(f"{self.home}/data/{attempt}")
        return {n.removeprefix("_bucket="): f"{attempt}/{n}" for n in self._names(f"data/{attempt}") if n.startswith("_bucket=")}

    def _publish(self, number: int, folders: dict[str, str], schema: str, source: dict[str, str] | None = None) -> int:
        """Makes a version the current one, in one step."""
        at = self._path(f"{self.home}/versions/{number:020}.json")
        draft = self._path(f"{self.home}/versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(json.dumps({"folders": folders, "schema": schema, "source": source or {}}).encode())
        finally:
            stream.close()
        if self._fs.exists(at) or not self._fs.rename(draft, at):
            self._fs.delete(draft, False)
            raise Conflict(f"{self.home}: version {number} is there already")
        return number

    @staticmethod
    def _ddl(rows: DataFrame) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def replace(self, rows: DataFrame) -> int:
        """A new version of these rows alone; gives its number."""
        number = self.version()["number"]
        return self._publish(number + 1, self._write(rows), self._ddl(rows))

    def upsert(self, changes: DataFrame, stamp: str, tie: str, before_publish=None) -> int:
        """A new version with the latest row of each key; only the buckets of the changes are read and written. before_publish() runs just before it becomes visible."""
        now = self.version()
        number, folders = now["number"], now["folders"]
        if not number:
            return self.replace(upsert(changes.limit(0), changes, self.key, stamp, tie))
        touched = {str(r.b) for r in changes.where(F.col(self.key).isNotNull()).select(self.bucket().alias("b")).distinct().collect()}  # `buckets` at most
        base = self.read(number, touched)
        new = upsert(base, changes, self.key, stamp, tie)
        written = self._write(new)
        if before_publish:
            before_publish()
        return self._publish(number + 1, {b: f for b, f in folders.items() if b not in touched} | written, self._ddl(new))

    def clean(self, keep: int = 2) -> int:
        """Deletes all but the last versions, and folders that none of these names; gives the number of folders deleted. Not to be run beside a writer."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.home}/versions/{n:020}.json"), False)
        named = {f for n in numbers[-keep:] for f in self.version(n)["folders"].values()}
        gone = 0
        for attempt in self._names("data"):
            own = [f"{attempt}/{n}" for n in self._names(f"data/{attempt}") if n.startswith("_bucket=")]
            stray = [f for f in own if f not in named]
            gone += len(stray)
            for f in [attempt] if len(stray) == len(own) else stray:
                self._fs.delete(self._path(f"{self.home}/data/{f}"), True)
        return gone


def refresh(derived: Versions, base: Versions, columns: list[str], derive: Callable[[DataFrame], DataFrame]) -> int:
    """A new version of a table that is derived from another's current one, row by row; gives its number.

    Derived rows keep a digest of the columns that they came from and the number of the version that made them (`_digest`, `_made`). Only
    buckets whose folder changed are looked at, and of these only rows with a new digest are derived; the others are taken over. Keys and
    digests alone are compared; rows stay where their bucket's files are, unless there are more changes than are broadcast, or so many files that they are dealt anew.
    """
    from scriptorium.plans.session import written

    source, last = base.version(), derived.version()
    folders, held, own = source["folders"], last["folders"], last["number"]
    touched = {b for b, f in folders.items() if last["source"].get(b) != f} | {b for b in held if b not in folders}
    rows = base.read(source["number"], touched).withColumn("_digest", F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))
    on = [base.key, "_digest"]
    new, taken, deal = rows, None, derived.buckets != base.buckets
    if own:
        before = derived.read(own, touched)
        # One row for each that only one side has: bounded by the changes, not by the table.
        sides = rows.select(*on, F.lit(1).alias("_new")).join(before.select(*on, F.lit(1).alias("_old")), on, "full")
        changes = written(sides.where("_new is null or _old is null").withColumn("_digest", F.unhex("_digest")))
        small = changes.count() <= BROADCAST
        only = lambda side: (F.broadcast if small else lambda x: x)(changes.where(f"{side} is not null").select(F.col(base.key).alias("_key"), F.hex("_digest").alias("_was")))
        same = lambda d: (d[base.key] == F.col("_key")) & (d["_digest"] == F.lower("_was"))
        new = rows.join(only("_new"), same(rows), "left_semi")
        taken = before.join(only("_old"), same(before), "left_anti")
        deal = deal or not small or len(before.inputFiles()) > FILES * (len(rows.inputFiles()) + derived.buckets)
    made = derive(new).withColumn("_made", F.lit(own + 1))
    every = made if taken is None else taken.select(*made.columns).unionByName(made)
    return derived._publish(own + 1, {b: f for b, f in held.items() if b not in touched} | derived._write(every, deal), derived._ddl(made), folders)
