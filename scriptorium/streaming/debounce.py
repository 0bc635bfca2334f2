"""Debounced events of a stream: those after which their session was quiet, held in state until that is sure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The state store that keeps runs of events outside of the executors' memory.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def debounced(events: DataFrame, session: str, stamp: str, key: str, seconds: float = 1.0, late: str = "10 minutes") -> DataFrame:
    """(session, ts, id) of the events of a stream after which their session was quiet, each once, as the batch report settled() finds
    them in order of time and id.

    Events nearer to each other than the gap make a run, of which the last one is followed by quiet; a run's state is one row, whatever
    its events. It goes out once the watermark has passed its last event by the gap, as then every event that might go on with it has come.
    Rows that the watermark has passed by the gap when they come are left out; repeated rows of one time and id are one.
    """
    rows = events.select(F.col(session).cast("string").alias("session"), F.col(stamp).cast("timestamp").alias("at"), F.col(key).cast("long").alias("id"))
    # Windows that touch are one, and an event a whole gap later is not of the run: so they end a microsecond before that.
    run = F.session_window("at", f"{int(seconds * 1_000_000) - 1} microseconds")
    out = rows.withWatermark("at", late).groupBy("session", run).agg(F.max(F.struct("at", "id")).alias("last"))
    return out.select("session", F.col("last.at").alias("ts"), "last.id")


def with_timers(spark: SparkSession) -> dict[str, str | None]:
    """Turns the state store outside of memory on, and gives the settings before for restoring."""
    before = {"spark.sql.streaming.stateStore.providerClass": spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return before


def restore(spark: SparkSession, before: dict[str, str | None]) -> None:
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
