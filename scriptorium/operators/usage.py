"""Usage events in batches: normalization and the log's reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import vocab

#: Events of one request; characters of a user agent.
BATCH, AGENT = 50, 200


def _event(e: Column) -> Column:
    """An event of a request's element: a property that it lacks, as any value but an object does, is null."""
    text = lambda name: F.try_variant_get(e, f"$.{name}", "string")
    filters = F.to_json(F.try_variant_get(e, "$.filters", "variant"))
    return F.struct(
        F.coalesce(text("sessionId"), F.lit("")).alias("session_id"), F.coalesce(text("type"), F.lit("unknown")).alias("type"), text("query").alias("query"), text("mode").alias("mode"),
        F.when(~filters.isin('""', "0", "false", "null"), filters).alias("filters"), F.expr("try_cast(null as int)").alias("result_count"), text("resultCount").alias("_count"),
        text("sketchId").alias("sketch_id"), text("source").alias("source"), F.is_variant_null(e).alias("_null"),
    )


_WHOLE = r"^-?\d+(\.0+)?$"


def classified(requests: DataFrame, body: str = "body") -> DataFrame:
    """Requests with `status` and `events`, an array of the first 50, each request in one of four states.

    `kept`: the body is one JSON value; an array's elements are events, anything else is one event. `empty`: an empty array, which
    has none. `broken`: not one JSON value. `failed`: JSON of which an event can't be stored, as it is null or its result
    count is no whole number of 32 bits; the whole request fails, as its events are stored in one transaction. Only kept
    requests have events.
    """
    b = F.col(body)
    value = F.try_parse_json(b)
    # What follows a value is only seen where the value lies inside another.
    inside = F.from_json(F.concat(F.lit('{"v":'), b, F.lit("}")), "v string, beyond string", {"columnNameOfCorruptRecord": "beyond"})
    sound = b.isNotNull() & value.isNotNull() & inside["beyond"].isNull()
    many = F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))
    elements = F.from_json(F.when(many, b).otherwise(F.concat(F.lit("["), b, F.lit("]"))), "array<variant>")
    events = F.transform(F.slice(elements, 1, BATCH), _event)
    with_events = requests.withColumn("_events", F.when(sound, events))
    whole = lambda e: e["_count"].isNull() | (e["_count"].rlike(_WHOLE) & F.regexp_replace(e["_count"], r"\..*", "").try_cast("int").isNotNull())
    fine = F.forall("_events", lambda e: ~e["_null"] & whole(e))
    status = F.when(F.col("_events").isNull(), "broken").when(F.size("_events") == 0, "empty").when(fine, "kept").otherwise("failed")
    done = F.transform("_events", lambda e: e.withField("result_count", F.regexp_replace(e["_count"], r"\..*", "").try_cast("int")).dropFields("_count", "_null"))
    return with_events.withColumn("status", status).withColumn("events", F.when(F.col("status") == "kept", done)).drop("_events")


def parse(requests: DataFrame, body: str = "body", agent: str = "ua", stamp: Column | None = None) -> DataFrame:
    """Request bodies as event rows: at most 50 of a request, defaults for session and type, the agent cut. Requests that are not kept give no rows; see broken()."""
    kept = classified(requests, body).where("status = 'kept'")
    e = kept.select((stamp if stamp is not None else F.current_timestamp()).alias("ts"), F.explode("events").alias("e"), F.substring(agent, 1, AGENT).alias("ua"))
    return e.select("ts", "e.*", "ua")


def broken(requests: DataFrame, body: str = "body") -> DataFrame:
    """Requests that give no events and are not empty: no JSON, or JSON that can't be stored."""
    return classified(requests, body).where("status in ('broken', 'failed')").drop("status", "events")


def session_of(session: str | Column) -> Column:
    """The session's id, `anon` for those that have none."""
    c = F.col(session) if isinstance(session, str) else session
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("anon"))


def visits(events: DataFrame, session: str, stamp: str, item: Column, gap: str = "30 minutes") -> DataFrame:
    """(session, start, stop, n_events, items) of sessions, which end with the first longer gap: `items` are the distinct non-null ones, so that an item opened
    again in a visit counts once. Over a stream with a watermark a session's row comes once, when it can't grow any more."""
    w = F.session_window(F.col(stamp), gap)
    # Bounds as aggregates and not as the key's own, as what a later step asks of a key may be applied to rows before their windows are merged.
    found = events.groupBy(w.alias("w"), session).agg(F.min(stamp).alias("start"), (F.max(stamp) + F.expr(f"interval {gap}")).alias("stop"), F.count("*").alias("n_events"), F.sort_array(F.collect_set(item)).alias("items"))
    return found.select(session, "start", "stop", "n_events", "items")


def known(events: DataFrame, types: Sequence[str] = vocab.EVENT_TYPES) -> DataFrame:
    return events.where(F.col("type").isin(list(types)))


def top_by(events: DataFrame, kind: str, type_col: str, value: str, when: Column | None = None, top: int | None = 30) -> DataFrame:
    """Most frequent values of one type of event; empty ones do not count."""
    e = events.where((F.col(type_col) == kind) & (F.col(value).cast("string") != ""))
    if when is not None:
        e = e.where(when)
    n = e.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), value)
    return n.limit(top) if top else n


def settled(events: DataFrame, session: str, stamp: str, seconds: float = 1.0, ties: Sequence[str] = ()) -> DataFrame:
    """The events after which a session was quiet for so many seconds: what a debounced client would have logged."""
    from pyspark.sql import Window

    following = F.lead(F.col(stamp)).over(Window.partitionBy(session).orderBy(stamp, *ties))
    gap = F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col(stamp).cast("timestamp"))
    return events.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= int(seconds * 1e6))).drop("_gap")
