"""Requests in one of four states, exactly-once ingest, debounced events and visits as streams, against plain versions."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import usage
from scriptorium.streaming import debounce, ledger

BODIES = {
    '{"type":"open","sketchId":"a","resultCount":5}': ("kept", 1), "[1,2]": ("kept", 2), '{"query":"a"} trailing': ("broken", 0), "5": ("kept", 1), "null": ("failed", 0), "": ("broken", 0), "[]": ("empty", 0),
    "[null]": ("failed", 0), "{'a':1}": ("broken", 0), "1],[2": ("broken", 0), "1}, {2": ("broken", 0), "1,2": ("broken", 0), ' \n {"sessionId": 7} ': ("kept", 1), "[1,]": ("broken", 0), '{"a":1': ("broken", 0),
    '{"resultCount":"many"}': ("failed", 0), '{"resultCount":1.5}': ("failed", 0), '{"resultCount":3000000000}': ("failed", 0), '[{"type":"a"},{"resultCount":true}]': ("failed", 0), '"text"': ("kept", 1), "[[1]]": ("kept", 1), "no json": ("broken", 0),
    json.dumps([{"type": "x"}] * 60): ("kept", 50), json.dumps([{"type": "x"}] * 50 + [None]): ("kept", 50), '["{\\"type\\":\\"x\\"}"]': ("kept", 1),
}


def test_every_request_has_a_state(spark):
    rows = spark.createDataFrame([*((i, b, "u" * 300) for i, b in enumerate(BODIES)), (99, None, None)], "i int, body string, ua string")
    got = {r.i: (r.status, len(r.events or [])) for r in usage.classified(rows).collect()}
    assert got == dict(enumerate(BODIES.values())) | {99: ("broken", 0)}
    assert usage.parse(rows).count() == sum(n for _, n in BODIES.values())
    assert usage.broken(rows).count() == 1 + sum(s in ("broken", "failed") for s, _ in BODIES.values())
    assert {len(r.ua) for r in usage.parse(rows).collect()} == {200}


def test_events_have_defaults(spark):
    rows = spark.createDataFrame([('[{"sessionId":null,"type":null,"filters":{"location":["x"]},"resultCount":"12"},{"filters":"","type":""},7,{"filters":0,"resultCount":5.0,"sketchId":9}]', "u")], "body string, ua string")
    got = [(e.session_id, e.type, e.filters, e.result_count, e.sketch_id) for e in usage.parse(rows).collect()]
    assert got == [("", "unknown", '{"location":["x"]}', 12, None), ("", "", None, None, None), ("", "unknown", None, None, None), ("", "unknown", None, 5, "9")]


def land(folder, name, bodies):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps({"request": f"{name}-{i}", "body": b, "ua": "x"}) + "\n" for i, b in enumerate(bodies)))


def requests(spark, folder):
    return spark.readStream.schema("request string, body string, ua string").option("maxFilesPerTrigger", 1).json(str(folder))


def told(books):
    return sorted((r.request, r.id) for r in books.table("log").collect()), sorted(r.request for r in books.table("quarantine").collect())


def test_each_request_lands_once_despite_failures(spark, tmp_path):
    folder = tmp_path / "in"
    for k in range(3):
        land(folder, k, ['{"type":"open"}', "broken", '[{"type":"a"},{"type":"b"}]'])
    books = ledger.Ledger(spark, str(tmp_path / "out"))
    seen = []

    def fail_in_the_second():
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("lost between writing and committing")

    with pytest.raises(Exception, match="lost between"):
        ledger.ingest(requests(spark, folder), books, before_commit=fail_in_the_second).awaitTermination()
    assert [c.batch for c in books.commits()] == [0] and books.table("log").count() == 3  # nothing of the second is seen
    ledger.ingest(requests(spark, folder), books).awaitTermination()
    log, bad = told(books)
    wanted = sorted(f"{k}-{i}" for k in range(3) for i in (0, 2, 2))
    assert [r for r, _ in log] == wanted and sorted(i for _, i in log) == list(range(1, 10)) and bad == ["0-1", "1-1", "2-1"]
    assert books.sweep() > 0 and told(books) == (log, bad)  # the failed attempt's folders are nobody's
    land(folder, 3, ['{"type":"late"}'])
    ledger.ingest(requests(spark, folder), books).awaitTermination()
    assert told(books)[0][: len(log)] == log and max(i for _, i in told(books)[0]) == 10
    assert [(c.rows["requests"], c.rows["quarantine"]) for c in books.commits()] == [(3, 1)] * 3 + [(1, 0)]


def test_a_committed_batch_is_not_written_again(spark, tmp_path):
    books = ledger.Ledger(spark, str(tmp_path))
    rows = spark.createDataFrame([("r1", '{"type":"open"}', "u"), ("r2", "broken", None), ("r3", "[]", None)], "request string, body string, ua string")
    for _ in range(2):
        ledger.take(rows, 7, books)
    assert told(books) == ([("r1", 1)], ["r2"])
    with pytest.raises(ValueError, match="already"):
        books.commit(books.last())
    ledger.take(rows.where("request = 'r3'"), 8, books)
    ledger.take(rows.limit(0), 9, books)
    assert told(books) == ([("r1", 1)], ["r2"]) and books.last().next_id == 2


START = datetime(2024, 5, 1, tzinfo=timezone.utc)


def write(spark, rows, path):
    spark.createDataFrame([(i, s, START + timedelta(seconds=t)) for i, s, t in rows], "id long, s string, ts timestamp").coalesce(1).write.mode("append").parquet(path)


def run(spark, source, out, state):
    stream = spark.readStream.schema("id long, s string, ts timestamp").parquet(source)
    before = debounce.with_timers(spark)
    try:
        debounce.debounced(stream, "s", "ts", "id", 60, "100 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        debounce.restore(spark, before)


def quiet(rows, until):
    """Plain: events that nothing of their session follows within a minute, decided before a time."""
    out = set()
    for s in {r[1] for r in rows}:
        own = sorted({(t, i) for i, x, t in rows if x == s})
        out |= {i for k, (t, i) in enumerate(own) if (k + 1 == len(own) or own[k + 1][0] - t >= 60) and t + 60 <= until}
    return out


def test_debounce_as_a_stream_with_late_rows_and_a_restart(spark, tmp_path):
    rnd = random.Random(3)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    first = [(i, f"s{rnd.randrange(4)}", rnd.randrange(2_000)) for i in range(150)] + [(150, "s0", 2_000)]
    write(spark, first, source)
    run(spark, source, out, state)
    got = lambda: [r.id for r in spark.read.parquet(out).collect()]
    assert sorted(got()) == sorted(quiet(first, 1_900))
    # A second run goes on with the state: rows that are late but within the delay count, later ones don't, an old row again counts once.
    more = [(200 + i, f"s{rnd.randrange(4)}", 1_905 + rnd.randrange(1_500)) for i in range(80)] + [(150, "s0", 2_000), (300, "new", 3_500), (301, "s1", 3_600)]
    write(spark, [*more, (400, "s2", 30)], source)
    run(spark, source, out, state)
    every = got()
    assert len(every) == len(set(every)) and set(every) == quiet(first + more, 3_500)


def test_visits_count_an_item_once(spark):
    minute = lambda m: START + timedelta(minutes=m)
    rows = [("a", minute(0), "x"), ("a", minute(10), "x"), ("a", minute(20), "y"), ("a", minute(51), "x"), ("a", minute(81), None), ("b", minute(5), "x"), ("anon", minute(0), "z")]
    e = spark.createDataFrame(rows, "s string, ts timestamp, item string")
    got = sorted(usage.visits(e, "s", "ts", F.col("item"), "30 minutes").collect())
    assert [(r.s, r.n_events, r["items"]) for r in got] == [("a", 3, ["x", "y"]), ("a", 2, ["x"]), ("anon", 1, ["z"]), ("b", 1, ["x"])]
    sessions = spark.createDataFrame([("s1",), ("",), (None,)], "s string").select(usage.session_of("s").alias("s")).collect()
    assert [r.s for r in sessions] == ["s1", "anon", "anon"]


def test_visits_as_a_stream_equal_the_batch(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, f"s{rnd.randrange(3)}", rnd.randrange(40_000)) for i in range(120)]
    write(spark, rows, str(tmp_path / "in"))
    write(spark, [(i, s, 40_000 + t) for i, s, t in rows], str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, s string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "12 hours")
    usage.visits(stream, "s", "ts", F.col("id") % 5, "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    batch = usage.visits(spark.read.parquet(str(tmp_path / "in")), "s", "ts", F.col("id") % 5, "10 minutes")
    end = START + timedelta(seconds=max(t for *_, t in rows) + 40_000) - timedelta(hours=12)
    got, wanted = (sorted((r.s, r.start, r.stop, r.n_events, r["items"]) for r in d.collect()) for d in (spark.read.parquet(str(tmp_path / "out")), batch.where(F.col("stop") <= F.lit(end))))
    assert got == wanted and got


def test_debounce_at_the_gap_itself(spark, tmp_path):
    """An event a whole gap later leaves quiet, one a microsecond sooner does not; of one time the largest id is last. State is a row for each run, by built-in functions."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = [(1, "a", 0), (2, "a", 60), (3, "b", 0), (4, "b", 59.999999), (5, "c", 7), (6, "c", 7), (7, None, 5), (8, None, 6), (9, "z", 1_000)]
    write(spark, rows, source)
    run(spark, source, out, state)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 4, 6, 8]
    stream = spark.readStream.schema("id long, s string, ts timestamp").parquet(source)
    assert "session_window" in debounce.debounced(stream, "s", "ts", "id", 60, "100 seconds")._jdf.queryExecution().analyzed().toString()
