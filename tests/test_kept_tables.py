"""Versioned tables, the clustered log and pages of a random order."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators.ranges import placed
from scriptorium.operators.shuffled import Permutation, in_random_order, random_page
from scriptorium.sources import readers, writers
from scriptorium.sources.versions import Conflict, Versions, refresh

SCHEMA = "k string, v string, stamp int"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def held(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_a_reader_sees_one_version(spark, tmp_path):
    t = Versions(spark, str(tmp_path), "k", buckets=8)
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.upsert(rows(spark, ("a", "1", 1), ("b", "1", 1), ("c", "1", 1), (None, "x", 1)), "stamp", "v") == 1
    before = t.read()
    seen = []
    during = lambda: seen.append((held(before), held(t.read())))
    assert t.upsert(rows(spark, ("a", "2", 2), ("d", "2", 2), ("b", "0", 0)), "stamp", "v", before_publish=during) == 2
    old, new = [("a", "1"), ("b", "1"), ("c", "1")], [("a", "2"), ("b", "1"), ("c", "1"), ("d", "2")]
    assert seen == [(old, old)] and held(before) == old and held(t.read()) == new and held(t.read(1)) == old


def test_a_failed_upsert_changes_nothing_and_a_lost_race_is_an_error(spark, tmp_path):
    t = Versions(spark, str(tmp_path), "k", buckets=4)
    t.replace(rows(spark, ("a", "1", 1)))

    def fail():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        t.upsert(rows(spark, ("a", "2", 2)), "stamp", "v", before_publish=fail)
    assert held(t.read()) == [("a", "1")]
    other = lambda: Versions(spark, str(tmp_path), "k", buckets=4).upsert(rows(spark, ("b", "3", 3)), "stamp", "v")
    with pytest.raises(Conflict):
        t.upsert(rows(spark, ("a", "2", 2)), "stamp", "v", before_publish=other)
    assert held(t.read()) == [("a", "1"), ("b", "3")] and t.numbers() == [1, 2]
    assert t.clean(keep=1) > 0 and held(t.read()) == [("a", "1"), ("b", "3")] and t.numbers() == [2]


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = Versions(spark, str(tmp_path), "k", buckets=32)
    t.replace(rows(spark, *((f"k{i}", "1", 1) for i in range(400))))
    one = t.version()["folders"]
    t.upsert(rows(spark, ("k7", "2", 2)), "stamp", "v")
    two = t.version()["folders"]
    assert sum(one[b] != two[b] for b in one) == 1 and t.read().count() == 400


def test_only_changed_rows_are_derived_anew(spark, tmp_path):
    base, derived = Versions(spark, str(tmp_path / "b"), "k", 4), Versions(spark, str(tmp_path / "d"), "k", 4)
    made = lambda r: r.select("k", F.upper("v").alias("v"), "_digest")
    told = lambda: {r.k: (r.v, r._made) for r in derived.read().collect()}
    base.replace(rows(spark, *((f"k{i}", "a", 1) for i in range(20))))
    assert refresh(derived, base, ["v"], made) == 1 and set(told().values()) == {("A", 1)}
    base.upsert(rows(spark, ("k3", "b", 2), ("k4", "a", 2), ("new", None, 2)), "stamp", "v")
    refresh(derived, base, ["v"], made)
    assert told() == {f"k{i}": ("A", 1) for i in range(20)} | {"k3": ("B", 2), "new": (None, 2)}
    refresh(derived, base, ["v"], made)  # nothing changed
    assert {x for _, x in told().values()} == {1, 2}
    base.replace(rows(spark, ("k3", "b", 2)))
    refresh(derived, base, ["v"], made)
    assert told() == {"k3": ("B", 2)}


def scanned(df):
    """Rows that the scan of a query's files gave, after row groups were skipped."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_type_and_a_session_are_read_in_part(spark, tmp_path):
    n = 40_000
    kind = F.element_at(F.array(*map(F.lit, ("search", "open", "filter", "findname", "copy"))), (F.col("id") % 5 + 1).cast("int"))
    events = spark.range(n).select("id", (F.lit(1_700_000_000) + F.col("id")).cast("timestamp").alias("ts"), kind.alias("type"), F.md5((F.col("id") % 4_000).cast("string")).alias("session_id"), F.md5(F.col("id").cast("string")).alias("sketch_id"))
    writers.clustered_log(events.repartition(4), str(tmp_path / "log"), row_group=64 << 10)
    get = lambda **k: readers.served_log(spark, str(tmp_path / "log"), **k)
    assert get().count() == n
    of_type = get(kinds=["open"])
    assert of_type.count() == n // 5 and scanned(of_type.select("id")) < 0.4 * n
    days = get(kinds=["open", "copy"], since="2023-11-14 22:13:20", until="2023-11-14 23:13:20")
    assert days.count() == 1_440 and scanned(days.select("id")) < 0.3 * n
    sketch = spark.range(1).select(F.md5(F.lit("77"))).first()[0]
    one = get(sketch=sketch)
    assert [r.id for r in one.collect()] == [77] and scanned(one.select("id")) < 0.3 * n
    session = spark.range(1).select(F.md5(F.lit("5"))).first()[0]
    assert get(session=session).count() == n // 4_000 and get(session="none").count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1_009])
def test_permutation_and_its_inverse(spark, n):
    p = Permutation(n, 5)
    places = [p(i) for i in range(n)]
    assert sorted(places) == list(range(n)) and places == [Permutation(n, 5)(i) for i in range(n)]
    back = {r.id: r.x for r in spark.range(n).select("id", p.position("id").alias("x")).collect()}
    assert all(back[place] == i for i, place in enumerate(places))
    if n == 1_009:
        moved = sum(abs(a - b) for a, b in enumerate(places)) / n
        assert 0.28 * n < moved < 0.39 * n and places != [Permutation(n, 6)(i) for i in range(n)]  # a random order moves a third on average


def test_pages_are_disjoint_and_hold_all_rows(spark):
    found = placed(spark.range(130).select((F.col("id") * 3).alias("k")), "k")
    pages = [[(r.slot, r.k) for r in random_page(found, "_place", 130, 9, k).orderBy("slot").collect()] for k in range(4)]
    assert [len(p) for p in pages] == [48, 48, 34, 0] and [s for s, _ in pages[0]] == list(range(48))
    order = [k for p in pages for _, k in p]
    assert sorted(order) == [3 * i for i in range(130)]
    assert order == [r.k for r in in_random_order(found, "_place", 130, 9).collect()]
    assert order != [r.k for r in in_random_order(found, "_place", 130, 10).collect()]


def test_a_refresh_moves_keys_and_digests_only(spark, tmp_path, monkeypatch):
    """Rows are neither shuffled to be compared nor to be written; with more changes than are broadcast, and with repeated keys, the result is the same."""
    from scriptorium.sources import versions

    dealt, write_ = [], Versions._write
    monkeypatch.setattr(Versions, "_write", lambda self, rows, deal=True: dealt.append((self.home[-1], deal, rows._jdf.queryExecution().optimizedPlan().toString())) or write_(self, rows, deal))
    for most in (500_000, 0):
        monkeypatch.setattr(versions, "BROADCAST", most)
        home = tmp_path / str(most)
        base, derived = Versions(spark, str(home / "b"), "k", 4), Versions(spark, str(home / "d"), "k", 4)
        base.replace(rows(spark, *((f"k{i}", "a", 1) for i in range(30)), ("twice", "x", 1), ("twice", "y", 1)))
        made = lambda r: r.select("k", F.upper("v").alias("v"), "_digest")
        refresh(derived, base, ["v"], made)
        base.replace(rows(spark, *((f"k{i}", "b" if i == 3 else "a", 2) for i in range(1, 30)), ("twice", "x", 1), ("twice", "z", 1), ("new", None, 2)))
        refresh(derived, base, ["v"], made)
        told = sorted(((r.k, r.v or "", r._made) for r in derived.read().collect()))
        assert told == sorted([*((f"k{i}", "A", 1) for i in range(1, 30) if i != 3), ("k3", "B", 2), ("new", "", 2), ("twice", "X", 1), ("twice", "Z", 2)])
        last = dealt[-1]
        assert last[:2] == ("d", most == 0) and ("strategy=broadcast" in last[2]) == (most > 0)
    first = [x for x in dealt if x[0] == "d"][0]
    assert not first[1]
