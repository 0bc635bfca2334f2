"""Many phrases in one pass, and the related rows of all rows, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import discover, kin, phrases, stats


def words_of(rnd, n, letters):
    return sorted({"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 12))) for _ in range(n)})


@pytest.mark.parametrize(("beginning", "stretch", "letters"), [(64, 2_048, "ab"), (3, 7, "abcé😀"), (5, 100, "abcdեֆ")])
def test_automaton_equals_contains(monkeypatch, beginning, stretch, letters):
    monkeypatch.setattr(phrases, "BEGINNING", beginning)
    monkeypatch.setattr(phrases, "STRETCH", stretch)
    rnd = random.Random(1)
    wanted = words_of(rnd, 300, letters)
    texts = ["", letters[0], *("".join(rnd.choice(letters + "z\n") for _ in range(rnd.randrange(400))) for _ in range(60))]
    of, held = phrases.Automaton(wanted).pairs(texts)
    assert sorted(zip(of.tolist(), held.tolist())) == [(i, k) for i, t in enumerate(texts) for k, p in enumerate(wanted) if p in t]


def test_ten_thousand_phrases(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CELLS", 60_000)  # many blocks
    monkeypatch.setattr(phrases, "ROUND", 40_000)  # and several rounds
    rnd = random.Random(2)
    wanted = words_of(rnd, 16_000, "abcdefgh") + ["a" * 70 + x for x in "bcd"]
    texts = [(k, "".join(rnd.choice("abcdefgh ") for _ in range(300)) + rnd.choice(["", "x" + "a" * 71 + "c"]), k % 7) for k in range(40)] + [(99, None, 1), (98, "", 1)]
    assert len(wanted) > 10_000
    docs = spark.createDataFrame(texts, "k int, t string, v int").repartition(3)
    asked = spark.createDataFrame([(p,) for p in [*wanted, "", None, "a"]], "p string")
    got = sorted(map(tuple, phrases.held(docs, "t", "k", asked, "p").collect()))
    assert got == sorted((p, k) for p in {*wanted, "a"} for k, t, _ in texts if t and p in t)
    best = {p: max(((v, -k) for k, t, v in texts if t and p in t), default=None) for p in wanted}
    tiles = {r.phrase: (r.views, -r.key) for r in phrases.tiles(docs, "t", "k", "v", asked, "p").collect()}
    assert {p: x for p, x in tiles.items() if p != "a"} == {p: x for p, x in best.items() if x and p != "a"}


def test_no_phrases_and_no_texts(spark):
    docs, none = spark.createDataFrame([("a", "some text", 1)], "k string, t string, v int"), spark.createDataFrame([], "p string")
    assert phrases.held(docs, "t", "k", none, "p").collect() == [] == phrases.tiles(docs, "t", "k", "v", none, "p").collect()
    assert phrases.held(docs.limit(0), "t", "k", spark.createDataFrame([("x",)], "p string"), "p").collect() == []


def test_mentions_of_many_names(spark):
    docs = spark.createDataFrame([("անին եկավ Անի",), ("անիի ու արմենը",), ("բանի",), (None,)], "t string")
    names = spark.createDataFrame([("Անի",), ("Արմեն",), ("Գագո",)], "name string")
    ends = ("", "ն", "ի", "ը")
    got = {r.name: r.n for r in phrases.mentions(docs, T.words("t"), names, "name", ends).collect()}
    slow = {r.name: r.n for r in stats.name_mentions(docs, F.col("t"), ["Անի", "Արմեն", "Գագո"], ends).collect()}
    assert got == slow == {"Անի": 2, "Արմեն": 1, "Գագո": 0}


def cast(rnd, n):
    """Rows of which many have the same two leads only, some a guest, some none."""
    leads, guests, places = ["H", "M"], [f"g{i}" for i in range(12)], ["home", "street", "other", None]
    rows, bridge = [], []
    for k in range(n):
        rows.append((f"r{k:02}", rnd.choice(places), rnd.choice([0, 5, 5, 70, None])))
        who = set(rnd.choice([[], leads, leads, leads[:1]])) | set(rnd.sample(guests, rnd.choice([0, 0, 1, 2])))
        bridge += [(f"r{k:02}", a) for a in who]
    return rows, bridge


@pytest.mark.parametrize(("hub", "block"), [(1_000, 4_096), (6, 3), (0, 2), (2, 1)])
def test_all_rows_at_once_equal_one_by_one(spark, hub, block):
    rows, bridge = cast(random.Random(7), 40)
    r = spark.createDataFrame([*rows], "id string, place string, v long")
    b = spark.createDataFrame(bridge + bridge[:5], "id string, actor string")
    got = {}
    for x in kin.related_every(r, b, "id", "actor", "place", "v", other="other", limit=4, hub=hub, block=block).collect():
        got.setdefault(x.id, {})[x.rank] = (x.other, x.score)
    f = {}
    for i, a in set(bridge):
        f.setdefault(a, set()).add(i)
    for i, at, _ in rows:
        mine = []
        for j, at2, v2 in rows:
            if i != j:
                s = sum(1 / len(f[a]) for a in sorted(f) if i in f[a] and j in f[a]) + (0.05 if at == at2 and at not in (None, "other") else 0)
                mine.append((-round(s, 6), -(v2 or 0), j))
        assert [got[i][n] for n in (1, 2, 3, 4)] == [(j, -s) for s, _, j in sorted(mine)[:4]], i


def test_all_rows_equal_related(spark):
    rows, bridge = cast(random.Random(8), 25)
    r, b = spark.createDataFrame(rows, "id string, place string, v long"), spark.createDataFrame(bridge, "id string, actor string")
    every = kin.related_every(r, b, "id", "actor", "place", "v", other="other", hub=3).collect()
    for target in ("r00", "r07", "r19"):
        one = discover.related(r, b, target, "id", "actor", "place", "v", other="other").collect()
        assert [(x.id, x.score) for x in one] == [(x.other, x.score) for x in sorted((x for x in every if x.id == target), key=lambda x: x.rank)]


def test_rare_guests_come_before_leads_and_loners_are_filled(spark):
    rows = [("t", "x", 0), ("rare", "x2", 1), ("duo", "x3", 9_000_000), *((f"d{i}", "x4", 1000) for i in range(20)), ("lonely", None, 3)]
    bridge = [("t", "H"), ("t", "M"), ("t", "A"), ("rare", "A"), *((k, a) for k in ["duo", *(f"d{i}" for i in range(20))] for a in "HM")]
    got = kin.related_every(spark.createDataFrame(rows, "id string, place string, v long"), spark.createDataFrame(bridge, "id string, actor string"), "id", "actor", "place", "v", hub=5).collect()
    of = lambda k: [x.other for x in sorted((x for x in got if x.id == k), key=lambda x: x.rank)]
    assert of("t")[:2] == ["rare", "duo"] and len(of("lonely")) == 6 and of("lonely")[0] == "duo"


def test_related_of_few_rows(spark):
    r = spark.createDataFrame([("a", None, None), (None, "p", 1)], "id string, place string, v long")
    b = spark.createDataFrame([], "id string, actor string")
    assert kin.related_every(r, b, "id", "actor", "place", "v").collect() == []


@pytest.mark.parametrize("size", [1, 7, 1_000_000])
def test_only_pairs_that_may_be_among_the_best_are_scored(size):
    import pyarrow as pa

    rnd = random.Random(9)
    people, values, w = list(range(40)), [rnd.sample(range(40), 6) for _ in range(90)], [rnd.choice([0.1, 0.2, 0.25]) for _ in range(90)]
    place, hub = {k: rnd.choice("xyz") for k in people}, {k: rnd.choice([0, 0.04, 0.3]) for k in people}
    told = [(k, w[i], [x for x in v if place[x] == place[k]], [x for x in v if place[x] != place[k]]) for i, v in enumerate(values) for k in v] + [(k, h, None, None) for k, h in hub.items()]
    told.sort(key=lambda x: x[0])
    many = pa.list_(pa.int64())
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told[a : a + 50]), (pa.int64(), pa.float64(), many, many))], ["k", "w", "same", "rest"]) for a in range(0, len(told), 50)]
    got = {(k, s): x for b in kin._near(3, size)(batches) for k, s, x in zip(*(b.column(c).to_pylist() for c in ("k", "s", "w")))}
    shared = {(k, s): sum(x for x, v in zip(w, values) if k in v and s in v) for k in people for s in people if k != s and any(k in v and s in v for v in values)}
    for k in people:
        least = {s: x + kin.PLACE * (place[k] == place[s]) for (j, s), x in shared.items() if j == k}
        bound = sorted(least.values())[-3]
        want = {s for s, x in least.items() if x + hub[k] >= bound - 2e-6}
        assert {s for j, s in got if j == k} == want and all(abs(got[k, s] - shared[k, s]) < 1e-9 for s in want)
    assert len(got) < len(shared)


def test_states_are_asked_once_a_text(monkeypatch):
    """A text that repeats itself costs its steps, not its hits: what ends at a state is looked up once for each text and state."""
    asked = []
    a = phrases.Automaton(["a", "aa", "b", "ab", "x" * 70])
    chains = a._chains
    monkeypatch.setattr(a, "_chains", lambda keys, n: asked.append(len(keys)) or chains(keys, n))
    of, held = a.pairs(["ab" * 20_000, "x" * 5_000, "zz"])
    assert list(zip(of.tolist(), held.tolist())) == [(0, 0), (0, 2), (0, 3), (1, 4)]
    assert sum(asked) < 200


def test_phrases_and_pairs_are_made_once(spark):
    """Phrases that come from a long way are written once; a text is cut into pairs of words once."""
    made = stats.bigram_counts(spark.createDataFrame([("one two three",), ("one",), ("",), (None,), ("a two one two",)], "t string"), F.col("t"), pattern="[a-z]+", stop=(), top=None)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert sorted(map(tuple, made.collect())) == [("one two", 2), ("two one", 1), ("two three", 1)]
    calls = spark.sparkContext.accumulator(0)
    slow = F.udf(lambda x: (calls.add(1), x)[1], "string").asNondeterministic()
    assert [p for some in phrases.rounds(spark.createDataFrame([("p",)], "p string").select(slow("p").alias("p")), "p") for p in some] == ["p"]
    assert calls.value == 1
