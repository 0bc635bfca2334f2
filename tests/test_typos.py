"""Substring distance and the kept gram index against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.distance import WORD, substring_distance
from scriptorium.operators import search
from scriptorium.operators.gram_index import GramIndex


def plain(query, text):
    row = list(range(len(query) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, q in enumerate(query):
            new.append(min(row[j] + (q != c), row[j + 1] + 1, new[-1] + 1))
        row, best = new, min(best, new[-1])
    return best


def edited(rnd, word, n, letters):
    w = list(word)
    for _ in range(n):
        p = rnd.randrange(len(w) + 1)
        kind = rnd.randrange(3)
        if kind == 0:
            w.insert(p, rnd.choice(letters))
        elif p < len(w):
            w[p : p + 1] = [] if kind == 1 else [rnd.choice(letters)]
    return "".join(w)


@pytest.mark.parametrize("n", [1, 2, 5, 9, WORD - 1, WORD, WORD + 1, 90])
def test_distance_equals_a_plain_version(spark, n):
    rnd = random.Random(n)
    letters = "abcdé😀ո"
    q = "".join(rnd.choice(letters) for _ in range(n))
    texts = ["", "a", q, q + q, "zz"] + ["x" * rnd.randrange(4) + edited(rnd, q, rnd.randrange(9), letters) + "y" * rnd.randrange(4) for _ in range(80)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(substring_distance("t", q)).collect()
    assert [r[0] for r in got] == [plain(q, t) for t in texts]


def test_distance_of_nulls_and_of_the_empty_query(spark):
    rows = spark.createDataFrame([(None,), ("abc",)], "t string")
    assert [tuple(r) for r in rows.select(substring_distance("t", "ab"), substring_distance("t", "")).collect()] == [(None, None), (0, 0)]


def vocabulary(rnd, n=400):
    stems = ["tormuz", "մուզիկա", "banana", "catalogue", "aaaa", "xy", "supercalifragilistic"]
    return sorted({edited(rnd, rnd.choice(stems), rnd.randrange(6), "abtmuzո") for _ in range(n)} - {""})


@pytest.mark.parametrize("query", ["torzuz", "tor", "մուզկա", "aaa", "catlogeu", "supercalifagilistic", "bananabananab"])
def test_index_equals_a_scan_of_all_words(spark, tmp_path, query):
    rnd = random.Random(3)
    words = vocabulary(rnd)
    rows = [(k, " ".join(rnd.sample(words, 7)) + " é" * (k % 2)) for k in range(120)]
    indexed = spark.createDataFrame([(k, t) for k, t in rows], "k int, combined string")
    index = GramIndex.build(search.word_index(indexed, "k"), str(tmp_path / "words"), "k", buckets=16)
    every = {w for _, t in rows for w in t.split(" ") if len(w) >= 2}
    near = {w: plain(query, w) / len(query) for w in every if plain(query, w) <= search.FUZZY_MOST * len(query)}
    assert {r.word: r.near for r in index.near(query, search.FUZZY_MOST).collect()} == pytest.approx(near)
    best = {k: min(near[w] for w in t.split(" ") if w in near) for k, t in rows if set(t.split(" ")) & set(near)}
    assert {r.k: r.near for r in index.rows(query, search.FUZZY_MOST).collect()} == pytest.approx(best)
    assert {r.k: r.near for r in search.fuzzy(indexed, query, "k").collect()} == pytest.approx(best)


def test_lists_are_read_pruned(spark, tmp_path):
    rnd = random.Random(4)
    words = spark.createDataFrame([(w, 1) for w in vocabulary(rnd, 3_000)], "word string, k int")
    index = GramIndex.build(words, str(tmp_path / "w"), "k")
    plan = index.near("torzuz", 0.35)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "/words" not in plan  # only grams are read, and of these only some folders
    folders = spark.read.parquet(str(tmp_path / "w" / "grams")).select("size", "bucket").distinct().count()
    read = index.lists("torzuz", 2).select(F.input_file_name()).distinct().count()
    assert 0 < read <= 5 < folders


def test_search_takes_near_rows_from_the_index(spark, tmp_path):
    rows = spark.createDataFrame([("a", "unrelated tormuz here", 1), ("b", "completely different", 2), ("c", "torzuz", 3)], "id string, text string, viewCount long")
    full = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("textCommon", "title", "actorsRaw", "rolesNames", "location", "uploadDate")])
    search.index(full).write.parquet(str(tmp_path / "rows"))
    indexed = spark.read.parquet(str(tmp_path / "rows"))
    words = GramIndex.build(search.word_index(indexed, "id"), str(tmp_path / "words"), "id")
    kept, scanned = (search.search(indexed, "torzuz", words=w).select("id", "score").collect() for w in (words, None))
    assert kept == scanned and [r.id for r in kept] == ["c", "a"]


def test_no_gram_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="leave no gram"):
        GramIndex(spark, str(tmp_path)).candidates("abc", 3)


def test_window_score_takes_the_word_and_windows_of_nearly_the_query_length(spark):
    q = "supplier#000000003"
    words = [q, "supplier#000000310", "supplier#000003000", "sup", "xx" + q + "yy", ""]
    got = spark.createDataFrame([(w,) for w in words], "t string").select(T.window_score("t", q), T.near_score("t", q)).collect()
    lev = lambda a, b: plain_whole(a, b) / len(q)
    for w, (windows, near) in zip(words, got):
        parts = [w] + [w[i : i + n] for n in (len(q) - 1, len(q), len(q) + 1) for i in range(max(len(w) - n + 1, 1))]
        assert windows == min(lev(p, q) for p in parts) >= near
    assert [round(x * len(q)) for x in got[1]] == [3, 2]


def plain_whole(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b):
            new.append(min(row[j] + (d != c), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_gate_scores_by_windows(spark, tmp_path):
    from scriptorium.plans import catalog

    spark.createDataFrame([(3, "Supplier#000000003", 1.0), (310, "Supplier#000000310", 2.0)], "s_suppkey long, s_name string, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    for name in ("search_gate_open", "search_union"):
        got = {r.s_suppkey: r.score for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got.keys() == {3, 310} and got[3] == 4.0 and abs(got[310] - (1 - 3 / 18) * 0.5) < 1e-12


def planned(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_distance_is_taken_once_a_word_and_texts_are_cut_once(spark, tmp_path):
    """The test of the distance stays above the aggregate of a word's grams or rows, and no filter cuts a text beside the explode."""
    rows = spark.createDataFrame([(1, "tormuz tormus"), (2, "tormuz"), (3, ""), (4, None)], "k int, combined string")
    words = search.word_index(rows, "k")
    assert planned(words).count("split(") == 1 and sorted(map(tuple, words.collect())) == [("tormus", 1), ("tormuz", 1), ("tormuz", 2)]
    index = GramIndex.build(words, str(tmp_path / "w"), "k", buckets=4)
    plan = planned(index.near("torzuz", 0.35))
    assert "aggregate(" in plan[: plan.index("Aggregate [")] and "aggregate(" not in plan[plan.index("Aggregate [") :]
    near = planned(search.fuzzy(rows, "torzuz", "k"))
    assert "split(" not in near and "aggregate(" not in near[near.rindex("Aggregate [word") :]
    assert sorted(map(tuple, search.fuzzy(rows, "torzuz", "k").collect())) == [(1, pytest.approx(1 / 6)), (2, pytest.approx(1 / 6))]


def test_grams_of_any_characters(spark):
    """Each place of a word has its gram, whole code points each, as the plain version says."""
    from scriptorium.operators.gram_index import grams

    words = ["a", "ab", "aa\n", "a😀b😀", "եւ😀", "x" * 70, ""]
    for size in (1, 2):
        got = sorted(map(tuple, grams(spark.createDataFrame([(w,) for w in words], "word string"), size).select("word", "n", "gram", "at").collect()))
        assert got == sorted((w, len(w), w[i : i + size], i) for w in words for i in range(len(w) - size + 1))


def test_white_space_and_composition_as_before(spark):
    """Every white space becomes one blank; texts of other characters cross to be composed, wherever in the text they stand."""
    import unicodedata

    texts = [" a  b\t\n c ", " x　 y\u0085", "é a", "a\n" * 3, "", "  ", "ա́", "Å", "ab\nç\n", "kᅡ", None]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.normalize("t").alias("x")).orderBy("i").collect()]
    assert got == [None if t is None else " ".join(unicodedata.normalize("NFC", t.lower()).split()) for t in texts]
