"""The operators on Spark against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scriptorium.llm import bpe, html_blocks, iblt, langid, lsh_forest, mixing, partenum, pst, secrets_crf, toxicity
from scriptorium.llm.common import crc_mod
from scriptorium.llm.components import components

from test_kernels import planted, secrets_and_others


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- 1 secrets


def test_secrets_base_columns(docs_of):
    rows = [(1, 'token = "abcdef123456"'), (2, None), (3, "AKIA" + "Z9" * 10 + " " + "ab" * 15), (3, "AKIA" + "Z9" * 10 + " " + "ab" * 15)]
    d = docs_of(rows)
    got = secrets_crf.scan(d, secrets_crf.fit(d)).orderBy("doc_id").collect()
    assert [(r.n_assign, r.n_access, r.n_hex) for r in got] == [(1, 0, 0), (0, 0, 0), (0, 1, 1), (0, 1, 1)]
    assert got[0].base_sha256 == sha("assign:0:21") and got[1].base_sha256 == sha("") and got[1].spans == ""
    assert got[2].base_sha256 == sha("access:0:24,hex:25:55") and got[2].spans.startswith("access:0:24")


def test_secrets_odd_rows_and_redaction(odd, nothing, docs_of):
    field = secrets_crf.fit(odd)
    assert secrets_crf.scan(odd, field).count() == odd.count()
    assert secrets_crf.scan(nothing, secrets_crf.fit(nothing)).count() == 0
    d = docs_of([(1, "a password=hunter22 b"), (2, None), (3, "clean")])
    got = {r.doc_id: (r.text, r.n_chars, r.node) for r in secrets_crf.redact(d, field).collect()}
    assert got == {1: ("a [SECRET] b", 12, 4), 2: (None, None, 4), 3: ("clean", 5, 4)}


def test_query_finds_planted_secrets(spark, docs_of, tmp_path):
    from scriptorium.llm.queries import op1_secrets_crf

    planted_ = secrets_and_others(9)
    docs_of([*((i, t) for i, (t, _) in enumerate(planted_)), (900, 'a token = "abcdef123456" b'), (901, None)], extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op1_secrets_crf(spark, str(tmp_path)).collect()}
    found = {i: [t[int(a) : int(b)] for k, a, b in (x.split(":") for x in got[i].spans.split(",") if x) if k == "crf"] for i, (t, _) in enumerate(planted_)}
    hits = sum(v in found[i] for i, (_, v) in enumerate(planted_) if v)
    every = sum(map(len, found.values()))
    assert len(got) == 402 and hits > 0.9 * 200 and hits > 0.95 * every and sum(r.n_crf for r in got.values()) == every
    assert got[900].base_sha256 == sha("assign:2:23") and got[900].spans == "assign:2:23"


# --- 2 mixing


def mix_rows():
    rng = random.Random(0)
    return [(i, " ".join(["word"] * rng.randrange(1, 60)) + (" a | b" if i % 3 else ""), rng.choice(["en", "de", None]), rng.choice(["big"] * 8 + ["small", None])) for i in range(600)]


def test_mixing_meets_targets_in_expectation(docs_of):
    got = mixing.sample(docs_of(mix_rows()), budget=0.5).toPandas()
    assert len(got) == 600
    w = got.mix_tokens * got.mix_probability * got.mix_weight
    share = got.groupby(got.source.fillna("(none)")).mix_tokens.sum() / got.mix_tokens.sum()
    want = share**mixing.TEMPER / (share**mixing.TEMPER).sum()
    assert np.allclose((w.groupby(got.source.fillna("(none)")).sum() / w.sum())[want.index], want, atol=1e-6)
    assert (got.mix_tokens * got.mix_probability).sum() == pytest.approx(0.5 * got.mix_tokens.sum(), rel=1e-6)
    assert abs(got.mix_kept.mean() - got.mix_probability.mean()) < 0.08
    assert set(got.columns) >= {"mix_topic", "factor", "h"}


def test_mixing_on_the_cluster_agrees_with_the_driver(docs_of):
    d = docs_of(mix_rows(), extra=False)
    a = mixing.sample(d).select("doc_id", "mix_probability").toPandas().set_index("doc_id").mix_probability
    b = mixing.sample(d, max_cells=0).select("doc_id", "mix_probability").toPandas().set_index("doc_id").mix_probability
    assert np.allclose(a, b[a.index], atol=1e-4)


def test_mixing_keeps_to_the_same_rounds_on_both_paths(spark):
    cells = spark.createDataFrame([("a", "x", "t", 1000), ("a", "y", "t", 1), ("b", "x", "t", 1), ("b", "y", "t", 1000)], "source string, lang string, topic string, tokens long")
    wish = {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.2, "y": 0.8}}
    found = []
    for most in (100, 0):
        with pytest.warns(RuntimeWarning, match="after 2 rounds"):
            found.append({(r.source, r.lang): r.factor for r in mixing.factors(cells, wish, max_cells=most, rounds=2)[0].collect()})
    assert found[0] == pytest.approx(found[1], rel=1e-9)


def plain_mixing(rows, targets, temper, budget):
    """Probability and weight of each row by raking in dictionaries and calibration by bisection; rows of (source, lang, topic, tokens)."""
    cells = Counter()
    for *cell, n in rows:
        cells[tuple(cell)] += n
    total, w = sum(cells.values()), dict(cells)
    wish = []
    for d in range(3):
        own = Counter()
        for c, n in cells.items():
            own[c[d]] += n / total
        given = targets.get(d)
        share = {v: x**temper for v, x in own.items()} if given is None else {v: given.get(v, x) for v, x in own.items()}
        wish.append({v: x / sum(share.values()) * total for v, x in share.items()})
    for _ in range(2_000):
        for d in range(3):
            now = Counter()
            for c, x in w.items():
                now[c[d]] += x
            w = {c: x * wish[d][c[d]] / now[c[d]] for c, x in w.items()}
    factor = {c: w[c] / cells[c] for c in cells}
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(n * min(1, mid * factor[c]) for c, n in cells.items()) < budget * total else (lo, mid)
    return [(min(1, hi * factor[tuple(c)]), max(1, hi * factor[tuple(c)])) for *c, _ in rows]


@pytest.mark.parametrize("targets", [None, {"source": {"big": 0.3, "small": 0.3, None: 0.2, "(none)": 0.2}, "lang": {"en": 0.25, "de": 0.5}}])
def test_mixing_equals_a_plain_version(docs_of, targets):
    rows = [(i, t, lang, "(none)" if i % 11 == 0 else source) for i, t, lang, source in mix_rows()]
    topic = F.when(F.contains("text", F.lit(" | ")), "table").otherwise("prose")
    got = mixing.sample(docs_of(rows), targets, budget=0.4, topic_of=topic).orderBy("doc_id").collect()
    flat = [(source, lang, "table" if " | " in t else "prose", len(t.split())) for _, t, lang, source in rows]
    want = plain_mixing(flat, {i: (targets or {}).get(d) for i, d in enumerate(mixing.DIMENSIONS)}, mixing.TEMPER, 0.4)
    assert [(r.mix_topic, r.mix_tokens) for r in got] == [(t, n) for _, _, t, n in flat]
    assert np.allclose([(r.mix_probability, r.mix_weight) for r in got], want, rtol=1e-6)


def test_mixing_odd_rows(odd, nothing):
    assert mixing.sample(odd).count() == odd.count() and mixing.sample(nothing).count() == 0
    twice = mixing.sample(odd).where("doc_id = 6").select("mix_kept").collect()
    assert twice[0] == twice[1]


# --- 3 html


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a&amp;b  c</p></article>", 1), (2, "u", None, 1), (2, "u", "", 1), (3, None, "<p>" * 10_000 + "x", 1)], "page_id long, url string, html string, text int")
    got = html_blocks.extract(pages).orderBy("page_id").collect()
    assert [(r.page_id, r.n_chars) for r in got][:3] == [(1, 5), (2, 0), (2, 0)] and got[0].text == "a&b c"
    assert html_blocks.extract(pages.limit(0)).count() == 0


# --- 4 language


def test_langid_held_out_accuracy(docs_of, odd, nothing):
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(3, 40)))
    rows = [(i, make("aeinrstdh" if i % 3 else "oaulqxçé"), "en" if i % 3 else "fr", "s") for i in range(400)]
    d = docs_of(rows).withColumn("held_out", crc_mod("doc_id", 4) == 2)
    model = langid.fit(d.where("not held_out"))
    got = langid.predict(d, model).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 60 and (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()
    o = {r.doc_id: r.lang_pred for r in langid.predict(odd.withColumn("held_out", F.lit(False)), model).collect()}
    assert o[1] == o[2] == o[3] == "und" and o[4] == "en"
    empty = langid.fit(nothing)
    assert [r.lang_pred for r in langid.predict(d.limit(2), empty).collect()] == ["und", "und"]
    assert langid.predict(nothing.withColumn("held_out", F.lit(False)), model).count() == 0


# --- 5 toxicity


def test_toxicity_held_out(spark, docs_of, odd, nothing):
    rng = random.Random(2)
    plain, bad = [f"w{c}{d}" for c in "abcdefghij" for d in "klmno"], ["idiot", "loser", "grobling", "grobler"]
    rows = []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        if i % 5 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
    d = docs_of(rows).withColumn("held_out", crc_mod("doc_id", 4) == 2).withColumn("toxic", (F.col("doc_id") % 5 == 0).cast("int"))
    model = toxicity.fit(d.where("not held_out"))
    got = toxicity.score(d, model).where("held_out").toPandas()
    assert (got.predicted == (got.doc_id % 5 == 0)).mean() > 0.97 and ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    assert toxicity.score(odd.withColumn("held_out", F.lit(False)), model).count() == odd.count()
    kept = toxicity.keep_clean(d.drop("held_out", "toxic"), model)
    assert kept.columns == d.drop("held_out", "toxic").columns and abs(kept.count() - 720) < 30
    alone = toxicity.fit(nothing.withColumn("toxic", F.lit(1)))
    assert [r.predicted for r in toxicity.score(docs_of([(1, "you idiot"), (2, "hello")]).withColumn("held_out", F.lit(False)), alone).orderBy("doc_id").collect()] == [1, 0]


# --- 6 fingerprints


def paragraphs(t):
    return {x for x in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n", t) if x}


def likeness(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


@pytest.mark.parametrize("rows", [5, 500])
def test_fingerprints(docs_of, rows, monkeypatch):
    rng = random.Random(4)
    make = lambda n: " ".join(rng.choice(["one", "two", "tree", "é4"]) + rng.choice(["", ".", "!", "\n"]) for _ in range(n))
    texts = [make(rng.choice([0, 1, 5, 40, 300])) for _ in range(30)]
    texts[7] = texts[3]
    ids = sorted(rng.sample(range(-50, 1000), 30))
    d = docs_of([*zip(ids, texts), (None, texts[3])])
    monkeypatch.setattr(iblt, "RANGE", rows)
    got = {r.doc_id: r for r in iblt.fingerprints(d).collect()}
    assert len(got) == 31
    order = [(None, texts[3]), *zip(ids, texts)]
    for i, (k, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = got[k]
        assert r.n_chars == len(t) and r.edited_sha256 == sha(edited)
        assert r.near_edited == pytest.approx(likeness(paragraphs(t), paragraphs(edited))) and r.near_next == pytest.approx(likeness(paragraphs(t), paragraphs(after)))
    assert got[ids[7]].fingerprint == got[ids[3]].fingerprint == got[None].fingerprint
    assert len({r.fingerprint for r in got.values()}) == len({frozenset(paragraphs(t)) for t in [*texts]})
    assert all(r.compared <= r.retried for r in got.values())


def cells_of(fingerprint):
    """groups, digests and {group: cells} of a written sketch."""
    groups, n, body = fingerprint.split("/")
    out = {}
    for part in filter(None, body.split(".")):
        g, cells = part.split(":")
        out[int(g, 16)] = [(int(cells[i : i + 2], 16), int(cells[i + 2 : i + 18], 16), int(cells[i + 18 : i + 26], 16)) for i in range(0, len(cells), 26)]
    return int(groups), int(n), out


def likeness_of_sketches(one, two, check):
    """The likeness of two written sketches by subtracting and peeling them alone; None where peeling stops early."""
    (size, n, a), (other, m, b) = cells_of(one), cells_of(two)
    size, width, found = min(size, other), iblt.CELLS[0], 0
    for g in range(size):
        cells = [[0, 0, 0] for _ in range(3 * width)]
        for sign, sketch in ((1, a), (-1, b)):
            for at, row in sketch.items():
                if at % size == g:
                    for c, (x, k, h) in zip(cells, row, strict=True):
                        c[0], c[1], c[2] = (c[0] + sign * x) % 256, c[1] ^ k, c[2] ^ h
        while pure := next(((c, k) for c, k, h in cells if c in (1, 255) and check(k) == h), None):
            found += 1
            for r in range(3):
                c = cells[r * width + (pure[1] >> iblt.ROW_BITS * r & width - 1)]
                c[0], c[1], c[2] = (c[0] - pure[0]) % 256, c[1] ^ pure[1], c[2] ^ check(pure[1])
        if any(map(any, cells)):
            return None
    return 1.0 if not n + m else (n + m - found) / (n + m + found)


def test_likeness_follows_from_two_fingerprints(spark, docs_of):
    rng = random.Random(14)
    words = ["one", "two", "tree", "four", "five", "six"]
    make = lambda n: " ".join(rng.choice(words) + rng.choice(words) + rng.choice(["", "."]) for _ in range(n))
    rows = [(i, make(rng.choice([0, 2, 8, 30, 200]))) for i in range(60)]
    got = iblt.fingerprints(docs_of(rows)).orderBy("doc_id").collect()
    check = lambda k: xxhash.xxh64_intdigest(struct.pack("<i", iblt.CHECK), xxhash.xxh64_intdigest(struct.pack("<Q", k), 42)) & 0xFFFFFFFF
    for k in (5, -9, 2**62):
        assert check(k % 2**64) == spark.range(1).selectExpr(f"xxhash64({k}L, {iblt.CHECK}) & 4294967295L as h").first().h
    peeled = 0
    for r, after in zip(got, [*got[1:], got[0]], strict=True):
        for mine, other in ((r.near_edited, r.edited_fingerprint), (r.near_next, after.fingerprint)):
            alone = likeness_of_sketches(r.fingerprint, other, check)
            peeled += alone is not None
            assert alone is None or alone == pytest.approx(mine)
    assert peeled > 20 and sum(r.retried for r in got) > 0 and all(0 <= r.compared <= r.retried for r in got)


def test_rows_of_one_id_are_spread(docs_of):
    rows = [(None, f"text {i}.") for i in range(300)] + [(i, f"other {i}.") for i in range(100)]
    keyed = docs_of(rows).select(F.coalesce("doc_id", F.lit(iblt.FIRST)).alias("key"), F.xxhash64("text").alias("h"))
    got = iblt.ranged(keyed, 20).collect()
    sizes = Counter(r.range for r in got)
    assert max(sizes.values()) < 60
    in_order = sorted((r.key, r.h) for r in got)
    assert [x[1] for x in sorted((r.range, (r.key, r.h)) for r in got)] == in_order
    after = {r.doc_id: r.edited_sha256 for r in iblt.fingerprints(docs_of(rows)).where("doc_id is not null").collect()}
    assert len(after) == 100 and after[7] == sha("other " + "ot")


def test_fingerprints_odd_rows(odd, nothing, docs_of):
    assert iblt.fingerprints(odd).count() == odd.count() and iblt.fingerprints(nothing).count() == 0
    one = iblt.fingerprints(docs_of([(5, "a. b. c. d.")])).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == sha("a. b. c. " + "a.")


def test_peeling_retries_until_complete(spark):
    rng = random.Random(5)
    rows = [([rng.getrandbits(63) for _ in range(n)], [rng.getrandbits(63) for _ in range(m)]) for n, m in [(0, 0), (3, 0), (4, 4), (15, 12), (40, 30), (300, 200)]]
    rows = [(a + [7], b + [7]) for a, b in rows]
    d = spark.createDataFrame(rows, "a array<long>, b array<long>")
    for r in iblt.differing(d, "a", "b", "x").collect():
        assert set(r.x) == set(r.a) ^ set(r.b) and len(r.x) == len(set(r.x))
        assert (r.x_tries == 0) if len(r.x) < 2 else (r.x_tries > 0 if len(r.x) > 6 else True)
        assert (r.x_tries < len(iblt.CELLS)) if len(r.x) < 100 else True


def test_wide_sketches_have_only_cells_with_digests(spark):
    """The difference of two wide sketches, without the cells that are empty in both; all 384 were made before."""
    rng = random.Random(9)
    some = lambda: rng.getrandbits(63)
    common = [some() for _ in range(3)]
    rows = [(common + [some() for _ in range(i)], [some() for _ in range(j)] + common) for i in range(4) for j in range(4)] + [([], []), ([], common)]
    width = iblt.CELLS[-1]
    whole, part = iblt.subtract(iblt.sketch("a", width), iblt.sketch("b", width)), iblt.difference("a", "b", width)
    for r in spark.createDataFrame(rows, "a array<long>, b array<long>").selectExpr("a", "b", f"{whole} as whole", f"{part} as part").collect():
        full = lambda cells: {tuple(x) for x in cells if x.c or x.k or x.h}
        assert full(r.whole) == full(r.part) and len(r.part) <= 3 * len({*r.a, *r.b})


# --- 7 suffix tree


def test_suffix_tree_scores(docs_of, odd, nothing, spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "cat", "Sat", f"rare{rng.randrange(3000)}"]) for _ in range(rng.randrange(40)))) for i in range(300)] + [(None, None), (5, "the"), (4000, "É the\x00x")]
    d = docs_of(rows)
    train = d.where(crc_mod("doc_id", 5) != 1)
    got = pst.score(d, *pst.train(train)).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    count = Counter(w for i, t in rows if not held(i) for w in pst.words_of(t))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows:
        w = pst.words_of(t)
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[i, held(i), len(w), sum(count[x] > 0 for x in w), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert pst.score(odd, *pst.train(odd)).count() == odd.count()
    assert pst.score(nothing, *pst.train(nothing)).count() == 0
    alone = pst.score(docs_of([(1, "a b")]), *pst.train(nothing)).collect()[0]
    assert alone.n_known == 0 and alone.train_tokens == 0 and alone.base_score == pytest.approx(0.0)


def test_tables_hold_the_whole_tree(docs_of):
    """Whatever is sent to the workers and whatever is joined, scores are those of the tree grown in one process, with contexts of three classes."""
    rng = random.Random(8)
    letters = "abcdef"
    text = lambda: " ".join(x for _ in range(30) for x in (lambda a: (a + "1", rng.choice(letters) + "2", rng.choice(letters) + "3", a + "4"))(rng.choice(letters)))
    rows = [(i, text()) for i in range(120)]
    d = docs_of(rows)
    train = d.where(crc_mod("doc_id", 5) != 1)
    score = lambda share: {r.doc_id: r.score - r.base_score for r in pst.score(d, *pst.train(train, share), hot_grams=share).collect()}
    model = pst.train(train)[0]
    seqs = {i: np.array([model.classes.of(w) for w in pst.words_of(t)], np.int32) for i, t in rows}
    levels = [{}] + [dict() for _ in range(pst.DEPTH)]
    for i, seq in seqs.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for k in range(1, pst.DEPTH + 1):
                for c, s in zip(pst.codes(seq) % pst.SIZE**k, seq):
                    levels[k].setdefault(int(c), np.zeros(pst.SIZE))[s] += 1
    tree = pst.grow(model.classes, model.root, [{c: n for c, n in x.items() if n.sum() >= 20} for x in levels])
    want = {i: tree.score(seq) for i, seq in seqs.items()}
    assert score(5e-7) == pytest.approx(want, abs=1e-3) and score(2.0) == pytest.approx(want, abs=1e-3) and score(2e-3) == pytest.approx(want, abs=1e-3)
    # The fourth word repeats the first's letter: only a context of three classes can tell (0.78 digits each).
    assert np.mean([want[i] for i in want]) > 30 * 3 * 0.78


def test_a_hot_pair_of_classes_meets_as_sums(spark):
    bits, size = 2, 4
    hot, cold = 5, 9  # the nearest two classes
    rows = [(c << 3 * bits | hot << bits | s, 1 + k % 3) for k in range(40) for c in range(4) for s in range(4)] + [(c << 3 * bits | cold << bits | 1, 2) for c in range(3)]
    grams = spark.createDataFrame(rows, "gram long, n long").repartition(8)
    got = [tuple(r) for r in pst.summed(grams, bits, size, copies=2).collect()]
    sums = Counter()
    for g, n in rows:
        sums[g] += n
    found = Counter()
    for g, n, near in got:
        found[g] += n
        assert near == (g >> bits) & (size * size - 1)
    of_pair = Counter(near for *_, near in got)
    assert found == sums and of_pair == {hot: size * size, cold: 3}  # 640 rows before
    assert pst.summed(grams, bits, size).count() == len(rows)


def test_a_flush_makes_one_row_for_each_pair_of_classes(spark):
    """Grams leave the counter as lists, so what is written, shuffled and sorted are pairs of classes and not grams; hot pairs meet as sums here too."""
    import pyarrow as pa

    size, bits = 256, 8
    classes = pst.Classes({b"a": 1, b"b": 2, pst.END: 0}, {b"1": 3, b"2": 4}, size)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "b", "1", "2", "xyz"]) for _ in range(60)) for _ in range(40)]
    count, pairs = Counter(), Counter()
    for t in texts:
        c = np.array([classes.of(w) for w in pst.words_of(t)], np.int64)
        g = pst.codes(c, size) * size + c
        count.update(g.tolist())
        pairs.update((g & (size * size - 1)).tolist())
    parts = [b for half in (texts[:20], texts[20:]) for b in pst._count_classes(classes)([pa.RecordBatch.from_arrays([pa.array(half)], ["text"])])]
    rows = [r for b in parts for r in b.to_pylist()]
    nears = {(g >> bits) & (size * size - 1) for g in count}
    assert len(parts) == 2 and len(rows) <= 2 * (len(nears) + 1) < len(count)  # two rows of numbers for each gram before
    found = {True: Counter(), False: Counter()}
    for r in rows:
        for g, n in zip(r["gram"], r["n"], strict=True):
            found[r["near"] == pst.PAIRS][g] += n
            assert r["near"] == pst.PAIRS or r["near"] == (g >> bits) & (size * size - 1)
    assert found[False] == count and found[True] == pairs
    lists = spark.createDataFrame([(r["near"], r["gram"], r["n"]) for r in rows], "near int, gram array<long>, n array<long>")
    for copies in (0, pst.COPIES):
        got = Counter()
        for r in pst.summed(lists, bits, size, copies).collect():
            for g, n in zip(r.gram, r.n, strict=True):
                got[g] += n
        assert got == count


def test_lookup_finds_what_it_holds():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 5_000):
        keys = np.unique(rng.integers(0, 20_000, n) << 30)
        held = pst.Lookup(keys, np.arange(len(keys)).astype(np.float32))
        asked = rng.integers(0, 20_000, 9_000) << 30
        inside, values = held(asked)
        assert (inside == np.isin(asked, keys)).all() and (keys[values.astype(int)] == asked[inside]).all()


def test_copies_of_grams_do_not_pile_up():
    """A group's counts are the same however many copies of its grams come, in batches of any size."""
    import pyarrow as pa

    size, bits, rng = 4, 2, np.random.default_rng(2)
    classes = pst.Classes({}, {}, size)
    root = np.full(size, 0.25)
    g = np.sort(rng.integers(0, 4**4, 3_000))
    g = g[np.argsort((g >> bits) & 15, kind="stable")]
    n = rng.integers(1, 9, len(g))
    told = lambda parts: sorted((k, i, m, round(float(v), 5)) for b in pst._lifts(classes, root, np.tile(root, (size, 1)))([pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["gram", "n"]) for x, y in parts]) for k, i, m, v in zip(*(c.to_pylist() for c in b.columns)))
    whole = told([(g, n)])
    assert whole and whole == told([(g[i : i + 37], n[i : i + 37]) for i in range(0, len(g), 37)])


def test_context_helps_on_held_out_text(docs_of):
    rng = random.Random(7)
    rows = [(i, " ".join(f"{a} {b}" for a, b in (rng.choice([("new", "york"), ("los", "angeles"), ("big", "apple")]) for _ in range(60)))) for i in range(200)]
    d = docs_of(rows)
    got = pst.score(d, *pst.train(d.where(crc_mod("doc_id", 5) != 1))).where("held_out").toPandas()
    assert (got.score > got.base_score + 20).all()


def test_grams_travel_split_in_few_bytes(spark):
    """Split rows hold two bytes a class; their groups, sums and tables are those of whole grams, which were sent before."""
    import pyarrow as pa

    size, rng = 4, random.Random(21)
    classes, bits = pst.Classes({b"a": 1, pst.END: 0}, {b"1": 2}, size), 2
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(rng.choice(["a", "x1", "y"]) for _ in range(80)) for _ in range(30)])], ["text"])
    whole, split = (list(pst._count_classes(classes, s)([batch])) for s in (False, True))
    root = np.full(size, 1 / size)
    rows = lambda batches: sorted(x for b in batches for x in zip(*(c.to_pylist() for c in b.columns)))
    lifts = lambda batches: rows(pst._lifts(classes, root, np.tile(root, (size, 1)))(batches))
    cut = lambda b: b.slice(0, len(b) - 1)  # without the row of pairs
    assert [str(t) for t in split[0].schema.types[1:]] == ["list<item: int16>", "list<item: int16>", "list<item: int32>"]
    assert lifts(map(cut, split)) == lifts(map(cut, whole)) and len(lifts(map(cut, split))) > 4
    table = spark.createDataFrame(pa.Table.from_batches(split).to_pylist(), pst.SPLIT)
    plain = {(r["near"], g >> 3 * bits, g & size - 1): n for r in pa.Table.from_batches(whole).to_pylist() if r["near"] != pst.PAIRS for g, n in zip(r["gram"], r["n"])}
    for copies, most in ((pst.COPIES, 2**31 - 1), (0, 2**31 - 1), (0, 3)):
        found = Counter()
        for r in pst.summed(table, bits, size, copies, most=most).collect():
            assert len(r.far) == len(r.next) == len(r.n) and max(r.n) <= most
            for f, x, n in zip(r.far, r.next, r.n):
                found[r.near, f, x] += n
        assert found == plain


# --- 8 BPE


def test_bpe_rows(odd, nothing):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text or "" for r in odd.select("doc_id", "text").collect()}
    rows = bpe.digests(odd, path).collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = theirs.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False)))
    both = bpe.encode(odd, path)
    assert {r.doc_id: r.decoded for r in bpe.decode(both, path).collect()} == {r.doc_id: r.decoded for r in both.collect()}
    assert bpe.encode(nothing, path).count() == 0 and bpe.digests(nothing, path).count() == 0


# --- 9 joins of sets


def brute_components(rows, rule):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + rule.words]) for k in range(max(1, len(w) - rule.words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and rule.linked(len(sets[a]), len(sets[b]), len(sets[a] & sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("rule, blocks", [(partenum.Rule(4, 85), (400_000, 1_024)), (partenum.Rule(5, 80), (300, 4))])
def test_join_of_sets(docs_of, rule, blocks):
    texts = planted(random.Random(8), 220, rule)
    rows = [*enumerate(texts), (900, None), (901, ""), (902, texts[0]), (903, texts[0].upper()), (904, "the of a"), (905, "of the a")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.join(docs_of(rows), rule, *blocks).collect()}
    assert got == brute_components(rows, rule)


def test_join_odd_rows(odd, nothing):
    got = Counter((r.doc_id, r.component_id) for r in partenum.join(odd, partenum.Rule()).collect())
    assert got[6, 6] == 2 and got[None, None] == 1 and got[4, 4] == 1 and sum(got.values()) == 10
    assert partenum.join(nothing, partenum.Rule()).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == got[90] == 90 and got[249] == 200 and len(got) == 41 + 3 + 50
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 10 neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(2000)] + [(5000, None, 1), (5100, [0.0] * 16, 1), (5200, [float("nan")] * 16, 1), (5300, [None] + [1.0] * 15, 1), (5400, [1.0], 1), (200, [float(v) for v in x[200]], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    got = lsh_forest.search(d, F.col("vec_id") % 100 == 0, bucket_rows=100, block_rows=300).toPandas()
    assert len(got) == 200 and set(got.query_id) == set(range(0, 2000, 100)) and (got.groupby("query_id")["rank"].max() == 10).all()
    hit, x64 = 0, x.astype(float)
    for q, g in got.groupby("query_id"):
        dist = np.sqrt(((x64 - x64[q]) ** 2).sum(axis=1))
        dist[q] = np.inf
        best = np.lexsort((np.arange(2000), dist))[:10]
        g = g.sort_values("rank")
        hit += len(set(g.vec_id) & set(best))
        assert np.allclose(g.score, dist[g.vec_id]) and list(g.score) == sorted(g.score)
    assert hit / 200 >= 0.9
    assert got[got.query_id == 100].sort_values("rank").vec_id.tolist() == list(range(101, 111))
    few = lsh_forest.search(d.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(few, key=lambda r: r.rank)] and len(few) == 2
    assert lsh_forest.search(d.limit(0), F.col("vec_id") == 0).count() == 0 and lsh_forest.search(d.where("vec_id = 1"), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize(("spread", "most"), [(0.05, 0.05), (0.1, 0.2), (None, 4.0)])
def test_matches_follow_the_data(spark, monkeypatch, spread, most):
    """Clustered vectors get few candidates, vectors without structure as many as a recall of 0.9 takes."""
    rng = np.random.default_rng(4)
    n, d = 3_000, 32
    heart = rng.normal(size=(60, d))
    x = rng.normal(size=(n, d)) if spread is None else heart[rng.integers(0, 60, n)] + rng.normal(0, spread, (n, d))
    x = x.astype(np.float32)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    fitted, found = lsh_forest.fitted_matches, []
    monkeypatch.setattr(lsh_forest, "fitted_matches", lambda *a, **k: found.append(fitted(*a, **k)) or found[-1])
    got = lsh_forest.search(rows, F.col("vec_id") % 50 == 0, bucket_rows=500, block_rows=500).toPandas()
    hits, x64 = 0, x.astype(float)
    for q, g in got.groupby("query_id"):
        dist = ((x64 - x64[q]) ** 2).sum(axis=1)
        dist[q] = np.inf
        hits += len(set(g.vec_id) & set(np.argsort(dist, kind="stable")[:10]))
    assert hits / 600 >= 0.9 and found[0] <= most and len(got) == 600


def nearest_by_force(rows, q, k=10):
    """(vec_id, distance) of the k nearest other ids of a query, each id by its least distance."""
    v = min(list(map(float, x)) for i, x in rows if i == q)
    least = {}
    for i, x in rows:
        if i != q:
            d = float(np.sqrt(((np.array(x, float) - v) ** 2).sum()))
            least[i] = min(d, least.get(i, d))
    return [(i, round(d, 9)) for d, i in sorted((d, i) for i, d in least.items())[:k]]


@pytest.mark.parametrize("case", ["equal vectors", "repeated rows", "an id with many vectors", "one hot vector"])
def test_neighbours_are_exact_when_all_are_candidates(spark, case):
    rng = np.random.default_rng(10)
    x = np.round(rng.normal(size=(120, 6)), 3)
    if case == "equal vectors":
        x[50:80] = x[50]
    rows = [(i, x[i].tolist()) for i in range(120)]
    if case == "repeated rows":
        rows = rows * 2 + [(5, x[6].tolist())] * 3
    if case == "an id with many vectors":
        rows += [(100, (x[0] + 1e-3 * rng.normal(size=6)).tolist()) for _ in range(100)]
    if case == "one hot vector":
        rows += [(1_000 + i, x[0].tolist()) for i in range(300)]
    asked = {0, 3, 60, 100, 1_007} & {i for i, _ in rows}
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in lsh_forest.search(d, F.col("vec_id").isin(*asked), trees=3, matches=99.0, bucket_rows=40, block_rows=30).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert got == {q: nearest_by_force(rows, q) for q in asked}


def test_lonely_queries_ascend_beyond_their_buckets(spark):
    """A vector far from all others finds its neighbours all the same, and few trees with few matches give less than all."""
    rng = np.random.default_rng(12)
    x = np.vstack((rng.normal(size=(3000, 12)) * 0.05 + np.eye(12)[rng.integers(0, 6, 3000)], -np.ones((1, 12))))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = lsh_forest.search(d, (F.col("vec_id") % 300 == 0) | (F.col("vec_id") == 3000), trees=48, matches=0.05, bucket_rows=100).toPandas()
    assert got.groupby("query_id").size().to_dict() == dict.fromkeys([*range(0, 3001, 300)], 10)
    hits = sum(len(set(g.vec_id) & {i for i, _ in nearest_by_force(rows, q)}) for q, g in got.groupby("query_id"))
    assert hits >= 0.9 * len(got)
