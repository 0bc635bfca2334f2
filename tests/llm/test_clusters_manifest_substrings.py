"""Hilbert zone maps, the Merkle manifest and relative Lempel-Ziv parsing against plain versions, with odd rows."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import hilbert_zones, merkle, relative_lz
from scriptorium.llm.hilbert_zones import Rule


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


# --- 11 clusters

VECTORS = "vec_id long, embedding array<float>, v int, id int, key int, c int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], VECTORS)


def plain_clusters(rows, k=40, rounds=5):
    """Every vector against every centroid, in whole numbers of any size."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: (sha(f"2:{'' if r[0] is None else r[0]}"), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, y)), j) for j, y in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        to = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, t) in zip(kept, to) if t == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    to = assign()
    far = [sum(d for d, t in to if t == j) for j in range(len(c))]
    return sorted((i is not None, i or 0, t, d, far[t], sum(far), sha(",".join(map(str, c[t])))) for (i, _), (d, t) in zip(kept, to))


@pytest.mark.parametrize("case", ["spread", "tight", "few", "odd"])
def test_clusters_equal_a_plain_version(spark, case):
    g = np.random.default_rng(3)
    if case == "spread":
        rows = [(i, x) for i, x in enumerate(g.normal(0, 0.3, (700, 64)).tolist())]
    elif case == "tight":
        heart = g.normal(0, 1, (20, 64))
        rows = [(i, (heart[i % 20] + g.normal(0, 0.01, 64)).tolist()) for i in range(900)]
    elif case == "few":
        rows = [(i, [float(i)] * 64) for i in range(7)]
    else:
        one = g.normal(0, 1, 64).tolist()
        rows = [(i, one) for i in range(300)] + [(5, one), (5, [0.0] * 64), (None, [1.0] * 64), (7, None), (8, []), (9, [1.0] * 63), (10, [1.0] * 63 + [None]), (11, [math.nan] * 64), (12, [math.inf] * 64), (13, [-3.25] * 64), (14, [60000.5] * 64)]
    rows = [(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None) for i, v in rows]
    got = hilbert_zones.cluster(vectors(spark, rows), block=16 if case == "tight" else hilbert_zones.BLOCK).collect()
    assert sorted((r.vec_id is not None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == plain_clusters(rows)
    if case == "tight":
        assert np.mean([r.compared for r in got]) < 20  # of 40 centroids


def test_no_vectors(spark):
    assert hilbert_zones.cluster(vectors(spark, [])).collect() == [] == hilbert_zones.cluster(vectors(spark, [(1, None)])).collect()


def test_huge_components_are_an_error(spark):
    with pytest.raises(Exception, match="may not fit a long"):
        hilbert_zones.cluster(vectors(spark, [(1, [1e30] * 64)]))


def test_curve_steps_by_one_cell():
    for axes, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        keys = hilbert_zones.hilbert(cells, bits)
        walk = cells[np.lexsort(keys.T[::-1])]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_candidates_hold_every_nearest_centroid():
    g = np.random.default_rng(4)
    for spread in (2, 40, 1000):
        c = g.integers(-300, 300, (40, 64))
        x = g.integers(-300, 300, 64) + g.integers(-spread, spread + 1, (50, 64))
        d = hilbert_zones.distances(x, c)
        assert (d == ((x[:, None] - c[None]) ** 2).sum(2)).all()
        some = hilbert_zones.candidates(x, x.min(0), x.max(0), c)
        assert set(d.argmin(1)) <= set(some.tolist())
    big = g.integers(-(1 << 27), 1 << 27, (5, 64))
    assert (hilbert_zones.distances(big, big) == ((big[:, None] - big[None]) ** 2).sum(2)).all()


# --- 12 manifest


def plain_manifest(rows):
    """Trees and proofs one by one; rows are (doc_id, source, lang, n_chars, text)."""
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha("".join(map(part, r)))
    low = lambda t: t if t is None else "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t)

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def path(tree, at):
        out = []
        for nodes in tree[:-1]:
            run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
            out.append((at % 8, run[: at % 8] + run[at % 8 + 1 :]))
            at //= 8
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, (*_, h, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            proof = path(trees[g], at) + path(top, k)
            tampered = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0
            now = leaf((*r[:4], low(r[4]))) if tampered else h
            for i, others in proof:
                now = sha("".join([*others[:i], now, *others[i:]]))
            text = "".join(x for _, others in proof for x in others)
            out.append((r[0] or -1, h, trees[g][-1][0], top[-1][0], sha(text), now, now == top[-1][0], len(text) // 64))
    return sorted(out)


CORPUS = "doc_id long, source string, lang string, n_chars long, text string, tree int, place int, digest int, now int, block int"


def corpus(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], CORPUS)


@pytest.mark.parametrize("case", ["odd", "many", "groups"])
def test_manifest_equals_a_plain_version(spark, case):
    rnd = random.Random(5)
    if case == "odd":
        rows = [(1, "s", "en", 3, "AbC"), (2, None, "en", None, None), (3, "s", None, 0, ""), (4, "é", "de", 3, "ÄBC"), (5, "s", "", 4, "x:-Y"), (5, "s", "", 4, "x:-Y"), (None, "s", "en", 1, "Q"), (6, "s", "en", 90_000, "Long " * 18_000)]
    elif case == "many":  # more than a block of leaves in one group
        rows = [(i, "s", "en" if i % 11 else "fr", i % 7, f"Text {rnd.random()}") for i in range(9_400)]
    else:  # more groups than a run has nodes
        rows = [(i, "s", f"g{i % 70}", 1, f"T {i % 50}") for i in range(300)]
    got = merkle.audit(corpus(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified, r.n_siblings) for r in got) == plain_manifest(rows)


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle.audit(corpus(spark, [])).collect() == []
    one = merkle.audit(corpus(spark, [(4, "s", "en", 1, "a")])).collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha("")


def test_proofs_of_a_few_leaves_are_those_of_all(spark):
    rows = [(i, "s", "en" if i % 5 else "fr", 1, f"text {i}") for i in range(5_000)]
    digest = merkle.leaf()
    made = corpus(spark, rows).select(F.col("doc_id").alias("id"), F.col("lang").alias("of_lang"), digest.alias("digest"), digest.alias("now"))
    m = merkle.manifest(made, "of_lang", "id")
    few = merkle.prove(m, m.leaves.where("id % 701 = 3")).collect()
    every = {r.doc_id: r for r in merkle.prove(m, m.leaves).collect()}
    assert len(few) == 8 and all(r == every[r.doc_id] and r.verified and r.root == m.root for r in few)
    m.discard()


def test_octopus_asks_for_the_least():
    rnd = random.Random(6)
    for n in (1, 2, 8, 9, 64, 65, 700, 4097):
        leaves = [sha(str(i)) for i in range(n)]
        tree = [leaves]
        while len(tree[-1]) > 1:
            tree.append([merkle.parent(tree[-1][i : i + 8]) for i in range(0, len(tree[-1]), 8)])
        for some in (sorted(rnd.sample(range(n), min(n, 5))), list(range(n)), list(range(n // 3, n // 3 + max(1, n // 4)))):
            asked = merkle.missing(np.array(some), n)
            derivable = {(0, p) for p in some}
            for level in range(len(tree) - 1):
                derivable |= {(level + 1, p // 8) for lv, p in list(derivable) if lv == level}
            path = {(level, q) for lv, p in derivable if lv < len(tree) - 1 for level, q in ((lv, q) for q in range(p // 8 * 8, min(p // 8 * 8 + 8, len(tree[lv]))))}
            assert len(asked) == len(set(asked)) and set(asked) == path - derivable
            part = merkle.Part(n, {p: leaves[p] for p in some}, {(lv, p): tree[lv][p] for lv, p in asked})
            assert part.root == tree[-1][0] and all(merkle.fold(leaves[p], part.proof(0, p)) == tree[-1][0] for p in some)


# --- 13 substrings


def plain_substrings(rows, width=13):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - width + 1):
            if d is not None:
                k = tuple(w[i : i + width])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out.append((d is not None, d or 0, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out)


def told(got):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got)


def texts(kind):
    rnd = random.Random(kind)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(40))
    run = lambda n: [word() for _ in range(n)]
    if kind == "passages":  # a passage that most have, whole or cut, in contexts of their own
        shared = [run(60) for _ in range(4)]
        rows = []
        for i in range(250):
            p = rnd.choice(shared)
            a = rnd.randrange(0, 40)
            rows.append((i, " ".join(run(rnd.randrange(30)) + p[a : a + rnd.randrange(5, 60)] + run(rnd.randrange(30)) + rnd.choice(shared)[:rnd.randrange(60)])))
        return rows
    if kind == "edits":  # a group of near copies
        base = run(200)
        rows = []
        for i in range(150):
            w = list(base)
            for _ in range(rnd.randrange(6)):
                w[rnd.randrange(len(w))] = word()
            rows.append((1_000 - i, "  ".join(w)))
        return rows
    if kind == "few words":  # windows repeat within and across documents, in ever other orders
        return [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(80)))) for i in range(120)]
    one = "one two three four five six seven eight nine ten eleven twelve thirteen"
    return [(1, None), (2, ""), (3, " \n\t "), (4, one), (4, one), (4, "zero " + one), (5, one.replace(" ", "\n\t ")), (6, one.upper()), (7, one[:-9]), (None, one), (None, None), (0, one + " " + one), (8, "a " * 50), (9, "a " * 40), (10, ("long text " * 9_000) + one), (11, one.replace(" ", " ")), (-3, "x " + one + " y")]


@pytest.mark.parametrize("kind", ["passages", "edits", "few words", "odd"])
def test_substrings_equal_a_plain_version(docs_of, kind):
    rows = texts(kind)
    assert told(relative_lz.dedup(docs_of(rows)).collect()) == plain_substrings(rows)


def test_parts_of_a_hot_block(docs_of, monkeypatch):
    monkeypatch.setattr(relative_lz, "MEETINGS", 50)
    monkeypatch.setattr(relative_lz, "ANCHORS", 8)
    rows = texts("passages") + [(d + 2_000, t) for d, t in texts("edits")]
    assert told(relative_lz.dedup(docs_of(rows)).collect()) == plain_substrings(rows)


def test_substrings_of_nothing(nothing):
    assert relative_lz.dedup(nothing).collect() == []


def test_factors_are_copies_of_their_sources():
    rnd = random.Random(8)
    ref = [relative_lz.codes(" ".join(rnd.choice("abcdefg") for _ in range(400)).encode()) for _ in range(3)]
    index = relative_lz.Index([r.tobytes() for r in ref], 6)
    c = np.concatenate([ref[1][20:90], relative_lz.codes(b"x y z"), ref[0][100:140], ref[2][5:50]])
    source = index.sources(c)
    spans = relative_lz.factors(source, np.zeros(len(source), int), 6)
    held = {tuple(r[i : i + 6]) for r in ref for i in range(len(r) - 5)}
    covered = {i for a, z, _ in spans for i in range(a, z - 5)}
    assert all((index.codes[s : s + z - a] == c[a:z]).all() for a, z, s in spans)
    assert covered == {i for i in range(len(c) - 5) if tuple(c[i : i + 6]) in held}


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(9)
    a = relative_lz.codes(" ".join(rnd.choice("abcdefghijklmn") for _ in range(300)).encode())
    b = np.concatenate([a[50:90], a[10:60]])
    assert (relative_lz.anchored(b, 13)[:28] == relative_lz.anchored(a, 13)[50:78]).all()
    assert len(np.unique(relative_lz.anchored(a, 13))) < 0.35 * 288


@pytest.mark.parametrize("name", ["op11_hilbert_zones", "op12_merkle_octopus", "op13_relative_lz"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from scriptorium.llm import queries

    home = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{home}/{t}.parquet'")
    got = queries.queries()[name](spark, home)
    columns = sorted(got.columns)
    rows = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(rows)
