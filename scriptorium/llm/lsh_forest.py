"""Approximate nearest neighbours by a hash-prefix forest.

Each of `trees` trees is one sorted array of long hash strings over all distinct vectors, a bit for the side of a random
hyperplane through the sample's mean. A tree lies in buckets: rows of one prefix of its strings, and where such a prefix
holds many rows, several buckets by a hash of the row. A query has two strings in a tree, its own and the one with the bit
flipped that its vector is nearest to, among the first `PROBE`; both descend in their buckets. There the rows that share
prefixes of each length are counted, and the counts are added up over all trees. From the longest prefix the query then
ascends in all trees at once, one bit at a time, until its matches add up to `matches` times the number of distinct vectors.
How many that must be depends on the data: unless it is given, a sample of queries is measured against all vectors, and the
least number of `GRID` is taken that finds a share `AIM` of their nearest.
All rows that share a prefix of that length with it in some tree, none cut off, are candidates and measured exactly in
double precision, next to the vectors, which are dealt into blocks by a hash. Queries that find too few within their
buckets' prefixes go through trees with buckets by hash alone, and those whose matches are fewer rows than an answer has are measured
against all rows.

Index rows, queries and candidates only meet in shuffles; nothing that grows is sent to or kept by the driver or all
workers. Vectors without any structure, whose nearest neighbours are hardly nearer than others, need most of the vectors as
candidates; clustered vectors need far less (see the README for shares and recall).

Equal vectors are one row of the forest with its least distinct ids, as many as an answer can hold, which loses nothing.
Vectors that are null, zero, of another length than most, or hold a null or non-finite component take no part. With
fewer candidates all are found. Repeated ids count once, with their least distance; a repeated query is one query, by its
least vector. Ties go to the smaller id. An empty table gives an empty result, and extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import checkpointed, discard, map_arrow

#: Trees, bits of a hash string, bits of which one is flipped, rows of a bucket, rows of a block of vectors, rows of the
#: sample that the mean and the numbers of matches come from.
TREES, BITS, PROBE, BUCKET_ROWS, BLOCK_ROWS, SAMPLE = 80, 30, 8, 16_384, 8_192, 4_000
#: Queries of the sample, the share of their nearest that is to be found, and the least matches of a query that are tried, as multiples of the distinct vectors.
QUERIES, AIM, GRID = 300, 0.95, (0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0, 1.5, 2.0, 4.0)


def usable(v: str | Column) -> Column:
    """Whether a vector may take part."""
    v = F.col(v) if isinstance(v, str) else v
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


class Hashes:
    """The hash strings of vectors in all trees."""

    def __init__(self, mean: np.ndarray, trees: int, seed: int):
        self.mean, self.trees = mean, trees
        self.planes = np.random.default_rng(seed).standard_normal((len(mean), trees * BITS))

    def __call__(self, vectors: np.ndarray, probes: bool = False) -> list[np.ndarray]:
        """Arrays of vectors by trees: the strings as numbers and, if asked for, those with the nearest bit flipped."""
        side = ((vectors - self.mean) @ self.planes).reshape(len(vectors), self.trees, BITS)
        own = ((side > 0) << np.arange(BITS - 1, -1, -1, dtype=np.int64)).sum(axis=2)
        if not probes:
            return [own]
        nearest = np.abs(side[:, :, :PROBE]).argmin(axis=2)
        return [own, own ^ (np.int64(1) << (BITS - 1 - nearest))]


def _coded(hashes: Hashes, probes: bool):
    """(tree, code, eid) of every row (eid, v), of queries for both strings."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            eid, v = b.column("eid").to_numpy(), b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
            for codes in hashes(v, probes):
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(hashes.trees, dtype=np.int32), len(v))), pa.array(codes.ravel().astype(np.int32)), pa.array(np.repeat(eid, hashes.trees))], ["tree", "code", "eid"])

    return run


def _of_bucket(group: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """A bucket's sorted codes with their rows, and its queries."""
    query = group.column("query").to_numpy()
    code, eid = group.column("code").to_numpy().astype(np.int64), group.column("eid").to_numpy()
    rows = np.flatnonzero(~query)
    order = rows[np.lexsort((eid[rows], code[rows]))]
    return code[order], eid[order], group.filter(pa.array(query))


def _bounds(codes: np.ndarray, of: np.ndarray, open_: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted codes those lie that differ in the last `open_` bits at most."""
    mask = (np.int64(1) << np.asarray(open_, np.int64)) - 1
    return np.searchsorted(codes, of & ~mask, "left"), np.searchsorted(codes, of | mask, "right")


def _counted(prefix: int):
    """For each query of a bucket how many rows share a prefix with it, by the number of bits left open."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        codes, _, queries = _of_bucket(group)
        of = queries.column("code").to_numpy().astype(np.int64)
        counts = []
        for open_ in range(BITS - prefix + 1):
            lo, hi = _bounds(codes, of, open_)
            counts.append(hi - lo)
        return pa.table([queries.column("eid"), *(pa.array(c.astype(np.int64)) for c in counts)], ["q", *(f"n{i}" for i in range(len(counts)))])

    return run


def _met(blocks: int):
    """The rows that a bucket's queries meet at their levels, as lists by block of vectors."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        codes, eid, queries = _of_bucket(group)
        lo, hi = _bounds(codes, queries.column("code").to_numpy().astype(np.int64), queries.column("open").to_numpy())
        q, block, lists, ends = [], [], [], [0]
        home = eid % blocks
        for x, a, z in zip(queries.column("eid").to_numpy().tolist(), lo.tolist(), hi.tolist(), strict=True):
            if z > a:
                at = a + np.argsort(home[a:z], kind="stable")
                where = home[at]
                cuts = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
                q += [x] * len(cuts)
                block += where[cuts].tolist()
                lists.append(eid[at])
                ends += (ends[-1] + np.append(cuts[1:], len(at))).tolist()
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists) if lists else [], pa.int64()))
        return pa.table([pa.array(block, pa.int64()), pa.array(q, pa.int64()), found], ["block", "q", "met"])

    return run


def _measured(k: int):
    """For each block and query the k nearest ids with their distances; rows come sorted:
    a block's vectors (kind 0), then each query's vector (1) and lists (2)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"block": None, "q": None, "eid": [], "v": [], "ids": [], "vector": None, "met": []}
        out: list[list] = [[], [], []]

        def answer() -> None:
            if state["met"]:
                if isinstance(state["eid"], list):
                    order = np.argsort(state["eid"])
                    state["v"], state["ids"], state["eid"] = np.array(state["v"])[order], [state["ids"][i] for i in order], np.array(state["eid"])[order]
                at = np.searchsorted(state["eid"], np.unique(np.concatenate(state["met"])))
                d = np.sqrt(((state["v"][at] - state["vector"]) ** 2).sum(axis=1))
                take = 2 * k
                while True:  # until k ids are met or all candidates are; an id may have several vectors
                    near = np.flatnonzero(d <= np.partition(d, take)[take]) if 2 * take < len(d) else np.arange(len(d))
                    held = [state["ids"][at[i]] for i in near]
                    ids, each = np.concatenate(held), np.repeat(d[near], list(map(len, held)))
                    order = np.lexsort((ids, each))
                    best = order[np.sort(np.unique(ids[order], return_index=True)[1])[:k]]  # each id's least distance
                    if len(best) == k or len(near) == len(d):
                        break
                    take *= 4
                for col, x in zip(out, ([state["q"]] * len(best), ids[best].tolist(), each[best].tolist()), strict=True):
                    col += x
            state["met"] = []

        def flushed() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["q", "vec_id", "score"])
            for col in out:
                col.clear()
            return b

        for b in batches:
            block, kind, q = (b.column(c).to_pylist() for c in ("block", "kind", "q"))
            v, ids = b.column("v"), b.column("list")
            for i in range(b.num_rows):
                if block[i] != state["block"] or (kind[i] and q[i] != state["q"]):
                    answer()
                    state["q"] = q[i]
                if block[i] != state["block"]:
                    state.update(block=block[i], eid=[], v=[], ids=[], q=None if not kind[i] else q[i])
                if kind[i] == 0:
                    state["eid"].append(q[i])
                    state["v"].append(v[i].values.to_numpy())
                    state["ids"].append(ids[i].values.to_numpy())
                elif kind[i] == 1:
                    state["vector"] = v[i].values.to_numpy()
                else:
                    state["met"].append(ids[i].values.to_numpy())
            if len(out[0]) > 50_000:
                yield flushed()
        answer()
        yield flushed()

    return run


def _exact(ids: np.ndarray, asked: np.ndarray, k: int):
    """A task's k nearest rows (q, eid, d) of each of some queries, their own aside."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d, best = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            eid, v = b.column("eid").to_numpy(), b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
            d = np.maximum((asked**2).sum(1)[:, None] + (v**2).sum(1)[None] - 2 * asked @ v.T, 0)
            d[ids[:, None] == eid[None]] = np.inf
            d, e = np.concatenate((best_d, d), axis=1), np.concatenate((best, np.broadcast_to(eid, (len(ids), len(eid)))), axis=1)
            at = np.argpartition(d, k - 1, axis=1)[:, :k]
            best_d, best = np.take_along_axis(d, at, 1), np.take_along_axis(e, at, 1)
        q, met = np.repeat(ids, k), np.isfinite(best_d.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(q[met]), pa.array(best.ravel()[met]), pa.array(best_d.ravel()[met])], ["q", "eid", "d"])

    return run


def opened(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The fewest bits that must be left open for codes to agree, over all trees and both strings; arrays end in trees."""
    x = np.bitwise_xor(own, other)
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1))).astype(int) + 1, 0).min(axis=-1)


def fitted_matches(entries: DataFrame, asking: DataFrame, hashes: Hashes, k: int, total: int, aim: float = AIM) -> float:
    """The least matches of GRID that find a share of the exact nearest vectors of a sample of queries; all vectors if none does."""
    asked = asking.orderBy(F.xxhash64("eid")).limit(QUERIES).collect()
    if not asked:
        return GRID[0]
    ids, vectors = np.array([r.eid for r in asked]), np.array([r.v for r in asked])
    nearest = map_arrow(entries.select("eid", "v"), _exact(ids, vectors, k), "q long, eid long, d double").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "eid"))).where(F.col("r") <= k)
    pairs = nearest.select("q", "eid").join(entries.select("eid", "v"), "eid").collect()  # k for each query of the sample
    if not pairs:
        return GRID[0]
    drawn = entries.orderBy(F.xxhash64("eid")).limit(SAMPLE).select("eid", "v").collect()
    sample = np.sort(hashes(np.array([r.v for r in drawn]))[0], axis=0)
    place = {e: i for i, e in enumerate(ids.tolist())}
    strings = hashes(vectors, probes=True)
    of, there = np.array([place[r.q] for r in pairs]), hashes(np.array([r.v for r in pairs]))[0]
    need = np.minimum(*(opened(codes[of], there) for codes in strings))
    # Matches by bits left open, of the sampled vectors; a query's own vector, which matches in every tree, is added apart.
    met = np.zeros((len(ids), BITS + 1)) - hashes.trees * np.isin(ids, [r.eid for r in drawn])[:, None]
    for codes in strings:
        for tree in range(hashes.trees):
            for open_ in range(BITS + 1):
                lo, hi = _bounds(sample[:, tree], codes[:, tree], open_)
                met[:, open_] += hi - lo
    met = np.maximum(met, 0) * total / len(sample) + hashes.trees
    for share in GRID:
        level = np.where((enough := met >= share * total).any(axis=1), enough.argmax(axis=1), BITS)
        if (need <= level[of]).mean() >= aim:
            return share
    return math.inf


def _dealt(rows: DataFrame, queries: DataFrame, prefix: int, salts: int) -> DataFrame:
    """Index rows and queries by bucket: tree, prefix of the code, and a hash of the row; a query goes to all of the latter."""
    rows = rows.select("tree", "code", "eid", F.lit(False).alias("query"), F.lit(0).alias("open"), F.pmod(F.xxhash64("eid"), F.lit(salts)).cast("int").alias("salt"))
    queries = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("tree", "code", "eid", F.lit(True).alias("query"), "open", "salt")
    return rows.union(queries).withColumn("prefix", F.shiftright("code", BITS - prefix)).groupBy("tree", "prefix", "salt")


def search(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, matches: float | None = None, bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows found for each row that is a query; `matches` as fitted to the data by default."""
    spark = rows.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fit = rows.where(usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")).where("id is not null")
    sizes = fit.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").first()
    if sizes is None:
        return none
    fit = fit.where(F.size("v") == sizes.d)
    mean = np.mean([r.v for r in fit.orderBy(F.xxhash64("id"), "v").limit(SAMPLE).select("v").collect()], axis=0)
    hashes = Hashes(mean, trees, seed)

    # The cut to k + 1 least ids of equal vectors is made before the shuffle too, so no vector is a hot key.
    ranked = fit.select("id", "v").distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    entries = checkpointed(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("eid", F.monotonically_increasing_id()))
    asked = checkpointed(fit.where("asked").groupBy("id").agg(F.min("v").alias("v")).join(entries.select("v", "eid"), "v").select("id", "eid"))
    total = entries.count()
    asking = entries.join(asked.select("eid").distinct(), "eid", "left_semi").select("eid", "v")
    matches = matches or fitted_matches(entries, asking, hashes, k, total)
    index = checkpointed(map_arrow(entries.select("eid", "v"), _coded(hashes, False), "tree int, code int, eid long", 512))
    # Buckets' prefixes are two bits shorter than even trees need; queries that need still shorter ones go a second time.
    prefix = max(0, min(math.floor(math.log2(2 * trees / min(matches, 2 * trees))) - 2, math.ceil(math.log2(max(1, total / bucket_rows)))))
    buckets = {depth: max(1, math.ceil(total / 2**depth / bucket_rows)) for depth in (prefix, 0)}
    tables = [entries, asked, index]
    found = _nearest(entries, index, asking, hashes, buckets, matches * total, max(1, math.ceil(total / block_rows)), k, tables)
    tables.append(found)
    # Matches may be few rows in many trees; queries with less than an answer are measured against all rows.
    ids = fit.select("id").distinct().limit(k + 1).count()
    short = asking.join(found.groupBy("q").count().where(F.col("count") >= ids), asking.eid == F.col("q"), "left_anti")
    if short.limit(1).count():
        every = _nearest(entries, index, short, hashes, {0: buckets[0]}, math.inf, max(1, math.ceil(total / block_rows)), k, tables)
        tables.append(every)
        found = found.join(short, found.q == short.eid, "left_anti").union(every)
    # A query's own id is left out only here; so one more id was kept until now.
    each = asked.join(found, asked.eid == found.q).where("id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("score", "vec_id"))
    kept = checkpointed(each.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "vec_id", "score"))
    discard(*tables)
    return kept


def _nearest(entries: DataFrame, index: DataFrame, asking: DataFrame, hashes: Hashes, buckets: dict[int, int], least: float, blocks: int, k: int, tables: list[DataFrame]) -> DataFrame:
    """(q, vec_id, score), a table: the k + 1 nearest ids that each row of asking meets, its own perhaps among them. buckets:
    for prefixes of these lengths, in turn, the number of buckets of one prefix; at last none is left out. Tables that the
    work leaves behind are added to `tables`."""
    strings, lists = checkpointed(map_arrow(asking, _coded(hashes, True), "tree int, code int, eid long", 512)), []
    left = strings
    tables.append(strings)
    for depth, salts in buckets.items():
        opens = range(BITS - depth + 1)
        counts = _dealt(index, left.withColumn("open", F.lit(0)), depth, salts).applyInArrow(_counted(depth), "q long, " + ", ".join(f"n{i} long" for i in opens))
        level = F.coalesce(*(F.when(F.col(f"n{i}") >= least, F.lit(i)) for i in opens), F.lit(None if depth else BITS).cast("int"))
        levels = checkpointed(counts.groupBy("q").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in opens)).select(F.col("q").alias("eid"), level.alias("open")))
        ready = left.join(levels.where("open is not null"), "eid")
        tables.append(levels)
        lists.append(checkpointed(_dealt(index, ready, depth, salts).applyInArrow(_met(blocks), "block long, q long, met array<long>")))
        if not levels.where("open is null").limit(1).count():
            break
        left = left.join(levels.where("open is null").select("eid"), "eid", "left_semi")
    met = lists[0] if len(lists) == 1 else lists[0].union(lists[1])
    home = F.col("eid") % blocks
    vectors = entries.select(home.alias("block"), F.lit(0).alias("kind"), F.col("eid").alias("q"), "v", F.col("ids").alias("list"))
    wanted = met.select("block", "q").distinct().join(asking.select(F.col("eid").alias("q"), "v"), "q").select("block", F.lit(1).alias("kind"), "q", "v", F.lit(None).cast("array<long>").alias("list"))
    found = met.select("block", F.lit(2).alias("kind"), "q", F.lit(None).cast("array<double>").alias("v"), F.col("met").alias("list"))
    beside = vectors.union(wanted).union(found).repartition("block").sortWithinPartitions("block", F.col("kind") > 0, "q", "kind")
    best = map_arrow(beside, _measured(k + 1), "q long, vec_id long, score double", 512)
    once = best.groupBy("q", "vec_id").agg(F.min("score").alias("score")).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id")))
    found = checkpointed(once.where(F.col("r") <= k + 1).drop("r"))
    discard(*lists)
    return found
