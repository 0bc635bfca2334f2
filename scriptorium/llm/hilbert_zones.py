"""Centroid clustering over Hilbert-ordered blocks with zone maps.

Vectors become integers and lie in the order of a Hilbert curve through their `AXES` components of largest spread, which
puts near vectors next to each other. `BLOCK` consecutive vectors are a block, a row of a table that is written once, with
the least and the largest value of every component: its box. A round reads the blocks only. The centroid nearest to a
box's middle gives an upper bound, the largest distance of the block's vectors to it; a centroid whose distance to the box
is larger cannot be nearest to any of them. The others are the block's candidates, and its vectors are compared with
them exactly, as matrix products. Counts and sums by cluster are added up within a task, then by Spark.

Only centroids, at most `k` of them, and sums by centroid and component meet in the driver. All arithmetic is in integers,
or in doubles that hold them exactly. The order of vectors never changes a result, only how many centroids are compared.

Vectors that are null, of another length, or hold a null or non-finite component take no part. Repeated ids or vectors are
vectors of their own; a null id counts as the empty text in the draw of first centroids, where equal ids go by their vectors.
With fewer vectors than centroids each one is a centroid. Distances fit a long while components lie within 2^27, that is
524 288 before scaling; a larger one is an error and not a wrong distance. An empty table gives an empty result, and
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import checkpointed, discard, map_arrow

#: Vectors of a block; components on the curve and bits of each.
BLOCK, AXES, BITS = 256, 12, 5
#: Largest component whose distances fit a long, and largest for which doubles hold all products.
MOST, EXACT = 1 << 27, 1 << 22


@dataclass(frozen=True)
class Rule:
    """Components of a vector, their scale, centroids, rounds, and the text before an id in the draw of first centroids."""

    size: int = 64
    scale: int = 256
    k: int = 40
    rounds: int = 5
    salt: str = "2:"


def usable(v: str | Column, size: int) -> Column:
    """Whether a vector takes part."""
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce((F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def scaled(values: pa.Array, rule: Rule) -> np.ndarray:
    """Lists of numbers as rows of integers."""
    x = np.floor(rule.scale * values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, rule.size)
    if len(x) and np.abs(x).max() > MOST:
        raise ValueError(f"a component beyond {MOST} after scaling: its distances may not fit a long")
    return x.astype(np.int64)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of cells from 0 to 2 ^ bits - 1, as rows of bytes in order of the curve."""
    x = cells.astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level
        p = q - 1
        for a in x:
            turned = (a & q) != 0
            swap = np.where(turned, 0, (x[0] ^ a) & p)
            x[0] ^= np.where(turned, p, swap)
            a ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    planes = [(a >> b) & 1 for b in range(bits - 1, -1, -1) for a in x]
    return np.packbits(np.stack(planes, axis=1).astype(np.uint8), axis=1)


def _spread(rule: Rule):
    """By component: vectors, least, largest, sum and sum of squares of a task's vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, lo, hi, s, ss = 0, np.full(rule.size, MOST), np.full(rule.size, -MOST), np.zeros(rule.size), np.zeros(rule.size)
        for b in batches:
            if b.num_rows:
                x = scaled(b.column("v"), rule)
                n, lo, hi = n + len(x), np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0))
                s, ss = s + x.sum(0), ss + (x.astype(float) ** 2).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rule.size)), pa.array(np.full(rule.size, n)), pa.array(lo), pa.array(hi), pa.array(s), pa.array(ss)], ["at", "n", "lo", "hi", "s", "ss"])

    return run


def _keyed(rule: Rule, axes: np.ndarray, lo: np.ndarray, width: np.ndarray, bits: int):
    """(id, v, key): the vector as integers, and its place on the curve."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = scaled(b.column("v"), rule)
                keys = hilbert(np.clip((x[:, axes] - lo) * (1 << bits) // width, 0, (1 << bits) - 1), bits)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()), pa.array([r.tobytes() for r in keys], pa.binary())], ["id", "v", "key"])

    return run


def _blocks(size: int, block: int):
    """Blocks of consecutive rows of a sorted partition: ids, vectors, and the box."""

    def row(ids: list, vectors: list[bytes]) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(vectors), "<i4").reshape(-1, size)
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([x.tobytes()]), pa.array([x.min(0).tobytes()]), pa.array([x.max(0).tobytes()])], ["ids", "v", "lo", "hi"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        for b in batches:
            ids += b.column("id").to_pylist()
            vectors += b.column("v").to_pylist()
            while len(ids) >= block:
                yield row(ids[:block], vectors[:block])
                ids, vectors = ids[block:], vectors[block:]
        if ids:
            yield row(ids, vectors)

    return run


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exact."""
    if not len(x) or max(np.abs(x).max(), np.abs(c).max()) >= EXACT:
        return np.stack([((x - y) ** 2).sum(1) for y in c], axis=1) if len(c) else np.empty((len(x), 0), np.int64)
    xf, cf = x.astype(np.float64), c.astype(np.float64)
    return ((xf**2).sum(1)[:, None] + (cf**2).sum(1)[None] - 2 * (xf @ cf.T)).astype(np.int64)


def candidates(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some vector of a block, ascending."""
    outside = np.maximum(np.maximum(lo - c, c - hi), 0)
    least = (outside**2).sum(1)
    guess = int((((2 * c - lo - hi) ** 2).sum(1)).argmin())
    return np.flatnonzero(least <= distances(x, c[guess : guess + 1]).max())


def _assigned(b: pa.RecordBatch, c: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each block its ids, vectors, nearest centroids, distances, and how many centroids were compared."""
    size = c.shape[1]
    wide = lambda raw: np.frombuffer(raw.as_buffer(), "<i4").astype(np.int64)
    for i in range(b.num_rows):
        x = wide(b.column("v")[i]).reshape(-1, size)
        some = candidates(x, wide(b.column("lo")[i]), wide(b.column("hi")[i]), c)
        d = distances(x, c[some])
        best = d.argmin(1)  # the first of equals, which has the smaller number
        yield b.column("ids")[i].values, x, some[best], d[np.arange(len(x)), best], len(some)


def _sums(c: np.ndarray):
    """By centroid: vectors, sums of their components and of their distances, of a task's blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, far = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
        for b in batches:
            for _, x, to, d, _ in _assigned(b, c):
                n += np.bincount(to, minlength=len(c))
                np.add.at(s, to, x)
                np.add.at(far, to, d)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own]), pa.array(s[own].tolist(), pa.list_(pa.int64())), pa.array(far[own])], ["c", "n", "s", "far"])

    return run


def _rows(c: np.ndarray, far: np.ndarray, inertia: int):
    """A row for each vector."""
    digest = [sha256(",".join(map(str, y)).encode()).hexdigest() for y in c.tolist()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x, to, d, some in _assigned(b, c):
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(to.astype(np.int32)), pa.array(d), pa.array(far[to]), pa.array(np.full(len(x), inertia)), pa.array([digest[t] for t in to]), pa.array(np.full(len(x), some, np.int32))],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared"],
                )

    return run


def _first(rows: DataFrame, rule: Rule) -> np.ndarray:
    """The first centroids: vectors in order of a hash of their ids, equal ones by components."""
    hashed = F.sha2(F.concat(F.lit(rule.salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    drawn = rows.select(hashed.alias("h"), "v").orderBy("h", "v").limit(rule.k).collect()
    return scaled(pa.array([r.v for r in drawn], pa.list_(pa.float64())), rule)


def in_blocks(rows: DataFrame, rule: Rule, block: int = BLOCK, axes: int = AXES, bits: int = BITS) -> DataFrame:
    """The table of blocks of rows (id, v) along the curve. It is written; discard() deletes it."""
    spread = map_arrow(rows.select("v"), _spread(rule), "at long, n long, lo long, hi long, s double, ss double").groupBy("at")
    found = sorted(spread.agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect())
    order = sorted(found, key=lambda r: (-(r.ss / r.n - (r.s / r.n) ** 2), r["at"]))[:axes]
    at, lo = np.array([r["at"] for r in order], int), np.array([r.lo for r in order])
    width = np.array([r.hi - r.lo + 1 for r in order])
    keyed = map_arrow(rows, _keyed(rule, at, lo, width, bits), "id long, v binary, key binary", rows=4096)
    # Equal vectors, which may be many, are told apart by their ids.
    laid = keyed.withColumn("tie", F.xxhash64("id")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    return checkpointed(map_arrow(laid, _blocks(rule.size, block), "ids array<long>, v binary, lo binary, hi binary", rows=1024))


def cluster(table: DataFrame, rule: Rule = Rule(), id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and compared: the candidates of the vector's block."""
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, compared int"
    rows = table.where(usable(vector, rule.size)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    c = _first(rows, rule)
    if not len(c):
        return table.sparkSession.createDataFrame([], schema)
    blocks = in_blocks(rows, rule, block)

    def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, sums and distances of the centroids as they are."""
        parts = map_arrow(blocks, _sums(c), "c long, n long, s array<long>, far long", rows=64)
        n, s, far = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
        for r in parts.select("c", "n", "far", F.posexplode("s").alias("at", "x")).groupBy("c", "at").agg(F.sum("n").alias("n"), F.sum("far").alias("far"), F.sum("x").alias("x")).collect():
            n[r.c], far[r.c], s[r.c, r["at"]] = r.n, r.far, r.x
        return n, s, far

    for _ in range(rule.rounds):
        n, s, _ = summed()
        c = np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], c)
    far = summed()[2]
    result = checkpointed(map_arrow(blocks, _rows(c, far, int(far.sum())), schema, rows=64))
    discard(blocks)
    return result
