"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles. Sets lie in size bands; a set has signatures for its own band and,
if a partner may lie there, the next. Two similar sets that meet in a band differ in at most k features, k following
from the band's largest size. The feature domain is dealt into n > k partitions; at least n - k are alike in both. The
signature of a partition stands for its band, its number and its features.

A partition with fewer than two features says little, and so do shingles of frequent words alone. A set leaves such
shingles out of the domain, which only lowers the differences, and has no signatures for light partitions as long as
fewer than n - k of them are light, as then a heavy one is alike in both. Otherwise it also has signatures over the whole
domain, and if that fails too, over its light partitions. As either set's count is enough, no similar pair is missed.

Equal sets are one class from the start. Classes that share a signature are a list; equal lists are looked at once, long
ones in blocks. Within a list, pairs are filtered by sizes and by parity sketches, whose differing bits never exceed the
sets' differences, and a spanning forest of what is left joins candidate groups, a superset of linked ones. A group is
dealt by hash into blocks of bounded size, and each pair of blocks is one task's work: it counts intersections exactly,
by the sets themselves, and returns a spanning forest of the links. So no task holds more than two blocks, and nothing
quadratic is written. Components of all forests are those of all links.

A group of n distinct sets takes n / 1024 passes of its sets through the exchange, which only very large groups of near
copies notice.

Null texts and those without words have the empty set, link with nothing and are their own component; a class whose only
rows have null ids has a null component, and rows that share an id are told apart by their sets. Texts of any length are read whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scriptorium.llm.common import FILTER_BITS, bits_of, checkpointed, discard, map_arrow
from scriptorium.llm.components import components

#: Features and sets that a block may hold.
BLOCK_FEATURES, BLOCK_SETS = 400_000, 1_024
#: Documents of the sample for frequent words, and how many words are frequent.
SAMPLE, FREQUENT = 2_000, 2_000


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and the least similarity as a percentage."""

    words: int = 5
    percent: int = 80

    def most_different(self, both: int) -> int:
        """The most differences of similar sets whose sizes together are `both`."""
        return both * (100 - self.percent) // (100 + self.percent)

    def linked(self, a: int, b: int, shared: int) -> bool:
        return 100 * shared >= self.percent * (a + b - shared)


def shingles(text: str | None, width: int, frequent: frozenset = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles, and which of them are of frequent words alone."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, bool)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    out, first = np.unique(out, return_index=True)
    if not frequent:
        return out, np.zeros(len(out), bool)
    known = np.concatenate(([0], np.cumsum(np.fromiter(map(frequent.__contains__, words), np.int64, len(words)))))
    return out, (known[width:] - known[:-width] == width)[first]


def features(text: str | None, width: int) -> np.ndarray:
    """The set of a text."""
    return shingles(text, width)[0]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Bands:
    """Size bands, each up to the inverse similarity times the one before."""

    def __init__(self, rule: Rule):
        self.rule, self.upper = rule, [1]

    def of(self, size: int) -> int:
        """The band of a size; upper[b] is the largest size of band b."""
        while self.upper[-1] < size:
            self.upper.append(max(self.upper[-1] + 1, self.upper[-1] * 100 // self.rule.percent))
        return int(np.searchsorted(self.upper, size))

    def k(self, band: int) -> int:
        """The most differences of similar sets that meet in the band."""
        return self.rule.most_different(2 * self.upper[band])

    def parts(self, band: int) -> int:
        return self.k(band) + 1 + max(3, self.k(band) // 4)

    def met(self, size: int) -> list[int]:
        """The bands in which a set may meet partners of its own size or more; none where only equal sets are similar."""
        own, partner = self.of(size), self.of(size * 100 // self.rule.percent)
        return [b for b in range(own, partner + 1) if self.k(b)]


def _parts(spread: np.ndarray, band: int, n: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all partitions, and how many features each has. The lowest byte of a signature is its band."""
    at = ((spread >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
    sums = np.zeros(n, np.uint64)
    np.add.at(sums, at, _mix(spread + np.uint64(band)))
    tag = np.uint64((level * 256 + band) << 32) + np.arange(n, dtype=np.uint64)
    return (_mix(_mix(tag + np.uint64(1)) + sums) & ~np.uint64(255)) | np.uint64(min(band, 255)), np.bincount(at, minlength=n)


def signatures(feats: np.ndarray, bands: Bands, common: np.ndarray) -> np.ndarray:
    """A set's signatures in all bands where it meets partners; common: which features are of frequent words alone."""
    out = [np.empty(0, np.uint64)]
    spread = _mix(feats)
    for band in bands.met(len(feats)):
        n, k = bands.parts(band), bands.k(band)
        sigs, size = _parts(spread[~common], band, n, 0)
        out.append(sigs[size > 1])
        if (size < 2).sum() >= n - k:
            sigs, size = _parts(spread, band, n, 1)
            out.append(sigs[size > 1])
            if (size < 2).sum() >= n - k:
                out.append(sigs[size < 2])
    return np.concatenate(out)


def parity(feats: np.ndarray, k: int) -> bytes:
    """A bit for each of about 4 k places: whether an odd number of features fall there."""
    bits = np.zeros(-(-max(64, 4 * (k + 1)) // 64) * 64, np.uint8)
    np.bitwise_xor.at(bits, ((_mix(feats + np.uint64(99)) >> np.uint64(16)) % np.uint64(len(bits))).astype(np.int64), 1)
    return np.packbits(bits).tobytes()


def node_of(feats: np.ndarray) -> int | None:
    """The class of a set: a digest of all its features; none for the empty set."""
    return int.from_bytes(blake2b(feats.tobytes(), digest_size=8).digest(), "little", signed=True) if len(feats) else None


class Seen(dict):
    """Classes that a worker has met, bounded; what is made of equal sets is written once by a worker."""

    def first(self, node: int | None) -> bool:
        if node is None or node in self:
            return False
        if len(self) > 100_000:
            self.clear()
        self[node] = True
        return True


def _describe(rule: Rule):
    """Size, class and sketches of every document's set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(rule), Seen()
        for b in batches:
            sizes, nodes, sketches = [], [], []
            for t in b.column("text").to_pylist():
                f = features(t, rule.words)
                node = node_of(f)
                sizes.append(len(f))
                nodes.append(node)
                sketches.append([{"band": min(x, 255), "bits": parity(f, bands.k(x))} for x in bands.met(len(f))] if seen.first(node) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.list_(pa.struct([("band", pa.int32()), ("bits", pa.binary())])))], ["doc_id", "n_shingles", "node", "sketches"])

    return run


def _sign(rule: Rule, frequent: frozenset):
    """A row for each signature of each class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(rule), Seen()
        for b in batches:
            sigs, nodes, held = [], [], 0
            for t in b.column("text"):
                f, common = shingles(t.as_py(), rule.words, frequent)
                if seen.first(node := node_of(f)):
                    sigs.append(signatures(f, bands, common).view(np.int64))
                    nodes.append(np.full(len(sigs[-1]), node))
                    held += len(sigs[-1])
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(nodes))], ["sig", "node"])
                    sigs, nodes, held = [], [], 0
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(nodes))], ["sig", "node"])

    return run


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n: Counter = Counter()
        for t in b.column("text").to_pylist():
            n.update((t or "").encode("utf-8", "replace").lower().split())
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])


def frequent_words(docs: DataFrame, sample: int = SAMPLE, words: int = FREQUENT) -> frozenset:
    """The most frequent words of a bounded sample. They only steer which signatures are made; any list gives whole results."""
    h = F.xxhash64("doc_id")
    limit = docs.select(h.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if limit is None:
        return frozenset()
    n = map_arrow(docs.where(h <= limit).select("text"), _words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(bytes(r.word) for r in n.orderBy(F.col("n").desc(), "word").limit(words).collect())


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys of sorted rows, with the runs' bounds; only the run at a batch's end is held over."""
    held: list[pa.RecordBatch] = []

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for k in keys:
            v = t.column(k).to_numpy()
            new |= v[1:] != v[:-1]
        return np.concatenate(([0], np.flatnonzero(new) + 1, [t.num_rows]))

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        same = all(held[0].column(k)[0] == b.column(k)[b.num_rows - 1] for k in keys)
        if same:
            continue
        t = pa.Table.from_batches(held)
        at = bounds(t)
        yield t.slice(0, at[-2]), at[:-1]
        held = t.slice(at[-2]).to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, bounds(t)


def _lists(block: int):
    """Lists of the classes that share a signature, each list once by a worker."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for t, at in runs(batches, ["sig"]):
            sig, node = t.column("sig").to_numpy(), t.column("node").to_numpy()
            out: list[list] = [[], [], [], []]
            for r in np.flatnonzero(np.diff(at) > 1):
                nodes = np.unique(node[at[r] : at[r + 1]])
                if len(nodes) < 2:
                    continue
                band = int(sig[at[r]]) & 255
                name = int.from_bytes(blake2b(nodes.tobytes() + bytes([band]), digest_size=8).digest(), "little", signed=True)
                if name in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(name)
                for col, x in zip(out, (np.full(len(nodes), name), np.arange(len(nodes), dtype=np.int32) // block, np.full(len(nodes), band, np.int32), nodes), strict=True):
                    col.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["list", "block", "band", "node"])

    return run


def spanning(n_first: int, n_second: int, same: bool, near) -> Iterator[tuple[int, int]]:
    """A spanning forest, by search in breadth, of the graph between two sides (or within one, if same).

    near(side, x, others) says which of the others x is tied to. A place is asked about once and only against places not
    reached yet, so a group that hangs together costs little more than its own size.
    """
    left = [np.arange(n_first), np.arange(n_second)]
    if same:
        left[1] = left[0]
    for start in range(n_first):
        if not np.any(left[0] == start):
            continue
        left[0] = left[0][left[0] != start]
        if same:
            left[1] = left[0]
        queue = [(0, start)]
        while queue:
            side, x = queue.pop()
            other = 1 - side
            rest = left[other]
            if not len(rest):
                continue
            hit = near(side, x, rest)
            for y in rest[hit].tolist():
                yield (x, y) if side == 0 or same else (y, x)
                queue.append((0 if same else other, y))
            if hit.any():
                left[other] = rest[~hit]
                if same:
                    left[0] = left[1] = left[other]


def _filtered(rule: Rule):
    """A spanning forest of the pairs of a list that may be similar, by sizes and parity sketches."""

    def may(size: int, bits: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
        most = (size + sizes) * (100 - rule.percent) // (100 + rule.percent)
        return (np.abs(size - sizes) <= most) & (np.bitwise_count(bits ^ others).sum(axis=1, dtype=np.int64) <= most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, ["list", "i", "j"]):
            u, v = [], []
            node, block, size = (t.column(c).to_numpy() for c in ("node", "block", "n"))
            bits = t.column("bits").to_pylist()
            i_, j_ = t.column("i").to_numpy(), t.column("j").to_numpy()
            for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                words = np.frombuffer(b"".join(bits[a:e]), np.uint64).reshape(e - a, -1)
                if e - a == 2:
                    if i_[a] == j_[a] and may(size[a], words[0], size[a + 1 : e], words[1:])[0]:
                        u.append(node[a])
                        v.append(node[a + 1])
                    continue
                sides = [np.flatnonzero(block[a:e] == x) for x in (i_[a], j_[a])]
                held = [(size[a:e][s], words[s]) for s in sides]

                def near(side: int, x: int, others: np.ndarray, held=held, same=i_[a] == j_[a]) -> np.ndarray:
                    sizes, w = held[0 if same else 1 - side]
                    return may(held[side][0][x], held[side][1][x], sizes[others], w[others])

                for x, y in spanning(len(sides[0]), len(sides[1]), bool(i_[a] == j_[a]), near):
                    u.append(node[a + sides[0][x]])
                    v.append(node[a + sides[1][y]])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def linked_pairs(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """A spanning forest of the links between the first and the second sets (positions), by exact counts."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    sizes = np.array([len(s) for s in sets])

    def tie(i: int, j: int) -> None:
        if (a := find(i)) != (b := find(j)):
            root[a] = b
            out.append((i, j))

    if len(sets) <= 6:
        for i in first:
            for j in second:
                if i != j and find(i) != find(j) and rule.linked(sizes[i], sizes[j], len(np.intersect1d(sets[i], sets[j], assume_unique=True))):
                    tie(int(i), int(j))
        return out
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, at, n = np.unique(every, return_inverse=True, return_counts=True)
    common = n[at] > 1
    column = np.cumsum(n > 1)[at[common]] - 1
    owner = owner[common]
    shared = np.zeros((len(first), len(second)), np.float32)
    row_of = np.full(len(sets), -1)
    row_of[first] = np.arange(len(first))
    col_of = np.full(len(sets), -1)
    col_of[second] = np.arange(len(second))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4_096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        o, c = owner[lo:hi], column[lo:hi] - a
        x, y = np.zeros((len(first), width), np.float32), np.zeros((len(second), width), np.float32)
        r = row_of[o] >= 0
        x[row_of[o[r]], c[r]] = 1
        r = col_of[o] >= 0
        y[col_of[o[r]], c[r]] = 1
        shared += x @ y.T
    shared = shared.astype(np.int64)
    linked = 100 * shared >= rule.percent * (sizes[first][:, None] + sizes[second][None, :] - shared)
    same = len(first) == len(second) and bool((first == second).all())
    near = lambda side, x, others: linked[x, others] if side == 0 or same else linked[others, x]
    return [(int(first[i]), int(second[j])) for i, j in spanning(len(first), len(second), same, near)]


def _verify(rule: Rule):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("features").to_pylist()]
        block = np.array(group.column("block").to_pylist())
        i, j = key[1].as_py(), key[2].as_py()
        pairs = linked_pairs(sets, np.flatnonzero(block == i), np.flatnonzero(block == j), rule)
        return pa.table({"u": pa.array([nodes[a] for a, _ in pairs], pa.int64()), "v": pa.array([nodes[b] for _, b in pairs], pa.int64())})

    return run


def _features(rule: Rule, wanted: np.ndarray):
    """Classes and sets of the documents that may be in a group, by a bit for the remainder of their ids' crc32."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            keep = [i is not None and bool(wanted[(h := crc32(str(i).encode()) % FILTER_BITS) >> 3] >> (h & 7) & 1) for i in ids]
            b = b.filter(pa.array(keep, pa.bool_()))
            feats = [features(t, rule.words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([node_of(f) for f in feats], pa.int64()), pa.array([f.tobytes() for f in feats], pa.binary())], ["doc_id", "node", "features"])

    return run


def with_class(docs: DataFrame, rule: Rule, name: str) -> DataFrame:
    """The rows with the class of their set in a column of this name; null for those without words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = [node_of(features(t, rule.words)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes, pa.int64())], [*b.schema.names, name])

    return map_arrow(docs, run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def join(docs: DataFrame, rule: Rule, block_features: int = BLOCK_FEATURES, block_sets: int = BLOCK_SETS, classes: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links) of every document; with `classes` also node, the class of
    its set, and component, the least class reachable, which tell rows apart whatever their ids are."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Texts are read twice rather than signatures kept: those are many times larger than all else.
    rows = checkpointed(map_arrow(docs, _describe(rule), "doc_id long, n_shingles long, node long, sketches array<struct<band:int,bits:binary>>"))
    least = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))

    sigs = map_arrow(docs.select("text"), _sign(rule, frequent_words(docs)), "sig long, node long").repartition("sig").sortWithinPartitions("sig")
    lists = checkpointed(map_arrow(sigs, _lists(block_sets), "list long, block int, band int, node long", 4_096).distinct())
    long = lists.where("block > 0").groupBy("list").agg(F.max("block").alias("last"))
    pairs = lists.join(long, "list", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))))
    pairs = pairs.select("list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "band", "node")
    sketches = rows.where("sketches is not null").dropDuplicates(["node"]).select("node", F.col("n_shingles").alias("n"), F.explode("sketches").alias("s")).select("node", "n", "s.band", "s.bits")
    held = pairs.join(sketches, ["node", "band"]).select("list", "i", "j", "block", "node", "n", "bits").repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")
    ties = map_arrow(held, _filtered(rule), "u long, v long", 4_096).distinct()
    grouped = components(ties)
    groups = checkpointed(grouped.withColumnRenamed("component", "group"))
    discard(lists, grouped)

    known = groups.join(least, "node")
    blocks = known.groupBy("group").agg(F.greatest(F.ceil(F.sum("n") / F.lit(block_features)), F.ceil(F.count("*") / F.lit(block_sets))).cast("int").alias("blocks"))
    place = checkpointed(known.join(blocks, "group").select("doc_id", "node", "group", "blocks"))
    wanted = np.packbits(bits_of(place), bitorder="little")
    # Another row may have the id of the class's least document; only the class's own set is taken.
    sets = map_arrow(docs, _features(rule, wanted), "doc_id long, node long, features binary").join(place, ["doc_id", "node"])
    own = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A set goes to every pair that its block is part of.
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "features")
    links = dealt.groupBy("group", "i", "j").applyInArrow(_verify(rule), "u long, v long")
    joined = components(links)

    ids = joined.join(least.select("node", "doc_id"), "node")
    lowest = ids.groupBy("component").agg(F.min("doc_id").alias("lowest"))
    final = least.join(ids.select("node", "component").join(lowest, "component").select("node", "lowest"), "node", "left").select("node", F.coalesce("lowest", "doc_id").alias("component_id"))
    found = rows.select("doc_id", "n_shingles", "node").join(final, "node", "left")
    more = []
    if classes:
        found = found.join(joined.select("node", "component"), "node", "left")
        more = ["node", F.coalesce("component", "node").alias("component")]
    found = found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *more)
    kept = checkpointed(found)
    discard(rows, groups, place, joined)
    return kept
