"""Substring deduplication by relative Lempel-Ziv parsing.

A window of `width` words is a duplicate where a document with a smaller id has it too. Every window has an anchor, the
least of the hashes of its grams of `GRAM` words, so equal windows have equal anchors, and neighbours mostly share one: a
document has about an anchor for every five words. An anchor's reference is the document with the least id that has it.

References lie in blocks, by a hash of their ids: a block has the stretches of its documents around the anchors that some
later document has too, and an index of their windows. A document's stretches go to every block that has a reference of
one of their anchors and are parsed there: a factor begins at a window that the index has and runs on for as long as text
and source agree. Windows across a factor's end are looked up on their own and may begin the next factor, which then
overlaps. Factors are duplicate spans. Windows that no factor covers are met once more, by digests of their words: of
windows with one anchor, those that its reference lacks can only be duplicates of each other, so the whole result is exact.

Documents without a shared anchor, and words away from shared anchors, are neither shuffled nor indexed. A block has a
bounded number of anchors, and documents that meet it are dealt into parts of bounded size by a hash, so a passage that a
third of all documents have is many tasks' work. The first of a hot anchor or window is found by partial aggregates.

Null and empty texts and those of fewer words than a window lose nothing, texts of any length are read whole, and rows with
a null id lose nothing and make no other row lose any. Rows that share an id are told apart by their texts and are no
duplicates of each other. Only sameness of words counts: white space between them may differ. An empty table gives an empty
result, and extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import FILTER_BITS, bits_of, checkpointed, discard, map_arrow, split_by

#: Words of a gram; anchors of a block; meetings of documents and anchors in a part of a block.
GRAM, ANCHORS, MEETINGS = 5, 16_384, 65_536


def words(text: bytes | None) -> list[bytes]:
    """Runs of characters other than ASCII white space."""
    return (text or b"").split()


def codes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each word."""
    w = words(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def rolled(c: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each `size` consecutive codes."""
    n = max(0, len(c) - size + 1)
    out = np.full(n, seed, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + c[k : k + n]
    return _mix(out)


def anchored(c: np.ndarray, width: int) -> np.ndarray:
    """The anchor of each window of codes. Shorter windows than a gram are their own anchors."""
    gram = min(GRAM, width)
    g = rolled(c, gram)
    least = g[: max(0, len(c) - width + 1)].copy()
    for k in range(1, width - gram + 1):
        np.minimum(least, g[k : k + len(least)], out=least)
    return least


def _batch(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all texts of a batch, and the row of each."""
    each = [codes(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
    return (np.concatenate(each) if each else np.empty(0, np.uint64)), np.repeat(np.arange(len(each)), [len(x) for x in each])


def _anchors(width: int, bits: np.ndarray | None):
    """(g, doc_id) for the distinct anchors of each document; with a filter only those that pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, of = _batch(b)
            if len(c) < width:
                continue
            whole = of[: len(c) - width + 1] == of[width - 1 :]
            g, of = anchored(c, width)[whole], of[: len(c) - width + 1][whole]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
            g, of = g[new], of[new]
            if bits is not None:
                h = (g & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                passed = (bits[h >> 3] >> (h & 7)) & 1 == 1
                g, of = g[passed], of[passed]
            order = np.lexsort((g, of))
            g, of = g[order], of[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(g[new].view(np.int64)), b.column("doc_id").take(pa.array(of[new]))], ["g", "doc_id"])

    return run


def stretches(c: np.ndarray, width: int, g: np.ndarray, kind: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(kind, from, to) of maximal runs of windows whose anchors have the same kind, in words; g must be sorted and distinct."""
    own = anchored(c, width).view(np.int64)
    if not len(own) or not len(g):
        return
    at = np.minimum(np.searchsorted(g, own), len(g) - 1)
    kinds = np.where(g[at] == own, kind[at], -1)
    cut = np.concatenate(([0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, [len(kinds)]))
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if kinds[a] >= 0:
            yield int(kinds[a]), a, z + width - 1


def _cut(width: int):
    """A document's stretches by block and part: as a reference (for all parts of its blocks) or to be parsed."""
    names = ["block", "part", "reference", "doc_id", "row", "start", "codes"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            lists = b.column("parts")
            flat = lists.flatten()
            g_all, block_all, parts_all, ref_all = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            for i, (doc, row, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True)):
                mine = slice(ends[i], ends[i + 1])
                g, first = np.unique(g_all[mine], return_index=True)
                block, parts, ref = block_all[mine][first], parts_all[mine][first], ref_all[mine][first]
                kinds, kind = np.unique(block * 2 + ref, return_inverse=True)
                n_parts = dict(zip((block * 2 + ref).tolist(), parts.tolist(), strict=True))
                c = codes(text)
                for k, a, z in stretches(c, width, g, kind):
                    key = int(kinds[k])
                    n, raw = n_parts[key], c[a:z].tobytes()
                    for part in range(n) if key & 1 else (xxhash.xxh3_64_intdigest(str(doc).encode()) % n,):
                        out.append((key >> 1, part, bool(key & 1), doc, row, a, raw))
                if len(out) > 4096:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=_STRETCH)
                    out = []
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=_STRETCH)

    return run


_STRETCH = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("reference", pa.bool_()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("codes", pa.binary())])


class Index:
    """The windows of a block's stretches."""

    def __init__(self, stretches: list[bytes], width: int):
        self.width = width
        self.codes = np.frombuffer(b"".join(stretches), np.uint64)
        ends = np.cumsum([len(s) // 8 for s in stretches])
        of = np.repeat(np.arange(len(stretches)), [len(s) // 8 for s in stretches])
        h = rolled(self.codes, width)
        at = np.flatnonzero(of[: len(h)] == of[width - 1 :]) if len(ends) and len(h) else np.empty(0, np.int64)
        order = at[np.argsort(h[at], kind="stable")]
        new = np.ones(len(order), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        self.at = order[new]  # the first of equal windows
        self.hashes = h[self.at]

    def sources(self, c: np.ndarray) -> np.ndarray:
        """For each window of codes its place in the block, -1 where it has none."""
        h = rolled(c, self.width)
        if not len(self.at) or not len(h):
            return np.full(len(h), -1)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.at) - 1)
        p = self.at[k]
        same = self.hashes[k] == h
        for j in range(self.width):
            same &= self.codes[p + j] == c[j : j + len(h)]
        return np.where(same, p, -1)


def factors(source: np.ndarray, of: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(from, to, source) in words of maximal factors: windows of one text whose places in the block follow each other."""
    found = np.flatnonzero(source >= 0)
    if not len(found):
        return []
    new = np.ones(len(found), bool)
    new[1:] = (np.diff(found) > 1) | (np.diff(source[found]) != 1) | (np.diff(of[found]) != 0)
    a = np.flatnonzero(new)
    z = np.concatenate((a[1:], [len(found)])) - 1
    return list(zip(found[a].tolist(), (found[z] + width).tolist(), source[found[a]].tolist(), strict=True))


_PARSED = "doc_id long, row long, start long, stop long, w1 long, w2 long"


def _parsed(width: int):
    """Factors of the documents of a part as spans, and digests of the windows that none covers."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        ref = group.column("reference").to_numpy()
        raw = group.column("codes").to_pylist()
        index = Index([r for r, x in zip(raw, ref, strict=True) if x], width)
        rows = np.flatnonzero(~ref)
        sizes = np.array([len(raw[i]) // 8 for i in rows], np.int64)
        c = np.frombuffer(b"".join(raw[i] for i in rows), np.uint64)
        of = np.repeat(np.arange(len(rows)), sizes)
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        start = group.column("start").to_numpy()[rows] - first
        source = index.sources(c)
        own = of[: len(source)]
        whole = own == of[width - 1 :] if len(source) else np.empty(0, bool)
        source = np.where(whole, source, -1)
        spans = factors(source, own, width)
        at = np.array([s[0] for s in spans], np.int64)
        left = np.flatnonzero(whole & (source < 0))
        of_span, of_left = own[at], own[left]
        doc, row = group.column("doc_id").take(pa.array(rows)), group.column("row").take(pa.array(rows))
        every = pa.array(np.concatenate((of_span, of_left)))
        none, n = pa.nulls(len(spans), pa.int64()), len(left)
        begin = np.concatenate((at + start[of_span], left + start[of_left]))
        stop = np.concatenate((np.array([s[1] for s in spans], np.int64) + start[of_span], left + start[of_left] + width))
        w1, w2 = (pa.chunked_array([none, pa.array(rolled(c, width, seed)[left].view(np.int64) if n else np.empty(0, np.int64))]) for seed in (0, 0x5851F42D4C957F2D))
        return pa.table([doc.take(every), row.take(every), pa.array(begin), pa.array(stop), w1, w2], ["doc_id", "row", "start", "stop", "w1", "w2"])

    return run


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, words removed, and the digest of the others."""
    for b in batches:
        n, removed, digests = [], [], []
        for text, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
            w = words(text)
            n.append(len(w))
            if spans:
                gone = np.zeros(len(w), bool)
                for s in spans:
                    gone[s["start"] : s["stop"]] = True
                w = [w[i] for i in np.flatnonzero(~gone).tolist()]
            removed.append(n[-1] - len(w))
            digests.append(sha256(b" ".join(w)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _filter(width: int, g: DataFrame) -> np.ndarray:
    """A filter of fixed size on anchors; those that share a place pass too, and a join follows."""
    return np.packbits(bits_of(g, "g", F.col("g").bitwiseAND(F.lit(FILTER_BITS - 1)).cast("long")), bitorder="little")


def spans(docs: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, row, spans) of the documents with duplicates, in words; row is xxhash64 of the text. It reads a table, for discard()."""
    read = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Anchors of more than one document, with the first of these.
    every = map_arrow(read, _anchors(width, None), "g long, doc_id long")
    met = checkpointed(every.groupBy("g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").select("g", "first", "n"))
    blocks = max(1, math.ceil(met.count() / ANCHORS))
    shared = met.withColumn("block", F.pmod(F.xxhash64("first"), F.lit(blocks)))
    parts = shared.groupBy("block").agg(F.ceil(F.sum("n") / MEETINGS).cast("int").alias("parts"))
    shared = shared.join(parts, "block").select("g", "first", "block", "parts")
    later = map_arrow(read, _anchors(width, _filter(width, met)), "g long, doc_id long")
    hits = checkpointed(later.join(shared, "g").where("doc_id > first"))
    to_parse = hits.select("doc_id", F.struct("g", "block", "parts", F.lit(0).alias("reference")).alias("p"))
    as_reference = hits.select(F.col("first").alias("doc_id"), F.struct("g", "block", "parts", F.lit(1).alias("reference")).alias("p")).distinct()
    lists = checkpointed(to_parse.unionByName(as_reference).groupBy("doc_id").agg(F.collect_list("p").alias("parts")))  # one document's anchors
    _, some = split_by(read, lists)
    met_docs = some.join(lists, "doc_id").select("doc_id", F.xxhash64("text").alias("row"), "text", "parts")
    cut = map_arrow(met_docs, _cut(width), "block long, part int, reference boolean, doc_id long, row long, start long, codes binary")
    parsed = checkpointed(cut.groupBy("block", "part").applyInArrow(_parsed(width), _PARSED))
    # Windows that the references of their anchors lack.
    left = parsed.where("w1 is not null")
    firsts = left.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w1", "w2", "first")
    more = left.join(firsts, ["w1", "w2"]).where("doc_id > first")
    found = parsed.where("w1 is null").select("doc_id", "row", "start", "stop").unionByName(more.select("doc_id", "row", "start", "stop"))
    out = checkpointed(found.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))  # one document's spans
    discard(met, hits, lists, parsed)
    return out


def dedup(docs: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row, without the words that duplicate windows cover."""
    found = spans(docs, width)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole, some = split_by(read, found)
    none = F.lit(None).cast("array<struct<start:long,stop:long>>").alias("spans")
    joined = some.withColumn("row", F.xxhash64("text")).join(found, ["doc_id", "row"], "left").select("doc_id", "text", "spans")
    rows = whole.select("doc_id", "text", none).unionByName(joined)
    kept = checkpointed(map_arrow(rows, _kept, "doc_id long, n_words long, n_removed long, kept_sha256 string"))
    discard(found)
    return kept
