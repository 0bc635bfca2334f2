"""Language-model scoring by a probabilistic suffix tree over word classes.

Tokens are words without ASCII white space, A-Z lowered, and one end sign a text. The tree's alphabet grows with the cube
root of the vocabulary, from SIZE on: the end sign, the most frequent words with a class each, the most frequent two-byte
word endings, and one class for the rest. A word's probability is that of its class in the tree's state times its share of
the class; shares come from the counts of all training words, each plus one half, one more for a word not met. So a text's
score is its base score plus, for each token, how much more likely its class is in its context than by itself.

Every context of up to `DEPTH` classes that occurs `LEAST` times is a candidate, however large the input. It stays if its
smoothed next-class distribution diverges from its parent's by the ratio `ratio` for some class, and by `gain` nats in all
where each occurrence is foretold by the others alone; so a context stays for what it tells of other texts, not for chance.
Distributions are smoothed with the parent's, which weighs as much as there are next classes. The state of a position is its longest kept suffix.

Contexts are counted, tested and kept as tables. Those that end in the same two classes meet in one group, of at most
size ^ 2 counts, with their parents. Grams (a kept context and the next class) that make up at least `hot_grams` of all tokens
are sent to the workers, at most 1 / hot_grams of either length, with the contexts of one and two classes and a filter of
fixed size on those of three; the others meet the documents' grams in joins, and a gram not met in training takes its
parent's probability by its context's weight. `grow` gives the same tree in one process.

Counts of words meet the documents' words in a join, but for a bounded table of words that make up at least `hot` of all
tokens, which is sent to the workers; no vocabulary is collected.

Words and endings of equal counts are taken in the order of their bytes. In each state the words met and, in each class, a
word not met of weight 0.5 / size have a sum of 1; as any one word not met is given 0.5, a state's words may exceed it by less
than half the share of one occurrence of the class.

Null and empty texts are one end sign. Texts of any length are scored whole. Repeated rows score alike; ids may repeat.
An empty table gives an empty result; with no training text counts are zero and distributions even. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import FILTER_BITS, bits_of, checkpointed, crc_mod, discard, map_arrow

#: Least number of classes, context length, least occurrences of a context, least ratio, least gain, least share of a hot word, of a hot gram.
SIZE, DEPTH, LEAST, RATIO, GAIN, HOT, HOT_GRAMS = 256, 3, 20, 1.05, 6.0, 4e-6, 5e-7
#: Entries of a worker's counters before it passes them on.
FLUSH = 150_000
#: The end sign; no word has a blank in it.
END = b" "


def words_of(text: str | None) -> list[bytes]:
    """The tokens of a text with its end sign."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


@dataclass
class Classes:
    """The class of a word: its own, its ending's, or the last."""

    own: dict[bytes, int]
    endings: dict[bytes, int]
    size: int = SIZE

    @property
    def bits(self) -> int:
        return self.size.bit_length() - 1

    def of(self, word: bytes) -> int:
        c = self.own.get(word)
        return self.endings.get(word[-2:], self.size - 1) if c is None else c


def codes(classes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The code of the DEPTH classes before each position, nearest in the lowest digit; the end sign's class stands before the text."""
    out, padded = np.zeros(len(classes), np.int64), np.concatenate((np.zeros(DEPTH, np.int32), classes))
    for k in range(DEPTH):
        out = out * size + padded[k : k + len(classes)]
    return out


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()

    def out():
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])
        words.clear()

    for b in batches:
        for t in b.column("text").to_pylist():
            words.update(words_of(t))
        if len(words) > FLUSH:
            yield from out()
    yield from out()


#: Stands for the nearest classes in the rows with counts of pairs.
PAIRS = -1


#: Rows of _count_classes() whose grams are split: the class farthest from the next, and the next.
SPLIT = "near int, far array<short>, next array<short>, n array<int>"


def _count_classes(classes: Classes, split: bool = False):
    """(near, gram, n): lists of grams and their counts by the nearest two classes of the context, and under PAIRS the counts of a
    class and the next by themselves. A flush of a task's counter makes one row for each.

    If split, rows are as in SPLIT, a quarter of the bytes: a class has two bytes up to a vocabulary of 2^45, and a task's counts four."""
    size, bits = classes.size, classes.bits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            g, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return g, np.bincount(at, np.concatenate([x for _, x in held])).astype(np.int32)

        def out() -> pa.RecordBatch:
            g, n = merged()
            held.clear()
            pairs = np.bincount(g & (size * size - 1), n, size * size).astype(np.int64)
            met, near = np.flatnonzero(pairs), g >> bits & (size * size - 1)
            order = np.argsort(near, kind="stable")
            near = near[order]
            starts = np.flatnonzero(np.concatenate(([True], near[1:] != near[:-1])))
            ends = pa.array(np.concatenate((starts, [len(g), len(g) + len(met)])), pa.int32())
            g, names, kinds = g[order], ["gram", "n"], [np.int64] * 2
            parts = [(g, met), (n[order], pairs[met])]
            if split:
                names, kinds = ["far", "next", "n"], [np.int16, np.int16, np.int32]
                parts[:1] = [(g >> 3 * bits, met >> bits), (g & (size - 1), met & (size - 1))]
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(t))) for x, t in zip(parts, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.append(near[starts], PAIRS), pa.int32()), *lists], ["near", *names])

        known = _Known(classes.of)
        for b in batches:
            seqs = []
            for t in b.column("text").to_pylist():
                w = words_of(t)
                s = np.fromiter(map(known.__getitem__, w), np.int32, len(w))
                seqs.append(codes(s, size) * size + s)
            if seqs:
                g, n = np.unique(np.concatenate(seqs), return_counts=True)
                held.append((g, n.astype(np.int32)))
            if len(held) > 1 and sum(len(x) for x, _ in held) > 1_500_000:
                held[:] = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield out()
        if held:
            yield out()

    return run


class _Known(dict):
    """Results of a function for words met before, bounded."""

    def __init__(self, of, start: dict | None = None):
        super().__init__(start or {})
        self.of, self.start = of, start

    def __missing__(self, word: bytes):
        if len(self) > 150_000 + len(self.start or ()):
            self.clear()
            self.update(self.start or {})
        self[word] = found = self.of(word)
        return found


@dataclass
class Tree:
    """A fitted tree: by state, how much likelier than by itself the next class is (log10); the state by code."""

    classes: Classes
    lift: np.ndarray
    state: np.ndarray
    contexts: int

    def score(self, classes: np.ndarray) -> float:
        return float(self.lift[self.state[codes(classes)], classes].sum(dtype=np.float64))


def grow(classes: Classes, root: np.ndarray, levels: list[dict[int, np.ndarray]], ratio: float = RATIO, gain: float = GAIN) -> Tree:
    """root: the probability of each class by itself; levels[k]: counts of next classes by the code of k classes."""
    dists, kept = [root], [{0: 0}]
    for k in range(1, DEPTH + 1):
        kept.append({})
        for code, n in sorted(levels[k].items()):
            above = next(kept[j][code % SIZE**j] for j in range(k - 1, -1, -1) if code % SIZE**j in kept[j])
            stays, p = _smoothed(n, dists[above], ratio, gain)
            if stays:
                kept[k][code] = len(dists)
                dists.append(p)
    state = np.zeros(1, np.int32)
    for k in range(1, DEPTH + 1):
        state = np.tile(state, SIZE)
        if kept[k]:
            state[np.fromiter(kept[k], np.int64)] = np.fromiter(kept[k].values(), np.int32)
    return Tree(classes, np.log10(np.array(dists) / root).astype(np.float32), state, len(dists))


@dataclass
class Model:
    """A fitted tree as tables: `hot` and `hot2` have the keys and lifts of frequent grams, `first` the probabilities after one
    class, `weight2` the weight of each kept context of two classes (nan where none is kept), `kept` a filter on contexts of
    three, and `tables` all of it by kind."""

    classes: Classes
    root: np.ndarray
    first: np.ndarray
    hot: tuple[np.ndarray, np.ndarray]
    hot2: tuple[np.ndarray, np.ndarray]
    weight2: np.ndarray
    kept: np.ndarray
    tables: DataFrame


#: Kinds of rows of a model's tables: lifts of grams of kept contexts and these contexts' weights, the same for contexts of two classes.
GRAM, CONTEXT, GRAM2, CONTEXT2 = range(4)
#: Added to the keys of grams of contexts of two classes, where both lengths are in one column; above all other keys.
SHORT = 1 << 62


def _smoothed(n: np.ndarray, q: np.ndarray, ratio: float = RATIO, gain: float = GAIN) -> tuple[bool, np.ndarray]:
    """Whether a context with these next classes stays, and its distribution, the parent's if not."""
    total, met, kinds = n.sum(), n > 0, np.count_nonzero(n)
    if total >= LEAST:
        p = (n + kinds * q) / (total + kinds)  # the parent's weight: the number of next classes met
        r = p[met] / q[met]
        alone = (n[met] - 1 + kinds * q[met]) / (total - 1 + kinds) / q[met]
        if (n[met] * np.log(alone)).sum() >= gain and (r.max() >= ratio or r.min() <= 1 / ratio):
            return True, p
    return False, q


#: Rows of a pair of classes, for each gram that it can have, from which they are added up before they meet.
COPIES = 64


def _lifts(classes: Classes, root: np.ndarray, first: np.ndarray):
    """The rows of a model's tables from counts sorted by the nearest two classes."""
    size, bits = classes.size, classes.bits

    def group(near: int, g: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        g, at = np.unique(g, return_inverse=True)
        n = np.bincount(at, n)
        s, context = g & (size - 1), g >> bits
        two = np.bincount(s, n, size)
        kept, q = _smoothed(two, first[near & (size - 1)])
        met = np.flatnonzero(two)
        if kept:
            yield GRAM2, near << bits | met, two[met], np.log10(q[met] / root[met])
            yield CONTEXT2, np.array([near]), np.array([two.sum()]), np.log10([len(met) / (two.sum() + len(met))])
        starts = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        kinds = np.diff(np.append(starts, len(g)))
        total, each = np.add.reduceat(n, starts), np.repeat(np.arange(len(starts)), kinds)
        p = (n + kinds[each] * q[s]) / (total + kinds)[each]
        r = p / q[s]
        alone = (n - 1 + kinds[each] * q[s]) / (total - 1 + kinds)[each] / q[s]
        stays = (total >= LEAST) & (np.add.reduceat(n * np.log(alone), starts) >= GAIN) & ((np.maximum.reduceat(r, starts) >= RATIO) | (np.minimum.reduceat(r, starts) <= 1 / RATIO))
        yield GRAM, g[stays[each]], n[stays[each]], np.log10(p / root[s])[stays[each]]
        yield CONTEXT, context[starts][stays], total[stays], np.log10(kinds / (total + kinds))[stays]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = most = 0
        out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

        def flushed() -> pa.RecordBatch:
            cols = [np.concatenate([np.full(len(x[1]), x[0]) for x in out]), *(np.concatenate([x[i] for x in out]) for i in (1, 2, 3))]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int32, np.int64, np.int64, np.float32), strict=True)], ["kind", "key", "n", "v"])

        def last() -> None:
            g, n = (np.concatenate(x) for x in zip(*held, strict=True))
            out.extend(group(int(g[0] >> bits) & (size * size - 1), g, n))
            held.clear()

        for b in batches:
            g, n = (c.flatten().to_numpy() if pa.types.is_list(c.type) else c.to_numpy() for c in (b.column("far" if "far" in b.schema.names else "gram"), b.column("n")))
            if "far" in b.schema.names:
                near = np.repeat(b.column("near").to_numpy().astype(np.int64), b.column("far").value_lengths().to_numpy())
                g = g.astype(np.int64) << 3 * bits | near << bits | b.column("next").flatten().to_numpy()
            near = (g >> bits) & (size * size - 1)
            cuts = [0, *(np.flatnonzero(near[1:] != near[:-1]) + 1).tolist(), len(g)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j > i:
                    if held and (int(held[0][0][0] >> bits) & (size * size - 1)) != near[i]:
                        last()
                        rows = most = 0
                    held.append((g[i:j], n[i:j]))
                    rows += j - i
                    if rows > 2 * most + 4 * size * size:  # so that copies of a gram never pile up
                        x, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
                        held[:] = [(x, np.bincount(at, np.concatenate([y for _, y in held])).astype(np.int64))]
                        rows = most = len(x)
            if sum(len(x[1]) for x in out) > 100_000:
                yield flushed()
        if held:
            last()
        if out:
            yield flushed()

    return run


def summed(grams: DataFrame, bits: int, size: int, copies: int = COPIES, every: int = 16, most: int = 2**31 - 1) -> DataFrame:
    """(gram, n, near): counts by gram, or lists of them, with the nearest two classes of its context; (far, next, n, near) of split ones.

    Every task counts for itself, so a pair of classes may have many rows of one gram. Where it has more than `copies` for each
    gram that there can be, by the rows of one in `every` files of the table, they are added up first; others are few and meet as they are.
    """
    listed = "near" in grams.columns
    named = ["far", "next"] if "far" in grams.columns else ["gram"]
    near = F.col("near") if listed else F.shiftright("gram", bits).bitwiseAND(size * size - 1).alias("near")
    keyed = grams.select(*named, "n", near)
    if listed:
        keyed = keyed.where(F.col("near") != PAIRS)
    files = sorted(grams.inputFiles())
    some = files[::every]
    share = len(some) / len(files) if files else 1.0
    part = grams.sparkSession.read.schema(grams.schema).parquet(*some) if files else grams
    seen = part.select(near, (F.size(named[0]) if listed else F.lit(1)).alias("rows")).groupBy("near").agg(F.sum("rows").alias("rows")).where(F.col("near") != PAIRS)
    hot = [r.near for r in seen.where(F.col("rows") > copies * size * size * share).collect()]  # at most size ^ 2
    if not hot:
        return keyed
    copied = keyed.where(F.col("near").isin(hot))
    if listed:
        copied = copied.select("near", F.explode(F.arrays_zip(*named, "n")).alias("r")).select(*(f"r.{c}" for c in (*named, "n")), "near")
    added = copied.groupBy("near", *named).agg(F.sum("n").alias("n"))
    if len(named) > 1:
        # A sum too large for four bytes is sent as several counts of its gram.
        added = added.withColumn("n", F.expr(f"transform(sequence(0L, (n - 1) div {most}), i -> cast(least({most}L, n - i * {most}) as int))"))
        added = added.select("near", *(F.expr(f"array_repeat({c}, size(n))").alias(c) for c in named), "n")
    elif listed:
        added = added.select(F.array("gram").alias("gram"), F.array("n").alias("n"), "near")
    return keyed.where(~F.col("near").isin(hot)).unionByName(added)


def train(docs: DataFrame, hot_grams: float = HOT_GRAMS) -> tuple[Model, DataFrame, int, int]:
    """The tree, the words' counts (word, c) as a table, N and V."""
    words = checkpointed(map_arrow(docs.select("text"), _count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    size = max(SIZE, 1 << math.ceil(math.log2(max(1, distinct)) / 3))
    ends = words.select(F.substring("word", -2, 2).alias("e"), "c").groupBy("e").agg(F.sum("c").alias("c")).orderBy(F.col("c").desc(), "e").limit(size - size // 4 - 2).collect()
    top = words.where(F.col("word") != F.lit(bytearray(END))).orderBy(F.col("c").desc(), "word").limit(size - 2 - len(ends)).collect()
    own = {END: 0} | {bytes(r.word): i for i, r in enumerate(top, 1)}
    classes = Classes(own, {bytes(r.e): len(top) + 1 + i for i, r in enumerate(ends)}, size)
    sizes = np.zeros((size, 2))
    for r in map_arrow(words, _class_sizes(classes), "class int, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # size rows
        sizes[r["class"]] = r.n, r.v
    root = sizes[:, 0] + 0.5 * sizes[:, 1] + 0.5 / size
    root /= root.sum()
    grams = checkpointed(map_arrow(docs.select("text"), _count_classes(classes, split=True), SPLIT))
    pairs = grams.where(F.col("near") == PAIRS).select(F.explode(F.arrays_zip("far", "next", "n")).alias("r")).groupBy((F.col("r.far").cast("int") * size + F.col("r.next")).alias("pair")).agg(F.sum("r.n").alias("n")).toArrow()  # at most size ^ 2 rows
    counts = np.zeros(size * size)
    counts[pairs.column("pair").to_numpy()] = pairs.column("n").to_numpy()
    first = np.array([_smoothed(n, root)[1] for n in counts.reshape(size, size)])
    sent = summed(grams, classes.bits, size).repartition("near").sortWithinPartitions("near").select("near", "far", "next", "n")
    tables = checkpointed(map_arrow(sent, _lifts(classes, root, first), "kind int, key long, n long, v float", 65_536))
    discard(grams)

    def hot_of(kind: int) -> tuple[np.ndarray, np.ndarray]:
        rows = tables.where((F.col("kind") == kind) & (F.col("n") >= max(2.0, hot_grams * total))).select("key", "v").toArrow()  # at most 1 / hot_grams rows
        key, v = rows.column("key").to_numpy(), rows.column("v").to_numpy()
        order = np.argsort(key)
        return key[order], v[order]

    weight2 = np.full(size * size, np.nan, np.float32)
    two = tables.where(F.col("kind") == CONTEXT2).select("key", "v").toArrow()  # at most size ^ 2 rows
    weight2[two.column("key").to_numpy()] = two.column("v").to_numpy()
    kept = bits_of(tables.where(F.col("kind") == CONTEXT), "key", F.pmod("key", F.lit(FILTER_BITS)))
    return Model(classes, root, first, hot_of(GRAM), hot_of(GRAM2), weight2, np.packbits(kept, bitorder="little"), tables), words, int(total), int(distinct)


def _lift_of_cold(scored: DataFrame, model: Model, hot_count: float, tables: list[DataFrame]) -> DataFrame:
    """(uid, lift): the lifts of the documents' grams that were not sent, summed; its table is added to `tables`."""
    bits = model.classes.bits
    kind = lambda k, key, v: model.tables.where(F.col("kind") == k).select(F.col("key").alias(key), F.col("v").alias(v))
    cold = scored.select("uid", F.explode("grams").alias("r")).select("uid", "r.gram", "r.k", "r.other")
    known = model.tables.where(F.col("kind").isin(GRAM, GRAM2) & (F.col("n") < hot_count)).select((F.col("key") + F.when(F.col("kind") == GRAM2, F.lit(SHORT)).otherwise(0)).alias("gram"), "v")
    # A short gram that is not in the table takes what its row says; a long one looks further.
    lift = F.coalesce(F.col("v").cast("double"), F.when(F.col("gram") >= SHORT, F.col("other")))
    new = F.when(F.col("v").isNull() & (F.col("gram") < SHORT), F.col("gram"))
    # One row a text for all that is settled, and one for each of its grams that is not.
    met = checkpointed(cold.join(known, "gram", "left").groupBy("uid", new.alias("gram")).agg(F.sum(F.col("k") * lift).alias("lift"), F.sum("k").alias("k"), F.max("other").alias("other")))
    tables.append(met)
    keyed = met.where("gram is not null").withColumns({"c3": F.shiftright("gram", bits), "g2": F.col("gram").bitwiseAND((1 << 3 * bits) - 1)})
    found = keyed.join(kind(CONTEXT, "c3", "b3"), "c3", "left").join(kind(GRAM2, "g2", "v2"), "g2", "left")
    more = found.groupBy("uid").agg(F.sum(F.col("k") * (F.coalesce("b3", F.lit(0.0)) + F.coalesce("v2", "other"))).alias("lift"))
    return met.where("gram is null").select("uid", "lift").unionByName(more).groupBy("uid").agg(F.sum("lift").alias("cold_lift"))


class Lookup:
    """Values by key, found by a hash whose few keys lie side by side."""

    SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        place = self._place(keys)
        order = np.argsort(place, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.starts = np.searchsorted(place[order], np.arange((1 << bits) + 1)).astype(np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self.SPREAD) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are held, and the values of those."""
        place = self._place(keys)
        at, end = self.starts[place], self.starts[place + 1]
        found = np.full(len(keys), -1, np.int32)
        left = np.flatnonzero(at < end)
        at, end, k = at[left], end[left], keys[left]
        while len(left):
            same = self.keys[at] == k
            found[left[same]] = at[same]
            at = at + 1
            on = ~same & (at < end)
            left, at, end, k = left[on], at[on], end[on], k[on]
        inside = found >= 0
        return inside, self.values[found[inside]]


class Lifts:
    """What the workers hold of a tree: lifts of the hot grams, of grams of one class, and which grams need a join."""

    def __init__(self, model: Model):
        self.size, self.bits = model.classes.size, model.classes.bits
        self.hot, self.hot2, self.kept, self.weight2 = Lookup(*model.hot), Lookup(*model.hot2), model.kept, model.weight2
        self.one = np.log10(model.first / model.root).ravel().astype(np.float32)

    def __call__(self, doc: np.ndarray, classes: np.ndarray, docs: int) -> tuple[np.ndarray, ...]:
        """For the tokens of `docs` texts, one after the other, and the text of each token: by text the sum of the lifts that
        are at hand; by text and gram that needs a join the text, the key, the number, and the lift where its two nearer classes have no table row."""
        size, at = self.size, np.arange(len(classes)) + DEPTH * (doc + 1)
        padded, g = np.zeros(len(classes) + DEPTH * (docs + 1), np.int64), np.zeros(len(classes), np.int64)
        padded[at] = classes
        for k in range(DEPTH, -1, -1):  # the end sign's class stands before each text
            g = g * size + padded[at - k]
        sent, lifts = self.hot(g)
        total = np.bincount(doc[sent], lifts, docs).astype(np.float64)  # whole numbers where nothing is sent
        g, doc = g[~sent], doc[~sent]
        h = (g >> self.bits) % FILTER_BITS
        long = (self.kept[h >> 3] >> (h & 7) & 1).astype(bool)
        weight, one = self.weight2[g >> self.bits & (size * size - 1)], self.one[g & (size * size - 1)]
        below = np.isnan(weight)
        other = np.where(below, 0.0, weight) + one
        alone = ~long & below
        total += np.bincount(doc[alone], one[alone], docs)
        short = np.flatnonzero(~long & ~below)
        g2 = g[short] & ((1 << 3 * self.bits) - 1)
        sent, lifts = self.hot2(g2)
        total += np.bincount(doc[short[sent]], lifts, docs)
        short = short[~sent]
        key, owner, other = (np.concatenate(x) for x in ((g[long], g2[~sent] + SHORT), (doc[long], doc[short]), (other[long], other[short])))
        order = np.lexsort((key, owner))
        key, owner, other = key[order], owner[order], other[order]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))) if len(key) else np.zeros(0, int)
        return total, owner[first], key[first], np.diff(np.append(first, len(key))), other[first]


def _class_sizes(classes: Classes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((classes.size, 2), np.int64)
        for b in batches:
            at = np.array([classes.of(w) for w in b.column("word").to_pylist()], int)
            if len(at):
                sums[:, 0] += np.bincount(at, b.column("c").to_numpy(), classes.size).astype(np.int64)
                sums[:, 1] += np.bincount(at, minlength=classes.size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes.size), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["class", "n", "v"])

    return run


def score(docs: DataFrame, model: Model, words: DataFrame, total: int, distinct: int, hot: float = HOT, hot_grams: float = HOT_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    The counts of words and the lifts of grams, hot ones aside, meet the documents' in joins; nothing is dropped. hot_grams is that of train().
    """
    v = math.log10(total + 0.5 * (distinct + 1))
    sent = words.where(F.col("c") >= max(2.0, hot * total)).toArrow().to_pylist()  # at most 1 / hot words
    logs = np.array([math.log10(r["c"] + 0.5) - v for r in sent] + [0.0])
    classes = np.array([model.classes.of(bytes(r["word"])) for r in sent] + [0], np.int64)
    place = {bytes(r["word"]): i for i, r in enumerate(sent)}
    shared = docs.sparkSession.sparkContext.broadcast((model.classes, Lifts(model), place, logs, classes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes_, lifts, place, logs, of_hot = shared.value
        known = _Known(lambda w: ~classes_.of(w), place)  # hot words by their place, others by the complement of their class
        for b in batches:
            texts_ = list(map(words_of, b.column("text").to_pylist()))
            n, words_ = np.fromiter(map(len, texts_), np.int64, len(texts_)), list(chain.from_iterable(texts_))
            at = np.fromiter(map(known.__getitem__, words_), np.int64, len(words_))
            doc, cold = np.repeat(np.arange(len(n)), n), at < 0
            base = np.bincount(doc, np.where(cold, 0.0, logs[np.where(cold, -1, at)]), len(n)).astype(np.float64)
            rare, n_cold = compress(words_, cold.tolist()), np.bincount(doc[cold], minlength=len(n))
            rare = [Counter(islice(rare, k)) for k in n_cold.tolist()]
            lift, owner, grams, times, other = lifts(doc, np.where(cold, ~at, of_hot[np.where(cold, -1, at)]), len(n))
            ends = lambda x: pa.array(np.append(0, np.cumsum(np.bincount(x, minlength=len(n)))), pa.int32())  # noqa: E731, B023
            lists = pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rare))], pa.int32()), pa.StructArray.from_arrays([pa.array(list(chain.from_iterable(rare)), pa.binary()), pa.array(list(chain.from_iterable(r.values() for r in rare)), pa.int32())], ["word", "k"]))
            cold_grams = pa.ListArray.from_arrays(ends(owner), pa.StructArray.from_arrays([pa.array(grams, pa.int64()), pa.array(times, pa.int32()), pa.array(other, pa.float32())], ["gram", "k", "other"]))
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), b.column("held_out"), pa.array(n), pa.array(n - n_cold), pa.array(base), pa.array(lift), lists, cold_grams], ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "lift", "rare", "grams"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "text")
    scored = checkpointed(map_arrow(rows, run, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, lift double, rare array<struct<word:binary,k:int>>, grams array<struct<gram:long,k:int,other:float>>", 64))
    rare = scored.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.k")
    cold = words.where(F.col("c") < max(2.0, hot * total))
    more = rare.join(cold, "word", "left").groupBy("uid").agg(F.sum(F.col("k") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5)) - F.lit(v))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("also"))
    base = F.col("base") + F.coalesce("more", F.lit(0.0))
    tables = [scored]
    lifts = _lift_of_cold(scored, model, max(2.0, hot_grams * total), tables)
    found = scored.join(more, "uid", "left").join(lifts, "uid", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("lift") + F.coalesce("cold_lift", F.lit(0.0))).alias("score"))
    kept = checkpointed(found)
    discard(*tables)
    return kept
