"""Many phrases in one pass over texts: an automaton of bounded size, stepped over all texts of a batch at once.

Phrases of up to `BEGINNING` characters are found by the automaton itself; longer ones by their beginning, after which the
rest is compared in place. Phrases are dealt into blocks whose automaton has at most `CELLS` transitions, and all blocks read
the same batch, so texts are read once and never shuffled. Texts are cut into overlapping stretches of equal length, and a step
takes one character of every stretch. More phrases than `ROUND` characters hold are taken in rounds of one reading each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a phrase that the automaton knows, transitions of an automaton, characters of a stretch, and of the phrases of a round.
BEGINNING, CELLS, STRETCH, ROUND = 64, 4_000_000, 2_048, 8_000_000


class Automaton:
    """The states of all beginnings of some phrases, with the longest state to fall back to folded into every transition."""

    def __init__(self, phrases: Sequence[str]):
        starts = [np.frombuffer(p[:BEGINNING].encode("utf-32-le", "surrogatepass"), np.uint32) for p in phrases]
        letters = np.unique(np.concatenate(starts))
        self.letters, width = letters, len(letters) + 1  # class 0 is any other character
        self.classes = np.zeros(int(letters[-1]) + 2, np.int32)  # the last one is that of all characters beyond
        self.classes[letters] = np.arange(1, width)
        goes: list[dict[int, int]] = [{}]
        depth, parent, by = [0], [0], [0]
        ends: dict[int, list[int]] = {}
        for k, s in enumerate(starts):
            at = 0
            for c in (np.searchsorted(letters, s) + 1).tolist():
                if c not in goes[at]:
                    goes[at][c] = len(goes)
                    goes.append({})
                    depth.append(depth[at] + 1)
                    parent.append(at)
                    by.append(c)
                at = goes[at][c]
            ends.setdefault(at, []).append(k)
        n = len(goes)
        depth, parent, by = np.array(depth), np.array(parent), np.array(by)
        self.step = np.zeros((n, width), np.int32)
        fall = np.zeros(n, np.int32)
        for d in range(int(depth.max()) + 1):
            level = np.flatnonzero(depth == d)
            if d:
                up = parent[level]
                fall[level] = np.where(up == 0, 0, self.step[fall[up], by[level]])
                self.step[level] = self.step[fall[level]]
            for s in level.tolist():
                for c, t in goes[s].items():
                    self.step[s, c] = t
        #: The state itself or the next one that it falls back to that ends a phrase; 0 for none.
        self.ends = ends
        self.out = np.zeros(n, np.int32)
        own = np.zeros(n, bool)
        own[list(ends)] = True
        for s in np.argsort(depth, kind="stable").tolist():
            if s:
                self.out[s] = s if own[s] else self.out[fall[s]]
        self.rest = np.zeros(n, np.int32)  # the next ending state after one of these
        for s in ends:
            self.rest[s] = self.out[fall[s]]
        self.longer: dict[int, list[int]] = {}
        for s, own_phrases in ends.items():
            if more := [k for k in own_phrases if len(phrases[k]) > BEGINNING]:
                self.longer[s] = more
        self.partly = np.zeros(n, bool)
        self.partly[list(self.longer)] = True
        #: The phrase that a state is to its end, as different phrases have different states; -1 for none.
        self.own = np.full(n, -1, np.int64)
        for s, own_phrases in ends.items():
            for k in own_phrases:
                if len(phrases[k]) <= BEGINNING:
                    self.own[s] = k
        #: Whether a state or one that it falls back to begins a longer phrase.
        self.begins = np.zeros(n, bool)
        for s in np.argsort(depth, kind="stable").tolist():
            self.begins[s] = self.partly[s] or (s > 0 and self.begins[fall[s]])
        self.goto = (self.step * width).ravel()  # states as the starts of their rows
        self.width = width
        self.phrases = phrases
        self.least = min(map(len, phrases))

    def _chains(self, keys: np.ndarray, n: int) -> np.ndarray:
        """All (text, ending state) numbers of these (text, state) numbers, each once: the state and those that it falls back to."""
        first = self.out[keys % n]
        live = keys - keys % n + first
        live, found = _unique(live[first > 0]), []
        while len(live):
            found.append(live)
            rest = self.rest[live % n]
            live = _unique((live - live % n + rest)[rest > 0])
        return _unique(np.concatenate(found)) if found else keys[:0]

    def pairs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, phrase) numbers of the phrases that each text holds, each once."""
        coded = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        lead = BEGINNING - 1
        spans = [(i, a) for i, c in enumerate(coded) for a in range(0, max(1, len(c)), STRETCH) if len(c) >= self.least]
        if not spans:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        wide = min(STRETCH, max(len(coded[i]) for i, _ in spans)) + lead
        # A row for each stretch, begun as many characters early as a beginning may reach back.
        block = np.zeros((len(spans), wide), np.int32)
        for k, (i, a) in enumerate(spans):
            c = coded[i][max(0, a - lead) : a + STRETCH]
            block[k, : len(c)] = self.classes[np.minimum(c, len(self.classes) - 1)]
        block = np.ascontiguousarray(block.T)
        of = np.array([i for i, _ in spans])
        first = np.array([max(0, a - lead) for _, a in spans])
        n = len(self.out)
        # Each step's states take the place of its characters; what they end is asked once for each text and state.
        row = np.zeros(len(spans), np.int32)
        for t in range(wide):
            row = self.goto[row + block[t]]
            block[t] = row
        late: set[tuple[int, int, int]] = set()
        found = []
        for a in range(0, wide, 256):
            states = block[a : a + 256] // self.width
            found.append(_unique((states + of * n).ravel()))
            if self.longer:
                at, which = np.nonzero(self.begins[states])
                for t, k, s in zip((a + at).tolist(), which.tolist(), states[at, which].tolist(), strict=True):
                    s = s if self.out[s] == s else int(self.out[s])
                    while s:
                        if self.partly[s]:
                            late.add((int(of[k]), int(first[k]) + t + 1 - BEGINNING, s))
                        s = int(self.rest[s])
        ended = self._chains(_unique(np.concatenate(found)), n)
        which = self.own[ended % n]
        both = np.column_stack((ended // n, which))[which >= 0]
        if late:
            more = {(i, p) for i, at, s in late for p in self.longer[s] if texts[i].startswith(self.phrases[p], at)}
            both = np.concatenate((both, np.array(sorted(more), np.int64).reshape(-1, 2)))
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        return both[:, 0], both[:, 1]


def _unique(numbers: np.ndarray) -> np.ndarray:
    """The different numbers in order."""
    x = np.sort(numbers)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def blocks(phrases: Sequence[str]) -> list[list[str]]:
    """Phrases in blocks whose automaton stays within CELLS, a single phrase's aside."""
    out: list[list[str]] = []
    chars, letters = 0, set()
    for p in sorted(phrases):
        more = letters | set(p[:BEGINNING])
        if not out or (chars + min(len(p), BEGINNING) + 1) * (len(more) + 1) > CELLS:
            out.append([])
            chars, more = 0, set(p[:BEGINNING])
        out[-1].append(p)
        chars, letters = chars + min(len(p), BEGINNING), more
    return out


_BUILT: dict[bytes, list[Automaton]] = {}


def automata(phrases: Sequence[str]) -> list[Automaton]:
    """A worker's automata for some phrases; the last ones are kept, as its next tasks want the same."""
    key = blake2b("\0".join(phrases).encode("utf-8", "surrogatepass"), digest_size=16).digest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = [Automaton(b) for b in blocks(phrases)]
    return _BUILT[key]


def rounds(phrases: DataFrame, phrase: str, size: int = ROUND) -> Iterator[list[str]]:
    """Distinct non-empty phrases in lists of about `size` characters at most, dealt by a hash; only their number grows."""
    from scriptorium.plans.session import written

    # Written once, as they may come from a long way and are asked for more than once.
    p = written(phrases.select(F.col(phrase).alias("p")).where("p <> ''").distinct())
    total = p.agg(F.sum(F.length("p"))).first()[0] or 0
    n = math.ceil(total / size)
    for k in range(n):
        part = p.where(F.pmod(F.xxhash64("p"), F.lit(n)) == k) if n > 1 else p
        if found := sorted(r.p for r in part.collect()):
            yield found


def _small(batches: Iterable[pa.RecordBatch], size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of about `size` characters, or of one longer text."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.utf8_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
            yield b.slice(a, z - a)
            a = z


def _batches(phrases: Sequence[str], reduce: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], tuple[np.ndarray, np.ndarray]], names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = automata(phrases)
        for b in _small(batches):
            texts = [x or "" for x in b.column("text").to_pylist()]
            for a in built:
                of, held = reduce(*a.pairs(texts), b)
                if len(of):
                    rows = pa.array(of)
                    yield pa.RecordBatch.from_arrays([pa.array(a.phrases, pa.string()).take(pa.array(held)), *(b.column(c).take(rows) for c in names)], ["phrase", *names])

    return run


def _every(of: np.ndarray, held: np.ndarray, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return of, held


def _best(of: np.ndarray, held: np.ndarray, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of each phrase the batch's row with the most views, of equals that with the least key."""
    if not len(of):
        return of, held
    keys = np.array(b.column("key").to_pylist(), object)
    place = np.empty(len(keys), np.int64)
    place[sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i]))] = np.arange(len(keys))
    views = b.column("views").to_numpy(zero_copy_only=False)
    order = np.lexsort((place[of], -views[of], held))
    new = np.concatenate(([True], np.diff(held[order]) != 0))
    return of[order][new], held[order][new]


def _over(docs: DataFrame, phrases: DataFrame, phrase: str, reduce, names: list[str]) -> DataFrame | None:
    """Rows of the phrases found, of all rounds; None without phrases."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(["phrase string", *(f"{c} {kinds[c]}" for c in names)])
    out = None
    for some in rounds(phrases, phrase):
        part = docs.mapInArrow(_batches(some, reduce, names), schema)
        out = part if out is None else out.unionByName(part)
    return out


def held(docs: DataFrame, text: str, key: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """(phrase, key) for every phrase that a row's text contains, each once a row. Null and empty phrases are in none."""
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return _found(d, _over(d, phrases, phrase, _every, ["key"]), ["key"])


def tiles(docs: DataFrame, text: str, key: str, views: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """(phrase, key, views): for each phrase the most viewed row that contains it, the least key of equals; phrases without one are
    left out. Tasks send a row for each phrase and batch at most."""
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(views), F.lit(0)).alias("views"), F.col(text).alias("text"))
    found = _found(d, _over(d, phrases, phrase, _best, ["key", "views"]), ["key", "views"])
    best = found.groupBy("phrase").agg(F.min(F.struct((-F.col("views")).alias("v"), F.col("key").alias("key"))).alias("b"))
    return best.select("phrase", F.col("b.key").alias("key"), (-F.col("b.v")).alias("views"))


def _found(docs: DataFrame, found: DataFrame | None, names: list[str]) -> DataFrame:
    return docs.limit(0).select(F.lit("").alias("phrase"), *names) if found is None else found


def mentions(docs: DataFrame, words: str, names: DataFrame, name: str, suffixes: Sequence[str]) -> DataFrame:
    """(name, n): rows with a word that is the name or the name with a suffix, for any number of names in one pass.

    `words` is a column with a row's words, in lower case; names are compared in lower case too.
    """
    own = names.select(F.col(name).alias("name")).where("name <> ''").distinct()
    forms = own.select("name", F.explode(F.transform(F.array(*map(F.lit, suffixes)), lambda s: F.concat(F.lit(" "), F.lower("name"), s, F.lit(" ")))).alias("form"))
    # Words stand between blanks; those between two words count for both.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.concat(F.lit(" "), F.array_join(F.array_distinct(words), "  "), F.lit(" ")).alias("said"))
    hits = held(rows, "said", "row", forms, "form").withColumnRenamed("phrase", "form")
    counts = hits.join(forms, "form").select("name", "key").distinct().groupBy("name").agg(F.count("*").alias("n"))
    return own.join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))
