"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled one by one, in rank order, into a deterministic automaton whose arcs carry vocabulary items.
Each merge adds a gadget: after an arc that ends in the merge's left part, no arc may start with its right part while
both parts are still open at that rank. A gadget is kept as the exposure chains of the new item, so the automaton's
transition function is a table over pairs of arcs. A path through it is exactly the tokenization that merging by rank gives.

Encoding reads each symbol of a pre-split word once: at each position one arc alone leads there from the state of an
earlier position, so the run is deterministic; the arcs are read back from the word's end. Decoding emits arc labels.

Nulls and empty texts give no ids and the empty text. Texts of any length are encoded whole, one after the other; a worker's
caches have a fixed size. There are no ties: one path spells a word, and of two equal merges the left one is made first.
Repeated rows give repeated results, an empty table an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from scriptorium.llm.common import map_arrow, texts

#: Marks the last symbol of a word. Fixed value of the vocabulary file.
WORD_END = "</w>"
#: Stands for it as one symbol behind the last one; no byte has this symbol.
CLOSE = "\n"
#: Entries of a worker's caches: words, and stretches in each of two generations.
CACHE = 200_000
#: Entries of the transition table, and how many may stay between tasks.
PAIRS, KEPT = 1_000_000, 200_000


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself if printable in Latin-1, else the next free code point from 256."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class MergeAutomaton:
    """The deterministic automaton of a merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.labels = {i: s for s, i in vocab.items()}
        #: Arcs by what they spell; one at a word's end spells CLOSE behind its last symbol.
        self.spelled = {s.removesuffix(WORD_END) + CLOSE if s.endswith(WORD_END) else s: i for s, i in vocab.items()}
        #: What an arc's spelling begins with, each beginning by its number in `begins`, and by number the arcs that end there: (symbols, arc), long ones first.
        self.beginnings = {"": 0}
        for s in self.spelled:
            for n in range(1, len(s) + 1):
                self.beginnings.setdefault(s[:n], len(self.beginnings))
        self.begins = list(self.beginnings)
        self.ending: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.begins)
        #: By a symbol and the beginning before it: the longest beginning that ends at the symbol. Filled when first asked.
        self.steps: dict[str, dict[int, int]] = {}
        never = len(merges)
        #: For each arc: its leading and trailing parts, each with the rank of the merge that closes it.
        self.leading: dict[int, tuple[tuple[int, int], ...]] = {}
        self.trailing: dict[int, tuple[tuple[int, int], ...]] = {}
        self.gadgets: dict[tuple[int, int], int] = {}
        for i in vocab.values():
            self.leading[i] = self.trailing[i] = ((i, never),)
        for rank, (a, b) in enumerate(merges):
            self.add_gadget(vocab[a], vocab[b], vocab[a + b], rank, never)
        #: By state x 65536 + arc.
        self.table: dict[int, bool] = {}

    def add_gadget(self, a: int, b: int, ab: int, rank: int, never: int) -> None:
        """The merge's left part opens no path to its right part any more; the item ab inherits what its parts expose."""
        self.gadgets[a, b] = rank
        self.leading[ab] = ((ab, never), (a, rank), *self.leading[a][1:])
        self.trailing[ab] = ((ab, never), (b, rank), *self.trailing[b][1:])

    def follows(self, state: int, arc: int) -> bool:
        """The transition table, filled when first asked: whether the arc may leave the state that the arc before led to.

        Of two equal merges the left one is made first, so a part on the right stays open at its own closing rank.
        """
        known = self.table.get(state << 16 | arc)
        if known is None:
            if len(self.table) > PAIRS:
                self.table.clear()
            known = self.table[state << 16 | arc] = not any(
                (rank := self.gadgets.get((u, v))) is not None and closed_u > rank and closed_v >= rank
                for u, closed_u in self.trailing[state]
                for v, closed_v in self.leading[arc]
            )
        return known

    def encode(self, word: str) -> list[int]:
        """The arcs of the one path that spells the word; its last symbol carries the word end."""
        n, table, steps, ending = len(word), self.table, self.steps, self.ending
        state, came = [-1] * (n + 1), [0] * (n + 1)
        at = 0
        for end, symbol in enumerate(word + CLOSE if n else "", 1):
            try:
                at = steps[symbol][at]
            except KeyError:
                at = self.step(at, symbol)
            if end == n:  # only an arc with the word's end leads there
                continue
            last = end > n
            for size, arc in ending[at] or self.endings(at):
                start = end - size
                if start:
                    before = state[start]
                    if before < 0:
                        continue
                    may = table.get(before << 16 | arc)
                    if not (self.follows(before, arc) if may is None else may):
                        continue
                if last:
                    end = n
                state[end], came[end] = arc, start
                break
        path, end = [], n
        while end:
            path.append(state[end])
            end = came[end]
        return path[::-1]

    def step(self, at: int, symbol: str) -> int:
        """The longest beginning that ends in the beginning `at` and a symbol."""
        s = self.begins[at] + symbol
        found = next((i for k in range(len(s)) if (i := self.beginnings.get(s[k:])) is not None), 0)
        self.steps.setdefault(symbol, {})[at] = found
        return found

    def endings(self, at: int) -> tuple[tuple[int, int], ...]:
        """The arcs that end where a beginning does."""
        s = self.begins[at]
        found = self.ending[at] = tuple((len(s) - k, i) for k in range(len(s)) if (i := self.spelled.get(s[k:])) is not None)
        return found


class Codec:
    """A vocabulary file: normalization, pre-splitting, the automaton and labels."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.automaton = MergeAutomaton(spec["model"]["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.labels | {i: s for s, i in self.special.items()}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split).findall
        self.symbols = dict(enumerate(byte_symbols()))
        self.blank = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
        self.young: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}
        self.words: dict[str, tuple[int, str, str]] = {}

    def release(self) -> None:
        """Empties the caches; workers outlive tasks, and what they hold counts against whatever runs next."""
        self.young, self.old, self.words = {}, {}, {}
        if len(self.automaton.table) > KEPT:
            self.automaton.table = {}

    def split(self, chunk: str) -> list[str]:
        """The pre-split words of a stretch without white space."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        low = "".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower()
        if low.isalpha():
            return [low]
        if low[-1] in ".,;:!?" and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return self.pieces(low)

    def piece(self, piece: str) -> tuple[int, str, str]:
        """Count, ids and labels of a pre-split word, from a cache of bounded size."""
        found = self.words.get(piece)
        if found is None:
            ids = self.automaton.encode(piece if piece.isascii() and piece.isprintable() else "".join(self.symbols[b] for b in piece.encode("utf-8", "replace")))
            labels = self.labels
            found = (len(ids), " ".join(map(str, ids)), " ".join([labels[i] for i in ids]))
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[piece] = found
        return found

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        """Count, ids and labels of a stretch, from a cache of bounded size."""
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                parts = [self.piece(p) for p in self.split(chunk)]
                found = parts[0] if len(parts) == 1 else (sum(p[0] for p in parts), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts]))
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[chunk] = found
        return found

    def chunks(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [c for c in self.blank.split(text) if c]
        return text.split()

    def parts(self, text: str) -> list[tuple[int, str, str]]:
        """Count, ids and labels for each stretch of a text in order; special tokens stand for themselves."""
        get, slow = self.young.get, self.chunk
        if self.at_special is None or not any(s in text for s in self.special):
            return [get(c) or slow(c) for c in self.chunks(text)]
        out = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append((1, str(self.special[part]), part))
            else:
                out += [slow(c) for c in self.chunks(part)]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for n, ids, _ in self.parts(text) if n for i in ids.split()]

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the arcs, as the vocabulary has no decoder joined by one space."""
        return " ".join(self.labels[i] for i in ids)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a file, compiled once."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def released(batches: Iterable[pa.RecordBatch], c: Codec) -> Iterator[pa.RecordBatch]:
    """The batches; after the last the codec's caches are emptied."""
    try:
        yield from batches
    finally:
        c.release()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids and decoded text of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in released(batches, c):
            parts = [c.parts(t) for t in texts(b, "text")]
            ids = [[int(i) for n, s, _ in p if n for i in s.split()] for p in parts]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([" ".join(x[2] for x in p if x[0]) for p in parts], pa.string())], ["id", "n_tokens", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.selectExpr(f"`{id_col}` id", f"`{text_col}` text"), run, f"id {kind}, n_tokens long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded text for arrays of ids; a null array gives the empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([c.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], ["id", "decoded"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return map_arrow(tokens.selectExpr(f"`{id_col}` id", f"`{ids_col}` ids"), run, f"id {kind}, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text, without moving the ids themselves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in released(batches, c):
            rows = []
            for t in texts(b):
                parts = [p for p in c.parts(t) if p[0]]
                rows.append((sum(p[0] for p in parts), sha(" ".join([p[1] for p in parts])), sha(" ".join([p[2] for p in parts]))))
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """The rows' other columns than text, with n_tokens, ids and decoded_sha256."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in released(batches, c):
            parts = [[p for p in c.parts(t) if p[0]] for t in texts(b)]
            ids = [[int(i) for p in row for i in p[1].split()] for row in parts]
            sha = [hashlib.sha256(" ".join(p[2] for p in row).encode()).hexdigest() for row in parts]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in others), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(sha, pa.string())], [*others, "n_tokens", "ids", "decoded_sha256"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return map_arrow(docs, run, "".join(f"`{c}` {kinds[c]}, " for c in others) + "n_tokens long, ids array<int>, decoded_sha256 string")
