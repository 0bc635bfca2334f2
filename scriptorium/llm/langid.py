"""Language identification by string kernels.

The kernel of two texts is the blended spectrum: how many hashed character n-grams of lengths 1 to 4 both have, divided
by the geometric mean of their own numbers, over a dictionary of the n-grams that most sample texts have. Landmark texts
give a Nyström map, in which one-versus-rest kernel ridge regression is solved. The kernel is linear in presence vectors,
so landmarks, map and weights fold into one matrix, and a batch of texts is scored by one matrix product.

The model is fitted on at most `fit_rows` labelled rows, those with the smallest hashes of their ids.

Null texts and texts without a letter (a character of a Unicode letter category; ½ or Ⅷ are none) are `und` with score 0. Texts of any length are read whole. Ties go to the first
language in order. With nothing to learn from, every text is `und`. Repeated rows score alike; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import map_arrow

#: Labelled rows, landmarks, n-grams of the dictionary, ridge, and the sharpness of scores.
FIT_ROWS, LANDMARKS, GRAMS, RIDGE, SHARPNESS = 6_000, 256, 8_191, 1e-3, 4.0
#: n-grams are hashed to this many bits.
BITS, LONGEST = 20, 4


def hashed(text: str) -> list[np.ndarray]:
    """The hashed n-grams of each length, lower-case, runs of other characters than letters as one blank."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.concatenate(([32], np.where(c < 65, 32, c), [32])).astype(np.uint32)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(LONGEST):
        h = h[: len(c) - n] * np.uint32(0x9E3779B1) + c[n:] + np.uint32(n + 1)
        out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    return out


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS, np.int32)
    for b in batches:
        for t in b.column("text").to_pylist():
            seen = np.zeros(1 << BITS, bool)
            for h in hashed(t or ""):
                seen[h] = True
            total += seen
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["gram", "n"])


def presence(texts: list[str], place: np.ndarray, size: int) -> np.ndarray:
    """Rows of presence flags over the dictionary; place maps hashes to 1 + position, 0 if absent."""
    out = np.zeros((len(texts), size + 1), np.uint8)
    for row, t in zip(out, texts, strict=True):
        for h in hashed(t):
            row[place[h]] = 1
    return out[:, 1:]


def _present(place: np.ndarray, size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags = presence([t or "" for t in b.column("text").to_pylist()], place, size)
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("lang"), pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())], ["h", "lang", "flags"])

    return run


@dataclass
class Model:
    langs: list[str]
    place: np.ndarray
    weights: np.ndarray

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Languages and scores; the scores of a text's languages sum to 1."""
        if not self.langs or not texts:
            return ["und"] * len(texts), [0.0] * len(texts)
        x = presence(texts, self.place, len(self.weights)).astype(np.float32)
        norm = np.sqrt(np.maximum(x.sum(axis=1), 1))
        s = SHARPNESS * (x @ self.weights) / norm[:, None]
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        ok = [any(map(str.isalpha, t)) for t in texts]  # a character of a letter category
        return [self.langs[i] if k else "und" for i, k in zip(best, ok, strict=True)], [float(p[r, i]) if k else 0.0 for r, (i, k) in enumerate(zip(best, ok, strict=True))]


def solve(flags: np.ndarray, langs: list[str], place: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström landmarks are taken in turn from each language, in the rows' order."""
    kinds = sorted(set(langs))
    x = flags.astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    rows = {k: [i for i, v in enumerate(langs) if v == k] for k in kinds}
    turns = sorted((turn, k, i) for k in kinds for turn, i in enumerate(rows[k]))
    z = x[[i for _, _, i in turns[:landmarks]]]
    k_mm = (z @ z.T).astype(np.float64)
    value, vector = np.linalg.eigh(k_mm)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    features = (x @ z.T).astype(np.float64) @ root
    y = np.where(np.array(langs)[:, None] == np.array(kinds), 1.0, -1.0)
    # Each language weighs the same, however many rows it has.
    w = np.array([1 / len(rows[v]) for v in langs]) * len(langs) / len(kinds)
    a = np.linalg.solve(features.T @ (features * w[:, None]) + ridge * len(langs) * np.eye(features.shape[1]), features.T @ (y * w[:, None]))
    return Model(kinds, place, (z.T @ (root @ a)).astype(np.float32))


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, grams: int = GRAMS) -> Model:
    """The model of rows (doc_id, text, lang); rows without text or language are left out."""
    rows = labelled.where("lang is not null and text is not null").select(F.xxhash64("doc_id").alias("h"), "lang", "text")
    limit = rows.select("h").orderBy("h").limit(fit_rows).agg(F.max("h")).first()[0]
    if limit is None:
        return Model([], np.zeros(1 << BITS, np.int16), np.zeros((0, 0), np.float32))
    sample = rows.where(F.col("h") <= limit)
    top = map_arrow(sample.select("text"), _frequencies, "gram int, n long", 64).groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "gram").limit(grams).collect()
    place = np.zeros(1 << BITS, np.int16)
    place[[r.gram for r in top]] = np.arange(1, len(top) + 1)
    got = map_arrow(sample, _present(place, len(top)), "h long, lang string, flags binary", 64).orderBy("h", "lang", "flags").limit(fit_rows).collect()
    flags = np.array([np.unpackbits(np.frombuffer(r.flags, np.uint8), count=len(top)) for r in got])
    return solve(flags, [r.lang for r in got], place)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows (doc_id, held_out, text) as doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs, scores = m.score([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "held_out", "text"), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double", 256)
