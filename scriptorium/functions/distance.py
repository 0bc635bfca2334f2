"""Approximate substring distance as columns: the fewest edits that turn a query into some substring of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a query whose states fit the bits of a long, one left for carries.
WORD = 62


def characters(text: Column) -> Column:
    """A text's characters, whole code points each."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _automaton(text: Column, query: str) -> Column:
    """All alignments of the query's beginnings side by side in the bits of two numbers: where the distance rises, and where it falls, by
    one from one beginning to the next. A character of the text takes one step of the automaton; the distance of the whole query follows its last bit."""
    n = len(query)
    full, last = (1 << n) - 1, n - 1
    places = {c: sum(1 << i for i, x in enumerate(query) if x == c) for c in dict.fromkeys(query)}
    held = F.create_map(*[F.lit(x) for c, b in places.items() for x in (c, b)])
    bit = lambda x: F.shiftrightunsigned(x, last).bitwiseAND(F.lit(1))
    flip = lambda x: x.bitwiseXOR(F.lit(full))  # noqa: E731  within the query's bits

    def step(s: Column, c: Column) -> Column:
        hit = F.coalesce(F.try_element_at(held, c), F.lit(0).cast("long"))
        up, down = s["up"], s["down"]
        diagonal = (hit.bitwiseAND(up) + up).bitwiseAND(F.lit(full)).bitwiseXOR(up).bitwiseOR(hit)
        rise = down.bitwiseOR(flip(diagonal.bitwiseOR(up)))
        fall = up.bitwiseAND(diagonal)
        score = (s["score"] + bit(rise) - bit(fall)).cast("int")
        rise, fall = (F.shiftleft(x, 1).bitwiseAND(F.lit(full)) for x in (rise, fall))
        across = hit.bitwiseOR(down)
        return F.struct(
            fall.bitwiseOR(flip(across.bitwiseOR(rise))).alias("up"), rise.bitwiseAND(across).alias("down"),
            score.alias("score"), F.least(s["best"], score).alias("best"),
        )

    start = F.struct(F.lit(full).cast("long").alias("up"), F.lit(0).cast("long").alias("down"), F.lit(n).alias("score"), F.lit(n).alias("best"))
    return F.aggregate(characters(text), start, step, lambda s: s["best"])


def _rows(text: Column, query: str) -> Column:
    """The same by rows of distances of the query's beginnings, for queries of any length."""
    n = len(query)
    letters = F.array(*[F.lit(c) for c in query])

    def step(s: Column, c: Column) -> Column:
        old = s["row"]
        # Without insertions first; those are a running minimum, less the place.
        base = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda j: F.when(j == 0, 0).otherwise(F.least(F.get(old, j - 1) + (F.get(letters, j - 1) != c).cast("int"), F.get(old, j) + 1)) - j)
        low = F.aggregate(base, F.array().cast("array<int>"), lambda a, x: F.array_append(a, F.least(x, F.coalesce(F.try_element_at(a, F.lit(-1)), x))))
        row = F.transform(low, lambda x, j: x + j)
        return F.struct(row.alias("row"), F.least(s["best"], F.get(row, n)).alias("best"))

    start = F.struct(F.sequence(F.lit(0), F.lit(n)).alias("row"), F.lit(n).alias("best"))
    return F.aggregate(characters(text), start, step, lambda s: s["best"])


def substring_distance(text: str | Column, query: str) -> Column:
    """The fewest insertions, deletions and substitutions between the query and any substring of the text, the empty one too.

    Null for a null text; 0 for the empty query. Its time is a step for each character, whatever the query's length up to
    WORD characters.
    """
    t = F.col(text) if isinstance(text, str) else text
    if not query:
        return F.when(t.isNotNull(), 0)
    return (_automaton if len(query) <= WORD else _rows)(t, query)
