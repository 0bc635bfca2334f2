"""The older searches' similarities of a text and a query, from 0 to 100, as columns: by the longest common subsequence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.distance import WORD, characters

NAMES = ("ratio", "token_sort_ratio", "token_set_ratio", "partial_ratio")


def _one_at(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _matched(chars: Column, mask, size: Column) -> Column:
    """Length of the longest common subsequence of some characters and a pattern of `size` characters; mask(c) has a bit for each of the
    pattern's places with the character. A zero bit stands for each match so far; a character moves all of them at once."""
    full = _one_at(size) - 1

    def step(open_: Column, c: Column) -> Column:
        hit = open_.bitwiseAND(mask(c))
        return (open_ + hit).bitwiseOR(open_ - hit).bitwiseAND(full)

    return F.aggregate(chars, full, step, lambda x: size - F.bit_count(x))


def _by_rows(chars: Column, pattern: Column) -> Column:
    """The same by rows of lengths, for patterns of any length."""
    at = F.sequence(F.lit(1), F.size(pattern))

    def step(row: Column, c: Column) -> Column:
        base = F.transform(at, lambda j: F.greatest(F.get(row, j), F.get(row, j - 1) + (F.get(pattern, j - 1) == c).cast("int")))
        return F.aggregate(base, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.greatest(x, F.element_at(a, -1))))

    start = F.array_repeat(F.lit(0), F.size(pattern) + 1)
    return F.when(F.size(pattern) > 0, F.aggregate(chars, start, step, lambda row: F.element_at(row, -1))).otherwise(0)


def common(text: Column, query: str) -> Column:
    """Length of the longest common subsequence of a text and a query."""
    if len(query) > WORD:
        return _by_rows(characters(text), F.array(*map(F.lit, query)))
    return _matched(characters(text), _mask_of(query), F.lit(len(query)))


def _mask_of(query: str):
    if not query:
        return lambda c: F.lit(0).cast("long")
    held = F.create_map(*[F.lit(x) for c in dict.fromkeys(query) for x in (c, sum(1 << i for i, q in enumerate(query) if q == c))])
    return lambda c: F.coalesce(F.try_element_at(held, c).cast("long"), F.lit(0).cast("long"))


def _common_of(a: Column, b: Column, most: int) -> Column:
    """Of two texts, of which the second has `most` characters at most."""
    x, y = characters(a), characters(b)
    if most > WORD:
        return _by_rows(x, y)
    mask = lambda c: F.aggregate(F.transform(y, lambda d, i: F.when(d == c, _one_at(i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda m, bit: m.bitwiseOR(bit))
    return _matched(x, mask, F.size(y))


def _share(matched: Column, both: Column) -> Column:
    return F.when(both == 0, 100.0).otherwise(200.0 * matched / both)


def _ratio(text: Column, query: str) -> Column:
    return _share(common(text, query), F.length(text) + len(query))


def _partial(text: Column, query: str) -> Column:
    """The best window of the longer one that is as long as the shorter one."""
    n, chars = len(query), characters(text)
    if n > WORD:
        raise ValueError(f"partial_ratio takes queries of {WORD} characters at most")
    mask, size = _mask_of(query), F.length(text)
    of_text = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: _matched(F.slice(chars, i, F.lit(n)), mask, F.lit(n)))
    cut = lambda i: lambda c: F.call_function("shiftright", mask(c), i).bitwiseAND(_one_at(size) - 1)
    of_query = F.transform(F.sequence(F.lit(0), n - size), lambda i: _matched(chars, cut(i), size))
    best = F.when(size >= n, F.array_max(of_text)).otherwise(F.array_max(of_query))
    return F.when(F.least(size, F.lit(n)) == 0, F.when(size == n, 100.0).otherwise(0.0)).otherwise(100.0 * best / F.least(size, F.lit(n)))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _token_set(text: Column, query: str) -> Column:
    """The best of three: the shared words against each side's own with them, and both sides whole. As all begin with the shared words,
    only the rests need to be compared."""
    mine, own = F.array(*map(F.lit, sorted(set(query.split())))).cast("array<string>"), F.array_distinct(_tokens(text))
    both, left, right = (F.array_join(F.array_sort(x), " ") for x in (F.array_intersect(own, mine), F.array_except(own, mine), F.array_except(mine, own)))
    shared = F.length(both)
    side = lambda rest: F.when((shared > 0) & (F.length(rest) > 0), shared + 1 + F.length(rest)).otherwise(shared + F.length(rest))
    one, two = side(left), side(right)
    front = F.when((shared > 0) & (F.length(left) > 0) & (F.length(right) > 0), shared + 1).otherwise(shared)
    whole = _share(front + _common_of(left, right, len(query)), one + two)
    return F.when(shared > 0, F.greatest(_share(shared, shared + one), _share(shared, shared + two), whole)).otherwise(whole)


def similarity(text: str | Column, query: str, scorer: str = "partial_ratio") -> Column:
    """A scorer of the lower-case text and query; null counts as the empty text.

    ratio: twice the longest common subsequence by both lengths. token_sort_ratio: the same of sorted words. token_set_ratio:
    of shared and own words. partial_ratio: of the best window as long as the shorter one.
    """
    t, q = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), query.lower()
    if scorer == "token_sort_ratio":
        return _ratio(F.array_join(F.array_sort(_tokens(t)), " "), " ".join(sorted(q.split())))
    return {"ratio": _ratio, "token_set_ratio": _token_set, "partial_ratio": _partial}[scorer](t, q)
