"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame and SQL functions only.

A text is the set of digests of its paragraphs: lines, cut further after sentence ends. Its sketch has 1, 2, 4, ... groups,
the least power of two that leaves at most `GROUP` digests a group on average; bits of a digest say its group. A group has
three rows of cells; each digest falls into one cell of a row, and a cell has the number, the exclusive or and the checks
of its digests. This sketch, written out, is the fingerprint: `groups/digests/`, then for each group with digests its
number and its cells. Group g of a sketch and group g + groups / 2 add up to group g of the sketch of half the size.

Two versions' sketches of one size subtract cell by cell, which cancels what both have. A cell left with one digest, as
its check shows, gives that digest; taking it out of its other cells lays open more, until all cells are empty and the
differing digests are known. Where two sizes differ, the text of the smaller sketch is sketched again at the larger size. A
group whose peeling stops early is sketched again for both versions with more cells, by the ladder `CELLS`; `retried` and
`compared` count such groups, and those that no sketch of the ladder could tell apart, whose digests are compared. Likeness
is the share of common digests in all: 1 for equal sets (two empty ones too), 0 for disjoint.

The next document is found without one sorted table: rows are ordered by id, then by the hash of their text, and cut into
ranges; an id with the rows of several ranges is cut by the hash. A range's first rows also go to the range before, the
first of all to the last. Cuts and first rows are tables of at most `MOST_RANGES` rows.

Null texts are empty texts; a null id comes first in order and stays null. An empty table gives an empty result; a lone
document is its own next. Repeated rows are rows of their own and next to each other. Texts are read whole, and extra
columns are ignored.
"""

from __future__ import annotations

import math
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Where paragraphs are cut (a pattern within an SQL string); documents of a range, most ranges; digests of a group; cells in a row, by try.
PARAGRAPHS, RANGE, MOST_RANGES, GROUP, CELLS = r"(?<=[.!?])\\s+|\\n", 500, 200_000, 4, (2, 8, 32, 128)
#: Bits of a digest between two rows' cells, and from which its group is read.
ROW_BITS, GROUP_BITS = 7, 24
#: Cells of a row above which most are empty for a group, so that only the others are made.
WIDE = 8
#: Seed of the check of a digest; rounds of peeling.
CHECK, ROUNDS = 77, 12
FIRST = -(2**63)


def digests(text: str) -> str:
    """The distinct digests of a text's paragraphs."""
    return f"array_distinct(transform(filter(split({text}, '{PARAGRAPHS}'), p -> p <> ''), p -> xxhash64(p)))"


def groups_of(n: str) -> str:
    """Groups of the sketch of n digests."""
    return f"case when {n} <= {GROUP} then 1 else shiftleft(1, length(bin(({n} - 1) div {GROUP}))) end"


def group_of(k: str, groups: str) -> str:
    return f"cast(shiftright({k}, {GROUP_BITS}) & ({groups} - 1) as int)"


def marked(keys: str, width: int, c: int = 1) -> str:
    """An array of digests with their number, their checks and the three cells that each falls into."""
    at = ", ".join(f"{r * width} + cast(shiftright(k, {ROW_BITS * r}) & {width - 1} as int)" for r in range(3))
    return f"transform({keys}, k -> named_struct('c', {c}, 'k', k, 'h', xxhash64(k, {CHECK}), 'at', array({at})))"


def sketch(keys: str, cells: int) -> str:
    """The cells of an array of digests: three rows, one after the other."""
    mine = f"(shiftright(k, cast({ROW_BITS} * (i div {cells}) as int)) & {cells - 1}) = i % {cells}"
    return f"transform(sequence(0, {3 * cells - 1}), i -> aggregate(filter({keys}, k -> {mine}), named_struct('c', 0, 'k', 0L, 'h', 0L), (s, k) -> named_struct('c', s.c + 1, 'k', s.k ^ k, 'h', s.h ^ xxhash64(k, {CHECK}))))"


def subtract(a: str, b: str) -> str:
    """The cells of two sketches' difference, with their places."""
    return f"transform(zip_with({a}, {b}, (x, y) -> named_struct('c', x.c - y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h)), (x, i) -> named_struct('i', i, 'c', x.c, 'k', x.k, 'h', x.h))"


def difference(a: str, b: str, width: int) -> str:
    """What subtract() gives of the sketches of two arrays of digests, without the cells that none of them falls into: these are empty in both."""
    cell = "aggregate(filter(m, p -> array_contains(p.at, i)), named_struct('i', i, 'c', 0, 'k', 0L, 'h', 0L), (s, p) -> named_struct('i', s.i, 'c', s.c + p.c, 'k', s.k ^ p.k, 'h', s.h ^ p.h))"
    return f"transform(array(concat({marked(a, width)}, {marked(b, width, -1)})), m -> transform(array_distinct(flatten(transform(m, p -> p.at))), i -> {cell}))[0]"


def peel(cells: str, width: int) -> str:
    """A state with what is left of the cells and the digests found, each with 1 or -1 for the version that has it.

    Steps take turns: one finds the pure cells, the next takes their digests out of all cells.
    """
    hit = f"(shiftright(p.k, cast({ROW_BITS} * (x.i div {width}) as int)) & {width - 1}) = x.i % {width}"
    pure = f"array_distinct(transform(filter(s.cells, x -> abs(x.c) = 1 and x.h = xxhash64(x.k, {CHECK})), x -> named_struct('c', x.c, 'k', x.k)))"
    taken = f"transform(s.cells, x -> aggregate(filter(s.pure, p -> {hit}), x, (y, p) -> named_struct('i', y.i, 'c', y.c - p.c, 'k', y.k ^ p.k, 'h', y.h ^ xxhash64(p.k, {CHECK}))))"
    none = "array()"
    kind = "array<struct<c:int,k:bigint>>"
    state = lambda live, cells, pure, found: f"named_struct('live', {live}, 'cells', {cells}, 'pure', cast({pure} as {kind}), 'found', cast({found} as {kind}))"
    step = f"case when not s.live then s when r % 2 = 1 then {state('true', 's.cells', pure, 's.found')} when size(s.pure) = 0 then {state('false', 's.cells', none, 's.found')} else {state('true', taken, none, 'concat(s.found, s.pure)')} end"
    return f"aggregate(sequence(1, {2 * ROUNDS}), {state('true', cells, none, none)}, (s, r) -> {step})"


def complete(state: str) -> str:
    return f"forall({state}.cells, x -> x.c = 0 and x.k = 0 and x.h = 0)"


def differing(df: DataFrame, a: str, b: str, out: str, first: tuple[str, str] | None = None) -> DataFrame:
    """The differing digests of two columns of digests, by sketches that grow until peeling is complete, and the number of
    tries beyond the first in the column `{out}_tries`; one more than the ladder has if the digests had to be compared.
    `first`: the columns with the smallest sketches of both, if these are there; of two empty lists they may be others."""
    state, tries = f"{out}_state", f"{out}_tries"
    for n, width in enumerate(CELLS):
        # Two empty lists leave nothing to peel.
        tried = peel(f"case when size({a}) + size({b}) = 0 then array() else {subtract(*first) if first and not n else difference(a, b, width) if width > WIDE else subtract(sketch(a, width), sketch(b, width))} end", width)
        if n:
            df = df.withColumn(tries, F.expr(f"case when {complete(state)} then {tries} else {n} end")).withColumn(state, F.expr(f"case when {tries} < {n} then {state} else {tried} end"))
        else:
            df = df.withColumn(state, F.expr(tried)).withColumn(tries, F.lit(0))
    df = df.withColumn(tries, F.expr(f"case when {complete(state)} then {tries} else {len(CELLS)} end"))
    return df.withColumn(out, F.expr(f"case when {tries} < {len(CELLS)} then transform({state}.found, x -> x.k) else array_union(array_except({a}, {b}), array_except({b}, {a})) end")).drop(state)


def ranged(keyed: DataFrame, rows: int) -> DataFrame:
    """The rows (key, h) with the range that they are in, in order of key, then h; ranges may be empty."""
    ranges = max(1, min(MOST_RANGES, math.ceil(keyed.count() / rows)))
    if ranges == 1:
        return keyed.withColumn("range", F.lit(0))
    shares = [i / ranges for i in range(1, ranges)]
    # A cut that occurs m > 1 times is an id with the rows of m - 1 ranges or more: it is cut in m by the hash.
    cuts, seen = [], 0
    for value, same in groupby(sorted(keyed.agg(F.percentile_approx("key", shares, max(10_000, 20 * ranges))).first()[0])):
        times = len(list(same))
        cuts.append((value, seen, times))
        seen += times
    width = math.isqrt(len(cuts)) + 1
    fine = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    table = keyed.sparkSession.createDataFrame([(1, [c[0][0] for c in fine], fine)], "one int, heads array<bigint>, fine array<array<struct<v:bigint,before:int,times:int>>>")
    met = keyed.withColumn("one", F.lit(1)).join(F.broadcast(table), "one")  # one row of at most MOST_RANGES cuts
    met = met.withColumn("part", F.expr("element_at(fine, greatest(1, size(filter(heads, x -> x <= key))))"))
    met = met.withColumn("cut", F.expr("try_element_at(part, nullif(size(filter(part, x -> x.v <= key)), 0))"))
    # The hash as a number from 0 to 1; rows of a key above the cut lie behind all of its ranges.
    share = "(shiftrightunsigned(h ^ shiftleft(1L, 63), 11) / 9007199254740992D)"
    place = f"case when cut is null then 0 when cut.v < key or cut.times = 1 then cut.before + cut.times else cut.before + 1 + cast(floor({share} * cut.times) as int) end"
    return met.withColumn("range", F.expr(place)).select(*keyed.columns, "range")


def with_next(docs: DataFrame, rows: int | None = None) -> DataFrame:
    """doc_id, text, the next document's text, and digests of both; a range and a row's place in it name a row."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("key"))
    placed = ranged(keyed.withColumn("h", F.xxhash64("text")), rows or RANGE)
    # At most MOST_RANGES rows: each range's first row, and the range before it that has rows.
    firsts = placed.groupBy("range").agg(F.min(F.struct("key", "h")).alias("first"))
    every = Window.orderBy("range")
    firsts = firsts.select("range", "first.key", "first.h", F.lag("range").over(every).alias("before"), F.max("range").over(Window.partitionBy()).alias("last"))
    firsts = firsts.select("range", "key", "h", F.coalesce("before", "last").alias("home"), F.when(F.col("before").isNull(), 2).otherwise(1).alias("turn"))
    copied = placed.join(F.broadcast(firsts), ["range", "key", "h"], "left")
    homes = "filter(array(named_struct('range', range, 'turn', 0), case when home is not null then named_struct('range', home, 'turn', turn) end), x -> x is not null)"
    dealt = copied.select("doc_id", "key", "h", "text", F.explode(F.expr(homes)).alias("home")).select("doc_id", "key", "h", "text", "home.range", "home.turn").repartition("range")
    dealt = dealt.withColumn("a", F.expr(digests("text")))
    over = "over (partition by range order by turn, key, h)"
    return dealt.selectExpr("doc_id", "text", "range", "turn", "a", f"row_number() {over} as place", f"lead(text) {over} as next_text", f"lead(a) {over} as n").where("turn = 0").drop("turn")


def written(cells: str) -> str:
    """A group's cells in hexadecimal: two digits of the number, sixteen of the digests, eight of the checks."""
    return "lower(concat(" + ",".join(f"lpad(hex({cells}[{i}].c & 255), 2, '0'), lpad(hex({cells}[{i}].k), 16, '0'), lpad(hex({cells}[{i}].h & 4294967295L), 8, '0')" for i in range(3 * CELLS[0])) + "))"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document, and how
    many groups were sketched again or compared.

    The edited text is the text with its last quarter replaced by as much of the next document's beginning.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 4 as int)), left(coalesce(next_text, ''), cast(n_chars div 4 as int)))"))
    rows = rows.select("doc_id", "range", "place", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), "a", F.expr(digests("edited")).alias("e"), F.expr("coalesce(n, array())").alias("n"))
    for c in "aen":
        rows = rows.withColumn(f"n_{c}", F.size(c)).withColumn(f"g_{c}", F.expr(groups_of(f"n_{c}")))
    # A pair is compared at the larger of both sizes.
    rows = rows.withColumn("g_edited", F.greatest("g_a", "g_e")).withColumn("g_next", F.greatest("g_a", "g_n"))
    sizes = ("g_a", "g_e", "g_edited", "g_next")
    wants = {"a": ("g_a", "g_edited", "g_next"), "e": ("g_e", "g_edited"), "n": ("g_next",)}
    entry = lambda c: f"flatten(transform(array_distinct(array({', '.join(wants[c])})), s -> transform({c}, k -> named_struct('k', k, 'of', '{c}', 'size', s))))"
    meta = ("doc_id", "n_chars", "sha", "n_a", "n_e", "n_n")
    rows = rows.select("range", "place", *meta, *sizes, F.expr(f"posexplode_outer(concat({entry('a')}, {entry('e')}, {entry('n')}))").alias("at", "entry"))
    rows = rows.selectExpr("range", "place", *sizes, "entry.k as k", "entry.of as of", "entry.size as size", f"{group_of('entry.k', 'entry.size')} as g", *(f"case when coalesce(at, 0) = 0 then {c} end as {c}" for c in meta))
    groups = rows.groupBy("range", "place", *sizes, "size", "g").agg(*(F.expr(f"collect_list(case when of = '{c}' then k end)").alias(c) for c in "aen"), *(F.max(c).alias(c) for c in meta))
    groups = groups.withColumns({f"{c}_first": F.expr(sketch(c, CELLS[0])) for c in "aen"})
    for c in "ae":
        groups = groups.withColumn(f"{c}_cells", F.expr(f"case when size = g_{c} and size({c}) > 0 then {c}_first end"))
        groups = groups.withColumn(f"{c}_text", F.expr(f"case when {c}_cells is not null then concat(lower(hex(g)), ':', {written(f'{c}_cells')}) end"))
    for other, out in (("e", "edited"), ("n", "next")):
        # Empty lists differ in nothing, so groups of another size cost next to nothing.
        one, two = (f"case when size = g_{out} then {c} else cast(array() as array<bigint>) end" for c in ("a", other))
        groups = differing(groups.withColumn("one", F.expr(one)).withColumn("two", F.expr(two)), "one", "two", out, ("a_first", f"{other}_first"))
    per = [F.expr(f"array_join(transform(array_sort(collect_list(case when {c}_text is not null then named_struct('g', g, 't', {c}_text) end)), x -> x.t), '.')").alias(f"{c}_text") for c in "ae"]
    per += [F.sum(F.size(c)).alias(c) for c in ("edited", "next")]
    per += [F.sum(F.expr(f"cast(edited_tries {test} as long) + cast(next_tries {test} as long)")).alias(c) for c, test in (("retried", "> 0"), ("compared", f"= {len(CELLS)}"))]
    docs_ = groups.groupBy("range", "place", *sizes).agg(*per, *(F.max(c).alias(c) for c in meta))
    like = lambda other, apart: f"case when n_a + n_{other} = 0 then 1.0D else (n_a + n_{other} - {apart}) / cast(n_a + n_{other} + {apart} as double) end"
    text_of = lambda c: f"concat(g_{c}, '/', n_{c}, '/', {c}_text)"
    return docs_.selectExpr("doc_id", "n_chars", "sha as edited_sha256", f"{text_of('a')} as fingerprint", f"{text_of('e')} as edited_fingerprint", f"{like('e', 'edited')} as near_edited", f"{like('n', 'next')} as near_next", "retried", "compared")
