"""Merkle dataset manifest with octopus multiproofs.

Every row is a leaf: a digest of its fields. The leaves of a group form a tree of runs of `ARITY` nodes, and the groups'
roots, the subroots, form one more tree above. Leaves are dealt by range, so that a leaf's place is the rows of its group
in the ranges before plus its place in its own, and no task sorts or counts a whole group. A tree grows by `LEVELS` levels
at a time: a block of ARITY ^ LEVELS consecutive nodes is one task's group. All nodes above the leaves are a table.

Proofs are made by leaf partition, a block of leaves (and of the leaves of the tree above). A partition walks up from its
leaves and notes the coordinates of siblings that it can't derive: the least set of nodes from which all its leaves'
proofs follow. These are fetched once, in one join; interiors that its leaves share are derived once; then each leaf's own
proof is spelled out in the partition. So siblings far up are fetched once for up to ARITY ^ LEVELS leaves. The few nodes of
levels with at most `FEW` in all are broadcast, as every partition asks for them; of the others each is asked for by few.

`manifest` builds the trees, `prove` gives proofs for all leaves or any set of them, `fold` recomputes a root from a leaf
and its proof.

Nulls in a field have a digest of their own; a null id comes first in its group and counts as the empty text where rows are
drawn for tampering. Leaves of equal ids are in order of their digests; repeated rows are leaves of their own. Texts of
any length are hashed whole. A group of one leaf is its own subroot, one group's subroot is the root, and a proof may be
empty. An empty table gives an empty result, and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import checkpointed, crc_mod, discard, map_arrow

#: Nodes of a run; levels that a block spans; nodes of levels that are broadcast.
ARITY, LEVELS, FEW = 8, 4, 65_536
BLOCK = ARITY**LEVELS
#: The group of the tree over subroots; groups of rows begin with another letter.
TOP = "^"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: str | Column) -> Column:
    """A field's part of a leaf: its length in bytes, a colon and its text; a dash for null."""
    v = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf(**instead: Column) -> Column:
    """A row's digest as hex text, some of its fields replaced."""
    return F.sha2(F.concat(*[field(instead.get(f, F.col(f))) for f in FIELDS]), 256)


def ascii_lower(c: str) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parent(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def width(n: int, level: int) -> int:
    """Nodes of a level."""
    for _ in range(level):
        n = -(-n // ARITY)
    return n


def missing(places: np.ndarray, n: int, known: int = 0) -> list[tuple[int, int]]:
    """The octopus: (level, place) of the nodes that are needed beside some nodes of a level for all their paths, none derivable."""
    out, own, level, n = [], np.unique(places), known, width(n, known)
    while n > 1:
        runs = np.unique(own // ARITY)
        whole = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        whole = whole[whole < n]
        out += [(level, int(p)) for p in np.setdiff1d(whole, own, assume_unique=True)]
        own, level, n = runs, level + 1, -(-n // ARITY)
    return out


class Part:
    """A leaf partition's own tree: its nodes and the fetched ones, with interiors derived once."""

    def __init__(self, n: int, leaves: dict[int, str], fetched: dict[tuple[int, int], str]):
        self.n, self.height = n, height(n)
        self.nodes: dict[tuple[int, int], str] = {(0, p): x for p, x in leaves.items()} | fetched
        self.above: dict[tuple[int, int], list[str]] = {(self.height, 0): []}
        own = sorted(leaves)
        for level in range(self.height):
            own = sorted({p // ARITY for p in own})
            for p in own:
                if (level + 1, p) not in self.nodes:
                    self.nodes[level + 1, p] = parent(self.run(level, p))

    def run(self, level: int, above: int) -> list[str]:
        """The digests of the run under a node."""
        return [self.nodes[level, p] for p in range(above * ARITY, min((above + 1) * ARITY, width(self.n, level)))]

    @property
    def root(self) -> str:
        return self.nodes[self.height, 0]

    def proof(self, level: int, place: int) -> list[tuple[int, list[str]]]:
        """By level: the node's place in its run, and the run's other digests."""
        path = []
        while level < self.height:
            run = self.run(level, place // ARITY)
            at = place % ARITY
            path.append((at, run[:at] + run[at + 1 :]))
            level, place = level + 1, place // ARITY
        return path


def fold(digest: str, proof: list[tuple[int, list[str]]]) -> str:
    """The root that follows from a digest and its siblings."""
    for at, others in proof:
        digest = parent([*others[:at], digest, *others[at:]])
    return digest


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with `part` and their place `i` within their tree's rows there."""
    part, tree, at = TaskContext.get().partitionId(), None, 0
    for b in batches:
        places = np.empty(b.num_rows, np.int64)
        for k, t in enumerate(b.column("tree").to_pylist()):
            tree, at = t, at + 1 if t == tree else 0
            places[k] = at
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(places)], [*b.schema.names, "part", "i"])


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with `place` from 0 in order within their `tree`, and `n`, the tree's rows. It reads a table, for discard()."""
    laid = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    kept = checkpointed(map_arrow(laid, _numbered, f"{kinds}, part int, i long", rows=4096))
    counts = kept.groupBy("tree", "part").agg(F.count("*").alias("m"))  # a row for each tree and range that meet
    w = Window.partitionBy("tree")
    before = counts.select("tree", "part", F.coalesce(F.sum("m").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("m").over(w).alias("n"))
    found = kept.join(before, ["tree", "part"]).withColumn("place", F.col("i") + F.col("before")).drop("part", "i", "before")
    found.kept_at = kept.kept_at
    return found


def _grown(level: int):
    """The nodes of the next levels over a block of nodes."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        tree, n = key[0].as_py(), group.column("n")[0].as_py()
        order = np.argsort(group.column("place").to_numpy())
        first, now = int(group.column("place")[int(order[0])].as_py()), [group.column("digest")[int(i)].as_py() for i in order]
        rows, at = [], level
        while at < level + LEVELS and width(n, at) > 1:
            now, first, at = [parent(now[i : i + ARITY]) for i in range(0, len(now), ARITY)], first // ARITY, at + 1
            rows += [(at, first + i, x) for i, x in enumerate(now)]
        return pa.table([pa.array([tree] * len(rows), pa.string()), pa.array([n] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["tree", "n", "level", "place", "digest"])

    return run


NODES = "tree string, n long, level int, place long, digest string"


def grown(leaves: DataFrame) -> list[DataFrame]:
    """Tables of all nodes above leaves (tree, n, place, digest), each of up to LEVELS levels. discard() deletes them."""
    tables, level = [], 0
    most = leaves.agg(F.max("n")).first()[0] or 0
    now = leaves.select("tree", "n", "place", "digest")
    while width(most, level) > 1:
        some = now.where(F.col("n") > ARITY**level)  # trees that end below are whole
        tables.append(checkpointed(some.groupBy("tree", F.floor(F.col("place") / BLOCK).alias("block")).applyInArrow(_grown(level), NODES)))
        level += LEVELS
        now = tables[-1].where(F.col("level") == level)
    return tables


@dataclass
class Manifest:
    """Leaves (tree, place, n, digest and the rows' own columns), nodes above them, subroots as leaves of the top tree, and the root."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None
    tables: list[DataFrame]

    def discard(self) -> None:
        discard(*self.tables)


def _roots(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, digest) of every tree's root."""
    ends = F.col("n") <= F.pow(F.lit(float(ARITY)), F.col("level"))
    alone = leaves.where("n = 1").select("tree", "digest")
    return alone.unionByName(nodes.where(ends & (F.col("place") == 0)).select("tree", "digest"))


def _united(spark, tables: list[DataFrame]) -> DataFrame:
    out = spark.createDataFrame([], NODES)
    for t in tables:
        out = out.unionByName(t)
    return out


def manifest(rows: DataFrame, group: str, order: str) -> Manifest:
    """Trees over rows with a `digest`: one for each value of a column, null too, its leaves in order of another."""
    spark = rows.sparkSession
    # Null first, then values by their bytes.
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = placed(rows.withColumn("tree", tree), order, "digest")
    own = grown(leaves)
    nodes = _united(spark, own)
    tops = placed(_roots(leaves, nodes).select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "digest"), "of")
    above = grown(tops)
    nodes = nodes.unionByName(_united(spark, above))
    root = _roots(tops, _united(spark, above)).first()
    return Manifest(leaves, nodes, tops, root.digest if root else None, [leaves, *own, tops, *above])


def _asked(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """The coordinates that a partition must fetch, in its own tree and in the top tree."""
    own = [(False, level, p) for level, p in missing(group.column("place").to_numpy(), group.column("n")[0].as_py())]
    own += [(True, level, p) for level, p in missing(group.column("top_place").to_numpy()[:1], group.column("top_n")[0].as_py())]
    n = len(own)
    return pa.table([pa.array([key[0].as_py()] * n, pa.string()), pa.array([key[1].as_py()] * n, pa.int64()), pa.array([x[0] for x in own], pa.bool_()), pa.array([x[1] for x in own], pa.int32()), pa.array([x[2] for x in own], pa.int64())], ["of", "block", "top", "level", "at"])


def _spelled(key: tuple[pa.Scalar, ...], group: pa.Table, fetched: pa.Table) -> pa.Table:
    """Each leaf's proof and the root that follows from what its row holds now."""
    near, far = {}, {}
    for top, level, at, digest in zip(*(fetched.column(c).to_pylist() for c in ("top", "level", "at", "digest")), strict=True):
        (far if top else near)[level, at] = digest
    place, digest = group.column("place").to_pylist(), group.column("digest").to_pylist()
    part = Part(group.column("n")[0].as_py(), dict(zip(place, digest, strict=True)), near)
    top_place = group.column("top_place")[0].as_py()
    top = Part(group.column("top_n")[0].as_py(), {top_place: part.root}, far)
    over = top.proof(0, top_place)
    shared: dict[int, list[tuple[int, list[str]]]] = {}
    proofs, folded, n = [], [], []
    for p, now in zip(place, group.column("now").to_pylist(), strict=True):
        run = part.run(0, p // ARITY) if part.height else [part.root]
        if p // ARITY not in shared:
            shared[p // ARITY] = (part.proof(1, p // ARITY) if part.height else []) + over
        own = [(p % ARITY, run[: p % ARITY] + run[p % ARITY + 1 :])] if part.height else []
        path = own + shared[p // ARITY]
        text = "".join(x for _, others in path for x in others)
        proofs.append(sha256(text.encode()).hexdigest())
        folded.append(fold(now, path))
        n.append(len(text) // 64)
    rows = len(place)
    return pa.table(
        [group.column("id"), group.column("digest"), pa.array([part.root] * rows), pa.array([top.root] * rows), pa.array(proofs), pa.array(folded), pa.array([f == top.root for f in folded]), pa.array(n, pa.int64())],
        ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "n_siblings"],
    )


def prove(m: Manifest, leaves: DataFrame) -> DataFrame:
    """Proofs of some leaves of a manifest (its own rows, with `id`, and `now`, the digest that a row has at the time)."""
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_siblings long"
    tops = m.subroots.select(F.col("of").alias("tree"), F.col("place").alias("top_place"), F.col("n").alias("top_n"))
    held = leaves.join(tops, "tree").withColumn("block", F.floor(F.col("place") / BLOCK)).withColumnRenamed("tree", "of")
    asked = checkpointed(held.select("of", "block", "place", "n", "top_place", "top_n").groupBy("of", "block").applyInArrow(_asked, "of string, block long, top boolean, level int, at long"))
    asked_of = asked.withColumn("tree", F.when(F.col("top"), TOP).otherwise(F.col("of")))
    below = m.leaves.select("tree", F.lit(0).alias("level"), F.col("place").alias("at"), "digest")
    tips = m.subroots.select("tree", F.lit(0).alias("level"), F.col("place").alias("at"), "digest")
    nodes = m.nodes.select("tree", "level", F.col("place").alias("at"), "digest").unionByName(tips)
    # Only levels that some partition asks for are read, a few for each tree height; leaves only where a partition lacks some of its own runs.
    level = F.concat_ws(" ", F.when(F.col("tree") == TOP, "top").otherwise("own"), "level")
    levels = [r.level for r in asked_of.select(level.alias("level")).distinct().collect()]
    if "own 0" in levels:
        nodes = nodes.unionByName(below)
    wanted = nodes.where(level.isin(levels))
    few, total = [], 0
    for n, name in sorted((r.n, r.name) for r in wanted.groupBy(level.alias("name")).agg(F.count("*").alias("n")).collect()):
        total += n
        if total <= FEW:
            few.append(name)
    kind = level.isin(few)
    on = ["tree", "level", "at"]
    pick = ["of", "block", "top", "level", "at", "digest"]
    # At most FEW nodes in all.
    fetched = asked_of.where(kind).join(F.broadcast(wanted.where(kind)), on).select(pick).unionByName(asked_of.where(~kind).join(wanted.where(~kind), on).select(pick))
    proven = held.groupBy("of", "block").cogroup(fetched.groupBy("of", "block")).applyInArrow(_spelled, schema)
    kept = checkpointed(proven)
    discard(asked)
    return kept


def audit(docs: DataFrame) -> DataFrame:
    """All rows of documents proven, those whose id 3 divides the checksum of with a text in lower case."""
    fields = docs.select(*FIELDS)
    digest = leaf()
    now = F.when(crc_mod("doc_id", 3) == 0, leaf(text=ascii_lower("text"))).otherwise(digest)
    rows = fields.select(F.col("doc_id").alias("id"), F.col("lang").alias("of_lang"), digest.alias("digest"), now.alias("now"))
    m = manifest(rows, "of_lang", "id")
    found = prove(m, m.leaves)
    m.discard()
    return found
