"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import checkpointed, discard


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (u, v); the component is its least node. It reads a table, for discard().

    Repeated edges count once, an edge with a null or of a node to itself is none, and no edges give no rows. Nodes of high
    degree are one key in two joins of a round; partial aggregates cut their rows first, and adaptive execution splits the rest.

    Each round is a table in the shared folder, which replaces the one before. The number of rounds grows with the logarithm of the longest path;
    if `rounds` is not enough, an error says so, as a partial answer would lose links.
    """
    now = checkpointed(edges.select("u", "v").where("u <> v").distinct())  # nulls fail the comparison
    before = None
    for _ in range(rounds):
        last, now = now, checkpointed(_small_star(_large_star(now)))
        discard(last)
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components: more rounds needed")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
    found.kept_at = now.kept_at
    return found
