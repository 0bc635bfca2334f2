"""Pages of a random order by a keyed permutation of positions: a page is found without sorting or drawing for all rows."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of the permutation, and the prime of its coins.
ROUNDS, PRIME = 40, (1 << 31) - 1


class Permutation:
    """A bijection of 0 .. n - 1 by a seed. In each round a position and its mirror about a round's own number are a pair, and a coin of the pair
    decides whether they swap; so each round undoes itself, and any n will do."""

    def __init__(self, n: int, seed: int, rounds: int = ROUNDS):
        rnd = random.Random(seed)
        self.n = n
        #: Of each round: the mirror's number as a share of 2^30, a factor and a summand of its coin.
        self.rounds = [(rnd.randrange(1 << 30), rnd.randrange(1, PRIME), rnd.randrange(PRIME)) for _ in range(rounds)]

    def __call__(self, position: int) -> int:
        """The place of the row that the order has at a position."""
        x = position
        for u, a, b in self.rounds:
            y = ((u * self.n >> 30) - x) % self.n
            top = max(x, y)
            if ((top % PRIME * a + b) % PRIME >> 12) & 1:
                x = y
        return x

    def position(self, place: str | Column) -> Column:
        """Where the order has the row of a place: the rounds backwards."""
        rounds = F.array(*[F.struct(F.lit(u * self.n >> 30).cast("long").alias("k"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for u, a, b in reversed(self.rounds)])

        def step(x: Column, r: Column) -> Column:
            y = F.pmod(r["k"] - x, F.lit(self.n))
            coin = F.shiftright((F.greatest(x, y) % PRIME * r["a"] + r["b"]) % PRIME, 12).bitwiseAND(F.lit(1))
            return F.when(coin == 1, y).otherwise(x)

        c = F.col(place) if isinstance(place, str) else place
        return F.aggregate(rounds, c.cast("long"), step)


def random_page(rows: DataFrame, place: str, n: int, seed: int, page: int, size: int = 48) -> DataFrame:
    """The rows of a page (from 0) of a random order, with `slot`, their place on it. `place` is a column of positions from 0 to n - 1.

    Pages of one seed are disjoint and together all rows. A page asks for `size` places by name, so a table in order of its places is read in part.
    """
    order = Permutation(n, seed)
    wanted = {order(p): p - page * size for p in range(page * size, min((page + 1) * size, n))}
    found = rows.where(F.col(place).isin(list(wanted)))
    if not wanted:
        return found.withColumn("slot", F.lit(0))
    slots = F.create_map(*[F.lit(x).cast("long") for pair in wanted.items() for x in pair])
    return found.withColumn("slot", F.try_element_at(slots, F.col(place).cast("long")).cast("int"))


def in_random_order(rows: DataFrame, place: str, n: int, seed: int) -> DataFrame:
    """All rows in the order that random_page() cuts."""
    return rows.orderBy(Permutation(n, seed).position(place)) if n else rows
