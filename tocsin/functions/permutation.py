"""A keyed permutation of the numbers below n, computed number by number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tocsin.functions.keys import key_to_long, seeded_key

ROUNDS = 6
#: Steps back into the range. A number is outside with odds of at most a half, for n of a million 0.2 percent.
WALKS = 64


def permuted(i: Column, n: Column, seed: int | str, rounds: int = ROUNDS) -> Column:
    """Image of ``i`` under a permutation of 0 .. n - 1 that ``seed`` chooses.

    The number is written with two digits in bases whose product is n or
    slightly more. Each round adds a hash of one digit to the other one, which
    can be undone, so all of it is one to one (a Feistel network). An image of
    n or more is mapped again until it is below n, which keeps it one to one.
    No row needs to know of another: there is no sort, window or shuffle, at
    any size. Null, negative and too large numbers give null.
    """
    high = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    low = F.greatest(F.ceil(n / high).cast("long"), F.lit(1).cast("long"))

    def mixed(s: Column, k: Column) -> Column:
        first = F.pmod(s["h"] + key_to_long(seeded_key(seed, k, s["l"])), high)
        second = F.pmod(s["l"] + key_to_long(seeded_key(seed, k, s["h"])), low)
        even = k % 2 == 0
        return F.struct(F.when(even, first).otherwise(s["h"]).alias("h"), F.when(even, s["l"]).otherwise(second).alias("l"))

    def once(x: Column) -> Column:
        digits = F.struct(F.floor(x / low).cast("long").alias("h"), F.pmod(x, low).cast("long").alias("l"))
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(rounds - 1)), digits, mixed, lambda s: s["h"] * low + s["l"]
        )

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(i), lambda y, _: F.when(y >= n, once(y)).otherwise(y))
    sure = F.when(walked < n, walked).otherwise(F.raise_error(F.lit("permutation left its range")).cast("long"))
    return F.when((i >= 0) & (i < n), sure)
