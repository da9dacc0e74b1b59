"""Pseudorandom permutations of 0 .. n-1 as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
WALK = 64


def permuted(x: Column, n: Column, *seed: Column | int) -> Column:
    """Image of x under a bijection of 0 .. n-1 that the seed chooses.

    An unbalanced Feistel network permutes a rectangle of a columns and b rows with a * b >= n and a * b - n < a; images
    outside are sent through it again until they fall inside (cycle walking), which takes one more step for a share of at
    most 1 in b.
    """
    a = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double")))).cast("long")
    b = F.greatest(F.lit(1), F.ceil(n / a)).cast("long")
    seeds = [s if isinstance(s, Column) else F.lit(s) for s in seed]

    def shuffled(v: Column) -> Column:
        left, right = F.floor(v / b).cast("long"), v % b
        for k in range(ROUNDS):
            if k % 2 == 0:
                left = (left + F.pmod(F.xxhash64(F.lit(k), right, *seeds), a)) % a
            else:
                right = (right + F.pmod(F.xxhash64(F.lit(k), left, *seeds), b)) % b
        return left * b + right

    steps = F.sequence(F.lit(1), F.lit(WALK))
    return F.aggregate(steps, shuffled(x), lambda v, _: F.when(v < n, v).otherwise(shuffled(v)))
