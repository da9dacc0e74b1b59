"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row.n, row.x


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every node of the edges (u, v): label is the smallest node reachable.

    Hubs are never gathered: the smallest neighbour comes from a partial aggregate and is joined back to the edges, where
    adaptive execution may split a hub's rows. The number of rounds grows with the logarithm of the longest path.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # large star: every larger neighbour of u moves to the smallest of u and its neighbours
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u != v").distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u"))
        small = large.join(least, "u").select(F.explode(F.array(moved, "u")).alias("u"), F.col("m").alias("v"))
        now = written(small.distinct(), "edges")
        before, state = state, _state(now)
    labels = now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("id"), "label")
    return labels.union(labels.select(F.col("label").alias("id"), "label").distinct())
