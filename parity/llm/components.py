"""Connected components of a graph given by its edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of the component of every node that has an edge.

    Each round points the larger neighbours of a node, then the smaller ones, to the smallest of them; the number of
    rounds is logarithmic. Rounds are checkpointed. Minima by node are combined before their shuffle, and checkpointed
    too: the join with them is then free of their partitioning, so adaptive execution can split the edges of a node
    that has very many.
    """
    current = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct().checkpoint()
    seen = _mark(current)
    while True:
        both = current.union(current.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = large.distinct().checkpoint()
        least = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u != v")
        current = small.distinct().checkpoint()
        now = _mark(current)
        if now == seen:
            break
        seen = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free fingerprint of the edges."""
    h = F.xxhash64("u", "v")
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s")
    ).first()
    return tuple(row)
