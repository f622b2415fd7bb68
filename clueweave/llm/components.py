"""Connected components of an edge table, by alternating large and small stars.

Each round hangs the larger neighbours of every node, then the others, below the smallest node
in reach; edges never multiply, and the number of rounds grows with the logarithm of the graph.
Minima are partly aggregated before each shuffle, so a node with very many edges does no harm,
and every round is stored, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clueweave.session import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    hung = both.where("b > a").join(least, "a")
    return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger node ``a`` to the smaller ``b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m")
    moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with an edge; the root is the smallest node in reach.

    ``edges`` has columns ``a`` and ``b`` (bigint) in any order and number; loops are ignored.
    """
    found = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    found = written(found.distinct(), "links")
    state = None
    while True:
        # equal sums of hashes before and after a round mean equal edges
        sums = found.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        previous, state = state, sums.first()
        if state == previous or not state[0]:
            break
        found = written(_small_star(_large_star(found)), "links")
    roots = found.groupBy("b").agg(F.lit(0)).select(F.col("b").alias("node"), F.col("b").alias("root"))
    return found.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
