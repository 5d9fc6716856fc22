"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one aggregate and one join on the edges, needs no adjacency lists
in memory, and the number of rounds grows with the logarithm of the graph.
Lineage is cut after each round by a table in the shared folder that
``spark.checkpoint.dir`` names, or by ``checkpoint()`` where that is set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], a: str = "src", b: str = "dst") -> DataFrame:
    """node, component (its smallest node) for every node that has an edge; ``cut`` materialises a frame."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = cut(e)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, both.u == low.k).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.select(F.col("u").alias("k"), "m"), large.u == F.col("k")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
