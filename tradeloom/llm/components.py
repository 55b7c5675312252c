"""Connected components of a graph given as a table of edges.

Large-star and small-star steps alternate: each links the neighbours of a node to the smallest
of them, so paths shrink while the number of edges doesn't grow. Every round is written to the
shared folder; only one number a round reaches the driver. A hub with a third of all nodes is
pre-aggregated before each shuffle and its join rows can be split, since no step needs them
together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradeloom.staging import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node linked to each node that has an edge; ``edges`` hold
    longs. Loops and repeated edges are allowed, and no edges give an empty table."""
    larger, smaller = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    now = staged(edges.where(F.col(a) != F.col(b)).select(larger, smaller).distinct(), "edges")
    while True:
        # A star: no node that others point to points on.
        if now.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count() == 0:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "large-star")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = staged(small.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "small-star")
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("b", "b"))
