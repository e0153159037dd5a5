"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlelab.session import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least node of its component.

    Alternating large-star and small-star steps: every step hooks nodes to the least neighbour
    seen, and pre-aggregates by node, so a node with very many edges is no single group. The
    number of steps grows with the logarithm of the longest path.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = durable(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        large = durable(large.where("a <> b").distinct())
        low = durable(large.groupBy("a").agg(F.min("b").alias("root")))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct("a", F.col("root").alias("b")), F.struct(F.col("b").alias("a"), F.col("root").alias("b")))).alias("e")
        )
        small = durable(small.select("e.a", "e.b").where("a <> b").distinct())
        if small.exceptAll(now).isEmpty() and now.exceptAll(small).isEmpty():
            break
        now = small
    roots = now.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )
