"""Connected components of edges, by alternating star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of every node of undirected edges (a, b): the smallest node it reaches.

    Each step links nodes to the smallest neighbour they know; only minima are gathered for a node, never its
    neighbours. `save` writes a table and reads it back; steps end when nothing changes, after some log of
    the longest way.
    """
    now, mark = save(edges.select("a", "b").where("a <> b").distinct()), None
    while True:
        both = now.union(now.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        far = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        near = far.groupBy("a").agg(F.min("b").alias("m"))
        back = far.join(near, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = save(back.union(near.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = after
        if seen == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = seen
