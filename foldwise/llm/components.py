"""Connected components by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a long, b long); component is its smallest node.

    A large star links each larger neighbour of a node with the smallest node around it; a small star
    does so for the smaller neighbours. The rounds are logarithmic in the longest path. Minima combine
    before the shuffle, and joins to a hub are left to adaptive skew splitting. Only two numbers per
    round reach the driver. A small star ahead, of grouped neighbours and no join, takes most of what
    several comparisons found of one group: a node has as many smaller neighbours as comparisons gave it roots.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = pairs.groupBy("a").agg(F.collect_set("b").alias("all")).withColumn("b", F.array_min("all"))
    ends = stars.select(F.explode(F.array_union(F.array("a"), "all")).alias("a"), "b").where("a <> b")
    now, before = written(ends.distinct(), "edges"), None
    while (state := now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != before:
        before = state
        if not state[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a")
        step = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b"), F.col("m")))
        now = written(step.distinct(), "edges")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(now.select("b", "b").distinct())
