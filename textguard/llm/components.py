"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable.

    Each round points the neighbours of a node to the smallest one known. A
    round is two aggregations by node and joins that AQE splits where a node is
    hot; no group is collected. Rounds grow with the logarithm of the longest
    chain. Null ends and self links are ignored.
    """
    edges = links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    edges = written(edges.where("low < high").distinct(), "links")
    before = None
    while True:
        # large star: larger neighbours of a node point to its smallest neighbour or itself
        both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).unionAll(
            edges.select(F.col("low").alias("u"), F.col("high").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low"))
        large = large.where("low < high").distinct()
        # small star: smaller neighbours and the node itself point to the smallest of them
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(least, "high").select(F.col("low").alias("high"), F.col("m").alias("low"))
        edges = written(small.where("low < high").unionAll(least.select("high", F.col("m").alias("low"))).distinct(), "links")
        # stable when every node has one link and no root hangs below another
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))
        ).head()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
    tops = edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    return roots.unionAll(tops)
