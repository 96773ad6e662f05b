"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import drop, stash


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b longs) but the roots; root is the component's least node.

    Every round is a few shuffles of the link table and ends in the shared folder; nothing but two counters
    comes to the driver. Hubs are joined, never collected; minima are tables of their own, so that both sides of a join
    are plain exchanges and a hub's rows can be split.
    """
    edges = stash(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        large = stash(large, "large")
        low = stash(large.groupBy("u").agg(F.min("v").alias("w")), "low")
        small = large.join(low, "u").filter("v != w").select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(low.select("u", F.col("w").alias("v")))
        used, edges = (edges, least, large, low), stash(small.distinct(), "links")
        drop(*used)
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before or not after[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
