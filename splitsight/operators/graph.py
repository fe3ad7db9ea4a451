"""Connected components of links between numbered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over links (a, b); nodes without links are left out.

    Alternates large and small stars, each an aggregate and a join on rows of two numbers, until the edges
    stay the same; rounds grow with the logarithm of the longest chain. Stars at a node with very many links
    are combined before they are shuffled.
    """
    edges = checkpointed(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v")).distinct()
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lows, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter(F.col("u") != F.col("v"))
            .distinct()
        )
        edges = checkpointed(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == tuple(now):
            break
        seen = tuple(now)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return checkpointed(nodes.unionByName(roots))
