"""Connected components of links between rows, in rounds that each shuffle the links once or twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastro.llm.common import remove, stored


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of the undirected ``links(u, v)``, stored: root is the least node that can be reached.

    Alternates two steps that both keep connectivity: every node hands its larger neighbours, then its smaller ones, to
    its least neighbour. It ends with stars, after a number of rounds about the logarithm of the longest path.
    """
    edges = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        remove(least)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        same = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        done = same == edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        for table in (least, large, edges):
            remove(table)
        if done:
            roots = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
            roots.stored_at = after.stored_at
            return roots
        edges = after
