"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertable.llm.tables import checkpointed, release_shuffles


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node that it reaches) of every node that is not the smallest of its component.

    Large-star and small-star steps: every node's larger neighbours, then its smaller ones, are tied to the smallest
    node around it, until nothing changes. Tables of edges stay in the cluster, cut off from what made them in each round; sums per
    node are formed in every task first, and a hub's edges are joined as two shuffled tables, which Spark can split.
    """
    own = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    before = None
    while True:
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = checkpointed(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        own = checkpointed(large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                           .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = own.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return own.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        del both, least, large
        release_shuffles(own.sparkSession)
