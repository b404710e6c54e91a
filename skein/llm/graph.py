"""Connected components of a table of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of links (a, b); component is the least node reachable.

    Alternating stars: each node hands its larger neighbours to the least node it knows, then itself and its smaller
    neighbours, until nothing moves. Minima are partial aggregates; every round is written to the shared folder.
    """
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.withColumnRenamed("m", "v")).distinct()
        after = scratch.keep(small)
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges = after
        if now == state:
            break
        state = now
    # A fixed point is a forest of stars: every node but a component's least has one edge, to the least.
    least = edges.select(F.col("v").alias("node")).distinct()
    return scratch.keep(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least.withColumn("component", F.col("node"))))
