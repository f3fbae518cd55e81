"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (a, b) to (node, label), the smallest node of each component; only nodes with an edge occur.

    Each step links every node's neighbours to the smallest one, so stars shrink to trees of depth one in about
    log(n) rounds, repeated until two agree; neighbours are never gathered in a row, so a hub is no hot task: minima are pre-aggregated.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    current = scratch.keep(both)
    before = None
    while True:
        # Large star: every neighbour above a node is linked to the smallest of its neighbourhood.
        sides = current.union(current.select("v", "u")).toDF("u", "v")
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its lower neighbours are linked to the lowest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = scratch.keep(small)
        state = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        scratch.drop(current)
        current = new
        if state == before:
            break
        before = state
    labels = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    return labels.union(current.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
