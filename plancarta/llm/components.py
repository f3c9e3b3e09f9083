"""Connected components by alternating large-star and small-star rounds over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, store


def _digest(df: DataFrame):
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """v, root for each vertex of edges (a, b): root is the smallest vertex of its component.

    Each round groups by vertex with a map-side minimum and joins that minimum, a written table, back; a hub's many
    edges are thereby left to a join whose large partitions Spark can split. The number of rounds grows with the
    logarithm of the vertices. Loops and repeated edges are allowed; no edges give no rows. Only two numbers per round
    reach the driver. A round's tables are deleted after it.
    """
    edges = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    was = _digest(edges)
    while was[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = store(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        forget(edges, low)
        low = store(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        edges = store(large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        forget(large, low)
        now = _digest(edges)
        if now == was:
            break
        was = now
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("v"), "root").unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
