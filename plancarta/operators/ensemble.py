"""The drivers: candidates of several passes become one fused region set, and segments' colours become clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box
from . import folds, regions


def pooled(passes: list[DataFrame]) -> DataFrame:
    """The rows of all passes, in their order, numbered by pass; a pass that found nothing is an empty table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("pass", F.lit(i)) for i, p in enumerate(passes)])


def fused(boxes: DataFrame, page: float, most: float = 0.06, floor: float = 1.5e-3, demerge: bool = False, iou: float = 0.4) -> DataFrame:
    """Regions by image with sequential ids: oversize and merged boxes go, the best by score stay, small bordered ones go."""
    rows = regions.oversize_prune(boxes, page, most)
    if demerge:
        rows = regions.demerge(rows, page, floor)
    rows = folds.non_max_suppression(regions.merged_block_drop(rows), iou)
    rows = regions.bordered_floor(rows, page, floor)
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), F.desc(Box().area), "rid")
    return rows.withColumn("id", F.row_number().over(order).cast("long"))


def hue_circle(colours: DataFrame) -> DataFrame:
    """colours (h, s, v; each 0 to 1) with c and d, their places on the hue circle at the saturation."""
    turn = F.col("h") * 2 * 3.141592653589793
    return colours.withColumns({"c": F.cos(turn) * F.col("s"), "d": F.sin(turn) * F.col("s")})


def colour_clusters(colours: DataFrame, most: int = 5, seed: int = 42) -> DataFrame:
    """colours (id, h, s, v; each 0 to 1) with cluster: k-means on the hue circle, k by the best mean silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["c", "d", "s", "v"], outputCol="features").transform(hue_circle(colours))
    n = rows.count()
    if n <= 2:
        return colours.withColumn("cluster", F.lit(0))
    best = None
    for k in range(2, min(most, n - 1) + 1):
        found = KMeans(k=k, seed=seed).fit(rows).transform(rows)
        if found.select("prediction").distinct().count() < 2:
            continue
        score = ClusteringEvaluator().evaluate(found)
        if best is None or score > best[0]:
            best = score, found
    if best is None:
        return colours.withColumn("cluster", F.lit(0))
    return best[1].select(*colours.columns, F.col("prediction").alias("cluster"))


def merged_clusters(colours: DataFrame, near: float = 0.22) -> DataFrame:
    """cluster, merged: clusters (cluster, r, g, b; 0 to 1, a row each) closer than `near` are one, numbered from 0."""
    from .graph import groups

    a, b = colours.alias("a"), colours.alias("b")
    gap = F.sqrt(sum((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "rgb"))
    # clusters are a handful by image, so their pairs are too
    edges = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.cluster") <= F.col("b.cluster")) & ((gap < near) | (F.col("a.cluster") == F.col("b.cluster"))))
    roots = groups(edges.select("a.image_id", F.col("a.cluster").alias("a"), F.col("b.cluster").alias("b")))
    order = Window.partitionBy("image_id").orderBy("root")
    return roots.select("image_id", F.col("v").alias("cluster"), (F.dense_rank().over(order) - 1).alias("merged"))
