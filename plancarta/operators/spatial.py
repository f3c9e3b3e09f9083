"""Spatial joins by grid cells: equi-joins on image and cell with the exact test behind, so no cross product is planned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, inter

CELL = 100.0


def _cell(v: Column, cell: float) -> Column:
    return F.floor(v / cell)


def covered(boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """boxes once for each grid cell they touch, as gx and gy."""
    b = Box()
    wide = F.explode(F.sequence(_cell(b.x, cell), _cell(b.right, cell)))
    tall = F.explode(F.sequence(_cell(b.y, cell), _cell(b.bottom, cell)))
    return boxes.withColumn("gx", wide).withColumn("gy", tall)


def point_in_box(points: DataFrame, boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """Rows p.*, b.* of points (image_id, cx, cy) in the closed boxes of their image."""
    p = points.withColumn("gx", _cell(F.col("cx"), cell)).withColumn("gy", _cell(F.col("cy"), cell)).alias("p")
    b, box = covered(boxes, cell).alias("b"), Box("b")
    keys = [F.col(f"p.{k}") == F.col(f"b.{k}") for k in ("image_id", "gx", "gy")]
    inside = F.col("p.cx").between(box.x, box.right) & F.col("p.cy").between(box.y, box.bottom)
    return p.join(b, [*keys, inside])


def overlaps(left: DataFrame, right: DataFrame, cell: float = CELL) -> DataFrame:
    """Rows l.*, r.* of boxes of the same image that share some area; each pair once, in the cell of its shared corner."""
    a, b = Box("l"), Box("r")
    keys = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("image_id", "gx", "gy")]
    here = (F.col("l.gx") == _cell(F.greatest(a.x, b.x), cell)) & (F.col("l.gy") == _cell(F.greatest(a.y, b.y), cell))
    return covered(left, cell).alias("l").join(covered(right, cell).alias("r"), [*keys, here, inter(a, b) > 0])
