"""Box arithmetic as columns. A box is four columns: left, top, width, height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box:
    """The box in the columns x, y, w, h of a DataFrame, or of its part under an alias."""

    def __init__(self, alias: str = ""):
        self.x, self.y, self.w, self.h = (F.col(f"{alias}.{c}" if alias else c) for c in "xywh")

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h


def inter(a: Box, b: Box) -> Column:
    """Area shared by two boxes."""
    wide = F.greatest(F.lit(0.0), F.least(a.right, b.right) - F.greatest(a.x, b.x))
    return wide * F.greatest(F.lit(0.0), F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y))


def iou(a: Box, b: Box) -> Column:
    """Shared area over the area of both together; 0 without any."""
    union = a.area + b.area - inter(a, b)
    return F.when(union > 0, inter(a, b) / union).otherwise(0.0)


def ios(a: Box, b: Box) -> Column:
    """Shared area over the smaller area; 0 without any."""
    small = F.least(a.area, b.area)
    return F.when(small > 0, inter(a, b) / small).otherwise(0.0)


def ring(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The closed five-point ring of a box."""
    point = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h), point(x, y))


def open_ring(points: Column) -> Column:
    """A ring without its closing point; null below three points."""
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    out = F.when(first == last, F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0)))).otherwise(points)
    return F.when(F.size(out) >= 3, out)


def shoelace(points: Column) -> Column:
    """Area inside an open ring; 0 below three points."""
    n = F.size(points)
    turn = F.transform(points, lambda p, i: p.x * F.get(points, (i + 1) % n).y - F.get(points, (i + 1) % n).x * p.y)
    return F.when(n >= 3, F.abs(F.aggregate(turn, F.lit(0.0), lambda s, v: s + v)) / 2).otherwise(0.0)


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def to_segment(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance from a point to the nearest point of a segment."""
    dx, dy = x1 - x0, y1 - y0
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x0) * dx + (py - y0) * dy) / size))).otherwise(0.0)
    return distance(px, py, x0 + t * dx, y0 + t * dy)
