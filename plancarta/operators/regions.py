"""Filters on regions, set rules between overlapping regions, tiles, and scales."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, inter, ios, iou
from .spatial import overlaps


def pairs(boxes: DataFrame, kind: str, above: float) -> DataFrame:
    """image_id, a, b and iou or ios of overlapping boxes a < b above a threshold."""
    value = {"iou": iou, "ios": ios}[kind](Box("l"), Box("r"))
    return overlaps(boxes, boxes).where((F.col("l.rid") < F.col("r.rid")) & (value > above)).select("l.image_id", F.col("l.rid").alias("a"), F.col("r.rid").alias("b"), value.alias(kind))


def oversize_prune(boxes: DataFrame, page: float, most: float) -> DataFrame:
    """Without boxes over a share of the page, bordered ones excepted."""
    return boxes.where((F.col("source") == "bordered") | (Box().area <= page * most))


def bordered_floor(boxes: DataFrame, page: float, least: float) -> DataFrame:
    """Without bordered boxes under a share of the page."""
    return boxes.where((F.col("source") != "bordered") | (Box().area >= page * least))


def component_shapes(boxes: DataFrame, width: float, height: float, least: float = 1e-4, most: float = 0.06, side: float = 20, edge: float = 2, fill: float = 0.60, aspect: float = 0.14) -> DataFrame:
    """Components (with pixel area `area`) of a plausible size, off the page's border, full, and not too thin."""
    b, page = Box(), width * height
    short, long = F.least(b.w, b.h), F.greatest(b.w, b.h)
    inside = (b.x >= edge) & (b.y >= edge) & (b.right <= width - edge) & (b.bottom <= height - edge)
    return boxes.where(F.col("area").between(least * page, most * page) & (short >= side) & inside & (F.col("area") / b.area >= fill) & (short / long >= aspect))


def color_shapes(boxes: DataFrame, page: float, least: float = 2e-4, most: float = 0.06, fill: float = 0.45, aspect: float = 0.12) -> DataFrame:
    """Colour regions (with pixel area `area`) of a plausible size, side, fill and aspect."""
    b = Box()
    short, long = F.least(b.w, b.h), F.greatest(b.w, b.h)
    side = max(6, round((least * page) ** 0.5))
    return boxes.where(F.col("area").between(least * page, most * page) & (short >= side) & (F.col("area") / b.area >= fill) & (short / long >= aspect))


def bordered_shapes(boxes: DataFrame, page: float, least: float = 1.5e-4, most: float = 0.06, fill: float = 0.55, aspect: float = 0.14) -> DataFrame:
    """Cells (with `area`, `perimeter` and `corners`) of a plausible size, outline, fill and aspect."""
    b = Box()
    short, long = F.least(b.w, b.h), F.greatest(b.w, b.h)
    shape = (F.col("perimeter") > 0) & F.col("corners").between(3, 12)
    return boxes.where(F.col("area").between(least * page, most * page) & shape & (F.col("area") / b.area >= fill) & (short / long >= aspect))


def white_gate(components: DataFrame, page: float) -> DataFrame:
    """image_id, open: whether an image has a white component that could be a cell."""
    b = Box()
    short, long = F.least(b.w, b.h), F.greatest(b.w, b.h)
    cell = F.col("area").between(1e-3 * page, 0.05 * page) & (short >= 15) & (F.col("area") / b.area >= 0.85) & (long / short <= 6)
    return components.groupBy("image_id").agg(F.bool_or(cell).alias("open"))


def _without(boxes: DataFrame, gone: DataFrame) -> DataFrame:
    return boxes.join(gone.select("image_id", "rid"), ["image_id", "rid"], "left_anti")


def merged_block_drop(boxes: DataFrame, least_ios: float = 0.80, cover: float = 0.75, thin: float = 2.5, small: float = 15000) -> DataFrame:
    """Without boxes that two or more smaller ones fill, unless one of these is a thin slice."""
    big, part = Box("l"), Box("r")
    share = ios(big, part)
    slim = (F.greatest(part.w, part.h) / F.greatest(F.lit(1.0), F.least(part.w, part.h)) > thin) & (part.area < small)
    found = overlaps(boxes, boxes).where((part.area < big.area) & (share > least_ios))
    by = found.groupBy("l.image_id", "l.rid").agg(F.count("*").alias("n"), F.sum(share * part.w * part.h).alias("covered"), F.first(big.area).alias("area"), F.bool_or(slim).alias("slim"))
    return _without(boxes, by.where((F.col("n") >= 2) & (F.col("covered") >= cover * F.col("area")) & ~F.col("slim")))


def row_envelope_drop(boxes: DataFrame, least_ios: float = 0.80, cover: float = 0.55) -> DataFrame:
    """Without boxes of which two or more smaller ones cover a share."""
    big, part = Box("l"), Box("r")
    found = overlaps(boxes, boxes).where((part.area < big.area) & (ios(big, part) > least_ios))
    by = found.groupBy("l.image_id", "l.rid").agg(F.count("*").alias("n"), F.sum(ios(big, part) * part.w * part.h).alias("covered"), F.first(big.area).alias("area"))
    return _without(boxes, by.where((F.col("n") >= 2) & (F.col("covered") >= cover * F.col("area"))))


def nested_fragment_drop(boxes: DataFrame, above: float = 0.85) -> DataFrame:
    """Without boxes that lie in a strictly larger one."""
    found = overlaps(boxes, boxes).where((Box("r").area > Box("l").area) & (ios(Box("l"), Box("r")) > above))
    return _without(boxes, found.select("l.image_id", "l.rid").distinct())


def demerge(boxes: DataFrame, page: float, least: float, inside: float = 0.70, low: float = 0.10, high: float = 0.70) -> DataFrame:
    """Without boxes that two or more bordered tiles of a share of their size lie in; bordered ones stay."""
    big, tile = Box("l"), Box("r")
    fit = (F.col("r.source") == "bordered") & (tile.area >= page * least) & tile.area.between(low * big.w * big.h, high * big.w * big.h) & (inter(big, tile) / tile.area > inside)
    by = overlaps(boxes.where(F.col("source") != "bordered"), boxes).where(fit).groupBy("l.image_id", "l.rid").agg(F.count("*").alias("n"))
    return _without(boxes, by.where("n >= 2"))


def fine_coverage(boxes: DataFrame, cell: float = 4, smaller: float = 0.9, most: float = 0.80) -> DataFrame:
    """Without boxes of whose raster cells smaller boxes cover too many. A box's cells are marked in an array, one image at
    a time, so cells never become rows."""

    def run(group):
        x, y, w, h = (group[c].to_numpy() for c in "xywh")
        x0, y0 = np.floor(x / cell).astype(int), np.floor(y / cell).astype(int)
        x1, y1 = np.maximum(x0, np.floor((x + w) / cell).astype(int) - 1) + 1, np.maximum(y0, np.floor((y + h) / cell).astype(int) - 1) + 1
        area, keep = w * h, []
        for i in range(len(x)):
            hit = np.zeros((y1[i] - y0[i], x1[i] - x0[i]), bool)
            for j in np.flatnonzero((area < smaller * w[i] * h[i]) & (x0 < x1[i]) & (x1 > x0[i]) & (y0 < y1[i]) & (y1 > y0[i])):
                hit[max(y0[j] - y0[i], 0) : y1[j] - y0[i], max(x0[j] - x0[i], 0) : x1[j] - x0[i]] = True
            if hit.sum() <= most * hit.size:
                keep.append(i)
        return group.take(pa.array(keep, pa.int64()))

    return boxes.groupBy("image_id").applyInArrow(run, boxes.schema)


def split_acceptance(parents: DataFrame, cells: DataFrame, least: float = 0.45) -> DataFrame:
    """Regions, each replaced by its two or more inner cells (parent) if they cover enough of it."""
    by = cells.groupBy("image_id", F.col("parent").alias("rid")).agg(F.count("*").alias("n"), F.sum(Box().area).alias("covered"))
    split = parents.join(by, ["image_id", "rid"], "left").withColumn("split", F.coalesce((F.col("n") >= 2) & (F.col("covered") > least * Box().area), F.lit(False)))
    own = split.where("not split").select("image_id", "rid", "x", "y", "w", "h")
    accepted = split.where("split").select("image_id", F.col("rid").alias("parent"))
    return own.unionByName(cells.join(accepted, ["image_id", "parent"]).select("image_id", "rid", "x", "y", "w", "h"))


def tile_origins(extent: Column, tile: int = 1800, step: int = 1400) -> Column:
    """Where tiles begin along an axis: 0, and steps until a tile reaches the end."""
    last = F.when(extent <= tile, 0).otherwise(F.ceil((extent - tile) / F.lit(step)) * step)
    return F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))


def tiles(pages: DataFrame, tile: int = 1800, step: int = 1400) -> DataFrame:
    """image_id, tx, ty, tw, th of each tile of pages (image_id, width, height)."""
    out = pages.withColumn("tx", F.explode(tile_origins(F.col("width"), tile, step))).withColumn("ty", F.explode(tile_origins(F.col("height"), tile, step)))
    size = lambda extent, at: F.least(F.lit(tile).cast("long"), F.col(extent).cast("long") - F.col(at))
    return out.select("image_id", "width", "height", "tx", "ty", size("width", "tx").alias("tw"), size("height", "ty").alias("th"))


def seam_clipped(edge: float = 4) -> Column:
    """Whether a tile's box (in the tile's own place) touches a tile edge that isn't the page's."""
    b = Box()
    left = (b.x <= edge) & (F.col("tx") > 0)
    top = (b.y <= edge) & (F.col("ty") > 0)
    right = (b.right >= F.col("tw") - edge) & (F.col("tx") + F.col("tw") < F.col("width"))
    bottom = (b.bottom >= F.col("th") - edge) & (F.col("ty") + F.col("th") < F.col("height"))
    return left | top | right | bottom


def big_regions(boxes: DataFrame, page: float, side: float = 700, most: float = 0.5) -> DataFrame:
    """Boxes with a long enough short side and at most a share of the page, as source bigregion."""
    b = Box()
    return boxes.where((F.least(b.w, b.h) >= side) & (b.area <= most * page)).withColumn("source", F.lit("bigregion"))


def big_coverage(big: DataFrame, crops: DataFrame) -> DataFrame:
    """image_id, rid, coverage, n_inner: how much crops cover each big region, shared places counted again."""
    both = overlaps(big, crops).groupBy("l.image_id", "l.rid").agg(F.sum(inter(Box("l"), Box("r"))).alias("covered"), F.count("*").alias("n_inner"))
    out = big.join(both, ["image_id", "rid"], "left")
    return out.select("image_id", "rid", (F.coalesce("covered", F.lit(0.0)) / Box().area).alias("coverage"), F.coalesce("n_inner", F.lit(0)).cast("long").alias("n_inner"))


def scaled(boxes: DataFrame, factor: float) -> DataFrame:
    """Boxes times a factor, rounded half to even."""
    return boxes.withColumns({c: F.bround(F.col(c) * factor).cast("long") for c in "xywh"})


def turned(boxes: DataFrame, degrees: float, cx: float, cy: float) -> DataFrame:
    """boxes turned about a point: the envelope x0, y0, x1, y1 of the four corners, and their centre."""
    from math import cos, radians, sin

    c, s = cos(radians(degrees)), sin(radians(degrees))
    b = Box()
    corners = F.array(*[F.struct((cx + c * (x - cx) - s * (y - cy)).alias("x"), (cy + s * (x - cx) + c * (y - cy)).alias("y")) for x, y in ((b.x, b.y), (b.right, b.y), (b.right, b.bottom), (b.x, b.bottom))])
    of = lambda k: F.transform(corners, lambda p: p[k])
    mean = lambda k: F.aggregate(of(k), F.lit(0.0), lambda t, v: t + v) / 4
    return boxes.select("image_id", "rid", F.array_min(of("x")).alias("x0"), F.array_min(of("y")).alias("y0"), F.array_max(of("x")).alias("x1"), F.array_max(of("y")).alias("y1"), mean("x").alias("cx"), mean("y").alias("cy"))
