"""Labels of regions: which texts belong to a region, its label and status, its hall, and which regions to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, inter
from ..functions.text import collapse, status
from .spatial import overlaps, point_in_box

STATUSES = ("boothlike", "text", "facility", "empty")
POLICIES = {"none": STATUSES, "facility": ("boothlike", "text", "empty"), "textless": ("boothlike", "text"), "strict": ("boothlike",)}
SHAPE_SOURCES = ("color", "bordered", "bigregion")
LEAST_COVER = 0.30


def centred(texts: DataFrame) -> DataFrame:
    """texts (x0, y0, x1, y1) with their centre, and as boxes x, y, w, h."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return texts.withColumns({"cx": (x0 + x1) / 2, "cy": (y0 + y1) / 2, "x": x0, "y": y0, "w": x1 - x0, "h": y1 - y0})


def contained(texts: DataFrame, boxes: DataFrame) -> DataFrame:
    """image_id, rid, tid: a text belongs to every region that holds its centre."""
    return point_in_box(centred(texts), boxes).select("p.image_id", "b.rid", "p.tid")


def orphans(texts: DataFrame, boxes: DataFrame) -> DataFrame:
    """image_id, rid, tid: other texts belong to the region that covers them most, the first of equals, if by enough."""
    rest = centred(texts).join(contained(texts, boxes).select("image_id", "tid").distinct(), ["image_id", "tid"], "left_anti")
    cover = inter(Box("l"), Box("r"))
    best = overlaps(rest, boxes).groupBy("l.image_id", "l.tid").agg(F.max_by(F.struct("r.rid", cover.alias("cover"), Box("l").area.alias("area")), F.struct(cover, -F.col("r.rid"))).alias("best"))
    area = F.when(F.col("best.area") > 0, F.col("best.area")).otherwise(1.0)
    return best.where(F.col("best.cover") >= LEAST_COVER * area).select("image_id", F.col("best.rid").alias("rid"), "tid")


def labelled(texts: DataFrame, boxes: DataFrame) -> DataFrame:
    """boxes with label, n_text and status; texts are joined in reading order: 8-pixel bands, then left to right."""
    owned = contained(texts, boxes).unionByName(orphans(texts, boxes))
    place = F.struct(F.bround(F.col("cy") / 8).alias("band"), "cx", "tid", "text")
    words = F.transform(F.array_sort(F.collect_list(place)), lambda t: t.text)
    labels = owned.join(centred(texts), ["image_id", "tid"]).groupBy("image_id", "rid").agg(collapse(F.array_join(words, " ")).alias("label"), F.count("*").alias("n_text"))
    out = boxes.join(labels, ["image_id", "rid"], "left")
    out = out.withColumns({"label": F.coalesce("label", F.lit("")), "n_text": F.coalesce("n_text", F.lit(0)).cast("long")})
    return out.withColumn("status", status(F.col("label")))


def with_text(regions: DataFrame) -> DataFrame:
    """Regions whose label holds a character."""
    return regions.where(F.trim("label") != "")


def hall_of(boxes: DataFrame, halls: DataFrame) -> DataFrame:
    """boxes with hall: the first valid hall, in order, that holds the region's centre, else Other."""
    rows = numbered(halls)
    b = Box("b")
    cx, cy = b.x + b.w / 2, b.y + b.h / 2
    inside = cx.between(F.col("h.cx") - F.col("h.w") / 2, F.col("h.cx") + F.col("h.w") / 2) & cy.between(F.col("h.cy") - F.col("h.h") / 2, F.col("h.cy") + F.col("h.h") / 2)
    first = boxes.alias("b").join(rows.alias("h"), [F.col("b.image_id") == F.col("h.image_id"), inside]).groupBy("b.image_id", "b.rid").agg(F.min_by("h.hall", "h.hall_ord").alias("hall"))
    return boxes.join(first, ["image_id", "rid"], "left").withColumn("hall", F.coalesce("hall", F.lit("Other")))


def numbered(halls: DataFrame) -> DataFrame:
    """Halls with a width and a height, named Hall_1, Hall_2, ... by image in order."""
    order = F.row_number().over(Window.partitionBy("image_id").orderBy("hall_ord"))
    return halls.where((F.col("w") > 0) & (F.col("h") > 0)).withColumn("hall", F.concat(F.lit("Hall_"), order.cast("string")))


def keeps(policy: str) -> Column:
    """Whether a policy keeps a region, from its source and status."""
    if policy == "shape":
        text = (F.col("source") == "opencv_strict") & (F.col("status") != "empty")
        return F.col("source").isin(*SHAPE_SOURCES) | text | (F.col("status") == "boothlike")
    return F.col("status").isin(*POLICIES[policy])


def adaptive(tagged: DataFrame) -> DataFrame:
    """image_id, n, n_boothlike, policy: strict where labels are many enough to go by, else shape."""
    by = tagged.groupBy("image_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "boothlike").alias("n_boothlike"))
    enough = F.greatest(F.lit(10.0), F.greatest(F.col("n"), F.lit(1)) * 0.15)
    return by.withColumn("policy", F.when(F.col("n_boothlike") >= enough, "strict").otherwise("shape"))


def policy_preview(tagged: DataFrame) -> DataFrame:
    """policy, kept, dropped for each policy, in one pass."""
    names = [*POLICIES, "shape"]
    sums = tagged.agg(F.count("*").alias("n"), *[F.count_if(keeps(p)).alias(p) for p in names])
    pairs = ", ".join(f"'{p}', {p}" for p in names)
    return sums.select("n", F.expr(f"stack({len(names)}, {pairs}) as (policy, kept)")).select("policy", "kept", (F.col("n") - F.col("kept")).alias("dropped"))


def status_histogram(tagged: DataFrame) -> DataFrame:
    """status, n in fixed order with zeros."""
    sums = tagged.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    pairs = ", ".join(f"{i}, '{s}', {s}" for i, s in enumerate(("boothlike", "text", "facility", "empty")))
    return sums.select(F.expr(f"stack(4, {pairs}) as (place, status, n)"))


def source_histogram(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy(F.coalesce("source", F.lit("?")).alias("source")).agg(F.count("*").alias("n"))


def hall_counts(tagged: DataFrame, halls: DataFrame, policy: str = "textless") -> DataFrame:
    """image_id, hall, n_regions, n_boothlike, n_text of kept regions; halls without any count 0, Other only if it has some."""
    by = hall_of(tagged.where(keeps(policy)), halls).groupBy("image_id", "hall").agg(F.count("*").alias("n_regions"), F.count_if(F.col("status") == "boothlike").alias("n_boothlike"), F.sum("n_text").alias("n_text"))
    every = numbered(halls).select("image_id", "hall").unionByName(by.select("image_id", "hall").where("hall = 'Other'"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(by, ["image_id", "hall"], "left").select("image_id", "hall", zero("n_regions"), zero("n_boothlike"), zero("n_text"))
