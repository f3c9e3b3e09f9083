"""Pixel tables (image_id, y, x, r, g, b): colour statistics, masks and neighbourhoods as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_merge(rows: DataFrame) -> DataFrame:
    """rows, never broadcast by a join: a table that rows were exploded from says nothing of their number."""
    return rows.hint("merge")


def hsv(pixels: DataFrame) -> DataFrame:
    """pixels with hue 0 to 179, and saturation and value 0 to 255, of 8-bit channels; rounded half to even."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    d = v - low
    turn = F.when(d == 0, 0.0).when(v == r, (g - b) * 30.0 / d).when(v == g, 60 + (b - r) * 30.0 / d).otherwise(120 + (r - g) * 30.0 / d)
    hue = F.pmod(F.bround(F.when(turn < 0, turn + 180).otherwise(turn)).cast("int"), F.lit(180))
    return pixels.withColumns({"hue": hue, "sat": F.when(v == 0, 0).otherwise(F.bround(d * 255.0 / v).cast("int")), "val": v})


def grey(pixels: DataFrame) -> Column:
    return F.bround(F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114).cast("int")


def colour_fractions(pixels: DataFrame) -> DataFrame:
    """image_id, colored, grey, white: shares of pixels."""
    s, v = F.col("sat"), F.col("val")
    share = lambda p: F.avg(p.cast("double"))
    return hsv(pixels).groupBy("image_id").agg(share((s > 45) & (v > 50) & (v < 250)).alias("colored"), share((s <= 30) & v.between(120, 210)).alias("grey"), share((s <= 30) & (v > 210)).alias("white"))


def background(pixels: DataFrame, least: int = 1000) -> DataFrame:
    """image_id, level: the 80th percentile of the value of unsaturated pixels if they are many, else 245; 200 to 255."""
    pale = F.when(F.col("sat") < 25, F.col("val"))
    by = hsv(pixels).groupBy("image_id").agg(F.percentile(pale, 0.8).alias("p"), F.count(pale).alias("n"))
    level = F.when(F.col("n") > least, F.col("p")).otherwise(245.0)
    return by.select("image_id", F.least(F.lit(255), F.greatest(F.lit(200), level.cast("int"))).alias("level"))


def main_hue(pixels: DataFrame, reach: int = 5) -> DataFrame:
    """image_id, hue, n: the hue with the most saturated pixels within its reach around the circle, the lowest of equals."""
    count = hsv(pixels).where("sat > 45").groupBy("image_id", "hue").agg(F.count("*").alias("n"))
    near = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("k")
    sums = count.select("image_id", "hue", "n", near).groupBy("image_id", F.pmod(F.col("hue") + F.col("k"), F.lit(180)).alias("hue")).agg(F.sum("n").alias("n"))
    best = sums.groupBy("image_id").agg(F.max(F.struct("n", (-F.col("hue")).alias("h"))).alias("m"))
    return best.select("image_id", (-F.col("m.h")).alias("hue"), F.col("m.n").alias("n"))


def ink(pixels: DataFrame, most: int = 128) -> DataFrame:
    """image_id, y, x, on: dark pixels."""
    return pixels.select("image_id", "y", "x", (grey(pixels) < most).alias("on"))


def _frame(axis: str, other: str, reach: int):
    return Window.partitionBy("image_id", other).orderBy(axis).rowsBetween(-reach, reach)


def dilate(mask: DataFrame, reach: int = 1) -> DataFrame:
    """A pixel is on if one within a square is; by rows, then by columns. Rows and columns are complete."""
    wide = mask.withColumn("on", F.max("on").over(_frame("x", "y", reach)))
    return wide.withColumn("on", F.max("on").over(_frame("y", "x", reach)))


def erode(mask: DataFrame, reach: int = 1) -> DataFrame:
    """A pixel is on if all within a square are."""
    wide = mask.withColumn("on", F.min("on").over(_frame("x", "y", reach)))
    return wide.withColumn("on", F.min("on").over(_frame("y", "x", reach)))


def downscale(pixels: DataFrame, factor: int) -> DataFrame:
    """Means over squares, rounded half to even."""
    cell = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("y", "x")]
    return pixels.groupBy("image_id", *cell).agg(*[F.bround(F.avg(c)).cast("int").alias(c) for c in "rgb"])


def recolor(pixels: DataFrame) -> DataFrame:
    """image_id, class, n: pixels by class of colour."""
    s, v = F.col("sat"), F.col("val")
    kind = F.when(v < 60, "dark").when((s <= 30) & (v > 210), "white").when(s <= 30, "grey").otherwise("colored")
    return hsv(pixels).groupBy("image_id", kind.alias("class")).agg(F.count("*").alias("n"))


def colour_of(pixels: DataFrame, key: str) -> DataFrame:
    """key, r, g, b: the median per channel of the most saturated fifth of each key's pixels, whole numbers."""
    order = Window.partitionBy(key).orderBy(F.desc("sat"), "image_id", "y", "x")
    most = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy(key)) / 5))
    top = hsv(pixels).withColumn("place", F.row_number().over(order)).withColumn("most", most).where("place <= most")
    return top.groupBy(key).agg(*[F.median(c).cast("int").alias(c) for c in "rgb"])


def components(mask: DataFrame, rounds: int = 64) -> DataFrame:
    """image_id, y, x, label of pixels that are on: per image, by union of neighbours, eight ways; the label is y * 2^16 + x
    of the first pixel. One image is one group, bounded by its page."""

    def run(group):
        import numpy as np
        import pyarrow as pa

        y, x = (group[c].to_numpy() for c in ("y", "x"))
        if not len(y):
            return pa.table({"image_id": group["image_id"], "y": group["y"], "x": group["x"], "label": pa.array([], pa.int64())})
        far = (y.max() + 3, x.max() + 3)
        big = np.iinfo(np.int64).max
        label = np.full(far, big)
        label[y + 1, x + 1] = y.astype(np.int64) << 16 | x
        on = label < big
        while True:
            low = label
            for axis in (0, 1):
                low = np.minimum(low, np.minimum(np.roll(low, 1, axis), np.roll(low, -1, axis)))
            low = np.where(on, low, big)
            if (low == label).all():
                break
            label = low
        return pa.table({"image_id": group["image_id"], "y": group["y"], "x": group["x"], "label": label[y + 1, x + 1]})

    on = mask.where("on").select(F.col("image_id").cast("long").alias("image_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    return on.groupBy("image_id").applyInArrow(run, "image_id long, y int, x int, label long")


def component_stats(labels: DataFrame) -> DataFrame:
    """image_id, label, x, y, w, h, area, cx, cy."""
    by = labels.groupBy("image_id", "label").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return by


def largest(stats: DataFrame, least: float, page: float) -> DataFrame:
    """image_id, label, area: the largest component (image_id, label, area) of each image, the lowest label of equals, if it
    is a share of the page."""
    best = stats.groupBy("image_id").agg(F.max(F.struct("area", (-F.col("label")).alias("l"))).alias("m"))
    return best.where(F.col("m.area") >= least * page).select("image_id", (-F.col("m.l")).alias("label"), F.col("m.area").alias("area"))


def stroke_widths(labels: DataFrame, skeleton: DataFrame, wide: float, small: float) -> DataFrame:
    """image_id, label, width, fat, tiny: pixels of a component over those of its skeleton (y, x; at least one)."""
    line = labels.join(by_merge(skeleton.select("image_id", "y", "x")), ["image_id", "y", "x"], "left_semi").groupBy("image_id", "label").agg(F.count("*").alias("n"))
    by = labels.groupBy("image_id", "label").agg(F.count("*").alias("area")).join(by_merge(line), ["image_id", "label"], "left")
    width = F.col("area") / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    return by.select("image_id", "label", width.alias("width"), (width > wide).alias("fat"), (F.col("area") < small).alias("tiny"))


def tilt(lines: DataFrame, low: float = 8.0, high: float = 82.0, least: int = 20, share: float = 0.10) -> DataFrame:
    """image_id, tilt of lines (image_id, angle in degrees): the middle of the 3-degree bin that most tilted lines fall in,
    the lowest of equals, if they and it are enough."""
    turn = F.pmod(F.col("angle"), F.lit(180))
    rows = lines.withColumn("a", F.when(turn > 90, turn - 180).otherwise(turn))
    is_tilted = (F.abs("a") > low) & (F.abs("a") < high)
    bins = rows.withColumn("bin", F.when(is_tilted, F.floor((F.col("a") + 90) / 3))).groupBy("image_id", "bin").agg(F.count("*").alias("n"))
    tilted = F.sum(F.when(F.col("bin").isNotNull(), F.col("n")))
    best = bins.groupBy("image_id").agg(tilted.alias("tilted"), F.sum("n").alias("every"), F.max(F.when(F.col("bin").isNotNull(), F.struct("n", (-F.col("bin")).alias("b")))).alias("m"))
    enough = (F.col("tilted") >= F.greatest(F.lit(float(least)), F.col("every") * share)) & (F.col("m.n") >= least)
    return best.where(enough).select("image_id", (-F.col("m.b") * 3.0 - 90 + 1.5).alias("tilt"))


def lab() -> tuple[Column, Column, Column]:
    """CIE L*a*b* under D65 of 8-bit r, g, b."""
    def line(c):
        v = F.col(c) / 255.0
        return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)

    r, g, b = (line(c) for c in "rgb")

    def bend(v):
        return F.when(v > 0.008856, F.cbrt(v)).otherwise(v * 7.787 + 16 / 116)

    x = bend((r * 0.412453 + g * 0.357580 + b * 0.180423) / 0.95047)
    y = bend(r * 0.212671 + g * 0.715160 + b * 0.072169)
    z = bend((r * 0.019334 + g * 0.119193 + b * 0.950227) / 1.08883)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def lab_distance(to: tuple[float, float, float]) -> Column:
    """The distance of r, g, b to a colour in L*a*b*."""
    return F.sqrt(sum((c - t) * (c - t) for c, t in zip(lab(), to, strict=True)))


def sampled(pixels: DataFrame, most: int) -> DataFrame:
    """At most so many pixels of each image, those whose places have the smallest hashes; the same ones each time."""
    place = F.md5(F.concat_ws("-", F.col("image_id"), F.col("y"), F.col("x")).cast("binary"))
    order = Window.partitionBy("image_id").orderBy("hash", "y", "x")
    return pixels.withColumn("hash", place).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("hash", "place")


def combined(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, y, x, either, both, without of two masks of the same images: or, and, and a without b."""
    rows = a.select("image_id", "y", "x", F.col("on").alias("p")).join(by_merge(b.select("image_id", "y", "x", F.col("on").alias("q"))), ["image_id", "y", "x"])
    return rows.select("image_id", "y", "x", (F.col("p") | F.col("q")).alias("either"), (F.col("p") & F.col("q")).alias("both"), (F.col("p") & ~F.col("q")).alias("without"))


def left_over(mask: DataFrame, used: DataFrame) -> DataFrame:
    """Pixels of a mask that are on and aren't among used ones."""
    return mask.where("on").select("image_id", "y", "x").join(by_merge(used.select("image_id", "y", "x")), ["image_id", "y", "x"], "left_anti")


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(c)), 2, "0") for c in (r, g, b)])


def occluded(gaps: DataFrame, mask: DataFrame, least: float = 0.40) -> DataFrame:
    """image_id, gap, occluded: whether enough of the straight way x1, y1 to x2, y2, without its ends, is on in a mask.

    A way has a sample a pixel; a quarter of them at most, else 15 %, one at least, is left out at each end.
    """
    n = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) + 1
    pad = F.least(F.floor(F.col("n") / 4), F.greatest(F.lit(1), F.floor(F.col("n") * 0.15)))
    ways = gaps.withColumn("n", n.cast("long")).withColumn("pad", pad.cast("long"))
    middle = ways.where(F.col("n") > 2 * F.col("pad")).withColumn("i", F.explode(F.sequence(F.col("pad"), F.col("n") - 1 - F.col("pad"))))
    share = F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))
    at = lambda c: F.bround(F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * share).cast("int").alias(c)
    hits = middle.select("image_id", "gap", at("y"), at("x")).join(by_merge(mask), ["image_id", "y", "x"]).groupBy("image_id", "gap").agg(F.avg(F.col("on").cast("int")).alias("share"))
    return gaps.select("image_id", "gap").join(by_merge(hits), ["image_id", "gap"], "left").select("image_id", "gap", F.coalesce(F.col("share") >= least, F.lit(False)).alias("occluded"))
