"""Trail polylines (image_id, trail_id, ord, x, y, cluster, trails and clusters being an image's own): windows over vertices, joins of endpoints, and selections of trails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, to_segment

def _by():
    return Window.partitionBy("trail_id")


def _order():
    return _by().orderBy("ord")


def _steps(lines: DataFrame) -> DataFrame:
    """lines with d, the way from the vertex before (0 at the first)."""
    x, y = F.lag("x").over(_order()), F.lag("y").over(_order())
    return lines.withColumn("d", F.coalesce(distance(x, y, F.col("x"), F.col("y")), F.lit(0.0)))


def lengths(lines: DataFrame) -> DataFrame:
    """trail_id, n, length."""
    return _steps(lines).groupBy("trail_id").agg(F.count("*").alias("n"), F.sum("d").alias("length"))


def smooth(lines: DataFrame, window: int = 7) -> DataFrame:
    """Centred means; the ends, and lines of at most `window` vertices, stay."""
    half = window // 2
    frame = _order().rowsBetween(-half, half)
    place, n = F.row_number().over(_order()), F.count("*").over(_by())
    stay = (n <= window) | (place <= half) | (place > n - half)
    return lines.select("trail_id", "ord", *[F.when(stay, F.col(c)).otherwise(F.avg(c).over(frame)).alias(c) for c in "xy"])


def resample(lines: DataFrame, spacing: float) -> DataFrame:
    """trail_id, k, x, y: evenly spaced points along each line, both ends included; the ends alone of short lines."""
    run = _steps(lines).withColumn("at", F.sum("d").over(_order()))
    ahead = run.select("trail_id", "at", "x", "y", *[F.lead(c).over(_order()).alias(f"{c}1") for c in ("at", "x", "y")], F.max("at").over(_by()).alias("total"))
    n = F.when(F.col("total") < spacing, 2).otherwise(F.greatest(F.lit(2), F.bround(F.col("total") / spacing).cast("int") + 1))
    # a segment makes the points from its begin up to, but not at, its end; the last segment makes its end too
    share = F.col("total") / (n - 1)
    first = F.ceil(F.col("at") / share)
    last = F.when(F.col("at1") >= F.col("total"), n - 1).otherwise(F.ceil(F.col("at1") / share) - 1)
    some = ahead.where("at1 > at").withColumn("n", n).withColumn("share", share).withColumn("k", F.explode(F.when(last >= first, F.sequence(first, last.cast("long"))).otherwise(F.array().cast("array<bigint>"))))
    t = F.least(F.lit(1.0), (F.col("k") * F.col("share") - F.col("at")) / (F.col("at1") - F.col("at")))
    return some.groupBy("trail_id", "k").agg(*[F.max_by(F.col(c) + t * (F.col(f"{c}1") - F.col(c)), "at").alias(c) for c in "xy"])


def densify(lines: DataFrame, most: float) -> DataFrame:
    """trail_id, ord, part, x, y: with evenly spaced points between neighbours further apart than `most`, to 3 places."""
    x1, y1 = F.lead("x").over(_order()), F.lead("y").over(_order())
    ahead = lines.select("trail_id", "ord", "x", "y", x1.alias("x1"), y1.alias("y1"))
    d = distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"))
    parts = F.coalesce(F.greatest(F.ceil(d / most), F.lit(1).cast("long")), F.lit(1).cast("long"))
    many = ahead.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    between = lambda c: F.when(F.col("part") == 0, F.col(c)).otherwise(F.round(F.col(c) + (F.col(f"{c}1") - F.col(c)) * F.col("part") / F.col("parts"), 3)).alias(c)
    return many.select("trail_id", "ord", "part", between("x"), between("y"))


def endpoints(lines: DataFrame, window: int = 12) -> DataFrame:
    """image_id, trail_id, port (0 start, 1 end), x, y, cluster, and tx, ty, the unit direction out of the line over its last vertices."""
    own = Window.partitionBy("image_id", "trail_id")
    place, back = F.row_number().over(own.orderBy("ord")), F.row_number().over(own.orderBy(F.desc("ord")))
    near = lines.withColumn("p", place).withColumn("q", back).withColumn("n", F.count("*").over(own))
    side = lambda port, p: near.where(F.col(p) <= F.least(F.lit(window), F.col("n"))).groupBy("image_id", "trail_id", "cluster").agg(F.min_by("x", p).alias("x"), F.min_by("y", p).alias("y"), F.max_by("x", p).alias("xi"), F.max_by("y", p).alias("yi")).withColumn("port", F.lit(port))
    both = side(0, "p").unionByName(side(1, "q"))
    d = distance(F.col("xi"), F.col("yi"), F.col("x"), F.col("y"))
    unit = lambda c: F.when(d > 0, (F.col(c) - F.col(f"{c}i")) / d).otherwise(0.0)
    return both.select("image_id", "trail_id", "port", "cluster", "x", "y", unit("x").alias("tx"), unit("y").alias("ty"))


def endpoint_pairs(ends: DataFrame, most: float, same_cluster: bool | None = None) -> DataFrame:
    """image_id, i, port_i, j, port_j, d, and ci, cj, the cosines of going straight on, of an image's endpoints closer than `most`, i < j.

    Endpoints meet in grid cells as wide as the reach: each asks its own and the eight around it.
    """
    here = ends.withColumns({"gx": F.floor(F.col("x") / most), "gy": F.floor(F.col("y") / most)})
    around = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
    asks = here.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).withColumns({"gx": F.col("gx") + F.col("dx"), "gy": F.col("gy") + F.col("dy")}).alias("i")
    to = here.alias("j")
    d = distance(F.col("i.x"), F.col("i.y"), F.col("j.x"), F.col("j.y"))
    tests = [F.col("i.image_id") == F.col("j.image_id"), F.col("i.gx") == F.col("j.gx"), F.col("i.gy") == F.col("j.gy"), F.col("i.trail_id") < F.col("j.trail_id"), d < most]
    if same_cluster is not None:
        tests.append((F.col("i.cluster") == F.col("j.cluster")) == F.lit(same_cluster))
    wx, wy = F.col("j.x") - F.col("i.x"), F.col("j.y") - F.col("i.y")
    ci = F.when(d > 0, (F.col("i.tx") * wx + F.col("i.ty") * wy) / d).otherwise(1.0)
    cj = F.when(d > 0, -(F.col("j.tx") * wx + F.col("j.ty") * wy) / d).otherwise(1.0)
    return asks.join(to, tests).select("i.image_id", F.col("i.trail_id").alias("i"), F.col("i.port").alias("port_i"), F.col("j.trail_id").alias("j"), F.col("j.port").alias("port_j"), d.alias("d"), ci.alias("ci"), cj.alias("cj"))


def directional_pairs(ends: DataFrame, most: float, corner: float) -> DataFrame:
    """Endpoint pairs of a cluster that go on in nearly the same direction; corners and long gaps have limits of their own."""
    rows = endpoint_pairs(ends, 2 * most, True)
    # cosines of 55, 100 and 20 degrees
    least = F.when(F.col("d") <= corner, -0.17364817766693033).when(F.col("d") > most, 0.9396926207859084).otherwise(0.573576436351046)
    score = F.col("d") * (2.2 - F.col("ci") - F.col("cj"))
    return rows.where((F.col("ci") >= least) & (F.col("cj") >= least)).withColumn("score", score)


def greedy_bridges(pairs: DataFrame):
    """The pairs (image_id, i, port_i, j, port_j, d), nearest first, whose ports are free and whose lines aren't joined yet."""
    schema = pairs.schema

    def run(group):
        rows = group.sort_by([(c, "ascending") for c in ("d", "i", "j", "port_i", "port_j")])
        used, root, keep = set(), {}, []

        def top(v):
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for k, (i, a, j, b) in enumerate(zip(*(rows[c].to_pylist() for c in ("i", "port_i", "j", "port_j")), strict=True)):
            if (i, a) in used or (j, b) in used or top(i) == top(j):
                continue
            used |= {(i, a), (j, b)}
            root[top(i)] = top(j)
            keep.append(k)
        return rows.take(keep)

    return pairs.groupBy("image_id").applyInArrow(run, schema)


def touching(lines: DataFrame, tolerance: float) -> DataFrame:
    """i, j, d: lines of a cluster an endpoint of one of which is within the tolerance of the other."""
    ends = endpoints(lines).select("trail_id", "cluster", F.col("x").alias("px"), F.col("y").alias("py"))
    x1, y1 = F.lead("x").over(_order()), F.lead("y").over(_order())
    parts = lines.select("trail_id", "cluster", "x", "y", x1.alias("x1"), y1.alias("y1")).where("x1 is not null")
    grid = lambda a, b, pad: F.explode(F.sequence(F.floor((F.least(a, b) - pad) / tolerance), F.floor((F.greatest(a, b) + pad) / tolerance)))
    s = parts.withColumn("gx", grid(F.col("x"), F.col("x1"), tolerance)).withColumn("gy", grid(F.col("y"), F.col("y1"), tolerance)).alias("s")
    e = ends.withColumns({"gx": F.floor(F.col("px") / tolerance), "gy": F.floor(F.col("py") / tolerance)}).alias("e")
    d = to_segment(F.col("e.px"), F.col("e.py"), F.col("s.x"), F.col("s.y"), F.col("s.x1"), F.col("s.y1"))
    keys = [F.col(f"e.{k}") == F.col(f"s.{k}") for k in ("cluster", "gx", "gy")]
    near = e.join(s.hint("merge"), [*keys, F.col("e.trail_id") != F.col("s.trail_id"), d <= tolerance])
    i, j = F.least("e.trail_id", "s.trail_id"), F.greatest("e.trail_id", "s.trail_id")
    return near.select(i.alias("i"), j.alias("j"), d.alias("d")).groupBy("i", "j").agg(F.min("d").alias("d"))


def near_share(lines: DataFrame, tolerance: float) -> DataFrame:
    """a, b, share: of the vertices of line a the share within the tolerance of a vertex of line b of its cluster."""
    around = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
    cells = lines.withColumns({"gx": F.floor(F.col("x") / tolerance), "gy": F.floor(F.col("y") / tolerance)})
    a = cells.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).withColumns({"gx": F.col("gx") + F.col("dx"), "gy": F.col("gy") + F.col("dy")}).alias("a")
    d = distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
    keys = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("cluster", "gx", "gy")]
    hit = a.join(cells.alias("b"), [*keys, F.col("a.trail_id") != F.col("b.trail_id"), d <= tolerance]).groupBy(F.col("a.trail_id").alias("a"), F.col("b.trail_id").alias("b")).agg(F.count_distinct("a.ord").alias("hits"))
    n = lines.groupBy(F.col("trail_id").alias("a")).agg(F.count("*").alias("n"))
    return hit.join(n, "a").select("a", "b", (F.col("hits") / F.col("n")).alias("share"))


def bounds(lines: DataFrame) -> DataFrame:
    """trail_id, cx, cy, w, h of each line's box."""
    low, high = lambda c: F.min(c), lambda c: F.max(c)
    out = lines.groupBy("trail_id").agg(low("x").alias("x0"), high("x").alias("x1"), low("y").alias("y0"), high("y").alias("y1"))
    return out.select("trail_id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))


def cluster_colours(segments: DataFrame) -> DataFrame:
    """image_id, cluster, r, g, b, confidence, class, n_segments of segments (with rid): medians in whole numbers, the best
    confidence, the first segment's class, and their number."""
    return segments.groupBy("image_id", "cluster").agg(*[F.median(c).cast("int").alias(c) for c in "rgb"], F.max("confidence").alias("confidence"), F.min_by("class", "rid").alias("class"), F.count("*").alias("n_segments"))


def long_enough(lines: DataFrame, points: int = 5, least: float = 0.0) -> DataFrame:
    """trail_id of lines with enough points and length."""
    return lengths(lines).where((F.col("n") >= points) & (F.col("length") >= least)).select("trail_id")


def to_pixels(x: Column, y: Column, sx: float, sy: float) -> tuple[Column, Column]:
    """Places of the model's page in pixels, cut to whole numbers."""
    return (x * sx).cast("long"), (y * sy).cast("long")


def port(ends: DataFrame, which: int) -> Column:
    return ends["port"] == which
