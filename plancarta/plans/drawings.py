"""Queries of pixels, drawn pages, colours and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decisions
from ..operators import detectors, drawing, ensemble, folds, graph, pixels, regions, trailmaps, trails
from .queries import PAGE, _fold, _HSV, _INK, _NEAR, _iou, _ios, _query, _SLIM, _HOLDS, _LAST, _area

_CELL = "(select image_id, i, j from (select distinct image_id from drawn), (select unnest(range(0,4)) as i), (select unnest(range(0,4)) as j) where (i*3+j+image_id) % 5<>0)"


def _cell_of(found):
    """The cell of a drawn page that each box lies in, if it fits the cell's square within 2 pixels."""
    row, column = F.floor((F.col("y") + 3) / 24), F.floor((F.col("x") + 3) / 24)
    fits = (F.abs(F.col("y") - row * 24 - 5) <= 2) & (F.abs(F.col("x") - column * 24 - 5) <= 2) & (F.abs(F.col("w") - 14) <= 3) & (F.abs(F.col("h") - 14) <= 3)
    return found.select("image_id", row.alias("i"), column.alias("j"), fits.alias("fits"))


@_query("drawn", sql=f"select image_id, i, j, true as fits, (i+j+image_id) % 2=0 as red from {_CELL}")
def colour_regions(drawn):
    found = detectors.detected(drawn, {"color": detectors.colour}, strict=True)
    row, column = F.floor((F.col("y") + 3) / 24), F.floor((F.col("x") + 3) / 24)
    centre = drawn.select("image_id", F.col("y").cast("long").alias("cy0"), F.col("x").cast("long").alias("cx0"), (F.col("r") > F.col("b")).alias("red")).where("cy0 % 24 = 10 and cx0 % 24 = 10")
    cells = _cell_of(found).distinct()
    return cells.withColumns({"cy0": F.col("i") * 24 + 10, "cx0": F.col("j") * 24 + 10}).join(pixels.by_merge(centre), ["image_id", "cy0", "cx0"]).select("image_id", "i", "j", "fits", "red")


@_query("drawn", sql=f"select image_id, i, j, true as fits from {_CELL}")
def bordered_regions(drawn):
    return _cell_of(detectors.detected(drawn, {"bordered": detectors.bordered}, strict=True)).distinct()


@_query("drawn", sql=f"select image_id, i, j, true as fits from {_CELL}")
def tiled_regions(drawn):
    return _cell_of(detectors.detected_in_tiles(drawn, 72, 36, passes={"color": detectors.colour}, given=detectors.options(colour_share=1e-3, most=0.08))).distinct()


@_query("drawn", sql=f"select image_id, i, j, true as fits from {_CELL}")
def big_pass(drawn):
    # the space between cells is a region too, of another size
    return _cell_of(detectors.big_candidates(drawn, 2, 10, 1e-3, 0.2, detectors.options(close=3))).where("fits").distinct()


@_query("drawn", "profiles", sql=f"select image_id, i, j, true as fits from {_CELL}")
def decided_regions(drawn, profiles):
    return _cell_of(detectors.detected_as_decided(drawn, decisions.config(profiles), {"color": detectors.colour}, strict=True)).distinct()


@_query("drawn", "boxes", sql="select distinct image_id, 'redmap' as kind, true as made from drawn")
def red_maps(drawn, boxes):
    own = boxes.withColumns({c: F.col(c) / 12 for c in "xywh"})
    return drawing.pictures(drawn, own, "redmap").select("image_id", "kind", (F.hex(F.substring("png", 1, 8)) == "89504E470D0A1A0A").alias("made"))


@_query("drawn", sql="select image_id, 'color' as pass, 0::bigint as failed from (select distinct image_id from drawn) union all select image_id, 'broken', 1 from (select distinct image_id from drawn)")
def pass_isolation(drawn):
    def broken(rgb, o):
        raise ValueError("this pass fails")

    found = detectors.detected(drawn, {"broken": broken, "color": detectors.colour})
    return found.groupBy("image_id", "pass").agg(F.count("error").alias("failed"))


@_query("drawn", sql=f"select image_id, i, j, true as fits from {_CELL}")
def geometric_regions(drawn):
    return _cell_of(detectors.detected(drawn, {"geometric": detectors.geometric}, strict=True)).distinct()


@_query("boxes", sql=_fold("w*h desc, rid", f"{_iou('o', 'b')}>0.45"))
def colour_dedup(boxes):
    return folds.keep_largest(boxes, 0.45).select("image_id", "rid")


@_query("boxes", sql=_fold("w*h, rid", f"{_iou('o', 'b')}>0.45"))
def bordered_dedup(boxes):
    return folds.prefer_fine(boxes, 0.45).select("image_id", "rid")


_COLOURS = "(select image_id, rid, rid*37 % 256 as r, rid*91 % 256 as g, rid*13 % 256 as b, (1+rid*29 % 97)/10000e0 as cover from boxes)"


@_query("boxes", sql=f"select image_id, k.rid as rid from (select image_id, unnest(list_filter(list_reduce(l, lambda acc, c: case when len(list_filter(acc, lambda o: sqrt((o.r-c.r)*(o.r-c.r)+(o.g-c.g)*(o.g-c.g)+(o.b-c.b)*(o.b-c.b))<35))>0 then acc else list_append(acc, c) end, list_filter(l, lambda z: false)), lambda c: c.cover>=3e-3)) as k from (select image_id, list({{'rid': rid, 'r': r, 'g': g, 'b': b, 'cover': cover}} order by cover desc, rid) as l from {_COLOURS} group by 1))")
def colour_centre_merge(boxes):
    rid = F.col("rid")
    rows = boxes.select("image_id", "rid", (rid * 37 % 256).alias("r"), (rid * 91 % 256).alias("g"), (rid * 13 % 256).alias("b"), ((1 + rid * 29 % 97) / 10000.0).alias("cover"))
    return folds.merged_colours(rows).select("image_id", "rid")


@_query("boxes", sql="select image_id, arg_max(label, (area, -label)) as label, max(area) as area from (select image_id, rid % 9 as label, sum(w*h) as area from boxes group by 1,2) group by 1 having max(area)>=0.1*1000000")
def largest_component(boxes):
    return pixels.largest(boxes.groupBy("image_id", (F.col("rid") % 9).alias("label")).agg(F.sum(F.col("w") * F.col("h")).alias("area")), 0.1, PAGE)


@_query("boxes", sql="select image_id, rid % 5 as cluster, trunc(median(rid*37 % 256))::int as r, trunc(median(rid*91 % 256))::int as g, trunc(median(rid*13 % 256))::int as b, max(score) as confidence, arg_min(source, rid) as class, count(*) as n_segments from boxes group by 1,2")
def cluster_colour(boxes):
    rid = F.col("rid")
    return trails.cluster_colours(boxes.select("image_id", (rid % 5).alias("cluster"), "rid", (rid * 37 % 256).alias("r"), (rid * 91 % 256).alias("g"), (rid * 13 % 256).alias("b"), F.col("score").alias("confidence"), F.col("source").alias("class")))


_FOLDED = "(select image_id, case when a % 180>90 then a % 180-180 else a % 180 end as a from (select image_id, (rid*rid*17+image_id*5) % 360 as a from boxes))"


@_query("boxes", sql=f"select image_id, arg_max(bin, (n, -bin))*3e0-90+1.5e0 as tilt from (select image_id, floor((a+90)/3) as bin, count(*) as n from {_FOLDED} where abs(a)>8 and abs(a)<82 group by 1,2) join (select image_id, count(*) as every, count_if(abs(a)>8 and abs(a)<82) as tilted from {_FOLDED} group by 1) using (image_id) group by image_id having max(n)>=20 and any_value(tilted)>=greatest(20, any_value(every)*0.1)")
def dominant_tilt(boxes):
    return pixels.tilt(boxes.select("image_id", ((F.col("rid") * F.col("rid") * 17 + F.col("image_id") * 5) % 360).alias("angle")))


_BLOCK = "(select image_id, y, x, (y//16*4+x//16)::bigint as label, (x+y) % 3=0 as line from pixels where (y+x) % 5<>0)"


def _blocks(pixels_):
    return pixels_.where("(y + x) % 5 <> 0").withColumn("label", (F.floor(F.col("y") / 16) * 4 + F.floor(F.col("x") / 16)).cast("long"))


@_query("pixels", sql=f"select image_id, label, min(x) as x, min(y) as y, max(x)-min(x)+1 as w, max(y)-min(y)+1 as h, count(*) as area, avg(x) as cx, avg(y) as cy from {_BLOCK} group by 1,2")
def component_stats(pixels_):
    return pixels.component_stats(_blocks(pixels_).select("image_id", "y", "x", "label"))


@_query("pixels", sql=f"select image_id, label, count(*)/greatest(count_if(line),1) as width, count(*)/greatest(count_if(line),1)>2.5 as fat, count(*)<205 as tiny from {_BLOCK} group by 1,2")
def stroke_width(pixels_):
    labels = _blocks(pixels_).select("image_id", "y", "x", "label")
    return pixels.stroke_widths(labels, pixels_.where("(x + y) % 3 = 0"), 2.5, 205)


@_query("pixels", sql="select image_id, y, x from (select *, row_number() over (partition by image_id order by md5(concat_ws('-',image_id,y,x)), y, x) as p from pixels) where p<=200")
def pixel_sample(pixels_):
    return pixels.sampled(pixels_, 200).select("image_id", "y", "x")


@_query("pixels", sql=f"select image_id, y, x, p or q as either, p and q as both, p and not q as without from (select image_id, y, x, on_ as p, (x+y) % 4=0 as q from {_INK})")
def mask_algebra(pixels_):
    other = pixels_.select("image_id", "y", "x", ((F.col("x") + F.col("y")) % 4 == 0).alias("on"))
    return pixels.combined(pixels.ink(pixels_), other)


@_query("pixels", sql=f"select image_id, y, x from {_INK} where on_ and (x+y) % 4<>0")
def pixels_left(pixels_):
    return pixels.left_over(pixels.ink(pixels_), pixels_.where("(x + y) % 4 = 0"))


_GROWN = f"(select a.image_id, a.y, a.x, bool_or(b.on_) as on_ {_NEAR})"
_WORN = f"(select a.image_id, a.y, a.x, bool_and(b.on_) as on_ {_NEAR})"


@_query("pixels", sql=f"select a.image_id, a.y, a.x, bool_and(b.on_) as \"on\" {_NEAR.replace(_INK, _GROWN)}")
def close_rect(pixels_):
    return pixels.erode(pixels.dilate(pixels.ink(pixels_)))


@_query("pixels", sql=f"select a.image_id, a.y, a.x, bool_or(b.on_) as \"on\" {_NEAR.replace(_INK, _WORN)}")
def open_rect(pixels_):
    return pixels.dilate(pixels.erode(pixels.ink(pixels_)))


_LINEAR = ", ".join(f"case when {c}/255e0>0.04045 then pow(({c}/255e0+0.055)/1.055, 2.4) else {c}/255e0/12.92 end as l{c}" for c in "rgb")
_BENT = ", ".join(f"case when {v}>0.008856 then cbrt({v}) else {v}*7.787+16/116e0 end as {n}" for v, n in (("(lr*0.412453+lg*0.357580+lb*0.180423)/0.95047", "fx"), ("(lr*0.212671+lg*0.715160+lb*0.072169)", "fy"), ("(lr*0.019334+lg*0.119193+lb*0.950227)/1.08883", "fz")))


@_query("pixels", sql=f"select image_id, count_if(d<26)::bigint as ink, round(avg(d),6) as mean from (select image_id, sqrt(pow(116*fy-16-50,2)+pow(500*(fx-fy)-30,2)+pow(200*(fy-fz)-10,2)) as d from (select image_id, {_BENT} from (select image_id, {_LINEAR} from pixels))) group by 1")
def lab_ink_mask(pixels_):
    d = pixels.lab_distance((50.0, 30.0, 10.0))
    return pixels_.groupBy("image_id").agg(F.count_if(d < 26).alias("ink"), F.round(F.avg(d), 6).alias("mean"))


@_query("pixels", sql=f"select image_id, y, x, round(cos(2*pi()*hue/180)*sat/255,6)+0 as c, round(sin(2*pi()*hue/180)*sat/255,6)+0 as d, round(sat/255e0,6) as s, round(val/255e0,6) as v from {_HSV}")
def hue_features(pixels_):
    rows = ensemble.hue_circle(pixels.hsv(pixels_).withColumns({"h": F.col("hue") / 180, "s": F.col("sat") / 255, "v": F.col("val") / 255}))
    return rows.select("image_id", "y", "x", *[(F.round(c, 6) + 0.0).alias(c) for c in "cdsv"])


_PRUNED = "select * from boxes where source='bordered' or w*h<=0.06*1000000"
_MERGED = f"select b.* from pruned b where not exists (select 1 from (select l.image_id, l.rid, count(*) as n, sum({_ios('l', 'r')}*r.w*r.h) as c, any_value(l.w*l.h) as a, bool_or({_SLIM}) as slim from pruned l join pruned r on l.image_id=r.image_id where r.w*r.h<l.w*l.h and {_ios('l', 'r')}>0.8 group by 1,2) d where d.image_id=b.image_id and d.rid=b.rid and n>=2 and c>=0.75*a and not slim)"
_CHOSEN = _fold("score desc, w*h desc, rid", f"{_iou('o', 'b')}>0.4 or ({_ios('o', 'b')}>0.7 and {_area('b')}<={_area('o')})", f"case when len(list_filter(acc, lambda o: {_HOLDS}))>0 then list_transform(acc, lambda o, i: case when i={_LAST} then b else o end) else list_append(acc, b) end").replace("from boxes", "from merged")


@_query("boxes", sql=f"select image_id, row_number() over (partition by image_id order by score desc, w*h desc, rid) as id, rid, source from ({_CHOSEN}) join boxes using (image_id, rid) where source<>'bordered' or w*h>=1.5e-3*1000000", pruned=_PRUNED, merged=_MERGED)
def ensemble_fused(boxes):
    return ensemble.fused(boxes, PAGE).select("image_id", "id", "rid", "source")


_MEANS = "(select image_id, rid % 4 as cluster, round(avg(x)/1000,4) as x from boxes group by 1,2)"


@_query("boxes", sql=f"select image_id, cluster, dense_rank() over (partition by image_id order by root)-1 as merged from (select image_id, cluster, min(cluster) over (partition by image_id, part) as root from (select *, sum(case when x-px<0.022 then 0 else 1 end) over (partition by image_id order by x, cluster) as part from (select *, lag(x) over (partition by image_id order by x, cluster) as px from {_MEANS})))")
def cluster_postmerge(boxes):
    by = boxes.groupBy("image_id", (F.col("rid") % 4).alias("cluster")).agg(F.round(F.avg("x") / 1000, 4).alias("r"), F.first(F.lit(0.0)).alias("g"), F.first(F.lit(0.0)).alias("b"))
    return ensemble.merged_clusters(by, 0.022)


def _strokes(drawn):
    """A page with one red stroke that is broken in the middle, and the polygons of its halves."""
    # dealt before it grows: few bytes of ids are long work
    pages = detectors.spread(drawn.select("image_id").distinct(), "image_id")
    rows = pages.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(59)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(119))))
    on = F.col("y").between(28, 31) & (F.col("x").between(8, 51) | F.col("x").between(60, 111))
    painted = rows.withColumns({"r": F.when(on, 200).otherwise(255), "g": F.when(on, 40).otherwise(255), "b": F.when(on, 40).otherwise(255)})
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = lambda x0, x1: F.array(corner(x0, 26), corner(x1, 26), corner(x1, 34), corner(x0, 34))
    polygons = pages.withColumn("points", F.explode(F.array(ring(6, 53), ring(58, 113)))).withColumns({"confidence": F.lit(0.9), "class": F.lit("trail")})
    return polygons, painted


@_query("drawn", sql="select distinct image_id, 1::bigint as trails, true as whole, 'trail' as class, 200 as r, 40 as g, 40 as b from drawn")
def trail_driver(drawn):
    found = trailmaps.trails_from(*_strokes(drawn)).where("error is null")
    x = F.transform("points", lambda p: p.x)
    whole = (F.array_min(x) <= 14) & (F.array_max(x) >= 105)
    return found.groupBy("image_id").agg(F.count("*").alias("trails"), F.bool_or(whole).alias("whole"), F.max("class").alias("class"), *[F.max(c).alias(c) for c in "rgb"])


@_query("drawn", sql="select distinct image_id, 1::bigint as lines, true as whole from drawn")
def merged_trails(drawn):
    polygons = _strokes(drawn)[0]
    from pyspark.sql import Window

    numbered = polygons.withColumn("pid", F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("points")[0]["x"])))
    lines = trailmaps.centrelines(numbered, 4)
    ends = lines.select("image_id", F.col("pid").alias("trail_id"), F.posexplode("points").alias("ord", "p")).select("image_id", "trail_id", "ord", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("image_id").alias("cluster"))
    bridges = trails.greedy_bridges(trails.endpoint_pairs(trails.endpoints(ends), 25).drop("ci", "cj"))
    found = trailmaps.merged_lines(lines, bridges.select("image_id", "i", "j"))
    x = F.transform("points", lambda p: p.x)
    return found.groupBy("image_id").agg(F.count("*").alias("lines"), F.bool_or((F.array_min(x) <= 14) & (F.array_max(x) >= 105)).alias("whole"))
