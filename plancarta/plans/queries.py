"""The registered queries: each operator over derived plan-map tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decisions, geometry, text
from ..functions.geometry import Box
from ..operators import ensemble, folds, graph, labels, pixels, regions, registry, shapes, spatial, trails
from .fixtures import fixture, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PAGE = 1_000_000.0


def _query(*inputs: str, sql: str | None = None, **views: str):
    """Register a function of DataFrames (fixtures by name, `table:` for the driver's own tables) and its SQL, with views."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[spark.read.parquet(f"{sf_dir}/{n[6:]}.parquet") if n.startswith("table:") else fixture(spark, sf_dir, n) for n in inputs])

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = oracle(sql, *[n for n in inputs if not n.startswith("table:")], **views)
        return f

    return add


# --- SQL of shared parts ---------------------------------------------------------------------------------------------


def _inter(a: str, b: str) -> str:
    side = lambda v, s: f"greatest(0e0, least({a}.{v}+{a}.{s},{b}.{v}+{b}.{s})-greatest({a}.{v},{b}.{v}))"
    return f"({side('x', 'w')}*{side('y', 'h')})"


def _area(a: str) -> str:
    return f"({a}.w*{a}.h)"


def _iou(a: str, b: str) -> str:
    union = f"({_area(a)}+{_area(b)}-{_inter(a, b)})"
    return f"(case when {union}>0 then {_inter(a, b)}/{union} else 0e0 end)"


def _ios(a: str, b: str) -> str:
    small = f"least({_area(a)},{_area(b)})"
    return f"(case when {small}>0 then {_inter(a, b)}/{small} else 0e0 end)"


_PAIR = "boxes l join boxes r on l.image_id=r.image_id"
_HELD = "select b.image_id, b.rid, t.tid from texts t join boxes b on t.image_id=b.image_id and (t.x0+t.x1)/2 between b.x and b.x+b.w and (t.y0+t.y1)/2 between b.y and b.y+b.h"
_T = "greatest(0e0, least(b.x+b.w,t.x1)-greatest(b.x,t.x0))*greatest(0e0, least(b.y+b.h,t.y1)-greatest(b.y,t.y0))"
_ORPHAN = f"""select image_id, rid, tid from (select b.image_id, b.rid, t.tid, {_T} as cover, (t.x1-t.x0)*(t.y1-t.y0) as area,
 row_number() over (partition by t.image_id, t.tid order by {_T} desc, b.rid) as k from texts t join boxes b on t.image_id=b.image_id
 where not exists (select 1 from ({_HELD}) h where h.image_id=t.image_id and h.tid=t.tid)) where k=1 and cover>0 and cover>=0.30*(case when area>0 then area else 1 end)"""


def _match(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


def _status(c: str) -> str:
    short = f"len(list_filter(string_split_regex({c}, '\\s+'), lambda t: t<>''))<=8"
    like = f"({_match(c, text.AREA)} or {_match(c, text.COMPANY)} or ({_match(c, text.CODE)} and {short}))"
    return f"(case when coalesce({c},'')='' then 'empty' when {like} then 'boothlike' when {_match(c, text.FACILITY)} then 'facility' else 'text' end)"


_COLLAPSE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_LABELS = f"""select image_id, rid, {_COLLAPSE.format("string_agg(text, ' ' order by round_even((y0+y1)/2/8,0), (x0+x1)/2, tid)")} as label, count(*) as n_text
 from (({_HELD}) union all ({_ORPHAN})) o join texts using (image_id, tid) group by all"""
_TAGGED = f"(select b.*, coalesce(l.label,'') as label, coalesce(l.n_text,0) as n_text, {_status('l.label')} as status from boxes b left join ({_LABELS}) l using (image_id, rid))"
_HALLS = "(select *, concat('Hall_', row_number() over (partition by image_id order by hall_ord)) as hall from halls where w>0 and h>0)"


def _hall(boxes: str) -> str:
    inside = "b.x+b.w/2 between h.cx-h.w/2 and h.cx+h.w/2 and b.y+b.h/2 between h.cy-h.h/2 and h.cy+h.h/2"
    return f"(select b.*, coalesce((select min_by(h.hall, h.hall_ord) from {_HALLS} h where h.image_id=b.image_id and {inside}),'Other') as hall from {boxes} b)"


def _keeps(policy: str) -> str:
    if policy == "shape":
        return "(source in ('color','bordered','bigregion') or (source='opencv_strict' and status<>'empty') or status='boothlike')"
    return f"status in ({', '.join(repr(s) for s in labels.POLICIES[policy])})"


# --- labels, halls and policies --------------------------------------------------------------------------------------


@_query("boxes", "texts", "halls", sql=f"""select i.image_id, i.hall, count(k.rid) as n_regions, coalesce(count_if(k.status='boothlike'),0)::bigint as n_boothlike, coalesce(sum(k.n_text),0)::bigint as n_text
 from (select image_id, hall from {_HALLS} union select distinct image_id, hall from {_hall(f"(select * from {_TAGGED} where {_keeps('textless')})")}) i
 left join {_hall(f"(select * from {_TAGGED} where {_keeps('textless')})")} k using (image_id, hall) group by all""")
def hall_map_counts(boxes, texts, halls):
    return labels.hall_counts(labels.labelled(texts, boxes), halls)


@_query("boxes", "halls", sql=f"select image_id, rid, hall from {_hall('boxes')}")
def hall_assign_first_match(boxes, halls):
    return labels.hall_of(boxes, halls).select("image_id", "rid", "hall")


@_query("boxes", "texts", sql=_HELD)
def label_join_contained(boxes, texts):
    return labels.contained(texts, boxes)


@_query("boxes", "texts", sql=_ORPHAN)
def label_join_orphan(boxes, texts):
    return labels.orphans(texts, boxes)


@_query("boxes", "texts", sql=f"select image_id, rid, label, n_text::bigint as n_text from {_TAGGED}")
def label_ordered_concat(boxes, texts):
    return labels.labelled(texts, boxes).select("image_id", "rid", "label", "n_text")


@_query("texts", sql=f"select image_id, tid, {_status('text')} as status from texts")
def tag_text_status(texts):
    return texts.select("image_id", "tid", text.status(F.col("text")).alias("status"))


@_query("texts", sql=f"select image_id, tid, list_has_any(string_split_regex(lower(replace(text,'/',' ')), '\\s+'), {text.ZONES!r}) as zone from texts")
def zone_type(texts):
    return texts.select("image_id", "tid", text.is_zone(F.col("text")).alias("zone"))


@_query("texts", sql="select image_id, tid, case when length(n)>1 then n end as name from (select *, trim(regexp_replace(regexp_replace(concat(text,' #é'), '[^A-Za-z0-9 .&\\-/]', '', 'g'), '\\s+', ' ', 'g')) as n from texts)")
def ocr_cleanup(texts):
    return texts.select("image_id", "tid", text.ocr_name(F.concat("text", F.lit(" #é"))).alias("name"))


@_query("texts", sql="select image_id, tid, case when length(text)>22 then concat(left(text,21),'…') else text end as label from texts")
def label_shortened(texts):
    return texts.select("image_id", "tid", text.shortened(F.col("text")).alias("label"))


@_query("boxes", "texts", sql=" union all ".join(f"select '{p}' as policy, count_if({_keeps(p)})::bigint as kept, count_if(not ({_keeps(p)}))::bigint as dropped from {_TAGGED}" for p in [*labels.POLICIES, "shape"]))
def policy_preview(boxes, texts):
    return labels.policy_preview(labels.labelled(texts, boxes))


@_query("boxes", "texts", sql=f"select image_id, rid, source, status from {_TAGGED} where {_keeps('shape')}")
def policy_shape(boxes, texts):
    return labels.labelled(texts, boxes).where(labels.keeps("shape")).select("image_id", "rid", "source", "status")


@_query("boxes", "texts", sql=f"select image_id, count(*) as n, count_if(status='boothlike')::bigint as n_boothlike, case when count_if(status='boothlike')>=greatest(10, 0.15*greatest(count(*),1)) then 'strict' else 'shape' end as policy from {_TAGGED} group by 1")
def policy_adaptive(boxes, texts):
    return labels.adaptive(labels.labelled(texts, boxes))


@_query("boxes", "texts", sql=f"select d.place, d.status, count(t.rid) as n from (values (0,'boothlike'),(1,'text'),(2,'facility'),(3,'empty')) d(place,status) left join {_TAGGED} t using (status) group by all")
def status_histogram(boxes, texts):
    return labels.status_histogram(labels.labelled(texts, boxes))


@_query("boxes", sql="select coalesce(source,'?') as source, count(*) as n from boxes group by 1")
def source_histogram(boxes):
    return labels.source_histogram(boxes)


@_query("boxes", "texts", sql=f"select image_id, count(*) as n_detected, {', '.join(f'''count_if(status='{s}')::bigint as {s}''' for s in labels.STATUSES)}, count_if({_keeps('shape')})::bigint as n_kept from {_TAGGED} group by 1")
def batch_summary(boxes, texts):
    tagged = labels.labelled(texts, boxes)
    return tagged.groupBy("image_id").agg(F.count("*").alias("n_detected"), *[F.count_if(F.col("status") == s).alias(s) for s in labels.STATUSES], F.count_if(labels.keeps("shape")).alias("n_kept"))


# --- overlaps, shapes and folds --------------------------------------------------------------------------------------


@_query("boxes", sql=f"select l.image_id, l.rid as a, r.rid as b, {_iou('l', 'r')} as iou from {_PAIR} where l.rid<r.rid and {_iou('l', 'r')}>0.3")
def iou_pairs(boxes):
    return regions.pairs(boxes, "iou", 0.3)


@_query("boxes", sql=f"select l.image_id, l.rid as a, r.rid as b, {_ios('l', 'r')} as ios from {_PAIR} where l.rid<r.rid and {_ios('l', 'r')}>0.7")
def ios_pairs(boxes):
    return regions.pairs(boxes, "ios", 0.7)


@_query("boxes", sql="select image_id, rid, w*h as area from boxes")
def polygon_area_ring(boxes):
    points = geometry.open_ring(geometry.ring(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    return boxes.select("image_id", "rid", geometry.shoelace(points).alias("area"))


@_query("boxes", sql="select image_id, rid, x as x0, y as y0, x+w as x1, y+h as y1, x+w/2 as cx, y+h/2 as cy from boxes")
def box_corners(boxes):
    b = Box()
    return boxes.select("image_id", "rid", b.x.alias("x0"), b.y.alias("y0"), b.right.alias("x1"), b.bottom.alias("y1"), (b.x + b.w / 2).alias("cx"), (b.y + b.h / 2).alias("cy"))


@_query("boxes", sql="select image_id, rid from boxes where source='bordered' or w*h<=4000")
def oversize_prune(boxes):
    return regions.oversize_prune(boxes, PAGE, 0.004).select("image_id", "rid")


@_query("boxes", sql="select image_id, rid from boxes where source<>'bordered' or w*h>=1500")
def bordered_floor(boxes):
    return regions.bordered_floor(boxes, PAGE, 1.5e-3).select("image_id", "rid")


_AREA = "floor(w*h*(40+rid % 61)/100)"


def _with_area(boxes):
    return boxes.withColumn("area", F.floor(F.col("w") * F.col("h") * (40 + F.col("rid") % 61) / 100).cast("double"))


@_query("boxes", sql=f"select image_id, rid from (select *, {_AREA} as area from boxes) where area between 100 and 60000 and least(w,h)>=20 and x>=2 and y>=2 and x+w<=998 and y+h<=998 and area/(w*h)>=0.6 and least(w,h)/greatest(w,h)>=0.14")
def component_shape_filter(boxes):
    return regions.component_shapes(_with_area(boxes), 1000, 1000).select("image_id", "rid")


@_query("boxes", sql=f"select image_id, rid from (select *, {_AREA} as area from boxes) where area between 200 and 60000 and least(w,h)>=14 and area/(w*h)>=0.45 and least(w,h)/greatest(w,h)>=0.12")
def color_shape_filter(boxes):
    return regions.color_shapes(_with_area(boxes), PAGE).select("image_id", "rid")


@_query("boxes", sql=f"select image_id, rid from (select *, {_AREA} as area from boxes) where area between 150 and 60000 and 2*(w+h)>0 and rid % 15 between 3 and 12 and area/(w*h)>=0.55 and least(w,h)/greatest(w,h)>=0.14")
def bordered_shape_filter(boxes):
    rows = _with_area(boxes).withColumns({"perimeter": 2 * (F.col("w") + F.col("h")), "corners": F.col("rid") % 15})
    return regions.bordered_shapes(rows, PAGE).select("image_id", "rid")


@_query("boxes", sql=f"select image_id, bool_or(area between 1000 and 50000 and least(w,h)>=15 and area/(w*h)>=0.85 and greatest(w,h)/least(w,h)<=6) as open from (select *, {_AREA} as area from boxes) group by 1")
def white_gate(boxes):
    return regions.white_gate(_with_area(boxes), PAGE)


_SLIM = "(greatest(r.w,r.h)/greatest(1e0,least(r.w,r.h))>2.5 and r.w*r.h<15000)"


@_query("boxes", sql=f"select image_id, rid from boxes b where not exists (select 1 from (select l.image_id, l.rid, count(*) as n, sum({_ios('l', 'r')}*r.w*r.h) as c, any_value(l.w*l.h) as a, bool_or({_SLIM}) as slim from {_PAIR} where r.w*r.h<l.w*l.h and {_ios('l', 'r')}>0.8 group by 1,2) d where d.image_id=b.image_id and d.rid=b.rid and n>=2 and c>=0.75*a and not slim)")
def merged_block_drop(boxes):
    return regions.merged_block_drop(boxes).select("image_id", "rid")


@_query("boxes", sql=f"select image_id, rid from boxes b where not exists (select 1 from (select l.image_id, l.rid, count(*) as n, sum({_ios('l', 'r')}*r.w*r.h) as c, any_value(l.w*l.h) as a from {_PAIR} where r.w*r.h<l.w*l.h and {_ios('l', 'r')}>0.8 group by 1,2) d where d.image_id=b.image_id and d.rid=b.rid and n>=2 and c>=0.55*a)")
def row_envelope_drop(boxes):
    return regions.row_envelope_drop(boxes).select("image_id", "rid")


@_query("boxes", sql=f"select l.image_id, l.rid from boxes l where not exists (select 1 from boxes r where l.image_id=r.image_id and r.w*r.h>l.w*l.h and {_ios('l', 'r')}>0.85)")
def nested_fragment_drop(boxes):
    return regions.nested_fragment_drop(boxes).select("image_id", "rid")


@_query("boxes", sql=f"select l.image_id, l.rid from boxes l where l.source='bordered' or (select count(*) from boxes r where l.image_id=r.image_id and r.source='bordered' and r.w*r.h>=500 and r.w*r.h between 0.1*l.w*l.h and 0.7*l.w*l.h and {_inter('l', 'r')}/(r.w*r.h)>0.7)<2")
def demerge_tiles(boxes):
    return regions.demerge(boxes, PAGE, 5e-4).select("image_id", "rid")


def _fold(order: str, goes: str, keep: str = "list_append(acc, b)") -> str:
    """An ordered fold over the boxes of an image as a list; acc holds what is kept."""
    box = "{'rid': rid, 'x': x, 'y': y, 'w': w, 'h': h, 'score': score}"
    step = f"case when len(list_filter(acc, lambda o: {goes}))>0 then acc else {keep} end"
    return f"select image_id, k.rid as rid from (select image_id, unnest(list_reduce(l, lambda acc, b: {step}, list_filter(l, lambda z: false))) as k from (select image_id, list({box} order by {order}) as l from boxes group by 1))"


_HOLDS = f"{_ios('o', 'b')}>0.7 and {_area('b')}>{_area('o')}"
_LAST = f"list_max(list_transform(list_filter(range(1, len(acc)+1), lambda i: {_HOLDS.replace('o.', 'acc[i].')}), lambda i: i))"


@_query("boxes", sql=_fold("score desc, w*h desc, rid", f"{_iou('o', 'b')}>0.3 or ({_ios('o', 'b')}>0.7 and {_area('b')}<={_area('o')})", f"case when len(list_filter(acc, lambda o: {_HOLDS}))>0 then list_transform(acc, lambda o, i: case when i={_LAST} then b else o end) else list_append(acc, b) end"))
def nms_fused(boxes):
    return folds.non_max_suppression(boxes).select("image_id", "rid")


@_query("boxes", sql=_fold("w*h desc, rid", f"{_ios('o', 'b')}>=0.6 and {_area('o')}>{_area('b')}"))
def drop_contained(boxes):
    return folds.drop_contained(boxes).select("image_id", "rid")


@_query("boxes", sql=_fold("w*h, rid", f"{_iou('o', 'b')}>0.55"))
def prefer_fine_pass1(boxes):
    return folds.prefer_fine(boxes).select("image_id", "rid")


@_query("boxes", sql=_fold("w*h desc, rid", f"{_iou('o', 'b')}>0.4"))
def keep_largest(boxes):
    return folds.keep_largest(boxes).select("image_id", "rid")


@_query("boxes", sql=_fold("score desc, rid", f"{_iou('o', 'b')}>0.5"))
def trail_nms(boxes):
    return folds.best_confidence(boxes, 0.5).select("image_id", "rid")


_CELLS = "(select *, unnest(range(floor(x/4)::bigint, greatest(floor(x/4)::bigint, floor((x+w)/4)::bigint-1)+1)) as gx from boxes)"
_CELLS = f"(select *, unnest(range(floor(y/4)::bigint, greatest(floor(y/4)::bigint, floor((y+h)/4)::bigint-1)+1)) as gy from {_CELLS})"


@_query("boxes", sql=f"select image_id, rid from boxes b where not exists (select 1 from (select l.image_id, l.rid, count(distinct (l.gx,l.gy)) as hit from {_CELLS} l join {_CELLS} r on l.image_id=r.image_id and l.gx=r.gx and l.gy=r.gy and r.w*r.h<0.9*l.w*l.h group by 1,2) d join (select image_id, rid, count(*) as n from {_CELLS} group by 1,2) s using (image_id, rid) where d.image_id=b.image_id and d.rid=b.rid and hit>0.8*n)")
def prefer_fine_coverage(boxes):
    return regions.fine_coverage(boxes).select("image_id", "rid")


_PARTS = "(select image_id, rid*10+k as rid, rid as parent, x+(w/2)*k as x, y, w/2 as w, h*(20+rid % 60)/100 as h from boxes, (values (0),(1)) v(k) where rid % 4<>0 or k=0)"


@_query("boxes", sql=f"select image_id, rid, x, y, w, h from boxes b where not exists (select 1 from (select image_id, parent, count(*) as n, sum(w*h) as c from {_PARTS} group by 1,2) p where p.image_id=b.image_id and p.parent=b.rid and n>=2 and c>45e-2*(b.w*b.h)) union all select c.image_id, c.rid, c.x, c.y, c.w, c.h from {_PARTS} c join boxes b on b.image_id=c.image_id and b.rid=c.parent join (select image_id, parent, count(*) as n, sum(w*h) as c from {_PARTS} group by 1,2) p on p.image_id=c.image_id and p.parent=c.parent where p.n>=2 and p.c>45e-2*(b.w*b.h)")
def split_acceptance(boxes):
    k = F.explode(F.when(F.col("rid") % 4 != 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    cells = boxes.withColumn("k", k).select("image_id", (F.col("rid") * 10 + F.col("k")).alias("rid"), F.col("rid").alias("parent"), (F.col("x") + F.col("w") / 2 * F.col("k")).alias("x"), "y", (F.col("w") / 2).alias("w"), (F.col("h") * (20 + F.col("rid") % 60) / 100).alias("h"))
    return regions.split_acceptance(boxes, cells)


# --- tiles, big regions and scales -----------------------------------------------------------------------------------

_PAGES = "(select s_suppkey as image_id, (1000+s_suppkey*97 % 5000)::bigint as width, (1800+s_suppkey % 3)::bigint as height from supplier)"
_ORIGIN = "unnest(range(0, (case when {0}<=1800 then 0 else ceil(({0}-1800)/1400.0)::bigint*1400 end)+1, 1400))"


def _pages(supplier: DataFrame) -> DataFrame:
    return supplier.select(F.col("s_suppkey").alias("image_id"), (1000 + F.col("s_suppkey") * 97 % 5000).alias("width"), (1800 + F.col("s_suppkey") % 3).alias("height"))


@_query("table:supplier", sql=f"select image_id, width, height, tx, ty, least(1800, width-tx) as tw, least(1800, height-ty) as th from (select *, {_ORIGIN.format('height')} as ty from (select *, {_ORIGIN.format('width')} as tx from {_PAGES}))")
def tile_origins(supplier):
    return regions.tiles(_pages(supplier))


_SEAM = "((x<=4 and tx>0) or (y<=4 and ty>0) or (x+w>=996 and tx<2400) or (y+h>=996 and ty<2400))"


@_query("boxes", sql=f"select image_id, rid from (select *, (rid % 4)*800 as tx, (rid % 3)*1200 as ty from boxes) where not {_SEAM}")
def tile_assign_seam_clip(boxes):
    rows = boxes.withColumns({"tx": F.col("rid") % 4 * 800, "ty": F.col("rid") % 3 * 1200, "tw": F.lit(1000), "th": F.lit(1000), "width": F.lit(3400), "height": F.lit(3400)})
    return rows.where(~regions.seam_clipped()).select("image_id", "rid")


@_query("boxes", sql="select image_id, rid, x+(rid % 4)*800 as x, y+(rid % 3)*1200 as y, w, h from boxes")
def tile_offset_back(boxes):
    return boxes.select("image_id", "rid", (F.col("x") + F.col("rid") % 4 * 800).alias("x"), (F.col("y") + F.col("rid") % 3 * 1200).alias("y"), "w", "h")


_BIG = "(select image_id, rid, x, y, w*10 as w, h*10 as h from boxes where source='bigregion')"
_CROPS = "(select * from boxes where source<>'bigregion')"


def _big(boxes):
    return regions.big_regions(boxes.where("source = 'bigregion'").withColumns({"w": F.col("w") * 10, "h": F.col("h") * 10}), PAGE, 0.0, 1.0)


@_query("boxes", sql=f"select l.image_id, l.rid, coalesce(sum(case when r.rid is not null then {_inter('l', 'r')} end),0e0)/any_value(l.w*l.h) as coverage, count(r.rid) as n_inner from {_BIG} l left join {_CROPS} r on l.image_id=r.image_id and {_inter('l', 'r')}>0 group by 1,2")
def big_region_coverage(boxes):
    return regions.big_coverage(_big(boxes), boxes.where("source <> 'bigregion'"))


_KEPT = f"(select l.image_id, l.rid, any_value(l.x) as x, any_value(l.y) as y, any_value(l.w) as w, any_value(l.h) as h from {_BIG} l left join {_CROPS} r on l.image_id=r.image_id and {_inter('l', 'r')}>0 group by 1,2 having coalesce(sum(case when r.rid is not null then {_inter('l', 'r')} end),0e0)/any_value(l.w*l.h)<0.15)"


@_query("boxes", sql=f"select image_id, rid, 'big' as role from {_KEPT} union all select r.image_id, r.rid, 'crop' from {_CROPS} r where not exists (select 1 from {_KEPT} l where l.image_id=r.image_id and {_inter('l', 'r')}>0)")
def big_region_merge(boxes):
    crops, big = boxes.where("source <> 'bigregion'"), _big(boxes)
    kept = big.join(regions.big_coverage(big, crops).where("coverage < 0.15").select("image_id", "rid"), ["image_id", "rid"])
    touched = spatial.overlaps(kept, crops).select("r.image_id", "r.rid").distinct()
    rest = crops.join(touched, ["image_id", "rid"], "left_anti").select("image_id", "rid", F.lit("crop").alias("role"))
    return kept.select("image_id", "rid", F.lit("big").alias("role")).unionByName(rest)


@_query("boxes", "texts", sql=f"select b.image_id, b.rid, count(distinct (floor((t.x0+t.x1)/2/120), floor((t.y0+t.y1)/2/120))) as cells from {_BIG} b join texts t on t.image_id=b.image_id and (t.x0+t.x1)/2 between b.x and b.x+b.w and (t.y0+t.y1)/2 between b.y and b.y+b.h group by 1,2")
def distinct_label_cells(boxes, texts):
    cell = lambda c: F.floor(F.col(f"p.{c}") / 120)
    return spatial.point_in_box(labels.centred(texts), _big(boxes)).groupBy("b.image_id", "b.rid").agg(F.count_distinct(cell("cx"), cell("cy")).alias("cells"))


@_query("boxes", sql="select image_id, rid, round_even(x*0.75,0)::bigint as x, round_even(y*0.75,0)::bigint as y, round_even(w*0.75,0)::bigint as w, round_even(h*0.75,0)::bigint as h from boxes")
def scale_booth_half_even(boxes):
    return regions.scaled(boxes, 0.75).select("image_id", "rid", "x", "y", "w", "h")


@_query("boxes", sql="select image_id, rid, trunc(x/0.8)::bigint as x, trunc(y/0.8)::bigint as y, trunc(w/0.8)::bigint as w, trunc(h/0.8)::bigint as h, w*h/0.64 as area from boxes")
def scale_back_render(boxes):
    return boxes.select("image_id", "rid", *[(F.col(c) / 0.8).cast("long").alias(c) for c in "xywh"], (F.col("w") * F.col("h") / 0.64).alias("area"))


@_query("texts", sql="select image_id, tid, (x0-10)*2 as x0, (1010-y1)*2 as y0, (x1-10)*2 as x1, (1010-y0)*2 as y1 from texts")
def affine_text_rect(texts):
    flip = lambda c: ((1010 - F.col(c)) * 2).cast("double")
    shift = lambda c: ((F.col(c) - 10) * 2).cast("double")
    return texts.select("image_id", "tid", shift("x0").alias("x0"), flip("y1").alias("y0"), shift("x1").alias("x1"), flip("y0").alias("y1"))


@_query("boxes", "texts", sql=f"select image_id, coalesce(nullif(trim(label),''), cast(rid as varchar)) as id, w*h as area, nullif(trim(label),'') as name from {_TAGGED}")
def normalize_regions(boxes, texts):
    name = F.nullif(F.trim("label"), F.lit(""))
    return labels.labelled(texts, boxes).select("image_id", F.coalesce(name, F.col("rid").cast("string")).alias("id"), Box().area.alias("area"), name.alias("name"))


# --- decisions -------------------------------------------------------------------------------------------------------

_FILL = "case when colored_frac>=0.045 then 'colored' when grey_frac>=0.045 then 'grey' else 'white' end"
_DENSITY = "case when n_geo<15 then 'sparse' when median_area_frac<=5e-4 and n_geo>=40 then 'dense' when median_area_frac<=6e-3 then 'normal' else 'sparse' end"
_PROFILED = f"(select *, {_FILL} as fill, {_DENSITY} as density from profiles)"


@_query("profiles", sql=f"select image_id, fill, density, concat_ws('/', source, fill, density) as profile from {_PROFILED}")
def profile_fill_density(profiles):
    return decisions.profiled(profiles).select("image_id", "fill", "density", "profile")


@_query("profiles", sql=f"select image_id, case when density='dense' then 250 else 150 end as dpi, case density when 'dense' then null when 'normal' then 4500 else 4000 end as max_edge, density='dense' as tiling, case when density='dense' then 1800 end as tile, case when density='dense' then 400 end as overlap, density='dense' as big_pass, case density when 'dense' then 5e-4 when 'normal' then 1.5e-3 else 3e-3 end as bordered_floor, case when fill='grey' or grey_frac>=0.05 then 140 end as grey_low, case when fill='grey' or grey_frac>=0.05 then 245 end as grey_high, case when density='dense' then 3 else 9 end as close_ksize, 0.4::double as iou, 0.06::double as max_box_area_frac, density='dense' as demerge, case when source='pdf_vector' then 'vector' else 'ocr' end as labels, 'none' as policy from {_PROFILED}")
def config_decision_table(profiles):
    return decisions.config(profiles)


@_query("profiles", sql=f"select image_id, concat_ws('; ', concat('density ', density), case when density='dense' then 'tiles at 250 dpi' end, case when fill='grey' or grey_frac>=0.05 then 'neutral grey band' end, case when source='pdf_vector' then 'vector labels' else 'read labels' end) as rationale from {_PROFILED}")
def config_rationale(profiles):
    return decisions.rationale(profiles)


# --- pixels ----------------------------------------------------------------------------------------------------------

_V, _D = "greatest(r,g,b)", "(greatest(r,g,b)-least(r,g,b))"
_TURN = f"case when {_D}=0 then 0e0 when {_V}=r then (g-b)*30e0/{_D} when {_V}=g then 60+(b-r)*30e0/{_D} else 120+(r-g)*30e0/{_D} end"
_HSV = f"(select *, (round_even(case when t<0 then t+180 else t end,0)::int % 180) as hue, case when v=0 then 0 else round_even(d*255e0/v,0)::int end as sat, v as val from (select *, {_TURN} as t, {_D} as d, {_V} as v from pixels))"


@_query("pixels", sql=f"select image_id, avg((sat>45 and val>50 and val<250)::int) as colored, avg((sat<=30 and val between 120 and 210)::int) as grey, avg((sat<=30 and val>210)::int) as white from {_HSV} group by 1")
def colour_fractions(pixels_):
    return pixels.colour_fractions(pixels_)


@_query("pixels", sql=f"select image_id, least(255, greatest(200, trunc(case when count_if(sat<25)>20 then quantile_cont(case when sat<25 then val end, 0.8) else 245 end)::int)) as level from {_HSV} group by 1")
def bg_percentile(pixels_):
    return pixels.background(pixels_, 20)


@_query("pixels", sql=f"select image_id, hue, n::bigint as n from (select image_id, (hue+k+180) % 180 as hue, sum(n) as n, row_number() over (partition by image_id order by sum(n) desc, (hue+k+180) % 180) as p from (select image_id, hue, count(*) as n from {_HSV} where sat>45 group by 1,2), (select unnest(range(-5,6))::int as k) group by 1,2) where p=1")
def hue_histogram(pixels_):
    return pixels.main_hue(pixels_)


@_query("pixels", sql=f"select image_id, case when val<60 then 'dark' when sat<=30 and val>210 then 'white' when sat<=30 then 'grey' else 'colored' end as class, count(*) as n from {_HSV} group by 1,2")
def recolor_classes(pixels_):
    return pixels.recolor(pixels_)


_INK = "(select image_id, y, x, round_even(r*0.299::double+g*0.587::double+b*0.114::double,0)<128 as on_ from pixels)"
_NEAR = f"from (select *, unnest([y-1,y,y+1]) as y1 from (select *, unnest([x-1,x,x+1]) as x1 from {_INK})) a join {_INK} b on a.image_id=b.image_id and b.y=a.y1 and b.x=a.x1 group by 1,2,3"


@_query("pixels", sql=f"select a.image_id, a.y, a.x, bool_or(b.on_) as \"on\" {_NEAR}")
def dilate_rect(pixels_):
    return pixels.dilate(pixels.ink(pixels_))


@_query("pixels", sql=f"select a.image_id, a.y, a.x, bool_and(b.on_) as \"on\" {_NEAR}")
def erode_rect(pixels_):
    return pixels.erode(pixels.ink(pixels_))


@_query("pixels", sql="select image_id, (y//4)::int as y, (x//4)::int as x, round_even(avg(r),0)::int as r, round_even(avg(g),0)::int as g, round_even(avg(b),0)::int as b from pixels group by 1,2,3")
def downscale_area(pixels_):
    return pixels.downscale(pixels_, 4)


@_query("pixels")
def pixel_components(pixels_):
    return pixels.component_stats(pixels.components(pixels.ink(pixels_, 60)))


@_query("pixels", sql=f"select poly, trunc(median(r))::int as r, trunc(median(g))::int as g, trunc(median(b))::int as b from (select *, row_number() over (partition by poly order by sat desc, image_id, y, x) as p, count(*) over (partition by poly) as n from (select *, image_id*16+(y//16)*4+(x//16) as poly from {_HSV})) where p<=greatest(1, n//5) group by 1")
def polygon_colour_top20(pixels_):
    poly = F.col("image_id") * 16 + F.floor(F.col("y") / 16) * 4 + F.floor(F.col("x") / 16)
    return pixels.colour_of(pixels_.withColumn("poly", poly), "poly")


@_query("boxes", "pixels", sql="select b.image_id, coalesce(median(w*h/1000000e0) filter (where not pale), median(w*h/1000000e0)) as median_area_frac, count(*) as n from (select b.*, coalesce(p.r+p.g+p.b>600, false) as pale from boxes b left join pixels p on p.image_id=b.image_id and p.x=floor((b.x+b.w/2)/16) and p.y=floor((b.y+b.h/2)/16)) b group by 1")
def median_area_frac(boxes, pixels_):
    b = boxes.withColumns({"py": F.floor((F.col("y") + F.col("h") / 2) / 16).cast("int"), "px": F.floor((F.col("x") + F.col("w") / 2) / 16).cast("int")})
    light = pixels_.select("image_id", F.col("y").alias("py"), F.col("x").alias("px"), (F.col("r") + F.col("g") + F.col("b") > 600).alias("pale"))
    share = F.col("w") * F.col("h") / PAGE
    joined = b.join(pixels.by_merge(light), ["image_id", "py", "px"], "left").withColumn("pale", F.coalesce("pale", F.lit(False)))
    return joined.groupBy("image_id").agg(F.coalesce(F.median(F.when(~F.col("pale"), share)), F.median(share)).alias("median_area_frac"), F.count("*").alias("n"))


# --- trails ----------------------------------------------------------------------------------------------------------

_STEP = "sqrt((x-lag(x) over w)*(x-lag(x) over w)+(y-lag(y) over w)*(y-lag(y) over w))"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@_query("polylines", sql=f"select trail_id, count(*) as n, round(sum(coalesce(d,0)),6) as length from (select trail_id, {_STEP} as d from polylines window w as (partition by trail_id order by ord)) group by 1")
def polyline_length(lines):
    return _rounded(trails.lengths(lines), "length")


def _smoothed(size: int) -> str:
    mean = lambda c: f"round(case when n<={size} or p<={size // 2} or p>n-{size // 2} then {c} else avg({c}) over (partition by trail_id order by ord rows between {size // 2} preceding and {size // 2} following) end,6) as {c}"
    return f"select trail_id, ord, {mean('x')}, {mean('y')} from (select *, row_number() over (partition by trail_id order by ord) as p, count(*) over (partition by trail_id) as n from polylines)"


@_query("polylines", sql=_smoothed(7))
def polyline_smooth(lines):
    return _rounded(trails.smooth(lines), "x", "y")


@_query("polylines", sql=_smoothed(5))
def polyline_smooth_path(lines):
    return _rounded(trails.smooth(lines, 5), "x", "y")


_RUN = f"(select *, sum(coalesce(d,0)) over (partition by trail_id order by ord) as pos, sum(coalesce(d,0)) over (partition by trail_id) as total from (select *, {_STEP} as d from polylines window w as (partition by trail_id order by ord)))"


@_query("polylines", sql=f"""select trail_id, k, round(x0+t*(x1-x0),4) as x, round(y0+t*(y1-y0),4) as y from (
 select s.trail_id, g.k, s.x as x0, s.x1, s.y as y0, s.y1, least(1e0,(g.k*g.share-s.pos)/(s.pos1-s.pos)) as t, row_number() over (partition by s.trail_id, g.k order by s.pos desc) as p
 from (select *, lead(pos) over w as pos1, lead(x) over w as x1, lead(y) over w as y1 from {_RUN} window w as (partition by trail_id order by ord)) s
 join (select trail_id, n, total/(n-1) as share, unnest(range(0, n)) as k from (select trail_id, max(total) as total, case when max(total)<50 then 2 else greatest(2, round_even(max(total)/50,0)::int+1) end as n from {_RUN} group by 1)) g
 on s.trail_id=g.trail_id and s.pos1>s.pos and ((g.k*g.share>=s.pos and g.k*g.share<s.pos1) or (g.k=g.n-1 and s.pos1>=s.total-1e-6))) where p=1""")
def polyline_resample(lines):
    return trails.resample(lines, 50).withColumns({c: F.round(c, 4) for c in "xy"})


@_query("polylines", sql="""select trail_id, ord, part, case when part=0 then x else round(x+(x1-x)*part/parts,3) end as x, case when part=0 then y else round(y+(y1-y)*part/parts,3) end as y
 from (select *, unnest(range(0, parts)) as part from (select *, coalesce(greatest(ceil(sqrt((x1-x)*(x1-x)+(y1-y)*(y1-y))/20),1),1)::bigint as parts from (select *, lead(x) over w as x1, lead(y) over w as y1 from polylines window w as (partition by trail_id order by ord))))""")
def polyline_densify(lines):
    return trails.densify(lines, 20)


_PLACED = "(select *, row_number() over (partition by trail_id order by ord) as p, row_number() over (partition by trail_id order by ord desc) as q, count(*) over (partition by trail_id) as n from polylines)"


def _side(port: int, p: str) -> str:
    return f"select image_id, trail_id, {port} as port, cluster, min_by(x,{p}) as x, min_by(y,{p}) as y, max_by(x,{p}) as xi, max_by(y,{p}) as yi from {_PLACED} where {p}<=least(12,n) group by image_id, trail_id, cluster"


_UNIT = "case when sqrt((x-xi)*(x-xi)+(y-yi)*(y-yi))>0 then ({0}-{0}i)/sqrt((x-xi)*(x-xi)+(y-yi)*(y-yi)) else 0e0 end"
_ENDS = f"(select image_id, trail_id, port, cluster, x, y, {_UNIT.format('x')} as tx, {_UNIT.format('y')} as ty from ({_side(0, 'p')} union all {_side(1, 'q')}))"


@_query("polylines", sql=f"select image_id, trail_id, port, cluster, x, y, round(tx,6) as tx, round(ty,6) as ty from {_ENDS}")
def polyline_tangent(lines):
    return _rounded(trails.endpoints(lines), "tx", "ty")


_GAP = "sqrt((j.x-i.x)*(j.x-i.x)+(j.y-i.y)*(j.y-i.y))"
_COS = f"case when {_GAP}>0 then (i.tx*(j.x-i.x)+i.ty*(j.y-i.y))/{_GAP} else 1e0 end as ci, case when {_GAP}>0 then -(j.tx*(j.x-i.x)+j.ty*(j.y-i.y))/{_GAP} else 1e0 end as cj"


@_query("polylines", sql=f"select i.image_id, i.trail_id as i, i.port as port_i, j.trail_id as j, j.port as port_j, round({_GAP},6) as d from {_ENDS} i join {_ENDS} j on i.image_id=j.image_id and i.trail_id<j.trail_id and {_GAP}<25")
def endpoint_band_join(lines):
    return _rounded(trails.endpoint_pairs(trails.endpoints(lines), 25).drop("ci", "cj"), "d")


@_query("polylines", sql=f"select i, port_i, j, port_j, round(d,6) as d, round(d*(2.2-ci-cj),6) as score from (select i.trail_id as i, i.port as port_i, j.trail_id as j, j.port as port_j, {_GAP} as d, {_COS} from {_ENDS} i join {_ENDS} j on i.trail_id<j.trail_id and i.cluster=j.cluster and {_GAP}<40) where ci>=(case when d<=8 then -0.17364817766693033 when d>20 then 0.9396926207859084 else 0.573576436351046 end) and cj>=(case when d<=8 then -0.17364817766693033 when d>20 then 0.9396926207859084 else 0.573576436351046 end)")
def directional_band_join(lines):
    rows = trails.directional_pairs(trails.endpoints(lines), 20, 8)
    return _rounded(rows.select("i", "port_i", "j", "port_j", "d", "score"), "d", "score")


_NEAREST = f"(select i.image_id, i.trail_id::bigint as i, i.port::bigint as port_i, j.trail_id::bigint as j, j.port::bigint as port_j, round({_GAP},6) as d from {_ENDS} i join {_ENDS} j on i.image_id=j.image_id and i.trail_id<j.trail_id and {_GAP}<25)"
_TOP = "coalesce(list_filter(acc.comp, lambda c: c.v=p.{0})[1].r, p.{0})"
_BRIDGE = f"""case when list_contains(acc.used, p.i*2+p.port_i) or list_contains(acc.used, p.j*2+p.port_j) or {_TOP.format('i')}={_TOP.format('j')} then acc else
 {{'kept': list_append(acc.kept, p), 'used': list_concat(acc.used, [p.i*2+p.port_i, p.j*2+p.port_j]), 'comp': list_concat(list_transform(list_filter(acc.comp, lambda c: c.v<>p.i and c.v<>p.j), lambda c: {{'v': c.v, 'r': case when c.r={_TOP.format('i')} then {_TOP.format('j')} else c.r end}}), [{{'v': p.i, 'r': {_TOP.format('j')}}}, {{'v': p.j, 'r': {_TOP.format('j')}}}])}} end"""


@_query("polylines", sql=f"select image_id, k.i as i, k.port_i as port_i, k.j as j, k.port_j as port_j, k.d as d from (select image_id, unnest(list_reduce(l, lambda acc, p: {_BRIDGE}, {{'kept': list_filter(l, lambda z: false), 'used': []::bigint[], 'comp': []::struct(v bigint, r bigint)[]}}).kept) as k from (select image_id, list({{'i': i, 'port_i': port_i, 'j': j, 'port_j': port_j, 'd': d}} order by d, i, j, port_i, port_j) as l from {_NEAREST} group by 1))")
def greedy_bridges(lines):
    rows = _rounded(trails.endpoint_pairs(trails.endpoints(lines), 25).drop("ci", "cj"), "d")
    return trails.greedy_bridges(rows)


_TO = "(case when size>0 then least(1e0, greatest(0e0, ((px-x)*(x1-x)+(py-y)*(y1-y))/size)) else 0e0 end)"


@_query("polylines", sql=f"""select least(e,s) as i, greatest(e,s) as j, round(min(sqrt((x+t*(x1-x)-px)*(x+t*(x1-x)-px)+(y+t*(y1-y)-py)*(y+t*(y1-y)-py))),6) as d from (
 select *, {_TO} as t from (select e.trail_id as e, s.trail_id as s, e.x as px, e.y as py, s.x, s.y, s.x1, s.y1, (s.x1-s.x)*(s.x1-s.x)+(s.y1-s.y)*(s.y1-s.y) as size
 from {_ENDS} e join (select *, lead(x) over w as x1, lead(y) over w as y1 from polylines window w as (partition by trail_id order by ord)) s on e.cluster=s.cluster and e.trail_id<>s.trail_id and s.x1 is not null))
 where sqrt((x+t*(x1-x)-px)*(x+t*(x1-x)-px)+(y+t*(y1-y)-py)*(y+t*(y1-y)-py))<=3 group by 1,2""")
def touch_groups(lines):
    return _rounded(trails.touching(lines, 3), "d")


@_query("polylines", sql="select a.trail_id as a, b.trail_id as b, round(count(distinct a.ord)::double/any_value(n.n),6) as share from polylines a join polylines b on a.cluster=b.cluster and a.trail_id<>b.trail_id and sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))<=8 join (select trail_id, count(*) as n from polylines group by 1) n on n.trail_id=a.trail_id group by 1,2 having count(distinct a.ord)::double/any_value(n.n)>=0.5")
def polyline_near_share(lines):
    return _rounded(trails.near_share(lines, 8).where("share >= 0.5"), "share")


@_query("polylines", sql="select trail_id, (min(x)+max(x))/2 as cx, (min(y)+max(y))/2 as cy, max(x)-min(x) as w, max(y)-min(y) as h from polylines group by 1")
def polyline_bounds(lines):
    return trails.bounds(lines)


# --- URLs, metadata and the hash registry ----------------------------------------------------------------------------


@_query("urls", sql="select page_id, case when regexp_matches(lower(trim(raw_url)), '^https?://') then trim(raw_url) end as url from urls")
def clean_url(urls):
    return urls.select("page_id", text.clean_url(F.col("raw_url")).alias("url"))


@_query("urls", sql="select page_id, case when p is not null then p when i is not null then i else 'file' end as chosen, case when p is not null then 'pdf_url' when i is not null then 'image_url' else 'file' end as kind from (select page_id, case when regexp_matches(lower(trim(raw_url)), '^https?://.*[.]pdf$') then trim(raw_url) end as p, case when regexp_matches(lower(trim(raw_url)), '^https?://') then trim(raw_url) end as i from urls)")
def source_priority(urls):
    return registry.source_priority(urls, "raw_url")


@_query("urls", sql="""select page_id, case when u like 's3://%' then regexp_extract(u, '^s3://([^/?]+)/', 1) when regexp_matches(u, '^https?://[^./]+\\.s3[^/]*\\.amazonaws\\.com/.') then regexp_extract(u, '^https?://([^./]+)', 1) when regexp_matches(u, '^https?://s3[^/]*\\.amazonaws\\.com/[^/]+/.') then regexp_extract(u, 'amazonaws\\.com/([^/?]+)/', 1) end as bucket,
 case when u like 's3://%' then regexp_extract(u, '^s3://[^/?]+/([^?]+)', 1) when regexp_matches(u, '^https?://[^./]+\\.s3[^/]*\\.amazonaws\\.com/.') then regexp_extract(u, 'amazonaws\\.com/([^?]+)', 1) when regexp_matches(u, '^https?://s3[^/]*\\.amazonaws\\.com/[^/]+/.') then regexp_extract(u, 'amazonaws\\.com/[^/]+/([^?]+)', 1) end as key,
 case when regexp_matches(u, '^https?://([^./]+\\.)?s3[^/]*\\.amazonaws\\.com/.') then nullif(regexp_extract(u, 's3[.-]([a-z0-9-]+)\\.amazonaws', 1),'') end as region from (select page_id, trim(raw_url) as u from urls)""")
def parse_object_url(urls):
    return urls.select("page_id", text.object_url(F.col("raw_url")).alias("o")).select("page_id", "o.bucket", "o.key", "o.region")


@_query("urls", sql="select page_id, coalesce(nullif(regexp_extract(split_part(raw_url,'?',1), '([^/]*)$', 1),''),'input') as name from urls")
def basename_url(urls):
    return urls.select("page_id", text.base_name(F.col("raw_url")).alias("name"))


@_query("urls", sql="select page_id, coalesce(nullif(regexp_replace(raw_url, '[^\\p{L}\\p{N}_.\\-]', '', 'g'),''),'input') as stem from urls")
def safe_stem(urls):
    return urls.select("page_id", text.safe_stem(F.col("raw_url")).alias("stem"))


@_query("urls", sql="select page_id, case page_id % 5 when 0 then 'image/jpeg' when 1 then 'image/png' when 2 then 'image/webp' when 3 then 'image/gif' else 'application/octet-stream' end as type, page_id % 6=5 as pdf from urls")
def content_type_magic(urls):
    heads = F.array(*map(F.lit, ("FFD8FFE000104A4649460001", "89504E470D0A1A0A0000000D", "524946460000000057454250", "474946383961000000000000", "000000000000000000000000")))
    data = F.unhex(F.get(heads, (F.col("page_id") % 5).cast("int")))
    pdf = F.when(F.col("page_id") % 6 == 5, F.unhex(F.lit("255044462D312E37"))).otherwise(data)
    return urls.select("page_id", text.content_type(data).alias("type"), registry.is_pdf(pdf).alias("pdf"))


@_query("metadata", sql="select event_id, json_extract_string(comment,'$.phash') as phash, json_extract_string(comment,'$.date') as date, json_extract_string(comment,'$.date') is not null as complete from metadata")
def json_metadata(metadata):
    return registry.embedded(metadata)


@_query("metadata", sql="select event_id, case when json_extract_string(comment,'$.date') is not null then json_extract_string(comment,'$.phash') else sha1(comment) end as hash from metadata")
def sha1_fallback(metadata):
    return registry.embedded_or_computed(metadata)


@_query("hashes", sql="select doc_id, hash, case when row_number() over (partition by hash order by arrival)>1 then 'present' else 'absent' end as hash_status from hashes")
def hash_registry_status(hashes):
    return registry.status_on_arrival(hashes)


@_query("hashes", sql="select hash, min(arrival) as arrival, count(*) as seen from hashes group by 1")
def dedup_skip(hashes):
    return registry.first_seen(hashes)


@_query("hashes", sql="select doc_id, hash from hashes where arrival>50 and hash not in (select hash from hashes where arrival<=50)")
def registry_new_entries(hashes):
    return registry.unknown(hashes.where("arrival > 50"), hashes.where("arrival <= 50")).select("doc_id", "hash")


@_query("table:events", sql="select event_type, count(*) as n, count_if(json_extract_string(props,'$.k') is not null)::bigint as with_key, sum(cast(json_extract_string(props,'$.k') as bigint))::bigint as total from events group by 1")
def prediction_extract(events):
    return registry.prediction_counts(events)


# --- polygons and kernels --------------------------------------------------------------------------------------------


@_query("boxes", sql=f"select l.image_id, l.rid as a, r.rid as b, round({_iou('l', 'r')},9) as iou, round({_ios('l', 'r')},9) as ios from {_PAIR} where l.rid<r.rid and {_inter('l', 'r')}>0 and {_iou('l', 'r')}>0.2")
def polygon_overlaps(boxes):
    near = regions.pairs(boxes, "iou", 0.2).drop("iou")
    b = boxes.select("image_id", "rid", geometry.open_ring(geometry.ring(F.col("x"), F.col("y"), F.col("w"), F.col("h"))).alias("ring"))
    side = lambda key, name: b.select("image_id", F.col("rid").alias(key), F.col("ring").alias(name))
    rows = near.join(side("a", "p"), ["image_id", "a"]).join(side("b", "q"), ["image_id", "b"])
    return shapes.polygon_overlaps(rows).select("image_id", "a", "b", F.round("iou", 9).alias("iou"), F.round("ios", 9).alias("ios"))


@_query("polylines")
def polyline_simplify(lines):
    return shapes.simplify(lines, 8.0).select("trail_id", "ord", "x", "y")


@_query("polylines")
def loop_excision(lines):
    return shapes.excise_loops(lines, 12.0, 6).select("trail_id", "ord", "x", "y")


_SHARES = "(select a.trail_id as a, b.trail_id as b, count(distinct a.ord)::double/any_value(n.n) as share from polylines a join polylines b on a.cluster=b.cluster and a.trail_id<>b.trail_id and sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))<=8 join (select trail_id, count(*) as n from polylines group by 1) n on n.trail_id=a.trail_id group by 1,2)"


@_query("polylines", sql=f"select unnest(kept) as trail_id from (select list_reduce(l, lambda acc, t: case when len(list_filter(t.near, lambda b: list_contains(acc.kept, b)))>0 then acc else {{'kept': list_append(acc.kept, t.id), 'id': acc.id, 'near': acc.near}} end, {{'kept': []::bigint[], 'id': 0::bigint, 'near': []::bigint[]}}).kept as kept from (select cluster, list({{'kept': []::bigint[], 'id': trail_id, 'near': near}} order by n desc, trail_id) as l from (select p.cluster, p.trail_id, p.n, coalesce(s.near, []::bigint[]) as near from (select cluster, trail_id::bigint as trail_id, count(*) as n from polylines group by 1,2) p left join (select a, list(b::bigint) as near from {_SHARES} where share>=0.7 group by 1) s on s.a=p.trail_id) group by 1))")
def polyline_dedup(lines):
    return shapes.drop_overlapping(lines, trails.near_share(lines, 8))


@_query("pixels")
def perceptual_hash(pixels_):
    return shapes.image_hashes(pixels_)


@_query("profiles", sql="select image_id, case when size<2300 then least(3, 2300/size) when size>3680 then 2300/size else 1e0 end as scale, sqrt(size*size+n_geo*n_geo)*0.004 as tolerance, greatest(10, 15e-2*n_geo) as cross, greatest(12, 17e-2*n_geo) as overlap from (select image_id, n_geo, (500+image_id*41 % 4000)::double as size from profiles)")
def working_scale(profiles):
    size = (500 + F.col("image_id") * 41 % 4000).cast("double")
    rows = profiles.select("image_id", "n_geo", size.alias("size"))
    scale = F.when(F.col("size") < 2300, F.least(F.lit(3.0), 2300 / F.col("size"))).when(F.col("size") > 3680, 2300 / F.col("size")).otherwise(1.0)
    diagonal = F.sqrt(F.col("size") * F.col("size") + F.col("n_geo") * F.col("n_geo"))
    at_least = lambda low, share: F.greatest(F.lit(low), F.col("n_geo") * share)
    return rows.select("image_id", scale.alias("scale"), (diagonal * 0.004).alias("tolerance"), at_least(10.0, 0.15).alias("cross"), at_least(12.0, 0.17).alias("overlap"))


@_query("boxes", sql="select image_id, rid, least(abs(h1-h2), 180-abs(h1-h2)) as hue_distance, case when least(a % 90, 90-a % 90)<=7 then 0 else least(a % 90, 90-a % 90) end as tilt from (select image_id, rid, rid*7 % 180 as h1, rid*11 % 180 as h2, rid*13 % 180 as a from boxes)")
def circular_measures(boxes):
    h1, h2, a = (F.col("rid") * k % 180 for k in (7, 11, 13))
    fold = F.least(F.pmod(a, F.lit(90)), 90 - F.pmod(a, F.lit(90)))
    return boxes.select("image_id", "rid", F.least(F.abs(h1 - h2), 180 - F.abs(h1 - h2)).alias("hue_distance"), F.when(fold <= 7, 0).otherwise(fold).alias("tilt"))


@_query("boxes", sql="select image_id, rid, case when coalesce(area,-1)>=0 then area else w*h end as area, row_number() over (partition by image_id order by score desc, w*h desc, rid) as id from (select *, case when rid % 3=0 then w*h/2 end as area from boxes)")
def sequential_ids(boxes):
    from pyspark.sql import Window

    order = Window.partitionBy("image_id").orderBy(F.desc("score"), F.desc(Box().area), "rid")
    area = F.when(F.col("rid") % 3 == 0, Box().area / 2)
    return boxes.select("image_id", "rid", F.coalesce(area, Box().area).alias("area"), F.row_number().over(order).cast("long").alias("id"))


@_query("boxes", "pixels", sql="select b.image_id, b.rid, avg((not (p.r>200 and p.g>200 and p.b>200))::int) as contrast from (select image_id, rid, floor(x/16) as x, floor(y/16) as y, floor(w/16)+1 as w, floor(h/16)+1 as h from boxes) b join pixels p on p.image_id=b.image_id and p.x between b.x-2 and b.x+b.w+1 and p.y between b.y-2 and b.y+b.h+1 and not (p.x between b.x and b.x+b.w-1 and p.y between b.y and b.y+b.h-1) group by 1,2")
def ring_contrast(boxes, pixels_):
    b = boxes.select("image_id", "rid", *[F.floor(F.col(c) / 16).alias(c) for c in "xy"], *[(F.floor(F.col(c) / 16) + 1).alias(c) for c in "wh"])
    # rows beside the box have two pixels at each side, so a box makes as many rows as its border is long
    x, right, beside = F.col("x"), F.col("x") + F.col("w"), F.col("py").between(F.col("y"), F.col("y") + F.col("h") - 1)
    rows = b.withColumn("py", F.explode(F.sequence(F.col("y") - 2, F.col("y") + F.col("h") + 1)))
    band = rows.select("image_id", "rid", F.explode(F.when(beside, F.array(x - 2, x - 1, right, right + 1)).otherwise(F.sequence(x - 2, right + 1))).alias("px"), "py")
    light = pixels_.select("image_id", F.col("x").cast("long").alias("px"), F.col("y").cast("long").alias("py"), ((F.col("r") > 200) & (F.col("g") > 200) & (F.col("b") > 200)).alias("white"))
    return band.join(pixels.by_merge(light), ["image_id", "px", "py"]).groupBy("image_id", "rid").agg(F.avg((~F.col("white")).cast("int")).alias("contrast"))


# --- graphs and drivers ----------------------------------------------------------------------------------------------

_TREE = "(select image_id, trail_id as id, trail_id as a, trail_id-trail_id % 24+(trail_id % 24+3)//4 as b, (trail_id*7 % 20)::double as length from polylines where trail_id % 24>1 group by image_id, trail_id)"


def _tree(lines):
    t = F.col("trail_id")
    return lines.where("trail_id % 24 > 1").select("image_id", t.alias("id"), t.alias("a"), (t - t % 24 + F.floor((t % 24 + 3) / 4)).alias("b"), (t * 7 % 20).cast("double").alias("length")).distinct()


def _pruned(rounds: int) -> str:
    rows = _TREE
    for _ in range(rounds):
        degree = f"(select v, count(*) as d from (select a as v from {rows} union all select b from {rows}) group by 1)"
        rows = f"(select e.* from {rows} e join {degree} p on p.v=e.a join {degree} q on q.v=e.b where not (least(p.d,q.d)=1 and greatest(p.d,q.d)>1 and length<9))"
    return rows


@_query("polylines", sql=f"select image_id, id, a, b, length from {_pruned(2)}")
def spur_prune(lines):
    return graph.prune_spurs(_tree(lines), 9, 2)


@_query("polylines")
def diameter_chain(lines):
    return graph.diameter_chains(_tree(lines))


@_query("polylines", sql=f"""with recursive e as (select i.trail_id as a, j.trail_id as b from {_ENDS} i join {_ENDS} j on i.trail_id<j.trail_id and i.cluster=j.cluster and {_GAP}<25),
 w as (select a as v, a as r from e union select b, b from e union select s.t, w.r from w join (select a as f, b as t from e union all select b, a from e) s on s.f=w.v) select v, min(r) as root from w group by 1""")
def trail_groups(lines):
    edges = trails.endpoint_pairs(trails.endpoints(lines), 25, True).select("image_id", F.col("i").alias("a"), F.col("j").alias("b"))
    return graph.groups(edges).select("v", "root")


@_query("pixels")
def skeleton(pixels_):
    return graph.skeletons(pixels.ink(pixels_, 100))


@_query("pixels")
def hole_fill(pixels_):
    return graph.filled(pixels.ink(pixels_, 140), 12)


@_query("table:embeddings")
def kmeans_silhouette(vectors):
    share = lambda i: F.abs(F.element_at("embedding", i)).cast("double")
    return ensemble.colour_clusters(vectors.select(F.col("vec_id").alias("id"), share(1).alias("h"), share(2).alias("s"), share(3).alias("v"))).select("id", "cluster")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes of a stream of documents, each once; the stream runs until it has read what is there."""
    import uuid

    from .. import sources, streaming

    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    # as a pattern, since the table may be one file or a folder of them
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/documents.parque[t]").select(F.sha1("text").alias("hash"))
    to = f"{sources.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    new = rows.writeStream.foreachBatch(lambda batch, _: streaming.into_registry(batch, f"{to}/registry"))
    new.option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("hash string").parquet(f"{to}/registry")


QUERIES["stream_dedup"] = stream_dedup
ORACLE_SQL["stream_dedup"] = "select distinct sha1(text) as hash from documents where text is not null"


# --- further scalar work ---------------------------------------------------------------------------------------------


@_query("pixels", sql="select image_id, y, x, printf('#%02x%02x%02x', r, g, b) as colour from pixels")
def hex_colour(pixels_):
    return pixels_.select("image_id", "y", "x", pixels.hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("colour"))


_GAPS = "(select image_id, k as gap, k as x1, (k*4) % 64 as y1, 63-k as x2, (k*13) % 64 as y2 from (select distinct image_id from pixels), (select unnest(range(0, 16))::int as k))"
_SAMPLES = f"(select *, unnest(range(pad, n-pad)) as i from (select *, least(n//4, greatest(1, floor(n*15e-2)))::bigint as pad from (select *, (greatest(abs(x2-x1), abs(y2-y1))+1)::bigint as n from {_GAPS})))"


@_query("pixels", sql=f"select g.image_id, g.gap, coalesce(avg(p.on_::int),0)>=0.4 as occluded from {_GAPS} g left join {_SAMPLES} s using (image_id, gap) left join {_INK} p on p.image_id=g.image_id and p.x=round_even(s.x1+(s.x2-s.x1)*(s.i::double/greatest(s.n-1,1)),0) and p.y=round_even(s.y1+(s.y2-s.y1)*(s.i::double/greatest(s.n-1,1)),0) group by 1,2")
def gap_occlusion(pixels_):
    k = F.col("gap")
    gaps = pixels_.select("image_id").distinct().withColumn("gap", F.explode(F.sequence(F.lit(0), F.lit(15))))
    gaps = gaps.withColumns({"x1": k, "y1": k * 4 % 64, "x2": 63 - k, "y2": k * 13 % 64})
    return pixels.occluded(gaps, pixels.ink(pixels_))


@_query("boxes", sql="select image_id, rid, round(least(a,b,c,d),6) as x0, round(greatest(a,b,c,d),6) as x1, round(least(e,f,g,h),6) as y0, round(greatest(e,f,g,h),6) as y1, round((a+b+c+d)/4,6) as cx, round((e+f+g+h)/4,6) as cy from (select image_id, rid, {0} from boxes)".format(", ".join(f"500+cos(radians(20))*({x}-500)-sin(radians(20))*({y}-500) as {p}, 500+sin(radians(20))*({x}-500)+cos(radians(20))*({y}-500) as {q}" for p, q, x, y in (("a", "e", "x", "y"), ("b", "f", "(x+w)", "y"), ("c", "g", "(x+w)", "(y+h)"), ("d", "h", "x", "(y+h)")))))
def oriented_envelope(boxes):
    return _rounded(regions.turned(boxes, 20, 500, 500), "x0", "y0", "x1", "y1", "cx", "cy")


@_query("halls", sql="select image_id, hall_ord, cx/0.5 as cx, cy/0.5 as cy, w/0.5 as w, h/0.5 as h from halls")
def hall_rescale(halls):
    return halls.select("image_id", "hall_ord", *[(F.col(c) / 0.5).alias(c) for c in ("cx", "cy", "w", "h")])


@_query("urls", sql="select page_id, case when lower(raw_url) like '%.pdf' then case when page_id % 6>=3 then 'pdf_vector' else 'pdf_raster' end else 'image' end as source from urls")
def page_source(urls):
    return urls.select("page_id", decisions.page_source(F.col("raw_url"), F.col("page_id") % 6).alias("source"))


@_query("urls", sql="select page_id, raw_url from urls where contains(lower(raw_url),'.png') or contains(lower(raw_url),'amazonaws')")
def name_filter(urls):
    wanted = F.array(F.lit(".PNG"), F.lit("amazonaws"))
    return urls.where(F.exists(wanted, lambda x: F.contains(F.lower("raw_url"), F.lower(x)))).select("page_id", "raw_url")


@_query("boxes", sql="select source, count(*) as n, min(w*h) as least, max(w*h) as most, median(w*h) as middle, avg(score) as score from boxes group by rollup(source)")
def detector_profile(boxes):
    area = Box().area
    return boxes.rollup("source").agg(F.count("*").alias("n"), F.min(area).alias("least"), F.max(area).alias("most"), F.median(area).alias("middle"), F.avg("score").alias("score"))


from . import drawings, service  # noqa: E402, F401  they register further queries
