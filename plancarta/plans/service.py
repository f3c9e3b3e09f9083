"""Queries of what stands around detection: metadata, modes, model outputs, stamps, and texts of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import ensemble, registry, trails
from .. import sources
from .queries import _TAGGED, _query
from ..operators import labels


@_query("urls", sql="select page_id, case when n in ('none','facility','textless','strict','shape','adaptive') then n else 'auto' end as policy from (select page_id, case cast(page_id % 8 as int) when 0 then 'none' when 1 then 'facility' when 2 then 'textless' when 3 then 'strict' when 4 then 'shape' when 5 then 'adaptive' when 6 then 'string' end as n from urls)")
def policy_names(urls):
    names = F.array(*map(F.lit, ("none", "facility", "textless", "strict", "shape", "adaptive", "string")))
    return urls.select("page_id", text.policy_name(F.get(names, (F.col("page_id") % 8).cast("int"))).alias("policy"))


@_query("hashes", sql="select mode, doc_id, case when k.hash is null then 'absent' else 'present' end as hash_status from (select * from hashes where arrival>50) h left join (select distinct hash from hashes where arrival<=50) k using (hash), (values ('always_run'),('skip_if_present')) m(mode) where mode='always_run' or k.hash is null")
def duplicate_modes(hashes):
    known, new = hashes.where("arrival <= 50"), hashes.where("arrival > 50")
    each = [registry.handled(new, known, m).select(F.lit(m).alias("mode"), "doc_id", "hash_status") for m in registry.MODES[:2]]
    return each[0].unionByName(each[1])


_CDN = '{"d0.cloudfront.net": {"bucket": "b0", "region": "eu-west-1"}, "d1.cloudfront.net": {"bucket": "b1", "key_prefix": "/pre/fix/"}, "d2.cloudfront.net": {"region": "x"}}'


@_query("urls", sql="select page_id, case page_id % 4 when 0 then 'b0' when 1 then 'b1' end as bucket, case page_id % 4 when 0 then concat('a/', page_id, '.png') when 1 then concat('pre/fix/a/', page_id, '.png') end as key, case page_id % 4 when 0 then 'eu-west-1' end as region from urls")
def cdn_lookup(urls):
    url = F.concat(F.lit("https://D"), F.col("page_id") % 4, F.lit(".cloudfront.net/a/"), F.col("page_id"), F.lit(".png?sig=1"))
    found = text.cdn_object(url, text.cdn_map(F.lit(_CDN)))
    return urls.select("page_id", found["bucket"].alias("bucket"), found["key"].alias("key"), found["region"].alias("region"))


@_query("urls", sql="select page_id, page_id % 3=0 as known from urls")
def cdn_map_malformed(urls):
    raw = F.when(F.col("page_id") % 3 == 0, F.lit(_CDN)).when(F.col("page_id") % 3 == 1, F.lit("{"))
    return urls.select("page_id", (F.size(text.cdn_map(raw)) > 0).alias("known"))


@_query("metadata", sql="select event_id, case when event_id % 3<2 then json_extract_string(comment,'$.phash') end as phash, case when event_id % 3<2 then json_extract_string(comment,'$.date') end as date from metadata")
def user_comment(metadata):
    zero = F.unhex(F.lit("0000"))
    body = F.when(F.col("event_id") % 3 < 2, F.encode("comment", "UTF-8")).otherwise(F.encode(F.lit("{"), "UTF-8"))
    raw = F.concat(F.unhex(F.lit("4153434949000000")), body, zero)
    found = registry.user_comment(raw)
    return metadata.select("event_id", found["phash"].alias("phash"), found["date"].alias("date"))


@_query("metadata", sql="""select event_id, kind, kind<>'GIF' and not (event_id % 4<>0 and event_id % 2=1) as changed, case when kind<>'GIF' and not (event_id % 4<>0 and event_id % 2=1) then 'new' else json_extract_string(comment,'$.date') end as date,
 case when kind='GIF' or event_id % 4<>0 and event_id % 2=1 or kind='PNG' then 'k' end as own from (select *, case event_id % 3 when 0 then 'JPEG' when 1 then 'PNG' else 'GIF' end as kind from metadata)""")
def metadata_writes(metadata):
    had = F.from_json("comment", "phash string, date string")
    meta = F.map_filter(F.create_map(F.lit("phash"), had["phash"], F.lit("date"), had["date"], F.lit("own"), F.lit("k")), lambda _, v: v.isNotNull())
    phash = F.when(F.col("event_id") % 2 == 1, had["phash"]).otherwise("other")
    kind = F.when(F.col("event_id") % 3 == 0, "JPEG").when(F.col("event_id") % 3 == 1, "PNG").otherwise("GIF")
    rows = metadata.select("event_id", kind.alias("kind"), meta.alias("meta"), F.lit(None).cast("map<string, string>").alias("extra"), phash.alias("phash"), F.lit("new").alias("date"))
    out = registry.tagged(rows)
    value = lambda k: F.try_element_at("written", F.lit(k)).alias(k)
    return out.select("event_id", "kind", "changed", value("date"), value("own"))


@_query("table:events", sql="select event_id, concat('{\"event_id\":',event_id,',\"event_type\":\"',event_type,'\",\"ts\":\"',strftime(ts,'%Y-%m-%dT%H:%M:%S'),'\"}') as json from events")
def json_dump(events):
    return events.withColumn("ts", F.date_trunc("second", "ts")).select("event_id", registry.as_json("event_id", "event_type", "ts").alias("json"))


@_query("table:events", sql="select event_id, strftime(ts,'%Y-%m-%dT%H:%M:%SZ') as date, strftime(ts,'%Y%m%d_%H%M%S_%f') as run from events")
def run_stamps(events):
    date, run = registry.stamps(F.col("ts"))
    return events.select("event_id", date.alias("date"), run.alias("run"))


_HAS = "page_id % 5>1"


@_query("outputs", sql=f"select page_id, case when {_HAS} then (100+page_id % 50)::int end as js_w, case when {_HAS} then 80 end as js_h, case when {_HAS} then case when page_id % 2=0 then 2 else 1 end else 0 end as n_predictions, case when {_HAS} then 1 else 0 end as n_with_points, case when {_HAS} then 2 else 0 end as first_points, case when {_HAS} then (page_id % 90)::double end as sample_x, case when {_HAS} then 7e0 end as sample_y, case when {_HAS} then 'image,predictions' end as block_keys, case when {_HAS} then 'x,width,points' end as first_keys from outputs")
def debug_projection(outputs):
    rows = registry.debug_projection(outputs, "output").drop("output")
    return rows.withColumns({c: F.array_join(c, ",") for c in ("block_keys", "first_keys")})


@_query("outputs", sql=f"select count(*) as outputs, sum(case when {_HAS} then case when page_id % 2=0 then 2 else 1 end else 0 end)::bigint as predictions, count_if({_HAS})::bigint as with_points from outputs")
def prediction_log(outputs):
    found = registry.first_predictions(registry.model_output(F.col("output")))
    own = F.size(F.filter(found, lambda p: F.coalesce(F.size(p.points), F.lit(0)) > 0))
    return outputs.agg(F.count("*").alias("outputs"), F.sum(F.size(found)).alias("predictions"), F.sum(own).alias("with_points"))


@_query("outputs", sql=f"select page_id, (page_id % 30)+0.5e0 as x from outputs where {_HAS} union all select page_id, 1e0 from outputs where {_HAS} and page_id % 2=0")
def first_block_predictions(outputs):
    found = registry.first_predictions(registry.model_output(F.col("output")))
    return outputs.select("page_id", F.explode(found).alias("p")).select("page_id", "p.x")


@_query("outputs", sql=f"select page_id, case when {_HAS} and page_id % 3<>0 then (100+page_id % 50)::int when {_HAS} then ceil(greatest(page_id % 90, 3)*1.05e0)::int else 2100 end as width, case when {_HAS} and page_id % 3<>0 then 80 when {_HAS} then 8 else 1275 end as height from outputs")
def js_dimensions(outputs):
    block = F.try_element_at(registry.model_output(F.col("output")), F.lit(1))
    image = F.when(F.col("page_id") % 3 != 0, block["image"])
    rows = outputs.select(F.col("page_id").alias("file"), image.alias("image"), F.explode_outer(registry.first_predictions(registry.model_output(F.col("output")))).alias("p")).select("file", "image", "p.points")
    return sources.js_size(rows).withColumnRenamed("file", "page_id")


@_query("outputs", sql="select page_id, trunc((page_id % 30+0.5e0)*1.7e0)::bigint as x, trunc((page_id % 90)*0.6e0)::bigint as y from outputs")
def js_to_pixel(outputs):
    x, y = trails.to_pixels(F.col("page_id") % 30 + 0.5, (F.col("page_id") % 90).cast("double"), 1.7, 0.6)
    return outputs.select("page_id", x.alias("x"), y.alias("y"))


@_query("boxes", "texts", sql=f"select image_id, rid, label from {_TAGGED} where trim(label)<>''")
def ocr_gate(boxes, texts):
    return labels.with_text(labels.labelled(texts, boxes)).select("image_id", "rid", "label")


@_query("texts", sql="select image_id, tid, (x0-3)*2e0 as x0, (900-y1)*2e0 as y0, (x1-3)*2e0 as x1, (900-y0)*2e0 as y1 from texts where tid % 7<>0")
def pdf_text_items(texts):
    rects = texts.select("image_id", "tid", F.when(F.col("tid") % 7 == 0, " ").otherwise(F.col("text")).alias("text"), F.col("x0").alias("l"), F.col("y0").alias("b"), F.col("x1").alias("r"), F.col("y1").alias("t"), F.lit(3.0).alias("crop_l"), F.lit(900.0).alias("crop_t"), F.lit(2.0).alias("scale"))
    return sources.text_items(rects).drop("text")


@_query("texts", sql="select image_id, tid, least(x0,x1-2)/0.5e0 as x0, least(y0,y1+1)/0.5e0 as y0, greatest(x0,x1)/0.5e0 as x1, greatest(y0,y1+1)/0.5e0 as y1 from texts")
def read_text_items(texts):
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    quad = F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1 + 1), corner(x1 - 2, y1))
    return sources.read_items(texts.select("image_id", "tid", "text", quad.alias("quad"), F.lit(0.5).alias("shrink"))).drop("text")


@_query("boxes", sql="select image_id, rid, case source when 'opencv_strict' then 0 when 'color' then 1 else 2 end as pass from boxes where source<>'bigregion'")
def pass_union(boxes):
    parts = [boxes.where(F.col("source") == s).drop("score") if k else boxes.where(F.col("source") == s) for k, s in enumerate(("opencv_strict", "color", "bordered"))]
    return ensemble.pooled(parts).select("image_id", "rid", "pass")


@_query("polylines", sql="select trail_id from (select trail_id, count(*) as n, sum(coalesce(sqrt((x-px)*(x-px)+(y-py)*(y-py)),0)) as d from (select *, lag(x) over w as px, lag(y) over w as py from polylines window w as (partition by trail_id order by ord)) group by 1) where n>=60 and d>=2000")
def long_trails(lines):
    return trails.long_enough(lines, 60, 2000.0)
