"""Inputs for the queries: plan-map tables derived from the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Rows numbered within their image, so that no task sorts the whole table.
_NUMBERED = "select *, cast(row_number() over (partition by l_suppkey order by l_orderkey,l_linenumber,l_partkey,l_extendedprice,l_quantity,l_tax,l_discount) as bigint) as rid from lineitem"
#: Sides of a page image in pixels, trails on a page, and halls of a page.
SIDE, TRAILS, HALLS = 64, 24, 5

#: Derived tables by name, over the driver's tables: every line item is a box or a text, every supplier a page. Geometry is integral, so both engines agree to the last digit.
FIXTURES: dict[str, str] = {
    "boxes": f"""select l_suppkey as image_id, rid, cast(l_partkey*37 % 1000 as double) as x, cast(l_orderkey*53 % 1000 as double) as y,
 cast(20+l_orderkey*7 % 60 as double) as w, cast(20+l_partkey*11 % 60 as double) as h,
 case when rid % 10=9 then 'bigregion' when rid % 3=0 then 'opencv_strict' when rid % 3=1 then 'color' else 'bordered' end as source,
 case when rid % 10=9 then 7e-1 when rid % 3=0 then 1e0 when rid % 3=1 then 5e-1+cast(rid % 50 as double)/100 else 45e-2 end as score
 from ({_NUMBERED}) t where l_linenumber % 3<>0""",
    "texts": f"""select l_suppkey as image_id, rid as tid,
 case cast(rid % 8 as int) when 0 then concat('A',cast(10+rid % 90 as varchar(10))) when 1 then concat(cast(1+rid % 99 as varchar(10)),' sqm') when 2 then 'ACME TRADERS LTD' when 3 then 'TOILET'
 when 4 then 'hello  stand' when 5 then 'one two three four five six seven eight B12' when 6 then 'FOOD COURT' else concat('hall ',cast(rid % 5 as varchar(10))) end as text,
 cast(l_orderkey*29 % 1000 as double) as x0, cast(l_partkey*31 % 1000 as double) as y0,
 cast(l_orderkey*29 % 1000+8+rid % 30 as double) as x1, cast(l_partkey*31 % 1000+6 as double) as y1
 from ({_NUMBERED}) t where l_linenumber % 3=0""",
    "halls": f"""select image_id, hall_ord, cast(150+hall_ord*200 as double) as cx, cast(200+(image_id*7+hall_ord*130) % 600 as double) as cy,
 cast(case when hall_ord=4 then 0 else 260 end as double) as w, cast(400 as double) as h from (select s_suppkey as image_id, each({HALLS}) as hall_ord from supplier) t""",
    "pixels": f"""select image_id, y, x, cast((y*5+x*3+image_id*11) % 256 as int) as r, cast((y*x+image_id) % 256 as int) as g, cast((y*7+x*x) % 256 as int) as b
 from (select image_id, y, each({SIDE}) as x from (select s_suppkey as image_id, each({SIDE}) as y from supplier) s) t""",
    # a page of 4 by 4 cells of 24 pixels: most have a square of one of two colours
    "drawn": """select image_id, y, x, case when own and odd=0 then 200 when own then 60 else 255 end as r, case when own then 60 else 255 end as g, case when own and odd=1 then 200 when own then 60 else 255 end as b
 from (select image_id, 24*i+v as y, 24*j+u as x, cast((i+j+image_id) % 2 as int) as odd, v between 5 and 18 and u between 5 and 18 and (i*3+j+image_id) % 5<>0 as own
 from (select image_id, i, j, v, each(24) as u from (select image_id, i, j, each(24) as v from (select image_id, i, each(4) as j from (select s_suppkey as image_id, each(4) as i from supplier) a) b) c) d) t""",
    "outputs": """select page_id, case cast(page_id % 5 as int) when 0 then '' when 1 then '{' else concat(case when page_id % 5=2 then '' else '[' end,
 '{"image":{"width":',cast(100+page_id % 50 as varchar(10)),',"height":80},"predictions":[{"x":',cast(page_id % 30 as varchar(10)),'.5,"width":4.0,"points":[{"x":',cast(page_id % 90 as varchar(10)),'.0,"y":7.0},{"x":3.0,"y":4.0}]}',
 case when page_id % 2=0 then ',{"x":1.0,"points":[]}' else '' end,']}',case when page_id % 5=2 then '' else ',{"predictions":[{"x":9.0}]}]' end) end as output from pages""",
    "profiles": """select s_suppkey as image_id, case s_suppkey % 3 when 0 then 'pdf_vector' when 1 then 'pdf_raster' else 'image' end as source,
 cast(s_suppkey*37 % 100 as double)/1000 as colored_frac, cast(s_suppkey*53 % 100 as double)/1000 as grey_frac, cast(s_suppkey*13 % 90 as int) as n_geo, cast(s_suppkey*71 % 97 as double)/10000 as median_area_frac from supplier""",
    "polylines": f"""select user_id as trail_id, cast((user_id-user_id % {TRAILS})/{TRAILS} as bigint) as image_id, ord, cast(ord*3+event_id % 7 as double) as x, cast(event_id*13 % 97 as double) as y, cast((user_id-user_id % {TRAILS})/8+user_id % 3 as bigint) as cluster
 from (select *, cast(row_number() over (partition by user_id order by event_id) as bigint) as ord from events) t""",
    "urls": """select page_id, url, case cast(page_id % 7 as int) when 0 then url when 1 then concat('  ',upper(substr(url,1,4)),substr(url,5)) when 2 then 'string' when 3 then ''
 when 4 then concat('s3://bkt-',cast(page_id as varchar(10)),'/dir/f.png') when 5 then concat('https://bkt',cast(page_id as varchar(10)),'.s3.eu-west-1.amazonaws.com/a/b.jpg?sig=1') else concat('https://s3-us-west-2.amazonaws.com/bk/k',cast(page_id as varchar(10)),'.pdf') end as raw_url from pages""",
    "metadata": """select event_id, concat('{"phash":"',substr(md5(cast(value as varchar(30))),1,16),'"',case when event_id % 4=0 then '' else ',"date":"2024-01-01T00:00:00Z"' end,'}') as comment from events""",
    "hashes": """select doc_id, sha1(text) as hash, cast(doc_id+1 as bigint) as arrival from documents""",
}
BASE = ("lineitem", "supplier", "region", "part", "events", "pages", "documents")


def _each(sql: str, form: str) -> str:
    """each(n), a row for each number below n, in an engine's own words."""
    return re.sub(r"each\((\d+)\)", lambda m: form.format(m[1]), sql)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _each(FIXTURES[name].replace("{", "{{").replace("}", "}}"), "explode(transform(sequence(0, {0}-1), i -> cast(i as int)))")
    used = [t for t in BASE if f" {t}" in sql]
    for t in used:
        sql = sql.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    if "each(" in FIXTURES[name]:  # a small file is one task, and so would be the pages of pixels made from it
        tables["supplier"] = tables["supplier"].repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.sql(sql, **tables)


def oracle(sql: str, *names: str, **views: str) -> str:
    """A query over named fixtures and further views, in order, as one statement."""
    parts = [f"{n} as ({_each(FIXTURES[n], 'unnest(range(0, {0}))::int')})" for n in names] + [f"{n} as ({v})" for n, v in views.items()]
    if sql.startswith("with recursive "):
        return f"with recursive {', '.join(parts)}, {sql[15:]}"
    return f"with {', '.join(parts)} {sql}" if parts else sql
