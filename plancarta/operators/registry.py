"""Inputs and the hash registry: which input counts, what its bytes and metadata say, and whether it was seen before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_url


def is_pdf(data: Column) -> Column:
    return F.hex(F.substring(data, 1, 4)) == "25504446"


def source_priority(urls: DataFrame, column: str) -> DataFrame:
    """page_id, chosen, kind: a PDF URL before an image URL before an uploaded file."""
    url = clean_url(F.col(column))
    pdf = F.when(F.lower(url).rlike("[.]pdf$"), url)
    return urls.select("page_id", F.coalesce(pdf, url, F.lit("file")).alias("chosen"), F.when(pdf.isNotNull(), "pdf_url").when(url.isNotNull(), "image_url").otherwise("file").alias("kind"))


def embedded(metadata: DataFrame) -> DataFrame:
    """event_id, phash, date, complete from a JSON comment; malformed comments give nulls."""
    m = F.from_json("comment", "phash string, date string")
    return metadata.select("event_id", m["phash"].alias("phash"), m["date"].alias("date"), (m["phash"].isNotNull() & m["date"].isNotNull()).alias("complete"))


def embedded_or_computed(metadata: DataFrame) -> DataFrame:
    """event_id, hash: the embedded hash where hash and date are there, else that of the content."""
    m = F.from_json("comment", "phash string, date string")
    return metadata.select("event_id", F.when(m["phash"].isNotNull() & m["date"].isNotNull(), m["phash"]).otherwise(F.sha1(F.col("comment").cast("binary"))).alias("hash"))


def status_on_arrival(hashes: DataFrame) -> DataFrame:
    """doc_id, hash, hash_status: present if the hash arrived before."""
    first = Window.partitionBy("hash").orderBy("arrival")
    return hashes.select("doc_id", "hash", F.when(F.row_number().over(first) > 1, "present").otherwise("absent").alias("hash_status"))


def first_seen(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("hash").agg(F.min("arrival").alias("arrival"), F.count("*").alias("seen"))


def unknown(inputs: DataFrame, known: DataFrame) -> DataFrame:
    """Inputs whose hash is not in the registry."""
    return inputs.join(known.select("hash"), "hash", "left_anti")


MODES = ("always_run", "skip_if_present", "reject_if_present")


def handled(inputs: DataFrame, known: DataFrame, mode: str) -> DataFrame:
    """inputs with hash_status, as a mode treats those whose hash is known: run all, leave them out, or fail on the first."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    there = known.select("hash").distinct().withColumn("there", F.lit(True))
    rows = inputs.join(there, "hash", "left").withColumn("hash_status", F.when(F.col("there"), "present").otherwise("absent")).drop("there")
    if mode == "skip_if_present":
        return rows.where("hash_status = 'absent'")
    if mode == "reject_if_present":
        refused = F.raise_error(F.concat(F.lit("hash is present: "), F.col("hash"))).cast("string")
        return rows.withColumn("hash_status", F.when(F.col("hash_status") == "present", refused).otherwise("absent"))
    return rows


COMMENT = "phash string, date string"


def user_comment(raw: Column, schema: str = COMMENT) -> Column:
    """The JSON of an image's comment bytes: behind an 8-byte prefix where there are more, without NULs and spaces around
    it; null if empty or malformed."""
    body = F.when(F.octet_length(raw) > 8, F.substring(raw, 9, 1 << 30)).otherwise(raw)
    text = F.regexp_replace(body.cast("string"), r"^[\x00\s]+|[\x00\s]+$", "")
    return F.when(text != "", F.from_json(text, schema))


def as_json(*columns: str) -> Column:
    """Columns as one JSON object: times as ISO text, binary as base64, nulls left out."""
    return F.to_json(F.struct(*columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"})


def stamps(time: Column) -> tuple[Column, Column]:
    """A time as an ISO date in UTC, and as a name for a run with microseconds."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(time, "yyyyMMdd_HHmmss_SSSSSS")


def tagged(images: DataFrame) -> DataFrame:
    """images (kind, meta, extra: maps; phash, date) with changed and the map to write. JPEG and PNG change unless they have
    this phash, any date and all extras; a PNG keeps its other keys, a JPEG's are replaced; other kinds stay."""
    meta, extra = (F.coalesce(c, F.create_map().cast("map<string, string>")) for c in ("meta", "extra"))
    current = (F.try_element_at(meta, F.lit("phash")) == F.col("phash")) & (F.coalesce(F.try_element_at(meta, F.lit("date")), F.lit("")) != "")
    same = F.forall(F.map_entries(extra), lambda e: F.coalesce(F.try_element_at(meta, e.key) == e.value, F.lit(False)))
    writes = F.col("kind").isin("JPEG", "PNG") & ~(F.coalesce(current, F.lit(False)) & same)
    new = F.map_from_entries(F.array_union(F.array(F.struct(F.lit("phash").alias("key"), F.col("phash").alias("value")), F.struct(F.lit("date").alias("key"), F.col("date").alias("value"))), F.filter(F.map_entries(extra), lambda e: ~e.key.isin("phash", "date"))))
    kept = F.map_filter(meta, lambda k, _: (F.col("kind") == "PNG") & ~F.array_contains(F.map_keys(new), k))
    return images.withColumns({"changed": writes, "written": F.when(writes, F.map_concat(new, kept)).otherwise(meta)})


PREDICTIONS = "array<struct<x: double, y: double, width: double, height: double, confidence: double, points: array<struct<x: double, y: double>>>>"
BLOCKS = f"array<struct<image: struct<width: int, height: int>, predictions: {PREDICTIONS}>>"


def model_output(text: Column) -> Column:
    """A model's JSON as an array of blocks: a list as it is, one object as a list of it, anything else as an empty list."""
    text = F.trim(F.coalesce(text, F.lit("")))
    listed = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    return F.coalesce(F.from_json(listed, BLOCKS), F.array().cast(BLOCKS))


def first_predictions(blocks: Column) -> Column:
    """The predictions of the first block; none where there is no block."""
    return F.coalesce(F.try_element_at(blocks, F.lit(1))["predictions"], F.array().cast(PREDICTIONS))


def debug_projection(outputs: DataFrame, text: str) -> DataFrame:
    """outputs with what their first block holds: its keys, the image's size, predictions, those with points, and of the
    first one its keys, number of points and first point."""
    first = F.get_json_object(F.when(F.ltrim(F.col(text)).startswith("["), F.col(text)).otherwise(F.concat(F.lit("["), F.col(text), F.lit("]"))), "$[0]")
    block = F.try_element_at(model_output(F.col(text)), F.lit(1))
    found = first_predictions(model_output(F.col(text)))
    points = F.try_element_at(found, F.lit(1))["points"]
    return outputs.withColumns({
        "block_keys": F.json_object_keys(first), "js_w": block["image"]["width"], "js_h": block["image"]["height"], "n_predictions": F.size(found),
        "n_with_points": F.size(F.filter(found, lambda p: F.coalesce(F.size(p.points), F.lit(0)) > 0)), "first_keys": F.json_object_keys(F.get_json_object(first, "$.predictions[0]")),
        "first_points": F.coalesce(F.when(F.size(points) > 0, F.size(points)), F.lit(0)), "sample_x": F.try_element_at(points, F.lit(1))["x"], "sample_y": F.try_element_at(points, F.lit(1))["y"],
    })


def prediction_counts(events: DataFrame) -> DataFrame:
    """event_type, n, with_key, total of JSON rows, malformed ones counted without a key."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_key"), F.sum(k).alias("total"))
