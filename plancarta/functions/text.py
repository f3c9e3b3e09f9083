"""Label, URL and name functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a label as a stand, a service area or a zone.
AREA = r"(?i)\d{1,4}\s*(?:sq\.?\s*m(?:tr)?|sqm|m2|m²)(?:$|[^\p{L}\p{N}_])"
CODE = r"\b(?:[A-Z]{1,3}[-\s]?\d{2,4}|\d{1,2}[A-Z]{1,2}[-\s]?\d{1,4})[A-Z]?\b"
COMPANY = r"(?i)\b(?:PVT|LTD|LLP|INC|LLC|EXPORTS?|IMPEX|INDUSTR|ENTERPRIS|INTERNATIONAL|TRADERS?|OVERSEAS|LIFECARE|TECHNOLOG)\b"
FACILITY = r"(?i)\b(?:TOILET|LIFT|DRINKING|WATER|CARGO|SERVICE|FHC|RWP|JC|HUB|LV|STAIR|ENTRY|EXIT|GATE|RAMP|PANTRY|FIRE|ELECTRIC|DG|AHU|DUCT|SHAFT)\b"
ZONES = "food court registration register entry exit entrance wc toilet washroom restroom pavilion lounge cafe cafeteria stage office store storage stair stairs steps lift elevator escalator reception help info information parking prayer medical aid atm meeting conference seminar organiser organizer lobby passage walkway aisle hall gate".split()
MOST_TOKENS = 8


def _unicode(pattern: str) -> str:
    return "(?U)" + pattern


def boothlike(text: Column) -> Column:
    """An area or a company at any length, or a stand code in a short label."""
    tokens = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""))
    return text.rlike(_unicode(AREA)) | text.rlike(_unicode(COMPANY)) | (text.rlike(_unicode(CODE)) & (tokens <= MOST_TOKENS))


def status(label: Column) -> Column:
    """empty, boothlike, facility or text."""
    return F.when(F.coalesce(label, F.lit("")) == "", "empty").when(boothlike(label), "boothlike").when(label.rlike(_unicode(FACILITY)), "facility").otherwise("text")


def collapse(text: Column) -> Column:
    """Each stretch of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def is_zone(label: Column) -> Column:
    """Whether a token of the label names a zone."""
    tokens = F.split(F.lower(F.replace(F.coalesce(label, F.lit("")), F.lit("/"), F.lit(" "))), r"\s+")
    return F.arrays_overlap(tokens, F.array(*map(F.lit, ZONES)))


def ocr_name(text: Column) -> Column:
    """A read label without odd characters; null at one character or none."""
    out = collapse(F.regexp_replace(text, r"[^A-Za-z0-9 .&\-/]", ""))
    return F.when(F.length(out) > 1, out)


def clean_url(url: Column) -> Column:
    """The trimmed URL if it is http or https, else null."""
    out = F.trim(url)
    return F.when(F.lower(out).rlike("^https?://"), out)


def object_url(url: Column) -> Column:
    """Bucket, key and region of an object-store URL: s3://b/k, b.s3.region..., or s3-region.../b/k; else null."""
    url = F.trim(url)
    part = lambda pattern, i: F.nullif(F.regexp_extract(url, pattern, i), F.lit(""))
    s3, hosted, path = r"^s3://([^/?]+)/([^?]+)", r"^(?i:https?)://([^./]+)\.s3(?:[.-]([a-z0-9-]+))?\.amazonaws\.com/([^?]+)", r"^(?i:https?)://s3(?:[.-]([a-z0-9-]+))?\.amazonaws\.com/([^/?]+)/([^?]+)"
    found = lambda b, k, r: F.struct(b.alias("bucket"), k.alias("key"), r.alias("region"))
    none = F.lit(None).cast("string")
    return F.when(url.rlike(s3), found(part(s3, 1), part(s3, 2), none)).when(url.rlike(hosted), found(part(hosted, 1), part(hosted, 3), part(hosted, 2))).when(url.rlike(path), found(part(path, 2), part(path, 3), part(path, 1)))


#: Rows of a map from a CDN's hosts to buckets.
CDN = "map<string, struct<bucket: string, region: string, key_prefix: string>>"


def cdn_map(text: Column) -> Column:
    """A JSON map from hosts to bucket, region and key prefix; missing or malformed JSON gives an empty one."""
    return F.coalesce(F.from_json(text, CDN), F.create_map().cast(CDN))


def cdn_object(url: Column, hosts: Column) -> Column:
    """Bucket, key and region of a URL whose host a CDN map has with a bucket; else null. The prefix goes before the key."""
    url = F.trim(url)
    host = F.lower(F.regexp_extract(url, r"^(?i:https?)://([^/?#]+)", 1))
    path = F.nullif(F.ltrim(F.regexp_extract(url, r"^(?i:https?)://[^/?#]+([^?#]*)", 1), F.lit("/")), F.lit(""))
    to = F.try_element_at(hosts, host)
    prefix = F.trim(F.coalesce(to["key_prefix"], F.lit("")), F.lit("/"))
    key = F.when(prefix == "", path).otherwise(F.concat(prefix, F.lit("/"), path))
    found = F.struct(to["bucket"].alias("bucket"), key.alias("key"), to["region"].alias("region"))
    return F.when(host.endswith(".cloudfront.net") & (F.coalesce(to["bucket"], F.lit("")) != "") & path.isNotNull(), found)


#: Names of keep policies; any other means auto.
POLICY_NAMES = ("none", "facility", "textless", "strict", "shape", "adaptive")


def policy_name(name: Column) -> Column:
    """A keep policy's name; auto for unknown, empty or missing ones."""
    return F.when(name.isin(*POLICY_NAMES), name).otherwise("auto")


def base_name(url: Column, default: str = "input") -> Column:
    """The last part of a URL's path, without its query."""
    name = F.regexp_extract(F.element_at(F.split(url, r"\?"), 1), "([^/]*)$", 1)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))


def safe_stem(name: Column) -> Column:
    """A name of letters, digits and -_. only; `input` if nothing is left."""
    out = F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}_.\-]", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("input"))


def content_type(data: Column) -> Column:
    """By the first bytes."""
    head = F.hex(F.substring(data, 1, 12))
    return F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").when(head.startswith("47494638"), "image/gif").otherwise("application/octet-stream")


def shortened(label: Column, most: int = 22) -> Column:
    return F.when(F.length(label) > most, F.concat(F.left(label, F.lit(most - 1)), F.lit("…"))).otherwise(label)
