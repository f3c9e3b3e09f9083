"""Inputs as tables: folders of plans, rasters, prediction files and hash registries; and where results go."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, content_type
from ..operators.registry import is_pdf

SUFFIXES = ("pdf", "png", "jpg", "jpeg")
POINT = "struct<x: double, y: double>"
PREDICTIONS = f"image struct<width: int, height: int>, predictions array<struct<x: double, y: double, width: double, height: double, confidence: double, class: string, points: array<{POINT}>>>"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset (local runs) a new one."""
    to = spark.conf.get("spark.checkpoint.dir", None)
    if not to:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        to = getattr(spark.sparkContext, "_plancarta_folder", None)
        if not to:
            made = tempfile.mkdtemp(prefix="plancarta")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            to = spark.sparkContext._plancarta_folder = f"file://{made}"
    return to.rstrip("/")


def described(files: DataFrame) -> DataFrame:
    """file, content, type, is_pdf of files (path, content)."""
    content = F.col("content")
    return files.select(base_name(F.col("path")).alias("file"), "content", content_type(content).alias("type"), is_pdf(content).alias("is_pdf"))


def folder(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """file, content, type, is_pdf of the plans in a folder; only: those whose name holds one of these. Sort what is made of
    them by file, not these rows, which carry whole files."""
    files = described(spark.read.format("binaryFile").load(path))
    name = F.lower("file")
    rows = files.where(name.rlike(rf"\.({'|'.join(SUFFIXES)})$"))
    if only:
        rows = rows.where(F.exists(F.array(*[F.lit(x.lower()) for x in only]), lambda x: F.contains(name, x)))
    return rows


def fetched(urls: DataFrame, column: str = "url", seconds: float = 60.0) -> DataFrame:
    """urls with content, status and error of each URL: 200, or 400 where the server refuses, or 500 where it can't be asked
    at all; null URLs are not asked. Each row is one request, so partitions set how many run at once."""
    from pyspark.sql import types as T

    def run(batches):
        import urllib.error
        import urllib.request

        import pyarrow as pa

        for b in batches:
            found: list[tuple] = []
            for url in b.column(column).to_pylist():
                if url is None:
                    found.append((None, None, None))
                    continue
                try:
                    with urllib.request.urlopen(url, timeout=seconds) as r:
                        parts = iter(lambda r=r: r.read(1 << 16), b"")
                        found.append((b"".join(parts), 200, None) if r.status == 200 else (None, 400, f"status {r.status}"))
                except urllib.error.HTTPError as e:
                    found.append((None, 400, f"status {e.code}"))
                except Exception as e:
                    found.append((None, 500, f"{type(e).__name__}: {e}"))
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.binary(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, "content", "status", "error"])

    return urls.mapInArrow(run, T.StructType([*urls.schema, T.StructField("content", T.BinaryType()), T.StructField("status", T.IntegerType()), T.StructField("error", T.StringType())]))


def rasters(spark: SparkSession, path: str) -> DataFrame:
    """origin, height, width, nChannels, data of the images in a folder; unreadable ones are left out."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """file and the predictions of its first block, of files of JSON blocks one a line; malformed ones give none."""
    blocks = spark.read.text(path, wholetext=True).select(base_name(F.input_file_name()).alias("file"), F.from_json("value", f"array<struct<{PREDICTIONS.replace(' struct<width', ': struct<width', 1).replace('predictions array', 'predictions: array')}>>").alias("blocks"))
    first = F.try_element_at("blocks", F.lit(1))
    return blocks.select("file", first["image"].alias("image"), F.explode_outer(first["predictions"]).alias("p")).select("file", "image", "p.*")


def js_size(rows: DataFrame) -> DataFrame:
    """file, width, height: of the image block, else a margin over the largest point, else 2100 by 1275."""
    point = lambda c: F.max(F.array_max(F.transform("points", lambda p: p[c])))
    by = rows.groupBy("file").agg(F.first("image", True).alias("image"), point("x").alias("x"), point("y").alias("y"))
    known = (F.col("x") > 0) & (F.col("y") > 0)
    size = lambda own, c, usual: F.coalesce(F.col(f"image.{own}"), F.when(known, F.ceil(F.col(c) * 1.05).cast("int")), F.lit(usual)).alias(own)
    return by.select("file", size("width", "x", 2100), size("height", "y", 1275))


def text_items(rects: DataFrame, scale: str = "scale") -> DataFrame:
    """Text items in pixels of a PDF's text rectangles (text, l, b, r, t; crop box crop_l, crop_t; scale) with text in them:
    shifted by the crop box and flipped about its top."""
    s = F.col(scale)
    across, down = (lambda c: (F.col(c) - F.col("crop_l")) * s), (lambda c: (F.col("crop_t") - F.col(c)) * s)
    return rects.where(F.trim("text") != "").withColumns({"x0": across("l"), "y0": down("t"), "x1": across("r"), "y1": down("b")}).drop("l", "b", "r", "t", "crop_l", "crop_t", scale)


def read_items(quads: DataFrame) -> DataFrame:
    """Text items of read quads (text, quad: points, shrink) with text in them: the box around each, at the page's own size."""
    of = lambda c: F.transform("quad", lambda p: p[c])
    side = lambda f, c: f(of(c)) / F.col("shrink")
    return quads.where(F.trim("text") != "").withColumns({"x0": side(F.array_min, "x"), "y0": side(F.array_min, "y"), "x1": side(F.array_max, "x"), "y1": side(F.array_max, "y")}).drop("quad", "shrink")


def hash_registry(spark: SparkSession, path: str) -> DataFrame:
    """hash: the registry's distinct entries, of JSON lists of strings; missing, empty or corrupt files hold none."""
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "hash string")
    return text.select(F.explode(F.from_json("value", "array<string>")).alias("hash")).where("hash is not null").distinct()


def write_run(result: DataFrame, path: str, endpoint: str) -> None:
    """Append a run's rows as JSON, by endpoint and day."""
    rows = result.withColumns({"endpoint": F.lit(endpoint), "day": F.current_date()})
    rows.write.mode("append").partitionBy("endpoint", "day").json(path)


def write_payload(result: DataFrame, pictures: DataFrame, path: str) -> None:
    """A run's rows as JSON, by page, and its pictures (image_id, kind, png) as a table, under path/result and path/pictures."""
    result.write.mode("append").partitionBy("image_id").json(f"{path}/result")
    pictures.write.mode("append").partitionBy("kind").parquet(f"{path}/pictures")


def write_registry(hashes: DataFrame, path: str) -> None:
    """Replace the registry: the new one is written beside the old, as path/<number>, and counts once its _SUCCESS file is
    there, so readers of read_registry see the old or the new one and a crash leaves the old. Hashes may come from the old."""
    to = _generations(hashes.sparkSession, path)
    hashes.select("hash").distinct().write.parquet(f"{path}/{max(to, default=-1) + 1:09d}")
    for old in sorted(to)[:-1]:  # the last one may still have readers
        _files(hashes.sparkSession, path)[0].delete(_path(hashes.sparkSession, f"{path}/{old:09d}"), True)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """hash: what write_registry wrote last; nothing where there is none."""
    whole = [k for k in _generations(spark, path) if _files(spark, path)[0].exists(_path(spark, f"{path}/{k:09d}/_SUCCESS"))]
    return spark.read.schema("hash string").parquet(f"{path}/{max(whole):09d}") if whole else spark.createDataFrame([], "hash string")


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the names in it."""
    at = _path(spark, path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def _generations(spark: SparkSession, path: str) -> list[int]:
    return [int(n) for n in _files(spark, path)[1] if n.isdigit()]
