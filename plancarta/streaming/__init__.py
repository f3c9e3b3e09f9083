"""Structured Streaming forms of the hash registry and the batch summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_arrivals(inputs: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """Stream rows (hash, and a time column) whose hash wasn't seen within the time that late rows are waited for.

    State is bounded, so a hash is forgotten after that time; into_registry never forgets. Rows at or before the first
    watermark, 1970-01-01, count as late and are dropped.
    """
    return inputs.withWatermark(time, late).dropDuplicatesWithinWatermark(["hash"])


def activity(events: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums of value by window of ts and event_type, each written once its window is over."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("window"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def arriving_files(spark: SparkSession, path: str):
    """A stream of the plans (file, content, type, is_pdf) that come into a folder; with availableNow, of what is there."""
    from ..sources import SUFFIXES, described

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return described(files).where(F.lower("file").rlike(rf"\.({'|'.join(SUFFIXES)})$"))


def journal(batch: DataFrame, path: str, endpoint: str) -> None:
    """For foreachBatch: append a batch's rows to the runs of an endpoint."""
    from ..sources import write_run

    write_run(batch, path, endpoint)


def into_registry(batch: DataFrame, registry: str) -> None:
    """For foreachBatch: append the hashes that the registry, a Parquet folder, doesn't hold; the same batch again adds none."""
    spark = batch.sparkSession
    new = batch.select("hash").where("hash is not null").distinct()
    try:
        new = new.join(spark.read.schema("hash string").parquet(registry), "hash", "left_anti")
    except Exception as e:  # a registry that isn't there yet is an empty one
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(registry)
