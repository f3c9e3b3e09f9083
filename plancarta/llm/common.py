"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A worker's memo tables are emptied beyond this many entries, so that their memory is bounded.
MEMO_ENTRIES = 400_000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for sessions whose workers don't have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_plancarta_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="plancarta")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    to = os.path.join(folder, "plancarta.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted((root / "plancarta").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(to)
    sc._plancarta_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset (local runs) a new one."""
    to = spark.conf.get("spark.checkpoint.dir", None)
    if not to:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        to = getattr(spark.sparkContext, "_plancarta_dir", None)
        if not to:
            folder = tempfile.mkdtemp(prefix="plancarta-shared")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            to = spark.sparkContext._plancarta_dir = f"file://{folder}"
    return to.rstrip("/")


def store(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors.

    Shuffle files go when the driver's collector finds their job's objects unused; with release, after large shuffles, it
    is run here, since a driver with little to do would otherwise leave the executors' disks to fill. What a first run
    lets go of holds the rest, and files go a moment later.
    """
    spark = df.sparkSession
    to = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(to)
    if release:
        gc.collect()
        for _ in range(2):
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)
    out = spark.read.schema(df.schema).parquet(to)
    out._stored_at = to
    return out


def forget(*stored: DataFrame) -> None:
    """Delete tables that store() wrote, once all that was made of them is stored itself."""
    for df in stored:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidied(run):
    """A map task's function that gives freed memory back when it is done, as its worker stays beside others."""

    def f(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return f


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives no bytes."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


#: The characters that separate words: [\\x20\\x09-\\x0D].
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def texts_of(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A string column in runs of rows of about `most` bytes: the first row's number, the UTF-8 bytes of all texts, eight
    spaces behind them, and where each text begins and the last ends. Null is an empty text."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        after = max(row + 1, int(np.searchsorted(ends, ends[row] + most, "right")) - 1)
        part = np.concatenate([data[ends[row] : ends[after]], np.full(8, 32, np.uint8)])
        yield row, part, ends[row : after + 1] - ends[row]
        row = after


def word_places(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts begin and end in their bytes, as texts_of gives them."""
    inside = ~SPACE[data]
    cut = np.zeros(len(data), bool)
    cut[ends[:-1]] = True
    joined = inside[1:] & inside[:-1] & ~cut[1:]  # with the byte before
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~joined
    last[:-1] &= ~joined
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def places_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at places in bytes that end in eight spaces."""
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    n = end - begin
    h = mix((eight[begin] & _LOW[np.minimum(n, 8)]) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    done, more = 8, np.flatnonzero(n > 8)
    while len(more):
        h[more] = mix(h[more] ^ (eight[begin[more] + done] & _LOW[np.minimum(n[more] - done, 8)]) * np.uint64(0xC2B2AE3D27D4EB4F))
        done += 8
        more = more[n[more] > done]
    return h


class Memo(dict):
    """A bounded memo of a function of one key."""

    def __init__(self, f, most: int = MEMO_ENTRIES):
        self.f, self.most = f, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        v = self[key] = self.f(key)
        return v


def word_hashes() -> Memo:
    """64-bit hashes of words (bytes)."""
    return Memo(xxhash.xxh3_64_intdigest)


def mix(g: np.ndarray) -> np.ndarray:
    """Spread 64-bit sums, so that their order and low bits are as good as random."""
    g = g ^ (g >> np.uint64(30))
    g = g * np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(27)
    g *= np.uint64(0x94D049BB133111EB)
    return g ^ (g >> np.uint64(31))


def factors(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit factors drawn by a fixed rule."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each window of k consecutive hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for j, c in enumerate(factors(k, seed)):
        g += h[j : j + n] * c
    return mix(g)


def rows_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def id_column(df: DataFrame, name: str):
    return F.col(name).cast("long")
