"""Pictures of results: outlines of regions, coverage in red and texts on a page, as PNG bytes, one page a row."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detectors import image_of

# fixed values: colours of sources and kinds
COLOURS = {"color": (0, 160, 0), "bordered": (200, 100, 0), "opencv_strict": (0, 0, 220), "bigregion": (160, 0, 160)}
OTHER, RED = (220, 0, 0), (255, 0, 0)
KINDS = ("outlines", "redmap", "textmap")


def png(rgb: np.ndarray) -> bytes:
    """An image (height, width, 3) as PNG."""
    h, w = rgb.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, -1)], axis=1)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def _clip(shape: tuple[int, ...], x, y, w, h) -> tuple[int, int, int, int]:
    return max(0, int(x)), max(0, int(y)), min(shape[1], int(x + w)), min(shape[0], int(y + h))


def outlined(rgb: np.ndarray, boxes: list[tuple[float, float, float, float, tuple[int, int, int]]], wide: int = 1) -> np.ndarray:
    """The image with a line inside the border of each box."""
    out = rgb.copy()
    for x, y, w, h, colour in boxes:
        x0, y0, x1, y1 = _clip(rgb.shape, x, y, w, h)
        for part in (np.s_[y0 : min(y0 + wide, y1), x0:x1], np.s_[max(y0, y1 - wide) : y1, x0:x1], np.s_[y0:y1, x0 : min(x0 + wide, x1)], np.s_[y0:y1, max(x0, x1 - wide) : x1]):
            out[part] = colour
    return out


def filled(shape: tuple[int, ...], boxes: list[tuple[float, float, float, float]], colour: tuple[int, int, int]) -> np.ndarray:
    """White, with boxes filled."""
    out = np.full(shape, 255)
    for box in boxes:
        x0, y0, x1, y1 = _clip(shape, *box)
        out[y0:y1, x0:x1] = colour
    return out


def pictures(pixels: DataFrame, boxes: DataFrame, kind: str = "outlines") -> DataFrame:
    """image_id, kind, png of pages of pixels with boxes (image_id, x, y, w, h, source): outlines over the page, or boxes
    filled in red, or in black for texts. A page without boxes is drawn too."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    schema = pa.schema([("image_id", pa.int64()), ("kind", pa.string()), ("png", pa.binary())])

    def run(key, page, own):
        if not page.num_rows:
            return schema.empty_table()
        rgb = image_of(page)
        places = [*zip(*(own[c].to_pylist() for c in ("x", "y", "w", "h")), strict=True)]
        if kind == "outlines":
            drawn = outlined(rgb, [(*p, COLOURS.get(s, OTHER)) for p, s in zip(places, own["source"].to_pylist(), strict=True)])
        else:
            drawn = filled(rgb.shape, places, RED if kind == "redmap" else (0, 0, 0))
        return pa.table({"image_id": [key[0].as_py()], "kind": [kind], "png": [png(drawn)]}, schema=schema)

    left = pixels.select(F.col("image_id").cast("long").alias("image_id"), *[F.col(c).cast("int").alias(c) for c in ("y", "x", "r", "g", "b")])
    right = boxes.select(F.col("image_id").cast("long").alias("image_id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")], "source")
    return left.groupBy("image_id").cogroup(right.groupBy("image_id")).applyInArrow(run, "image_id long, kind string, png binary")
