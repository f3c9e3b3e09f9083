"""Packing of tokenised documents into windows by the sum-of-squares rule.

A document's ids are cut into pieces of at most `size`. Pieces are dealt at random, by their place in a stored table, to
shards of about SHARD pieces, so that repeated rows spread too; in each, in order of document and place, a piece goes to the fill level for which the sum of squares of the counts of
partially filled windows grows least, a new window being level 0 and full windows not counted; equal growth goes to the
fullest level. An array over levels holds the counts.

Ids: text is cut at [\\x20\\x09-\\x0D]+, at which this tokenizer's normaliser and pre-tokeniser always cut, so each
stretch between is tokenised alone and remembered; the end id follows the last. This, and that case makes no difference,
holds for tokenizers with the RULES of the usual one; with any other, whole texts are tokenised.

Defined cases: null or empty text is the end id alone; repeated rows are packed once each; rows with a null id are packed
like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict, deque
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_column, raw, rows_of, ship, store, tidied

SIZE, END = 4096, 2
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SHARD = 8192
#: Stretches of text whose ids a worker remembers, at most.
REMEMBERED = 800_000


#: ASCII signs that are one pre-token with their like and never part of a contraction.
DOTTED = "\u0130".encode()
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


# fixed values: the steps before the vocabulary that this module's short ways rely on
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class Ids(dict):
    """Little-endian 32-bit ids by stretch of text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, rules = tokenizer.encode, json.loads(tokenizer.to_str())
        self.short = all(rules[k] == v for k, v in RULES.items())

    def __missing__(self, w: bytes) -> bytes:
        letters = w.rstrip(SIGNS)
        if DOTTED in w:  # its lower case ends in a mark that goes with what follows
            ids = self.said(w.decode())
        elif letters and letters.decode().isalpha():
            if letters != w:  # letters, then signs: two pre-tokens, known apart
                ids = self[letters] + self[w[len(letters) :]]
            else:
                text = w.decode()
                lower = text.lower().encode()
                # lower case is taken letter by letter, which final sigma can't be
                ids = self[lower] if lower != w and "\u03a3" not in text else self.said(text)
        else:
            ids = self.said(w.decode())
        self[w] = ids
        return ids

    def said(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: bytes, end: bytes) -> bytes:
        if not self.short:
            return self.said(text.decode()) + end
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, text.split())) + end


@cache
def _ids(path: str) -> Ids:
    """One for each worker process, which serves many tasks."""
    return Ids(path)


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pieces(path: str, size: int, end: int):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids, last = _ids(path), np.array([end], "<u4").tobytes()
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in _PIECE}
            for i, text in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
                data = ids(text, last)
                n = len(data) // 4
                for s in range(0, n, size):
                    for name, v in zip(out, (i, s, min(size, n - s), zlib.crc32(data[4 * s : 4 * (s + size)]), n), strict=True):
                        out[name].append(v)
            yield rows_of(_PIECE, **out)

    return run


def place(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """The window and the offset in it of each piece, by the sum-of-squares rule."""
    counts = np.zeros(size + 1, np.int64)  # of windows by level; level 0 and full windows stay 0
    levels: dict[int, deque[int]] = defaultdict(deque)
    windows, offsets, made = [], [], 0
    for n in lengths:
        # growth of the sum of squares, for a window of level h = 0 ... size - n that becomes h + n
        rise = 2 * (counts[n:] - counts[: size - n + 1]) + 2
        rise[-1] = 1 - 2 * counts[size - n]
        rise = np.where(counts[: size - n + 1] > 0, rise, np.iinfo(np.int64).max)
        rise[0] = 2 * counts[n] + 1 if n < size else 0
        h = len(rise) - 1 - int(np.argmin(rise[::-1]))
        if h and counts[h] > 0:
            counts[h] -= 1
            window = levels[h].popleft()
        else:
            h, window, made = 0, made, made + 1
        if h + n < size:
            counts[h + n] += 1
            levels[h + n].append(window)
        windows.append(window)
        offsets.append(h)
    return windows, offsets


def _pack(size: int):
    def run(key, group):
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("length", "ascending")])
        windows, offsets = place(group["length"].to_pylist(), size)
        out = group.select([f.name for f in _PIECE])
        base = key[0].as_py() << 32
        return out.append_column("sequence_id", pa.array([base + w for w in windows], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str = TOKENIZER, end: int = END, shard: int = SHARD) -> DataFrame:
    """A row for each piece of docs (doc_id, text): where its ids begin in the document and in which window they lie."""
    ship(docs.sparkSession)
    docs = docs.select(id_column(docs, "doc_id").alias("doc_id"), "text")
    pieces = store(docs.mapInArrow(tidied(_pieces(tokenizer, size, end)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    shards = max(1, -(-pieces.count() // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_pack(size), _OUT)
