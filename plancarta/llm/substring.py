"""Substring dedup by level-wise doubling.

A passage is removed where it repeats: a word goes if a window of `size` consecutive words that covers it also starts in
a document with a smaller id. The first level looks at windows of about `first` words: `size` halved, rounding up, until it
is no more than that. A window that repeats across documents, and no other, is extended to twice its length for the next
level, and so on until no candidate survives or the length is `size` (7 and 13 for 13, or 7, 14, 28 and 50 for 50). Of the
shorter windows inside each full window, only the one with the smallest hash stands for it (two equal full windows choose
the same), so about a quarter of the positions are counted. Windows beyond `size` are made of these and can't cover
another word, so no candidate goes on from there.

Hashes meet in one shuffle each. Before it, a map task settles what its own batch shows: that a seed repeats, or that a
smaller document has a window; so a hash sends one row that asks or tells per batch, however many documents share it.

Defined cases: null text has no words; documents shorter than a window are returned whole; rows with a null id are
returned whole and are no source for others; rows that share an id are one document's windows but keep a row each, and
don't remove each other's words; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, grams, id_column, mix, raw, rows_of, ship, store, word_hashes

SIZE, FIRST = 13, 7


def levels(size: int, first: int = FIRST) -> list[int]:
    """Lengths of windows, each twice the one before but for the last, which is size."""
    out = [size]
    while out[0] > first:
        out[0] = (out[0] + 1) // 2
    while out[-1] < size:
        out.append(min(2 * out[-1], size))
    return out


def _seeds(h: np.ndarray, size: int, length: int) -> np.ndarray:
    """For each full window the hash of the window of length that stands for it."""
    g, n = grams(h, length), len(h) - size + 1
    m = g[:n].copy()
    for j in range(1, size - length + 1):
        np.minimum(m, g[j : j + n], out=m)
    return m


def _going_on(h: np.ndarray, size: int, length: int | None, found: pa.Scalar | None) -> np.ndarray:
    """Places of the full windows whose window of length is one of those found to repeat; all where there is no length."""
    if length is None:
        return np.arange(len(h) - size + 1)
    return np.flatnonzero(np.isin(_seeds(h, size, length).view(np.int64), found.values.to_numpy(zero_copy_only=False)))


def _windows(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each full window: 64 and 32."""
    return grams(h, size, 1).view(np.int64), grams(h, size, 2).astype(np.uint32).view(np.int32)


def _hashes(text: bytes, memo) -> tuple[list[bytes], np.ndarray]:
    words = text.split()
    return words, np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


#: key: the hash by which rows meet. state: ASKS whether its hash is elsewhere, TELLS that it is here, or KNOWN to repeat.
_SEED = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("seed", pa.int64()), ("state", pa.int32())])
_WINDOW = pa.schema([("key", pa.int64()), ("v", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("known", pa.bool_())])
ASKS, TELLS, KNOWN = 0, 1, 2


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows, sorted by columns, begin a new group."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _spread(ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys for rows that need not meet others: 20 bits, which spread as well as 64 and take less room."""
    return (mix(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + places.view(np.uint64)) >> np.uint64(44)).view(np.int64)


def _tag(text: bytes) -> int:
    """Tells rows apart that share an id; above a place in a text."""
    return (xxhash.xxh3_64_intdigest(text) & 0x7F) << 48


def _seed_rows(size: int, length: int, before: int | None):
    """Windows of length of rows (doc_id, text, and seeds, those of the length before that repeat). Those of several documents of a batch are known to repeat; one row tells other batches."""

    def run(batches):
        memo = word_hashes()
        for b in batches:
            seeds, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, text, found in zip(b.column(0).to_pylist(), raw(b.column(1)), b.column(2) if before else repeat(None), strict=False):
                _, h = _hashes(text, memo)
                if len(h) >= size:
                    seeds.append(np.unique(_seeds(h, size, length)[_going_on(h, size, before, found)]))
                    ids.append(np.full(len(seeds[-1]), i, np.int64))
            seed, doc = np.concatenate(seeds).view(np.int64), np.concatenate(ids)
            order = np.argsort(seed, kind="stable")
            seed, doc = seed[order], doc[order]
            begin = _starts(seed) if len(seed) else np.zeros(0, np.int64)
            n = np.diff(np.r_[begin, len(seed)])
            many = np.repeat(n > 1, n)
            tells = begin[n > 1]
            key = np.r_[np.where(many, _spread(doc, seed), seed), seed[tells]]
            state = np.r_[np.where(many, KNOWN, ASKS), np.full(len(tells), TELLS)]
            # only rows that are spread need their seed beside the key
            yield rows_of(_SEED, key=key, doc_id=np.r_[doc, doc[tells]], seed=np.r_[np.where(many, seed, 0), np.zeros(len(tells), np.int64)], state=state)

    return run


def _repeated_seeds(batches):
    """Over seed rows by key: doc_id and seed of those that repeat. A hash has a row for each batch at most."""
    held = None

    def found(key, doc, seed, state):
        begin = _starts(key) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.r_[begin, len(key)])
        tells = np.add.reduceat(state == TELLS, begin) if len(key) else n
        hit = (np.repeat((n > 1) | (tells > 0), n) & (state == ASKS)) | (state == KNOWN)
        return pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(np.where(state == KNOWN, seed, key)[hit])], ["doc_id", "seed"])

    for b in batches:
        rows = [b.column(i).to_numpy() for i in range(4)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        last = int(_starts(rows[0])[-1])  # its group may go on
        held = [x[last:] for x in rows]
        yield found(*[x[:last] for x in rows])
    if held is not None:
        yield found(*held)


def _window_rows(size: int, before: int | None):
    """Full windows of rows (doc_id, text, seeds) whose seed repeats. In a batch, only the smallest document must ask for a smaller one."""

    def run(batches):
        memo = word_hashes()
        for b in batches:
            parts = []
            for i, text, found in zip(b.column(0).to_pylist(), raw(b.column(1)), b.column(2) if before else repeat(None), strict=False):
                _, h = _hashes(text, memo)
                if len(h) >= size:
                    at = _going_on(h, size, before, found)
                    x, y = _windows(h, size)
                    parts.append((x[at], y[at], np.full(len(at), i, np.int64), at + _tag(text)))
            w, v, doc, at = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, k) for k in (np.int64, np.int32, np.int64, np.int64))
            order = np.lexsort((doc, v, w))
            w, v, doc, at = (c[order] for c in (w, v, doc, at))
            begin = _starts(w, v) if len(w) else np.zeros(0, np.int64)
            known = doc > np.repeat(doc[begin], np.diff(np.r_[begin, len(w)]))
            yield rows_of(_WINDOW, key=np.where(known, _spread(doc, at), w), v=np.where(known, 0, v), doc_id=doc, at=at, known=known)

    return run


def _later(batches):
    """Over window rows by key, v and document: doc_id and at of those that a smaller document has too."""
    last = None  # of the group that the batch before ended in
    for b in batches:
        key, v, doc, at, known = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        asks = np.flatnonzero(~known)
        hit = known.copy()
        if len(asks):
            k, x, d = key[asks], v[asks], doc[asks]
            begin = _starts(k, x)
            low = np.repeat(d[begin], np.diff(np.r_[begin, len(k)]))
            if last is not None and (k[0], x[0]) == last[:2]:
                low[: begin[1] if len(begin) > 1 else len(k)] = last[2]
            last = (k[-1], x[-1], low[-1])
            hit[asks] = d > low
        yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(at[hit])], ["doc_id", "at"])


def _kept(size: int, with_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept_text", pa.string())] if with_text else [])])

    def run(batches):
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for i, text, found in zip(b.column(0).to_pylist(), raw(b.column(1)), b.column(2), strict=True):
                gone = 0
                words = kept = text.split()
                if found.is_valid:
                    tag = _tag(text)
                    at = found.values.to_numpy(zero_copy_only=False)
                    at = at[at >> 48 == tag >> 48] - tag
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + size, -1)
                    covered = np.cumsum(step[:-1]) > 0
                    gone = int(covered.sum())
                    kept = [words[k] for k in np.flatnonzero(~covered)]
                data = b" ".join(kept)
                out["doc_id"].append(i)
                out["n_words"].append(len(words))
                out["n_removed"].append(gone)
                out["kept_sha256"].append(hashlib.sha256(data).hexdigest())
                if with_text:
                    out["kept_text"].append(data.decode())
            yield rows_of(schema, **out)

    return run


def substring_dedup(docs: DataFrame, size: int = SIZE, with_text: bool = True, first: int = FIRST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text of each row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    # an id that is a long already is read as it is, so that both joins' plans are alike
    docs = docs.select("doc_id" if dict(docs.dtypes)["doc_id"] == "bigint" else id_column(docs, "doc_id").alias("doc_id"), "text")
    known, null = docs.where("doc_id is not null"), docs.where("doc_id is null")
    rows, before, found = known, None, None
    for length in levels(size, first)[:-1]:
        seeds = rows.mapInArrow(_seed_rows(size, length, before), "key long, doc_id long, seed long, state int").repartition("key").sortWithinPartitions("key")
        last, found = found, store(seeds.mapInArrow(_repeated_seeds, "doc_id long, seed long").groupBy("doc_id").agg(F.collect_set("seed").alias("seeds")), "seeds", release=True)
        if last is not None:
            forget(last)
        rows, before = known.join(found, "doc_id"), length
        if found.limit(1).count() == 0:
            break
    windows = rows.mapInArrow(_window_rows(size, before), "key long, v int, doc_id long, at long, known boolean")
    later = windows.repartition("key").sortWithinPartitions("key", "v", "doc_id").mapInArrow(_later, "doc_id long, at long")
    cover = later.groupBy("doc_id").agg(F.collect_set("at").alias("found"))
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    # both joins read one shuffle of the texts
    rows = known.join(cover, "doc_id", "left").unionByName(null.withColumn("found", F.lit(None).cast("array<long>")))
    return rows.select("doc_id", "text", "found").mapInArrow(_kept(size, with_text), out)
