"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words; every line with a word is compared. A line goes if an earlier one, by
document id and then place, has a Jaccard similarity of at least `similarity`; whether that one goes too makes no
difference, so the result needs no order of work.

Equal sets first: one set's earliest line stands for it, and its others go; a map task settles this for what it reads
together, so a hot line sends a row a task. Sets too small to be similar to any but their equals (under 4 words at 0.8; 4
words of 5 are similar) are done with that. For the rest, tokens are put in order of rarity, by counts over all documents
in a table of fixed size (a bucket may hold several words, which can cost work but no result), and the first
n - ceil(similarity * n) + 1 of them are sent to their token's group. Tokens travel in blocks of rows by a hash, and groups
are found by sorting a block.

In a group, pairs must pass the length filter, the positional filter (for both the token must lie in the prefix that
the pair's own lengths ask for, and what lies before and after it must suffice), and a bound from the parities of 128
bits that the sets' words are hashed to. A group names for each set the NAMED earlier partners with the fewest
differing bits; in groups of over LEADERS sets only the earliest LEADERS are looked at. Each set tries the TRIES
nearest first, then the other named ones; sets of which none proves right and that had more, try all. Partners are
proved on the whole token sets, which are read from the texts once: a table of bits of bounded size says which lines
may be wanted, and the join drops the others.

Defined cases: null or empty text has one empty line; rows with a null id are returned whole and are no source for
others; rows that share an id are one document: where a line of one goes, that place goes in each of them, but equal
lines at one place don't remove each other; an empty table gives no rows; other columns are not read, and may have any
names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, id_column, mix, places_hashes, rows_of, ship, store, texts_of, tidied, word_places

SIMILARITY, TRIES, NAMED, LEADERS = 0.8, 1, 4, 1024
BUCKETS, CHUNK = 1 << 18, 1 << 14
#: Rows of tokens in a block, about, and how many a map task gathers before it sends blocks on.
BLOCK, GATHERED = 1 << 16, 1 << 20
#: Pairs of rows that are held before those that won't be named are let go.
HELD = 1 << 20
#: The table of wanted lines has 2 ** WANTED bits at most, whatever the input.
WANTED = 26


def _lines(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where the lines of texts begin and end, each line's text and its place in it."""
    breaks = np.flatnonzero(data[:-8] == 10)
    owner = np.concatenate([np.arange(len(ends) - 1), np.searchsorted(ends, breaks, "right") - 1])
    order = np.argsort(owner, kind="stable")  # a text's first line, then those behind its breaks
    starts, owner = np.concatenate([ends[:-1], breaks + 1])[order], owner[order]
    last = np.r_[owner[1:] != owner[:-1], True][: len(owner)]
    stops = np.where(last, ends[owner + 1], np.r_[starts[1:], 0][: len(owner)] - 1)
    return starts, stops, owner, np.arange(len(owner)) - np.searchsorted(owner, owner)


def _line_of(begin: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which line each word is in, of words and lines in order."""
    first = np.searchsorted(begin, starts)
    return np.repeat(np.arange(len(starts)), np.diff(np.r_[first, len(begin)]))


def _counts(batches):
    """The task's counts of words by bucket of their hash, a row a chunk."""
    counts = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for _, data, ends in texts_of(b.column(0)):
            h = places_hashes(data, *word_places(data, ends))
            counts += np.bincount((h & np.uint64(BUCKETS - 1)).view(np.int64), minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS // CHUNK), pa.int32()), pa.array([c.tobytes() for c in counts.reshape(-1, CHUNK)])], ["chunk", "counts"])


def _add(key, chunks):
    for batch in [chunks]:
        total = sum((np.frombuffer(c, np.int64) for c in batch["counts"].to_pylist()), np.zeros(CHUNK, np.int64))
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def rarity(docs: DataFrame) -> np.ndarray:
    """Ranks, up to 4095, of words by bucket of their hash, the rarest first: BUCKETS numbers, however many documents."""
    chunks = docs.select("text").mapInArrow(_counts, "chunk int, counts binary").groupBy("chunk").applyInArrow(_add, "chunk int, counts binary").collect()
    out = np.zeros((BUCKETS // CHUNK, CHUNK), np.int64)
    for r in chunks:
        out[r.chunk] = np.frombuffer(r.counts, np.int64)
    return np.minimum(np.round(np.log2(out.ravel() + 1) * 64), 4095).astype(np.uint16)


def prefix(n, similarity: float = SIMILARITY):
    """Tokens of a set of n that are sent to groups."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def ordered(h: np.ndarray, line: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each line, by rank and then hash, and their lines. One sort of packed numbers does it, but for
    words of a line that these can't tell apart."""
    if not len(h) or line[-1] < 1 << 20:
        packed = (line.astype(np.uint64) << np.uint64(44)) | (rank << np.uint64(32)) | (h >> np.uint64(32))
        order = np.argsort(packed)
        packed, sort = packed[order], h[order]
        same = packed[1:] == packed[:-1]
        if (sort[1:][same] == sort[:-1][same]).all():
            new = np.r_[True, ~same][: len(h)]
            return sort[new], line[order][new]
    order = np.lexsort((h, rank, line))
    h, line = h[order], line[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (line[1:] != line[:-1])]
    return h[new], line[new]


def _keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever its order; first: where sets begin."""
    return mix(np.add.reduceat(mix(h + np.uint64(1)), first)).view(np.int64)


def _parities(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Of each set, whether each of 128 buckets holds an odd number of its words, in two numbers."""
    bit, low = np.uint64(1) << ((h >> np.uint64(57)) & np.uint64(63)), h < np.uint64(1 << 63)
    return [np.bitwise_xor.reduceat(np.where(x, bit, np.uint64(0)), first).view(np.int64) for x in (low, ~low)]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of bytes as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


#: n 0: a line that goes. prefix: the tokens to send, five bytes each.
_SET = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("n", pa.int32()), ("bits0", pa.int64()), ("bits1", pa.int64()), ("prefix", pa.binary())])
_SET_SQL = "key long, doc_id long, line int, n int, bits0 long, bits1 long, prefix binary"
TOKEN = 5


def _later(key: np.ndarray, doc: np.ndarray, place: np.ndarray, last=None) -> tuple[np.ndarray, np.ndarray]:
    """Of rows by key, document and place: which are behind their key's first, and which are no repetition of it at its own
    place. last: the first row of the key that the rows before ended with."""
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[begin, len(key)])
    first = [np.repeat(x[begin], sizes) for x in (doc, place)]
    again = np.arange(len(key)) != np.repeat(begin, sizes)
    if last is not None and len(key) and key[0] == last[0]:
        for x, y in zip(first, last[1:], strict=True):
            x[: sizes[0]] = y
        again[0] = True
    later = (doc != first[0]) | (place != first[1])
    return later, later | ~again


def _sets(ranks, similarity: float, least: float):
    """Over rows (doc_id, text): the sets of lines, one of the equal ones read together, and the others as lines to go."""

    def run(batches):
        for b in batches:
            docs = b.column(0).to_numpy(zero_copy_only=False)
            for row, data, ends in texts_of(b.column(1)):
                starts, _, owner, place = _lines(data, ends)
                begin, end = word_places(data, ends)
                if not len(begin):
                    continue
                h, line = places_hashes(data, begin, end), _line_of(begin, starts)
                h, line = ordered(h, line, ranks.value[h & np.uint64(BUCKETS - 1)].astype(np.uint64))
                first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
                n, own = np.diff(np.r_[first, len(h)]), line[first]
                key, bits = _keys(h, first), _parities(h, first)
                doc, place = docs[row + owner[own]].astype(np.int64), place[own]
                order = np.lexsort((place, doc, key))
                later, kept = (np.zeros(len(n), bool) for _ in range(2))
                later[order], kept[order] = _later(key[order], doc[order], place[order])
                sent = np.where(later | (n < least - 1e-9), 0, prefix(n, similarity))
                use = np.arange(len(h)) - np.repeat(first, n) < np.repeat(sent, n)
                tokens = (h[use] >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN]
                # lines that go meet no others, so their key need not be the set's
                spread = mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.view(np.uint64)).view(np.int64)
                out = pa.RecordBatch.from_arrays([pa.array(np.where(later, spread, key)), pa.array(doc), pa.array(place.astype(np.int32)), pa.array(np.where(later, 0, n).astype(np.int32)), *(pa.array(np.where(later, 0, x)) for x in bits), _binary(tokens, sent * TOKEN)], schema=_SET)
                yield out if kept.all() else out.filter(pa.array(kept))

    return run


def _firsts(batches):
    """Over sets by key, document and line: the first of each key that sends tokens, and the others as lines to go."""
    last = None
    for b in batches:
        key, doc, line, n = (b.column(i).to_numpy() for i in range(4))
        own = np.flatnonzero(n > 0)
        later, kept = _later(key[own], doc[own], line[own], last)
        gone, use = n == 0, np.ones(len(n), bool)
        gone[own], use[own] = later, kept
        if len(own):
            first = np.searchsorted(key[own], key[own[-1]])
            last = last if last is not None and last[0] == key[own[-1]] else tuple(x[own[first]] for x in (key, doc, line))
        sends = np.array(pc.binary_length(b.column(6))) > 0
        yield b.set_column(3, "n", pa.array(np.where(gone, 0, n).astype(np.int32))).filter(pa.array(use & (gone | sends)))


_ROW = np.dtype([("token", "<u8"), ("bits0", "<u8"), ("bits1", "<u8"), ("doc", "<i8"), ("line", "<i4"), ("n", "<i4"), ("at", "<i4"), ("asks", "?")])


def _blocks(blocks: int, wanted=None):
    """Over sets (doc_id, line, n, bits0, bits1, prefix, asks): a row for each token, of those that may be wanted, in blocks by the
    token's hash."""

    def sent(parts: list[np.ndarray]):
        rows = np.concatenate(parts)
        to = (rows["token"] % np.uint64(blocks)).astype(np.int32)
        order = np.argsort(to)
        rows, to = rows[order], to[order]
        begin = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
        # columns of bytes, so that those that are all alike take no room
        data = rows.view(np.uint8).reshape(-1, _ROW.itemsize)
        return pa.RecordBatch.from_arrays([pa.array(to[begin]), pa.array([data[i:j].T.tobytes() for i, j in zip(begin, np.r_[begin[1:], len(to)], strict=True)], pa.binary())], ["block", "rows"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            tokens, sizes = _tokens_of(b.column(5))
            rows = np.zeros(len(tokens), _ROW)
            rows["token"] = tokens
            for name, i in (("doc", 0), ("line", 1), ("n", 2), ("bits0", 3), ("bits1", 4), ("asks", 6)):
                rows[name] = np.repeat(b.column(i).to_numpy(zero_copy_only=False).astype(_ROW[name]), sizes)
            rows["at"] = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            if wanted is not None:
                rows = rows[wanted.value.has(_spread(tokens))]
            held.append(rows)
            size += len(rows)
            if size >= GATHERED:
                yield sent(held)
                held, size = [], 0
        if size:
            yield sent(held)

    return run


_PAIR = pa.schema([("doc_a", pa.int64()), ("line_a", pa.int32()), ("doc_b", pa.int64()), ("line_b", pa.int32()), ("apart", pa.int32()), ("more", pa.bool_())])
_PAIR_SQL = "doc_a long, line_a int, doc_b long, line_b int, apart int, more boolean"


class Rows:
    """Token rows of whole groups, by token and length."""

    def __init__(self, parts: list[bytes]):
        columns = np.concatenate([np.frombuffer(x, np.uint8).reshape(_ROW.itemsize, -1) for x in parts], axis=1)
        fields = {name: np.ascontiguousarray(columns[at : at + kind.itemsize].T).view(kind).ravel() for name, (kind, at) in _ROW.fields.items()}
        self.short = np.minimum(fields["n"], (1 << 24) - 1).astype(np.int64)  # lengths to sort and stop by
        order = np.argsort((fields["token"] << np.uint64(24)) | self.short.astype(np.uint64))
        self.token, self.bits0, self.bits1, self.doc, self.line, self.n, at, self.asks = (x[order] for x in fields.values())
        self.short, self.rest = self.short[order], self.n - at

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.bits0[i] ^ self.bits0[j]).astype(np.int32) + np.bitwise_count(self.bits1[i] ^ self.bits1[j])

    def possible(self, i: np.ndarray, j: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may reach the similarity if their token is the first that both have: what is left from there on must
        do, and the bits that differ must be few. A pair that reaches it passes at its first common token."""
        both = self.n[i] + self.n[j].astype(np.int64)
        ok = np.minimum(self.rest[i], self.rest[j]) * ((1 + similarity) / similarity) >= both - 1e-6
        i, j, both = i[ok], j[ok], both[ok]
        ok = self.apart(i, j) <= both - 2 * np.ceil(similarity / (1 + similarity) * both - 1e-9)
        return i[ok], j[ok]

    def _met(self, similarity: float, every: bool):
        """Pairs of rows of a group that may reach the similarity, a run at a time. In groups of over LEADERS rows each row
        meets only the earliest of them, unless every row is to be met."""
        begin = np.flatnonzero(np.r_[True, self.token[1:] != self.token[:-1]])
        sizes = np.diff(np.r_[begin, len(self.token)])
        place = np.arange(len(self.token)) - np.repeat(begin, sizes)
        live, back = np.flatnonzero((place > 0) & np.repeat(sizes <= LEADERS, sizes)), 1
        while len(live):
            near = self.short[live - back] >= similarity * self.short[live] - 1e-9  # once not, nothing further back is
            live = live[near]
            yield self.possible(live, live - back, similarity)
            back += 1
            live = live[place[live] >= back]
        for a, size in zip(begin[sizes > LEADERS], sizes[sizes > LEADERS], strict=True):
            rows = a + np.lexsort((self.line[a : a + size], self.doc[a : a + size]))
            asks = np.flatnonzero(self.asks[rows])
            if not every:
                self.more[rows[asks[asks > LEADERS]]] = True
            for k in range(size - 1 if every else LEADERS):
                i = rows[asks[np.searchsorted(asks, k, "right") :]]
                if not len(i):
                    break
                yield self.possible(i, np.full(len(i), rows[k]), similarity)

    def _named(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of later and earlier rows the NAMED with the fewest differing bits of each later row."""
        order = np.lexsort((j, self.apart(i, j), i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        self.more[i[rank >= NAMED]] = True
        return i[rank < NAMED], j[rank < NAMED]

    def partners(self, similarity: float, every: bool):
        """Runs of i, j: possible partners j of rows i that ask, earlier than these and in their group. Without every, one
        run with the NAMED partners of each; self.more then says which rows may have more, and these are in it with
        themselves as partner, too."""
        self.more = np.zeros(len(self.token), bool)
        none = np.zeros(0, np.int64)
        i, j, held, size = none, none, [], 0

        def oriented():
            a, b = (np.concatenate([none, *x]) for x in (zip(*held, strict=True) if held else ((), ())))
            later = (self.doc[a] > self.doc[b]) | (self.doc[a] == self.doc[b]) & (self.line[a] > self.line[b])
            a, b = np.where(later, a, b), np.where(later, b, a)
            use = self.asks[a] & ((self.doc[a] != self.doc[b]) | (self.line[a] != self.line[b]))
            return a[use], b[use]

        for pair in self._met(similarity, every):
            held.append(pair)
            size += len(pair[0])
            if size > HELD:
                a, b = oriented()
                held, size = [], 0
                if every:
                    yield a, b
                else:
                    i, j = self._named(np.r_[i, a], np.r_[j, b])
        a, b = oriented()
        if every:
            yield a, b
        else:
            i, j = self._named(np.r_[i, a], np.r_[j, b])
            rest = np.flatnonzero(self.more)
            yield np.r_[i, rest], np.r_[j, rest]


def _pairs(similarity: float, every: bool):
    """Over blocks in order: possible partners before each set that asks."""

    def pairs(parts: list[bytes]):
        rows = Rows(parts)
        for i, j in rows.partners(similarity, every):
            apart, more = rows.apart(i, j), rows.more[i]
            none = i == j
            columns = [rows.doc[i], rows.line[i], np.where(none, 0, rows.doc[j]), np.where(none, -1, rows.line[j])]
            # a pair that meets at several tokens of the block is named once
            order = np.lexsort((~more, *columns))
            columns = [x[order] for x in columns]
            new = np.ones(len(order), bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
            doc_a, line_a, doc_b, line_b = (x[new] for x in columns)
            yield rows_of(_PAIR, doc_a=doc_a, line_a=line_a, doc_b=doc_b, line_b=pa.array(line_b, mask=line_b < 0), apart=apart[order][new], more=more[order][new])

    def run(batches):
        block, held = None, []
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != block and held:
                    yield from pairs(held)
                    held = []
                block = k
                held.append(x)
        if held:
            yield from pairs(held)

    return run


def _places(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Hashes of lines."""
    return mix(doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64) + np.uint64(1))


class Wanted:
    """A table of bits by hash, which has all that was put in, and perhaps others; 2 ** WANTED bits at most."""

    def __init__(self, packed: np.ndarray):
        self.packed, self.shift = packed, np.uint64(64 - (8 * len(packed)).bit_length() + 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h >> self.shift).astype(np.int64)
        return ((self.packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


_BITS = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])


def _mark(bits: int, hashes):
    """The table's chunks that are not zero, of all that hashes(batch) gives."""

    def run(batches):
        table = np.zeros(1 << bits, bool)
        for b in batches:
            table[(hashes(b) >> np.uint64(64 - bits)).astype(np.int64)] = True
        packed = np.packbits(table).reshape(-1, min(CHUNK, (1 << bits) // 8))
        some = np.flatnonzero(packed.any(axis=1))
        yield rows_of(_BITS, chunk=some, counts=[packed[k].tobytes() for k in some])

    return run


def _or(key, chunks):
    total = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in chunks["counts"].to_pylist()])
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _wanted(rows: DataFrame, n: int, hashes) -> Wanted:
    """A table of about 8 bits for each of n things whose hashes rows give."""
    bits = min(WANTED, max(10, math.ceil(math.log2(8 * n + 1))))
    chunk = min(CHUNK, (1 << bits) // 8)
    out = np.zeros(((1 << bits) // 8 // chunk, chunk), np.uint8)
    for r in rows.coalesce(64).mapInArrow(_mark(bits, hashes), "chunk int, counts binary").groupBy("chunk").applyInArrow(_or, "chunk int, counts binary").collect():
        out[r.chunk] = np.frombuffer(r.counts, np.uint8)
    return Wanted(out.ravel())


def _line_hashes(b: pa.RecordBatch) -> np.ndarray:
    return _places(b.column(0).to_numpy(), b.column(1).to_numpy())


def _token_hashes(b: pa.RecordBatch) -> np.ndarray:
    return _spread(_tokens_of(b.column(0))[0])


def _tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a column of prefixes, and how many each has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    out = np.zeros((int(ends[-1] - ends[0]) // TOKEN, 8), np.uint8)
    if len(out):
        out[:, :TOKEN] = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, TOKEN)
    return out.view("<u8").ravel(), np.diff(ends) // TOKEN


def _spread(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens + np.uint64(1))


def _those(wanted):
    """Rows (doc_id, line, ...) of lines that may be wanted."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(wanted.value.has(_line_hashes(b))))

    return run


_WHOLE = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("tokens", pa.list_(pa.int64()))])


def _whole(wanted):
    """The whole sets of the lines that may be wanted, of rows (doc_id, text)."""

    def run(batches):
        for b in batches:
            docs = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, data, ends in texts_of(b.column(1)):
                starts, stops, owner, place = _lines(data, ends)
                use = np.flatnonzero(wanted.value.has(_places(docs[row + owner], place)))
                # only these lines, each like a text
                step = np.zeros(len(data) + 1, np.int32)
                np.add.at(step, starts[use], 1)
                np.add.at(step, stops[use], -1)
                data = np.concatenate([data[np.cumsum(step[:-1]) > 0], np.full(8, 32, np.uint8)])
                ends = np.r_[0, np.cumsum(stops[use] - starts[use])]
                begin, end = word_places(data, ends)
                if not len(begin):
                    continue
                h, line = places_hashes(data, begin, end), _line_of(begin, ends[:-1])
                h, line = ordered(h, line, np.zeros(len(h), np.uint64))
                first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
                tokens = pa.ListArray.from_arrays(pa.array(np.r_[first, len(h)].astype(np.int32)), pa.array(h.view(np.int64)))
                own = use[line[first]]
                yield pa.RecordBatch.from_arrays([pa.array(docs[row + owner[own]]), pa.array(place[own].astype(np.int32)), tokens], schema=_WHOLE)

    return run


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and gone, the places of the lines to remove, of documents (doc_id, text) that have some."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(id_column(docs, "doc_id").alias("doc_id"), "text").where("doc_id is not null")
    ranks = spark.sparkContext.broadcast(rarity(docs))
    least = similarity / (1 - similarity) if similarity < 1 else math.inf  # n of n + 1 words must be similar
    lines = docs.mapInArrow(tidied(_sets(ranks, similarity, least)), _SET_SQL).repartition("key").sortWithinPartitions("key", "doc_id", "line")
    sets = store(lines.mapInArrow(tidied(_firsts), _SET_SQL), "sets", release=True)
    sending = sets.where("n > 0")
    tokens = sending.agg(F.sum(F.length("prefix"))).first()[0] or 0
    blocks = max(1, -(-tokens // TOKEN // BLOCK))

    def found(asking: DataFrame, every: bool, wanted=None) -> DataFrame:
        rows = asking.select("doc_id", "line", "n", "bits0", "bits1", "prefix", "asks").mapInArrow(tidied(_blocks(blocks, wanted)), "block int, rows binary")
        return rows.repartition("block").sortWithinPartitions("block").mapInArrow(tidied(_pairs(similarity, every)), _PAIR_SQL)

    def ends(pairs: DataFrame):
        a, b = (pairs.select(F.col(f"doc_{x}").alias("doc_id"), F.col(f"line_{x}").alias("line")) for x in "ab")
        both = a.unionByName(b)
        return spark.sparkContext.broadcast(_wanted(both, both.count(), _line_hashes))

    def whole(pairs: DataFrame, few: bool = False) -> DataFrame:
        """The whole sets of lines in pairs; few: of so few documents that they may well fit a broadcast join."""
        of = docs
        if few:
            places = [pairs.select(F.col(f"doc_{x}").alias("doc_id")) for x in "ab"]
            own = store(places[0].unionByName(places[1]).distinct(), "own")
            of = docs.join(own, "doc_id", "left_semi")
        return store(of.mapInArrow(tidied(_whole(ends(pairs))), "doc_id long, line int, tokens array<long>"), "whole")

    def proved(pairs: DataFrame, of: DataFrame) -> DataFrame:
        """doc_id and line of the later lines in pairs of that similarity."""
        of = of.mapInArrow(_those(ends(pairs)), of.schema)
        side = lambda x: of.select(F.col("doc_id").alias(f"doc_{x}"), F.col("line").alias(f"line_{x}"), F.col("tokens").alias(x))
        both = pairs.select("doc_a", "line_a", "doc_b", "line_b").join(side("b"), ["doc_b", "line_b"]).join(side("a"), ["doc_a", "line_a"])
        common = F.size(F.array_intersect("a", "b"))
        right = both.where(common >= (F.size("a") + F.size("b") - common) * similarity - 1e-9)
        return store(right.select(F.col("doc_a").alias("doc_id"), F.col("line_a").alias("line")).distinct(), "near")

    partners = F.array_sort(F.collect_set(F.when(F.col("line_b").isNotNull(), F.struct("apart", "doc_b", "line_b"))))
    named = found(sending.withColumn("asks", F.lit(True)), False).groupBy(F.col("doc_a").alias("doc_id"), F.col("line_a").alias("line")).agg(partners.alias("b"), F.max("more").alias("more"))
    named = store(named.select("doc_id", "line", F.slice("b", 1, NAMED).alias("b"), (F.col("more") | (F.size("b") > NAMED)).alias("more")), "named", release=True)
    paired = lambda df, bs: df.select(F.col("doc_id").alias("doc_a"), F.col("line").alias("line_a"), F.explode(bs).alias("b")).select("doc_a", "line_a", "b.*")
    of = whole(paired(named, F.col("b")))
    near = proved(paired(named, F.slice("b", 1, TRIES)), of)
    rest = store(named.where((F.size("b") > TRIES) | F.col("more")).join(near, ["doc_id", "line"], "left_anti"), "rest", release=True)
    near = near.unionByName(proved(paired(rest, F.slice("b", TRIES + 1, NAMED)), of))
    again = store(rest.where("more").join(near, ["doc_id", "line"], "left_anti").select("doc_id", "line", F.lit(True).alias("asks")), "again", release=True)
    forget(of, named, rest)
    if again.limit(1).count():
        asking = store(sending.join(again, ["doc_id", "line"], "left").na.fill(False, ["asks"]), "asking")
        tokens = asking.where("asks").select("prefix")
        wanted = spark.sparkContext.broadcast(_wanted(tokens, tokens.agg(F.sum(F.length("prefix"))).first()[0] // TOKEN, _token_hashes))
        pairs = store(found(asking, True, wanted).drop("apart", "more").distinct(), "pairs")
        forget(asking)
        near = near.unionByName(proved(pairs, whole(pairs, True)))
    gone = sets.where("n = 0").select("doc_id", "line").unionByName(near)
    gone = store(gone.groupBy("doc_id").agg(F.collect_set("line").alias("gone")), "gone", release=True)
    forget(sets, again)
    return gone


def _joined(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """row (the columns of docs), kept (its text without the lines to remove), n_lines and n_removed."""
    # places to remove grow with the documents, so they are merged with these at every size, not sent to all executors
    places = gone.withColumnRenamed("doc_id", "id").hint("merge")
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).join(places, F.col("row.doc_id").cast("long") == F.col("id"), "left")
    split = F.split(F.coalesce("row.text", F.lit("")), "\n")
    # places that a repeated id's other rows have, and this text doesn't, remove nothing
    there = F.filter(F.coalesce("gone", F.array().cast("array<int>")), lambda i: i < F.size("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "there")
    kept = F.when(F.size("there") == 0, F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return out.withColumn("lines", split).withColumn("there", there).select("row", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.size("there").cast("long").alias("n_removed"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs (doc_id, text and others), its text without the lines to remove."""
    return _joined(docs, gone).select(*[F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def line_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text, n_lines and n_removed of each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    return _joined(docs, repeated_lines(docs, similarity)).select("row.doc_id", F.col("kept").alias("text"), "n_lines", "n_removed")
