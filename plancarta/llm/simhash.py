"""SimHash near-dedup with BK-trees.

A text's fingerprint has a bit set where over half of its shingles' XXH64 (seed 42) have it set. Equal fingerprints
become one vertex. To find those within `radius` bits, vertices are dealt to shards: the 64 bits are cut into radius + 1
blocks, and two fingerprints within the radius agree on a block, so a shard holds those with one block's value. A shard
of over SHARD vertices is cut again by the same rule over its other bits, so that a hot block's vertices spread too. In
each shard a BK-tree, children keyed by the Hamming distance to their parent, is built and searched, following only
edges within the radius of the distance. Trees stay with their shard: broadcasting them would grow with the corpus.
Each shard returns a spanning star per group, not its pairs, and alternating stars join these into components.

Fingerprints of texts with a Jaccard similarity of 0.8 mostly differ by more bits than any block rule finds. Where a
`similarity` is asked, texts whose shingle sets reach it are linked as well: BANDS hashes of ROWS smallest shingle hashes
name candidates, and the whole sets prove them. A pair at 0.8 shares no band with a chance of (1 - 0.8^4)^25, 2 in a
million; more alike, less. Each band's texts are first compared with one of them, then all that this left in different
components with each other.

Defined cases: null or empty text has fingerprint zero, which links like any other; fewer words than a shingle give one
shingle of all words; shingles count as often as they occur; repeated rows each get a row; rows with a null id get a row
but no say in the component's id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import factors, grams, id_column, mix, raw, rows_of, ship, store, tidied, word_hashes
from .components import components

WORDS, RADIUS, SEED = 3, 2, 42
SHARD = 1000
BANDS, ROWS = 25, 4

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_AT = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes, n: int = WORDS) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    f = xxhash.xxh64_intdigest
    h = np.array([f(line[a:b], SEED) for a, b in zip(starts, ends[n - 1 :], strict=False)], np.uint64)
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _AT).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * counts > len(h)).ravel(), bitorder="little").view(np.uint64)[0])


_PRINT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _prints(n: int):
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, n) for t in raw(b.column(1))], np.uint64)
            yield rows_of(_PRINT, doc_id=b.column(0), fp=fp.view(np.int64))

    return run


class Tree:
    """A BK-tree over integers."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        self.values.append(x)
        self.children.append({})
        if len(self.values) == 1:
            return
        at = 0
        while True:
            d = (self.values[at] ^ x).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.values) - 1
                return
            at = below

    def within(self, x: int, radius: int) -> list[int]:
        """Positions of the values within radius of x."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ x).bit_count()
            if d <= radius:
                found.append(at)
            todo += [c for k, c in self.children[at].items() if d - radius <= k <= d + radius]
        return found


def stars(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, first value of its group) for the groups that links within radius make of values."""
    tree, root = Tree(), list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(values):
        for j in tree.within(x, radius):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
        tree.add(x)
    return [(x, values[top(i)]) for i, x in enumerate(values) if top(i) != i]


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _search(radius: int):
    """Over rows (shard, fp) in the shard's order, whose shards may run over several batches."""

    def run(batches):
        shard, held = None, []
        for b in batches:
            out: list[tuple[int, int]] = []
            for k, fp in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != shard:
                    if len(held) > 1:
                        out += stars(held, radius)
                    shard, held = k, []
                held.append(fp & 0xFFFFFFFFFFFFFFFF)
            e = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield rows_of(_EDGE, a=e[:, 0], b=e[:, 1])
        e = np.array(stars(held, radius) if len(held) > 1 else [], np.uint64).reshape(-1, 2).view(np.int64)
        yield rows_of(_EDGE, a=e[:, 0], b=e[:, 1])

    return run


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    """bits cut into n runs of even length."""
    return [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _dealt(df: DataFrame, blocks: list[list[int]], other: DataFrame | None = None) -> DataFrame:
    """A row for each fingerprint and block: path of the shard, its bits as a mask, fp."""
    one = F.explode(F.array(*[F.lit(_mask(b)) for b in blocks])).alias("mask")
    return df.select("fp", one).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _counted(shards: DataFrame, keys: list[str]) -> DataFrame:
    return store(shards.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "shards")


def links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that make the same components as all pairs within radius."""
    blocks = _blocks(list(range(64)), radius + 1)
    rows = _dealt(prints, blocks)
    counts = _counted(rows, ["mask", "key"])
    rows = rows.join(counts, ["mask", "key"])
    done = rows.where(F.col("n") <= shard).select("mask", "key", "fp")
    for _ in range(2):
        hot = rows.where(F.col("n") > shard)
        if counts.where(F.col("n") > shard).limit(1).count() == 0:
            break
        # the bits outside the shard's own, cut by the same rule; a sub-shard's mask holds both
        cuts = {_mask(own): [_mask(own + x) for x in _blocks([i for i in range(64) if i not in own], radius + 1)] for own in blocks}
        cut = F.coalesce(*[F.when(F.col("mask") == m, F.array(*map(F.lit, xs))) for m, xs in cuts.items()])
        rows = hot.select("fp", F.explode(cut).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        counts = _counted(rows, ["mask", "key"])
        rows = rows.join(counts, ["mask", "key"])
        done = done.unionByName(rows.where(F.col("n") <= shard).select("mask", "key", "fp"))
        blocks = [[i for i in range(64) if m >> i & 1] for xs in cuts.values() for m in xs]
    else:
        done = done.unionByName(rows.where(F.col("n") > shard).select("mask", "key", "fp"))
    sharded = done.select(F.xxhash64("mask", "key").alias("shard"), "fp").repartition("shard").sortWithinPartitions("shard", "fp")
    return sharded.mapInArrow(_search(radius), "a long, b long")


_SEEDS = factors(BANDS * ROWS, 1)[:, None], factors(BANDS * ROWS, 2)[:, None]
_SIGNED = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("bands", pa.list_(pa.int64()))])
_SET = pa.schema([("key", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def shingles(text: bytes, n: int, memo) -> np.ndarray:
    """Hashes of the distinct shingles of n words, or the one of all words where there are fewer."""
    words = text.lower().split()
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    return np.unique(grams(h, min(n, len(h)))) if len(h) else h


def _key(s: np.ndarray) -> int:
    return int(mix(np.add.reduce(mix(s + np.uint64(1)), keepdims=True)).view(np.int64)[0])


def bands(s: np.ndarray) -> np.ndarray:
    """Hashes of ROWS smallest hashes of a set of shingles, BANDS of them."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, ((s[None, i : i + 4096] ^ _SEEDS[0]) * _SEEDS[1]).min(axis=1))
    return mix((mix(low).reshape(BANDS, ROWS) * factors(ROWS, 3)).sum(axis=1, dtype=np.uint64) + factors(BANDS, 4)).view(np.int64)


def _signed(n: int):
    def run(batches):
        memo = word_hashes()
        for b in batches:
            texts = raw(b.column(1))
            sets = [shingles(t, n, memo) for t in texts]
            fp = np.array([fingerprint(t, n) for t in texts], np.uint64)
            yield rows_of(_SIGNED, doc_id=b.column(0), fp=fp.view(np.int64), key=[_key(s) if len(s) else None for s in sets], n=[len(s) for s in sets], bands=[bands(s) if len(s) else None for s in sets])

    return run


def _sets(n: int):
    """The shingle sets of rows (text, keys) whose key is one of keys."""

    def run(batches):
        memo = word_hashes()
        for b in batches:
            sets = [shingles(t, n, memo) for t in raw(b.column(0))]
            found = [(k, s.view(np.int64)) for s, keys in zip(sets, b.column(1).to_pylist(), strict=True) if len(s) and (k := _key(s)) in keys]
            yield rows_of(_SET, key=[k for k, _ in found], shingles=[s for _, s in found])

    return run


def similar(docs: DataFrame, signed: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (a, b) between fingerprints that join the texts whose shingle sets have that similarity."""
    signed = signed.where("doc_id is not null and key is not null")
    prints = signed.select("key", "fp").distinct()
    sets = store(signed.groupBy("key").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("bands").alias("bands")), "keys")
    rows = sets.select(F.explode("bands").alias("band"), "key", "n")
    low = rows.groupBy("band").agg(F.min("key").alias("low"), F.count("*").alias("c")).where("c > 1").drop("c")
    rows = store(rows.join(low, "band"), "bands")

    def fits(n, m):
        return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9

    def proved(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        wanted = sets.join(ends, "key").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
        whole = store(docs.join(wanted, "doc_id").select("text", "keys").mapInArrow(_sets(words), "key long, shingles array<long>").dropDuplicates(["key"]), "sets")
        of = lambda x: whole.select(F.col("key").alias(x), F.col("shingles").alias(x * 2))
        common = F.size(F.array_intersect("aa", "bb"))
        both = pairs.join(of("a"), "a").join(of("b"), "b")
        return store(both.where(common >= (F.size("aa") + F.size("bb") - common) * similarity - 1e-9).select("a", "b"), "similar")

    first = rows.where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b")).distinct()
    size = lambda x: sets.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"))
    first = first.join(size("a"), "a").join(size("b"), "b").where(fits(F.col("n_a"), F.col("n_b"))).select("a", "b")
    found = proved(store(first, "pairs"))
    roots = components(found).withColumnRenamed("v", "key")
    rooted = store(rows.join(roots, "key", "left").select("band", "key", "n", F.coalesce("root", "key").alias("root")), "rooted")
    open_ = rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
    left = store(rooted.join(open_, "band"), "open")
    l, r = left.alias("l"), left.alias("r")
    rest = l.join(r, (F.col("l.band") == F.col("r.band")) & (F.col("l.root") < F.col("r.root")) & fits(F.col("l.n"), F.col("r.n")))
    rest = rest.select(F.col("l.key").alias("a"), F.col("r.key").alias("b")).distinct()
    found = found.unionByName(proved(store(rest, "pairs")))
    fp = lambda x: sets.select(F.col("key").alias(x), F.col("fp").alias(f"fp_{x}"))
    edges = found.join(fp("a"), "a").join(fp("b"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    # a set with several fingerprints, its shingles being repeated otherwise
    same = prints.join(sets.select("key", F.col("fp").alias("b")), "key").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return edges.unionByName(same)


def simhash_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id of its group, of docs (doc_id, text).

    With a similarity, texts whose sets of shingles reach it are linked too.
    """
    ship(docs.sparkSession)
    docs = docs.select(id_column(docs, "doc_id").alias("doc_id"), "text")
    if similarity is None:
        prints = store(docs.mapInArrow(_prints(words), "doc_id long, fp long"), "prints")
    else:
        signed = store(docs.mapInArrow(tidied(_signed(words)), "doc_id long, fp long, key long, n int, bands array<long>"), "signed")
        prints = signed.select("doc_id", "fp")
    vertices = store(prints.groupBy("fp").agg(F.min("doc_id").alias("lo")), "vertices")
    # vertices sort as unsigned or signed alike: roots only name a group
    edges = links(vertices.select("fp"), radius)
    roots = components(edges if similarity is None else edges.unionByName(similar(docs, signed, words, similarity)))
    grouped = store(vertices.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "lo", F.coalesce("root", "fp").alias("root")), "grouped")
    lowest = store(grouped.groupBy("root").agg(F.min("lo").alias("component_id")), "lowest")
    named = store(grouped.join(lowest, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int, radius: int, similarity: float | None = None) -> DataFrame:
    """The rows of docs (doc_id, text and others) whose id is its group's smallest; rows with a null id stay."""
    gone = simhash_groups(docs, words, radius, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).join(gone, F.col("row.doc_id").cast("long") == gone["_gone"], "left_anti")
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
