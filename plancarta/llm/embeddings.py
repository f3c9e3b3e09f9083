"""Embedding near-dedup by product quantisation over inverted lists.

Equal vectors become one vertex with a count. Coarse centroids and the codebooks of the residuals' subspaces are fitted
to a sample of the vertices, chosen by hash; every vertex is indexed. Lists grow in number with the root of the vertices,
from 256 to 16,384, and the sample with them, at about 16 vertices a list.

A vertex is a member of its nearest list, and asks that list and each other that may hold a partner. Where two partners
have different lists, the plane between the two centroids parts them, and their distances from it add up to the pair's
distance in that one direction: at most half of it lies on one of the sides, so that one of the two asks the other's list
if vertices ask across planes closer than that. The distance in any one direction of a partner at the threshold is a
`1 / sqrt(dimension)` share of its whole distance on average; `margin` such shares are allowed for, and the whole
distance where that is less.

Whole vectors don't go to all lists that are asked. A list gets its members' vectors, rounded, and only an id and codes
from those that ask; a pair stays a candidate unless its distance by these, less the coding error, exceeds the threshold's.
Vertices with a candidate in a list meet there again with whole vectors and are compared in double precision.

A large list's members and asking vertices are split, each pair of parts a group of its own, so that a hot list spreads
over tasks. Groups return each vertex's number of links and a spanning forest, never the pairs.

Defined cases: vectors that are null, empty, zero, or hold a null or a non-finite number link with nothing and keep
themselves; so do rows with a null id. Vectors of different lengths don't link. Repeated rows count as vectors each. An
empty table gives no rows; other columns are not read. Rows find their vertex again by two 64-bit hashes of the vector.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, id_column, rows_of, ship, store
from .components import components

COSINE, SAMPLE, LISTS, MOST_LISTS, PARTS, CODES, MARGIN, BLOCK, TURN = 0.9, 16_384, 256, 16_384, 16, 256, 3.0, 1000, 1.75


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _near(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    d = x @ (-2 * centroids.T)
    d += (x * x).sum(1)[:, None]
    d += (centroids * centroids).sum(1)
    return np.maximum(d, 0, out=d)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([_near(x[i : i + 4096], centroids).argmin(1) for i in range(0, len(x), 4096)])


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k centroids of the rows, by Lloyd's rounds from evenly spaced rows; the same rows give the same."""
    c = np.unique(x, axis=0)
    c = c[np.linspace(0, len(c) - 1, min(k, len(c))).astype(int)]
    for _ in range(rounds):
        at = _nearest(x, c)
        order = np.argsort(at, kind="stable")
        cells, first, n = np.unique(at[order], return_index=True, return_counts=True)
        c[cells] = np.add.reduceat(x[order], first, axis=0) / n[:, None].astype(x.dtype)
    return c


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    """At most k centroids of the rows; many are fitted in two steps, within the cells of the root of their number."""
    if k <= LISTS:
        return _kmeans(x, k)
    top = _kmeans(x[:: max(1, len(x) // SAMPLE)], math.isqrt(k))
    at = _nearest(x, top)
    ends = np.round(np.cumsum(np.bincount(at, minlength=len(top))) * (k / len(x))).astype(int)
    return np.concatenate([_kmeans(x[at == j], max(1, n)) for j, n in enumerate(np.diff(ends, prepend=0)) if (at == j).any()])[:MOST_LISTS]


class Index:
    """Coarse centroids and, by subspace, codes of residuals."""

    def __init__(self, x: np.ndarray, lists: int = LISTS, parts: int = PARTS, codes: int = CODES, cosine: float = COSINE, margin: float = MARGIN):
        x = x.astype(np.float32)
        self.coarse = _centroids(x, max(1, min(lists, len(x) // (32 if lists <= LISTS else 8))))
        few = x[:: max(1, len(x) // SAMPLE)]
        rest = few - self.coarse[_nearest(few, self.coarse)]
        self.cuts = [s for s in np.array_split(np.arange(x.shape[1]), min(parts, x.shape[1])) if len(s)]
        self.books = [_kmeans(rest[:, s], codes) for s in self.cuts]
        self.even = np.concatenate(self.books) if len({len(s) for s in self.cuts}) == 1 else None
        self.starts = np.cumsum([0, *map(len, self.books)])[:-1]
        self.radius = float(np.sqrt(2 - 2 * cosine))
        self.reach = min(1.0, margin / np.sqrt(x.shape[1])) * self.radius
        self.widest = np.concatenate([np.sqrt(_near(self.coarse[i : i + 1024], self.coarse).max(1)) for i in range(0, len(self.coarse), 1024)])

    def ask(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The list of each row; then row and list of all that is asked, by row, the row's own list included."""
        homes, rows, cells = [], [], []
        to = np.ascontiguousarray(np.c_[self.coarse * -2, (self.coarse * self.coarse).sum(1)].T)
        for first in range(0, len(x), 128):
            some = x[first : first + 128]
            d = np.c_[some, np.ones(len(some), np.float32)] @ to  # squared distances, less the row's own square
            home = d.argmin(1)
            least = d[np.arange(len(d)), home]
            # half the reach, to a plane that is half the difference of squares over the centroids' distance away
            row, cell = np.divmod(np.flatnonzero(d <= (least + self.reach * self.widest[home] + 1e-5)[:, None]), len(self.coarse))
            apart = self.coarse[home[row]] - self.coarse[cell]
            near = d[row, cell] - least[row] <= self.reach * np.sqrt((apart * apart).sum(1)) + 1e-5
            homes.append(home)
            rows.append(row[near] + first)
            cells.append(cell[near])
        return np.concatenate(homes), np.concatenate(rows), np.concatenate(cells)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each row, and its coding error in hundredths, rounded up."""
        codes = np.empty((len(x), len(self.cuts)), np.uint8)
        rest = x - self.coarse[home]
        for k, (s, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            codes[:, k] = _nearest(np.ascontiguousarray(rest[:, s]), b)
        error = np.sqrt(((x - self.decode(home, codes)) ** 2).sum(1))
        return codes, np.ceil(np.minimum(error * 100 + 0.01, 255)).astype(np.uint8)

    def decode(self, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = self.coarse[home]
        if self.even is not None:
            out += self.even.take((codes + self.starts).ravel(), axis=0).reshape(out.shape)
            return out
        for k, (s, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out[:, s[0] : s[-1] + 1] += b[codes[:, k]]
        return out


def _binary(data: np.ndarray, ends: np.ndarray | None = None) -> pa.Array:
    """Rows of an array as bytes; or items of a flat one, cut at ends."""
    n = len(data) if ends is None else len(ends)
    data = np.ascontiguousarray(data)
    ends = np.arange(1, n + 1) * (data.nbytes // max(n, 1)) if ends is None else ends * data.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(data)])


def _joined(column, kind) -> np.ndarray:
    """All bytes of a binary column as items."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


_CODED = pa.schema([("rep", pa.int64()), ("c", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("dim", pa.int32()), ("home", pa.int32()), ("v", pa.binary()), ("codes", pa.binary()), ("error", pa.int32()), ("probes", pa.binary())])
_CODED_SQL = "rep long, c long, h long, g long, dim int, home int, v binary, codes binary, error int, probes binary"


def _encode(indexes, kind):
    def run(batches):
        for b in batches:
            vectors = b.column("v")
            flat, at = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), np.r_[0, np.cumsum(vectors.value_lengths().to_numpy())]
            dims = np.diff(at)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                v = flat[at[rows][:, None] + np.arange(dim)]
                x = unit(v.astype(float)).astype(np.float32)
                index = indexes.value[int(dim)]
                home, row, cell = index.ask(x)
                codes, error = index.encode(x, home)
                own = [b.column(name).take(pa.array(rows)) for name in ("rep", "c", "h", "g")]
                probes = _binary(cell.astype(np.uint16), np.cumsum(np.bincount(row, minlength=len(x))))
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(x), dim, np.int32)), pa.array(home.astype(np.int32)), _binary(v), _binary(codes), pa.array(error.astype(np.int32)), probes], schema=_CODED)

    return run


def _by_dim(batches):
    for b in batches:
        dims = b.column("dim").to_numpy()
        for dim in np.unique(dims):
            yield int(dim), b if (dims == dim).all() else b.filter(pa.array(dims == dim))


_SIZES = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("own", pa.int64()), ("asks", pa.int64())])


def _sizes(batches):
    for dim, b in _by_dim(batches):
        own, asks = np.bincount(b.column("home").to_numpy()), np.bincount(_joined(b.column("probes"), np.uint16))
        cells = np.flatnonzero(asks)
        yield rows_of(_SIZES, dim=np.full(len(cells), dim, np.int32), cell=cells.astype(np.int32), own=np.r_[own, np.zeros(len(asks), int)][cells], asks=asks[cells])


def _kinds(dim: int, index: Index) -> tuple[np.dtype, np.dtype]:
    """A member and an asking vertex as a list gets them."""
    return np.dtype([("rep", "<i8"), ("u", "<f2", (dim,))]), np.dtype([("rep", "<i8"), ("home", "<u2"), ("codes", "u1", (len(index.cuts),)), ("error", "u1")])


def _several(n: np.ndarray) -> np.ndarray:
    """0, 1, ... below each number."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


_DEALT = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("members", pa.binary()), ("asks", pa.binary())])


def _deal(indexes, plans, kind, turn: int = 0, turns: int = 1):
    """Members and asking vertices to the parts of their lists, of every list in one of the turns: a row for each part and batch."""

    def run(batches):
        for dim, b in _by_dim(batches):
            member, asking = _kinds(dim, indexes.value[dim])
            blocks, chunks, first = plans.value[dim]
            n = len(b)
            home = b.column("home").to_numpy()
            own, asks = np.empty(n, member), np.empty(n, asking)
            own["rep"] = asks["rep"] = rep = b.column("rep").to_numpy()
            own["u"] = unit(_joined(b.column("v"), kind).reshape(n, dim).astype(float))
            asks["home"], asks["error"] = home, b.column("error").to_numpy()
            asks["codes"] = _joined(b.column("codes"), np.uint8).reshape(n, -1)
            dealt = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            spread = chunks[home] * (home % turns == turn)
            row = np.repeat(np.arange(n), spread)
            to = first[home[row]] + (dealt[row] % blocks[home[row]].astype(np.uint64)).astype(np.int64) * spread[row] + _several(spread)
            cells = _joined(b.column("probes"), np.uint16)
            who = np.repeat(np.arange(n), [len(x) // 2 for x in b.column("probes").to_pylist()])
            spread = blocks[cells] * (cells % turns == turn)
            k = np.repeat(np.arange(len(cells)), spread)
            whom = who[k]
            there = first[cells[k]] + _several(spread) * chunks[cells[k]] + (dealt[whom] % chunks[cells[k]].astype(np.uint64)).astype(np.int64)
            parts = np.unique(there)  # every vertex asks its own list: each part that gets a member here is a candidate for one
            parts = np.union1d(parts, to)
            order, other = np.argsort(to, kind="stable"), np.argsort(there, kind="stable")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(parts), dim, np.int32)),
                    pa.array(parts.astype(np.int32)),
                    _binary(own[row[order]], np.searchsorted(to[order], parts, "right")),
                    _binary(asks[whom[other]], np.searchsorted(there[other], parts, "right")),
                ],
                schema=_DEALT,
            )

    return run


_MARKED = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("rep", pa.int64()), ("asks", pa.bool_())])


def _mark(indexes, plans):
    """Members and asking vertices of a list's part that have a candidate there."""

    def run(key, group):
        dim, part = key[0].as_py(), key[1].as_py()
        index = indexes.value[dim]
        member, asking = _kinds(dim, index)
        own, asks = _joined(group["members"], member), _joined(group["asks"], asking)
        cell = int(np.searchsorted(plans.value[dim][2], part, "right")) - 1
        if not len(own) or not len(asks):
            return _MARKED.empty_table()
        asks = asks[np.argsort(asks["home"] != cell, kind="stable")]  # those that meet themselves first
        u = np.empty((len(own), dim + 2), np.float32)
        u[:, :dim] = own["u"]
        u[:, dim], u[:, dim + 1] = (u[:, :dim] ** 2).sum(1) / -2, 1
        hit, met = np.zeros(len(asks), bool), np.zeros(len(own), bool)
        for i in range(0, len(asks), 256):
            some = asks[i : i + 256]
            q = np.empty((len(some), dim + 2), np.float32)
            q[:, :dim] = index.decode(some["home"], some["codes"])
            # at least 0 where the distance is at most the radius and the error; rounded halves are off by less than 0.001
            q[:, dim], q[:, dim + 1] = 1, ((index.radius + some["error"] / 100 + 1e-3) ** 2 - (q[:, :dim] ** 2).sum(1)) / 2
            for j in range(0, len(own), 512):
                s = q @ u[j : j + 512].T
                if s.max() < -1e-5:
                    continue
                a, b = np.divmod(np.flatnonzero(s >= -1e-5), s.shape[1])
                other = some["rep"][a] != own["rep"][b + j]
                hit[a[other] + i] = True
                met[b[other] + j] = True
        rep = np.concatenate([asks["rep"][hit], own["rep"][met]])
        return pa.table({"dim": np.full(len(rep), dim, np.int32), "cell": np.full(len(rep), cell, np.int32), "rep": rep, "asks": np.arange(len(rep)) < hit.sum()}, schema=_MARKED)

    return run


_FOUND = pa.schema([("rep", pa.int64()), ("root", pa.int64()), ("n", pa.int64())])


def _compare(cosine: float, kind):
    def run(key, group):
        dim, cell = key[0].as_py(), key[1].as_py()
        asks = group["asks"].combine_chunks().to_numpy(zero_copy_only=False)
        own, other = group.filter(pa.array(~asks)), group.filter(pa.array(asks))
        if not len(own) or not len(other):
            return _FOUND.empty_table()
        u, q = (unit(_joined(x["v"], kind).reshape(-1, dim).astype(float)) for x in (own, other))
        cu, cq = own["c"].to_numpy(), other["c"].to_numpy()
        homes, asked = np.unique(other["home"].to_numpy(), return_inverse=True)
        probes = own["probes"].to_pylist()
        at = np.repeat(np.arange(len(own)), [len(p) // 2 for p in probes])
        cells = np.frombuffer(b"".join(probes), np.uint16)
        place = np.minimum(np.searchsorted(homes, cells), len(homes) - 1)
        back = np.zeros((len(own), len(homes)), bool)  # whether a member asks a home
        same = homes[place] == cells
        back[at[same], place[same]] = True
        ru, rq = own["rep"].to_numpy(), other["rep"].to_numpy()
        reps = np.concatenate([ru, rq])
        n = np.zeros(len(reps), np.int64)
        label, linked = np.arange(len(reps)), np.zeros(len(reps), bool)
        for first in range(0, len(q), 256):
            s = q[first : first + 256] @ u.T
            near = s >= cosine - 1e-9
            for i in np.flatnonzero(near.any(1)):
                x = first + i
                at = np.flatnonzero(near[i])
                at = at[ru[at] != rq[x]]
                edge = s[i, at] < cosine + 1e-9  # the same sum from either side
                if edge.any():
                    at = at[~edge | ((u[at] * q[x]).sum(1) >= cosine)]
                if not len(at):
                    continue
                n[len(u) + x] += cu[at].sum()
                n[at[~back[at, asked[x]]]] += cq[x]  # a member that itself asks the vertex's list counts this link there
                met = np.r_[len(u) + x, at]
                linked[met] = True
                old = np.unique(label[met])
                if len(old) > 1:
                    label[np.isin(label, old)] = old[0]
        hit = np.flatnonzero(linked)
        # labels are places, and places hold ids
        return pa.table({"rep": reps[hit], "root": reps[label[hit]], "n": n[hit]}, schema=_FOUND)

    return run


def _usable():
    """Whether a row's vector can link; in built-in functions of arrays, as lambdas are not compiled."""
    inf = float("inf")
    most = F.array_max("v")  # nan is the greatest
    whole = ~F.array_contains("v", -inf)  # null where an element is
    return F.col("vec_id").isNotNull() & F.coalesce(whole & (most < inf) & ((most > 0) | (F.array_min("v") < 0)), F.lit(False))


def vertices(vectors: DataFrame) -> DataFrame:
    """rep (smallest vec_id), c and v of each distinct usable vector of rows (vec_id, v)."""
    return vectors.where(_usable()).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("c")).select("rep", "c", "v")


def fit(vectors: DataFrame, sample: int = SAMPLE, cosine: float = COSINE) -> dict[int, Index]:
    """An index for each vector length of rows (vec_id, v), from about `sample` rows of each, or 16 a list where that is more."""
    usable = vectors.where(_usable())
    counts = {r.dim: r.n for r in usable.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    out = {}
    for dim, n in counts.items():
        lists = min(MOST_LISTS, max(LISTS, 3 * math.isqrt(n)))
        most = sample if lists == LISTS else max(sample, 16 * lists)
        at = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30))
        rows = usable.where((F.size("v") == dim) & at).select("vec_id", "v").toArrow().sort_by("vec_id")
        if not len(rows):
            rows = usable.where(F.size("v") == dim).orderBy("vec_id").limit(1).select("vec_id", "v").toArrow()
        x = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
        x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]  # copies count once
        out[dim] = Index(unit(x), lists if len(x) >= 8 * LISTS else LISTS, cosine=cosine)
    return out


def _plans(coded: DataFrame, indexes: dict[int, Index], kind: np.dtype, block: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """By vector length: how many parts a list's members and asking vertices are split into, and its first pair of parts.
    Then in how many turns lists get what they compare, so that a turn sends less than TURN times the vectors' bytes."""
    out = {dim: [np.ones(len(x.coarse), np.int64), np.ones(len(x.coarse), np.int64)] for dim, x in indexes.items()}
    sizes = coded.select("dim", "home", "probes").mapInArrow(_sizes, "dim int, cell int, own long, asks long").groupBy("dim", "cell").agg(F.sum("own").alias("own"), F.sum("asks").alias("asks"))
    held = sent = 0
    for r in sizes.collect():
        blocks, chunks = max(1, -(-r.own // (8 * block))), max(1, -(-r.asks // (256 * block)))
        out[r.dim][0][r.cell], out[r.dim][1][r.cell] = blocks, chunks
        member, asking = _kinds(r.dim, indexes[r.dim])
        held += r.own * r.dim * kind.itemsize
        sent += r.own * chunks * member.itemsize + r.asks * blocks * asking.itemsize
    return {dim: (blocks, chunks, np.r_[0, np.cumsum(blocks * chunks)[:-1]]) for dim, (blocks, chunks) in out.items()}, max(1, math.ceil(sent / max(TURN * held, 1)))


def embedding_groups(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    ship(spark)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = np.dtype("<f4" if single else "<f8")
    rows = vectors.select(id_column(vectors, "vec_id").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    hashes = F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")
    fitted = fit(rows, sample, cosine)
    indexes = spark.sparkContext.broadcast(fitted)
    coded = store(vertices(rows).select("rep", "c", "v", *hashes).mapInArrow(_encode(indexes, kind), _CODED_SQL), "coded", release=True)
    plan, turns = _plans(coded, fitted, kind, block)
    plans, marked = spark.sparkContext.broadcast(plan), []
    for turn in range(turns):  # a turn's shuffle is freed before the next
        dealt = coded.select("rep", "dim", "home", "v", "codes", "error", "probes").mapInArrow(_deal(indexes, plans, kind, turn, turns), "dim int, part int, members binary, asks binary")
        marked.append(store(dealt.groupBy("dim", "part").applyInArrow(_mark(indexes, plans), "dim int, cell int, rep long, asks boolean"), "marked", release=True))
    # parts by list: a table of at most MOST_LISTS rows for each vector length; a part of a list may be marked more than once
    whole = store(functools.reduce(DataFrame.unionByName, marked).distinct(), "whole")
    forget(*marked)
    own, asks = F.count_if(~F.col("asks")), F.count_if("asks")
    cells = F.broadcast(store(whole.groupBy("dim", "cell").agg(F.ceil(own / block).cast("int").alias("blocks"), F.ceil(asks / (8 * block)).cast("int").alias("chunks")), "cells"))
    met = whole.join(cells, ["dim", "cell"]).join(coded.select("rep", "c", "home", "v", "probes"), "rep")
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    columns = ["dim", "cell", "b", "k", "rep", "c", "home", "v", "probes", "asks"]
    spread = F.when(F.col("asks"), F.col("blocks")).otherwise(F.col("chunks"))
    met = met.where("blocks > 0 and chunks > 0").withColumn("to", F.explode(F.sequence(F.lit(0), spread - 1)))
    met = met.withColumn("b", F.when(F.col("asks"), F.col("to")).otherwise(part("blocks"))).withColumn("k", F.when(F.col("asks"), part("chunks")).otherwise(F.col("to")))
    met = met.withColumn("probes", F.when(~F.col("asks"), F.col("probes"))).select(*columns)
    found = store(met.groupBy("dim", "cell", "b", "k").applyInArrow(_compare(cosine, kind), "rep long, root long, n long"), "found", release=True)
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("v").alias("rep"), "root")
    vertex = coded.select("rep", "c", "h", "g")
    named = vertex.join(links, "rep", "left").join(roots, "rep", "left").select("h", "g", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    # rows meet their vertex by hashes, not by whole vectors
    linked = rows.where(_usable()).select("vec_id", *hashes).join(named, ["h", "g"]).select("vec_id", "n_links", "component_id", (F.col("component_id") == F.col("vec_id")).alias("kept"))
    alone = rows.where(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)
