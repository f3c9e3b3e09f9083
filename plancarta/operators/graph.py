"""Graphs of trails and skeletons: components, spurs, longest chains, cheapest ways, and masks as arrays."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def groups(edges: DataFrame) -> DataFrame:
    """image_id, v, root of edges (image_id, a, b): an image's graph is bounded by its page, so it is one Arrow group."""

    def run(group):
        root: dict[int, int] = {}

        def top(v):
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for a, b in zip(group["a"].to_pylist(), group["b"].to_pylist(), strict=True):
            a, b = sorted((top(a), top(b)))
            root[b] = a
        vs = sorted(root)
        return pa.table({"image_id": pa.array([group["image_id"][0].as_py()] * len(vs), pa.int64()), "v": pa.array(vs, pa.int64()), "root": pa.array([top(v) for v in vs], pa.int64())})

    rows = edges.select(*[F.col(c).cast("long").alias(c) for c in ("image_id", "a", "b")])
    return rows.groupBy("image_id").applyInArrow(run, "image_id long, v long, root long")


def prune_spurs(edges: DataFrame, least: float, rounds: int = 4) -> DataFrame:
    """edges (image_id, id, a, b, length) after dropping, a few times, short ones with one loose end, by image."""

    def run(group):
        _, ends = np.unique(np.stack([group["a"].to_numpy(), group["b"].to_numpy()]), return_inverse=True)
        ends, short, on = ends.reshape(2, -1), group["length"].to_numpy() < least, np.ones(group.num_rows, bool)
        for _ in range(rounds):
            degree = np.bincount(ends[:, on].ravel(), minlength=int(ends.max()) + 1)[ends]
            spur = on & short & (degree.min(axis=0) == 1) & (degree.max(axis=0) > 1)
            if not spur.any():
                break
            on &= ~spur
        return group.filter(pa.array(on))

    return edges.groupBy("image_id").applyInArrow(run, edges.schema)


def diameter(edges: list[tuple[int, int]]) -> list[int]:
    """A longest path, in vertices, of a tree: the furthest from the smallest vertex, and the furthest from that."""
    near = defaultdict(list)
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)

    def far(start):
        before, order = {start: None}, [start]
        for v in order:
            for w in sorted(near[v]):
                if w not in before:
                    before[w] = v
                    order.append(w)
        return order[-1], before

    end, _ = far(min(near))
    v, before = far(end)
    path = []
    while v is not None:
        path.append(v)
        v = before[v]
    return path


def diameter_chains(edges: DataFrame) -> DataFrame:
    """image_id, path of edges (image_id, a, b), trees by image."""

    def run(group):
        path = diameter([*zip(group["a"].to_pylist(), group["b"].to_pylist(), strict=True)])
        return pa.table({"image_id": pa.array([group["image_id"][0].as_py()], pa.int64()), "path": pa.array([path], pa.list_(pa.int64()))})

    rows = edges.select(*[F.col(c).cast("long").alias(c) for c in ("image_id", "a", "b")])
    return rows.groupBy("image_id").applyInArrow(run, "image_id long, path array<long>")


def labelled(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Component numbers of a mask, 0 where it is off, by spreading the smallest place."""
    far = mask.size + 1
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), far)
    while True:
        padded = np.pad(label, 1, constant_values=far)
        low = label
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if eight or not dy or not dx:
                    low = np.minimum(low, padded[1 + dy : padded.shape[0] - 1 + dy, 1 + dx : padded.shape[1] - 1 + dx])
        low = np.where(mask, low, far)
        if (low == label).all():
            return np.where(mask, label, 0)
        label = low


def fill_holes(mask: np.ndarray, most: int) -> np.ndarray:
    """The mask with holes of at most `most` pixels that don't reach the border."""
    holes = labelled(~mask, eight=False)
    border = {*holes[0], *holes[-1], *holes[:, 0], *holes[:, -1]}
    ids, sizes = np.unique(holes, return_counts=True)
    small = [i for i, n in zip(ids, sizes, strict=True) if i and n <= most and i not in border]
    return mask | np.isin(holes, small)


def thinned(mask: np.ndarray) -> np.ndarray:
    """A mask worn down to lines one pixel wide, by alternating passes over south-east and north-west borders."""
    on = np.pad(mask, 1)
    while True:
        was = on.sum()
        for side in (0, 1):
            n = [np.roll(on, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            count = sum(x.astype(int) for x in n)
            turns = sum((~a & b).astype(int) for a, b in zip(n, n[1:] + n[:1], strict=True))
            north, east, south, west = n[0], n[2], n[4], n[6]
            free = ~(north & east & south) & ~(east & south & west) if side == 0 else ~(north & east & west) & ~(north & south & west)
            on &= ~(on & (count >= 2) & (count <= 6) & (turns == 1) & free)
        if on.sum() == was:
            return on[1:-1, 1:-1]


def distances(mask: np.ndarray, cap: float = np.inf) -> np.ndarray:
    """Of each pixel that is on, the distance to the nearest that is off, up to a cap, in steps of 0.955 straight and 1.3693
    across: all pixels step at once until none comes nearer."""
    d = np.where(mask, cap, 0.0)
    while True:
        p, low = np.pad(d, 1, constant_values=cap), d
        for y in (0, 1, 2):
            for x in (0, 1, 2):
                if y != 1 or x != 1:
                    low = np.minimum(low, p[y : y + d.shape[0], x : x + d.shape[1]] + (0.955 if y == 1 or x == 1 else 1.3693))
        if (low == d).all():
            return d
        d = low


def cheapest_way(cost: np.ndarray, start: tuple[int, int], end: tuple[int, int]) -> tuple[list[tuple[int, int]], float]:
    """The pixels of the cheapest way, eight ways, and its cost: the mean cost of each step's ends times its length."""
    best, before, todo = {start: 0.0}, {}, [(0.0, start)]
    while todo:
        c, p = heapq.heappop(todo)
        if p == end:
            break
        if c > best[p]:
            continue
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                q = p[0] + dy, p[1] + dx
                if (dy or dx) and 0 <= q[0] < cost.shape[0] and 0 <= q[1] < cost.shape[1]:
                    n = c + (cost[p] + cost[q]) / 2 * (2**0.5 if dy and dx else 1)
                    if n < best.get(q, np.inf):
                        best[q], before[q] = n, p
                        heapq.heappush(todo, (n, q))
    path = [end]
    while path[-1] != start:
        path.append(before[path[-1]])
    return path[::-1], best[end]


def _per_image(mask: DataFrame, change) -> DataFrame:
    """image_id, y, x, on of mask rows, each image's array changed."""

    def run(group):
        y, x = (group[c].to_numpy() for c in ("y", "x"))
        array = np.zeros((y.max() + 1, x.max() + 1), bool)
        array[y, x] = group["on"].to_numpy(zero_copy_only=False)
        return pa.table({"image_id": group["image_id"], "y": group["y"], "x": group["x"], "on": change(array)[y, x]})

    rows = mask.select(F.col("image_id").cast("long").alias("image_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "on")
    return rows.groupBy("image_id").applyInArrow(run, "image_id long, y int, x int, on boolean")


def skeletons(mask: DataFrame) -> DataFrame:
    return _per_image(mask, thinned)


def filled(mask: DataFrame, most: int) -> DataFrame:
    return _per_image(mask, lambda m: fill_holes(m, most))
