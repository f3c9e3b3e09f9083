"""Operators that SQL doesn't express, and hand-made cases."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plancarta import sources, streaming
from plancarta.functions import decisions, text
from plancarta.operators import ensemble, folds, graph, pixels, regions, registry, shapes, trails

BOX = "image_id long, rid long, x double, y double, w double, h double, source string, score double"


def boxes(spark, *rows):
    return spark.createDataFrame([(1, i, *map(float, r[:4]), "color", r[4] if len(r) > 4 else 1.0) for i, r in enumerate(rows)], BOX)


def ids(df):
    return sorted(r.rid for r in df.collect())


def test_eviction_replaces_the_last_contained(spark):
    rows = [(0, 0, 10, 10, 0.9), (50, 50, 10, 10, 0.8), (0, 0, 100, 100, 0.5)]
    assert ids(folds.non_max_suppression(boxes(spark, *rows))) == [0, 2]


def test_eviction_is_cancelled_by_overlap(spark):
    rows = [(0, 0, 10, 10, 0.9), (0, 0, 100, 90, 0.7), (0, 0, 100, 100, 0.5)]
    assert 2 not in ids(folds.non_max_suppression(boxes(spark, *rows)))


def test_fold_of_none(spark):
    assert folds.prefer_fine(boxes(spark, (0, 0, 1, 1)).where("false")).count() == 0


def test_skinny_slice_keeps_merged_block(spark):
    rows = [(0, 0, 100, 100), (0, 0, 45, 100), (45, 0, 10, 100), (55, 0, 45, 100)]
    assert ids(regions.merged_block_drop(boxes(spark, *rows))) == [0, 1, 2, 3]
    rows = [(0, 0, 200, 100), (0, 0, 100, 100), (100, 0, 100, 100)]
    assert ids(regions.merged_block_drop(boxes(spark, *rows))) == [1, 2]


@pytest.mark.parametrize(("extent", "want"), [(1800, [0]), (1801, [0, 1400]), (3200, [0, 1400]), (3201, [0, 1400, 2800])])
def test_tile_axis(spark, extent, want):
    assert spark.range(1).select(regions.tile_origins(F.lit(extent)).alias("o")).first().o == want


@pytest.mark.parametrize(("label", "want"), [("9 m²", "boothlike"), ("9 m²9", "text"), ("A50", "boothlike"), ("", "empty"), (None, "empty"), ("toilet", "facility"), ("INDUSTRIES", "text"), ("a b c d e f g B12", "boothlike"), ("a b c d e f g h B12", "text"), ("A 50", "boothlike")])
def test_status(spark, label, want):
    assert spark.createDataFrame([(label,)], "l string").select(text.status(F.col("l")).alias("s")).first().s == want


def test_decisions(spark):
    rows = [(0.045, 0.9, 20, 1e-3), (0.0, 0.045, 14, 1e-5), (0.0, 0.0, 40, 5e-4), (0.0, 0.0, 39, 7e-3)]
    df = spark.createDataFrame(rows, "c double, g double, n int, m double")
    got = [tuple(r) for r in df.select(decisions.fill(F.col("c"), F.col("g")), decisions.density(F.col("n"), F.col("m"))).collect()]
    assert got == [("colored", "normal"), ("grey", "sparse"), ("white", "dense"), ("white", "sparse")]


def test_polygon_overlap():
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    assert shapes.overlap(square, square + 1) == pytest.approx((1 / 7, 0.25))
    diamond = np.array([(1, 0), (2, 1), (1, 2), (0, 1)], float)
    assert shapes.overlap(square, diamond) == pytest.approx((0.5, 1.0))
    assert shapes.overlap(square, square + 5) == (0.0, 0.0) == shapes.overlap(square, square[:2])


def test_simplified_stays_near():
    p = np.cumsum(np.random.default_rng(1).normal(size=(200, 2)), axis=0)
    kept = shapes.simplified(p, 2.0)
    assert kept[0] == 0 and kept[-1] == 199 and len(kept) < 200
    for a, b in zip(kept, kept[1:], strict=False):
        d = p[b] - p[a]
        assert (np.abs(d[0] * (p[a:b, 1] - p[a, 1]) - d[1] * (p[a:b, 0] - p[a, 0])) <= 2.0 * np.hypot(*d) + 1e-9).all()


def test_loops_go():
    line = np.array([(x, 0) for x in range(10)] + [(9, y) for y in range(1, 6)] + [(x, 5) for x in range(8, 3, -1)] + [(4, y) for y in range(4, -6, -1)], float)
    at = shapes.without_loops(line, 0.5, 6)
    assert at[0] == 0 and at[-1] == len(line) - 1 and len(at) < len(line)
    assert shapes.without_loops(line[:10], 0.5, 6).tolist() == [*range(10)]


def test_components_and_masks(spark):
    rng = random.Random(2)
    on = {(y, x) for y in range(12) for x in range(12) if rng.random() < 0.4}
    mask = spark.createDataFrame([(1, y, x, (y, x) in on) for y in range(12) for x in range(12)], "image_id long, y int, x int, on boolean")
    got = {(r.y, r.x): r.label for r in pixels.components(mask).collect()}
    assert got.keys() == on
    for y, x in on:
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if (y + dy, x + dx) in on:
                    assert got[y, x] == got[y + dy, x + dx]
    assert sum(r.area for r in pixels.component_stats(pixels.components(mask)).collect()) == len(on)
    closed = {(r.y, r.x) for r in pixels.erode(pixels.dilate(mask)).where("on").collect()}
    opened = {(r.y, r.x) for r in pixels.dilate(pixels.erode(mask)).where("on").collect()}
    assert opened <= on <= closed


def test_perceptual_hash_ignores_scale(spark):
    # a picture with something in every low frequency; where there is nothing, noise decides
    wave = np.random.default_rng(5).normal(size=(8, 8))

    def value(y, x):
        k = np.arange(8)
        return int(128 + 12 * np.cos(np.pi * k * y) @ wave @ np.cos(np.pi * k * x))

    rows = [(size, y, x, *[value((y + 0.5) / size, (x + 0.5) / size)] * 3) for size in (64, 128) for y in range(size) for x in range(size)]
    got = [r.hash for r in shapes.image_hashes(spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int")).collect()]
    assert (int(got[0], 16) ^ int(got[1], 16)).bit_count() <= 6


def test_bridges_use_each_port_once(spark):
    rows = [(0, 1, 0, 2, 0, 3.0), (0, 1, 0, 3, 0, 2.0), (0, 2, 0, 3, 1, 4.0), (0, 1, 1, 2, 1, 5.0)]
    df = spark.createDataFrame(rows, "image_id int, i long, port_i int, j long, port_j int, d double")
    assert sorted((r.i, r.j, r.d) for r in trails.greedy_bridges(df).collect()) == [(1, 3, 2.0), (2, 3, 4.0)]


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.PDF").write_bytes(b"%PDF-1.7")
    (tmp_path / "in" / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n0000")
    (tmp_path / "in" / "c.txt").write_bytes(b"no")
    got = sorted((r.file, r.type, r.is_pdf) for r in sources.folder(spark, str(tmp_path / "in")).collect())
    assert got == [("a.png", "image/png", False), ("b.PDF", "application/octet-stream", True)]
    assert [r.file for r in sources.folder(spark, str(tmp_path / "in"), ["B."]).collect()] == ["b.PDF"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.json").write_text(json.dumps([{"image": {"width": 10, "height": 20}, "predictions": [{"x": 1.0, "width": 2.0, "points": [{"x": 1, "y": 2}, {"x": 3, "y": 4}]}]}, {"predictions": [{"x": 9.0}]}]))
    (tmp_path / "p" / "y.json").write_text(json.dumps([{"predictions": [{"x": 2.0, "points": [{"x": 100, "y": 50}]}]}]))
    (tmp_path / "p" / "z.json").write_text("{")
    rows = sources.predictions(spark, str(tmp_path / "p"))
    assert sorted((r.file, r.x) for r in rows.where("x is not null").collect()) == [("x.json", 1.0), ("y.json", 2.0)]
    assert {r.file: (r.width, r.height) for r in sources.js_size(rows).collect()} == {"x.json": (10, 20), "y.json": (105, 53), "z.json": (2100, 1275)}
    assert sources.hash_registry(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.json").write_text('["x", "y", "x"]')
    (tmp_path / "h" / "b.json").write_text("")
    assert sorted(r.hash for r in sources.hash_registry(spark, str(tmp_path / "h")).collect()) == ["x", "y"]


def test_streams(spark, tmp_path):
    rows = [(i, f"h{i % 5}", f"2024-01-01 00:{i:02d}:00") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, hash string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming.first_arrivals(stream, "ts").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.hash for r in spark.sql("select * from seen").collect()) == [f"h{i}" for i in range(5)]
    to = str(tmp_path / "registry")
    for _ in range(2):
        q = stream.writeStream.foreachBatch(lambda batch, _: streaming.into_registry(batch, to)).option("checkpointLocation", str(tmp_path / f"c{_}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.read.parquet(to).count() == 5
    (tmp_path / "plans").mkdir()
    (tmp_path / "plans" / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "plans" / "b.txt").write_bytes(b"x")
    files = streaming.arriving_files(spark, str(tmp_path / "plans"))
    runs = str(tmp_path / "runs")
    files.select("file", "is_pdf").writeStream.foreachBatch(lambda batch, _: streaming.journal(batch, runs, "predict")).option("checkpointLocation", str(tmp_path / "c9")).trigger(availableNow=True).start().awaitTermination(120)
    assert [(r.file, r.is_pdf, r.endpoint) for r in spark.read.json(runs).collect()] == [("a.pdf", True, "predict")]


def test_fetching_and_payloads(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Plans(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/a.pdf" else 404)
            self.end_headers()
            self.wfile.write(b"%PDF-1.7" * 20_000 if self.path == "/a.pdf" else b"no")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Plans)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    urls = spark.createDataFrame([(1, f"{at}/a.pdf"), (2, f"{at}/b"), (3, "http://127.0.0.1:1/x"), (4, None)], "id long, url string")
    got = {r.id: r for r in sources.fetched(urls, seconds=5).collect()}
    server.shutdown()
    assert [got[i].status for i in (1, 2, 3, 4)] == [200, 400, 500, None]
    assert got[1].content == b"%PDF-1.7" * 20_000 and got[2].error == "status 404" and got[3].error and got[4].error is None
    result = spark.createDataFrame([(1, "x"), (2, "y")], "image_id long, label string")
    pictures = spark.createDataFrame([(1, "redmap", b"p")], "image_id long, kind string, png binary")
    sources.write_payload(result, pictures, str(tmp_path / "run"))
    assert sorted((r.image_id, r.label) for r in spark.read.json(str(tmp_path / "run" / "result")).collect()) == [(1, "x"), (2, "y")]
    assert spark.read.parquet(str(tmp_path / "run" / "pictures")).first().png == b"p"


def test_registry_generations_and_modes(spark, tmp_path):
    to = str(tmp_path / "r")
    assert sources.read_registry(spark, to).count() == 0
    for names in (["a", "b"], ["c"], ["c", "d", "d"]):
        new = spark.createDataFrame([(n,) for n in names], "hash string")
        sources.write_registry(sources.read_registry(spark, to).unionByName(new), to)
    assert sorted(r.hash for r in sources.read_registry(spark, to).collect()) == ["a", "b", "c", "d"]
    (tmp_path / "r" / "000000009").mkdir()  # a writer that crashed
    assert sources.read_registry(spark, to).count() == 4
    inputs = spark.createDataFrame([(1, "a"), (2, "z")], "id long, hash string")
    known = sources.read_registry(spark, to)
    assert {m: sorted((r.id, r.hash_status) for r in registry.handled(inputs, known, m).collect()) for m in registry.MODES[:2]} == {"always_run": [(1, "present"), (2, "absent")], "skip_if_present": [(2, "absent")]}
    with pytest.raises(Exception, match="hash is present"):
        registry.handled(inputs, known, "reject_if_present").collect()
    assert registry.handled(inputs.where("id = 2"), known, "reject_if_present").count() == 1


def test_masks_as_arrays():
    rng = np.random.default_rng(4)
    blob = np.zeros((20, 24), bool)
    blob[3:9, 2:20] = blob[5:18, 8:13] = True
    line = graph.thinned(blob)
    assert line.any() and (line <= blob).all() and line.sum() < blob.sum() / 2
    assert len(np.unique(graph.labelled(line))) == len(np.unique(graph.labelled(blob))) == 2
    ring = np.ones((7, 7), bool)
    ring[3, 3] = ring[0, 0] = False
    assert graph.fill_holes(ring, 1)[3, 3] and not graph.fill_holes(ring, 1)[0, 0] and not graph.fill_holes(ring, 0)[3, 3]
    mask = rng.random((9, 9)) < 0.8
    d = graph.distances(mask)
    off = np.argwhere(~mask)
    for y, x in np.argwhere(mask):
        assert d[y, x] == pytest.approx(np.hypot(*(off - (y, x)).T).min(), rel=0.1)


def test_cheapest_way():
    cost = np.ones((5, 5))
    cost[1:4, 2] = 50
    path, total = graph.cheapest_way(cost, (2, 0), (2, 4))
    assert path[0] == (2, 0) and path[-1] == (2, 4) and not any(cost[p] > 1 for p in path)
    assert total == pytest.approx(4 * 2**0.5)


def test_diameter():
    assert graph.diameter([(1, 2), (2, 3), (3, 4), (2, 5), (5, 6), (6, 7)]) in ([4, 3, 2, 5, 6, 7], [7, 6, 5, 2, 3, 4])


def test_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(h + rng.normal() * 0.01), 0.9, 0.9) for i, h in enumerate([0.1] * 15 + [0.45] * 15 + [0.8] * 15)]
    got = {r.id: r.cluster for r in ensemble.colour_clusters(spark.createDataFrame(rows, "id long, h double, s double, v double")).collect()}
    assert len({got[i] for i in range(15)}) == len({got[i] for i in range(15, 30)}) == 1 and len({*got.values()}) == 3
    by = spark.createDataFrame([(1, 0, 0.1, 0.1, 0.1), (1, 1, 0.9, 0.9, 0.9), (1, 2, 0.2, 0.1, 0.1)], "image_id long, cluster long, r double, g double, b double")
    assert {r.cluster: r.merged for r in ensemble.merged_clusters(by).collect()} == {0: 0, 1: 1, 2: 0}
