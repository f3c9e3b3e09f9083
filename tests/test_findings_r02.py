"""Cases from a review."""

from __future__ import annotations

import numpy as np
import pytest

from plancarta.operators import arrays, detectors, regions, trails
from plancarta.plans import queries
from plancarta.plans import drawings as _drawings  # noqa: F401  registers its queries

BOX = "image_id long, rid long, x double, y double, w double, h double, source string, score double"


def kept(df):
    return sorted(r.rid for r in df.collect())


def test_endpoints_of_trails_numbered_by_page(spark):
    rows = [(image, trail, k, float(10 * image + k), float(trail), image) for image in range(1, 16) for trail in (1, 2) for k in range(4)]
    ends = trails.endpoints(spark.createDataFrame(rows, "image_id long, trail_id long, ord int, x double, y double, cluster long"))
    assert sorted((r.image_id, r.trail_id, r.port, r.x) for r in ends.collect()) == [(image, trail, port, 10.0 * image + 3 * port) for image in range(1, 16) for trail in (1, 2) for port in (0, 1)]


def test_demerge_compares_areas_in_the_order_of_its_sql(spark):
    # 0.7 * 20 * 33 is 462, as much as a tile's area; 0.7 * 660 is less
    rows = [(1, 1, 0.0, 0.0, 20.0, 33.0, "color", 1.0), *[(1, i, 0.0, 0.0, 14.0, 33.0, "bordered", 1.0) for i in (2, 3)]]
    assert 0.7 * 20 * 33 == 462 > 0.7 * (20 * 33)
    assert kept(regions.demerge(spark.createDataFrame(rows, BOX), 1e6, 4e-4)) == [2, 3]


def test_fine_coverage_compares_areas_in_the_order_of_its_sql(spark):
    w, h, ws, hs = 21.0, 30.0, 21.0, 27.0
    smaller = ws * hs < 0.9 * w * h
    assert smaller != (ws * hs < 0.9 * (w * h))
    rows = [(1, 1, 0.0, 0.0, w, h, "color", 1.0), (1, 2, 0.0, 0.0, ws, hs, "color", 1.0)]
    assert kept(regions.fine_coverage(spark.createDataFrame(rows, BOX))) == ([2] if smaller else [1, 2])


def test_merged_block_sums_areas_in_the_order_of_its_sql(spark):
    # the parts share 396 and 414 of the block's 1080, three quarters of it but for the rounding of shares times sides
    parts = [(97.0, 99.0, 21.0, 23.0), (98.0, 131.0, 20.0, 25.0)]
    assert 396 / 483 * 21 * 23 + 414 / 500 * 20 * 25 < 810 == 396 / 483 * (21 * 23) + 414 / 500 * (20 * 25)
    rows = [(1, i, *b, "color", 1.0) for i, b in enumerate([(100.0, 100.0, 20.0, 54.0), *parts], 1)]
    assert kept(regions.merged_block_drop(spark.createDataFrame(rows, BOX))) == [1, 2, 3]


@pytest.mark.parametrize("name", ["mask_algebra", "median_area_frac", "gap_occlusion", "ring_contrast", "touch_groups", "pixels_left", "stroke_width", "colour_regions", "tiled_regions"])
def test_exploded_rows_are_not_broadcast(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" in plan


def test_geometric_blurs_a_page_once_for_each_window(monkeypatch):
    asked, blur = [], arrays.median_blur
    monkeypatch.setattr(arrays, "median_blur", lambda a, k: asked.append((a.shape, k)) or blur(a, k))
    page = np.full((60, 80, 3), 250)
    page[10:50, 10:70] = (180, 120, 90)
    detectors.geometric(page, detectors.options(long_side=80))
    whole = [k for shape, k in asked if shape == (60, 80)]
    assert len(whole) == 2  # lines and bright cells; four were for the same lines


@pytest.mark.parametrize("name", ["trail_driver", "merged_trails", "geometric_regions"])
def test_pages_are_dealt_over_many_tasks(spark, name):
    # few bytes of ids are long work: a shuffle that Spark chose itself becomes one task
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
