"""Pixels that lie by scene are neither shuffled nor made twice; a mask is closed on words of its lines."""

import random

import pytest

from wakeline import catalog
from wakeline.operators import raster

SF = "/root/testdata/sf0.01"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_an_image_are_not_shuffled(spark):
    assert "Exchange hashpartitioning(scene_id" not in plan_of(catalog.queries()["ca_cfar"](spark, SF))


def test_detections_are_made_once(spark):
    assert "explode" not in plan_of(catalog.queries()["sar_contacts"](spark, SF))


@pytest.mark.parametrize("name", ["clean_mask", "component_stats"])
def test_pixels_of_a_mask_are_not_shuffled(spark, monkeypatch, name):
    plans, write = [], raster.cut_lineage
    monkeypatch.setattr(raster, "cut_lineage", lambda df: plans.append(plan_of(df)) or write(df))
    catalog.queries()[name](spark, SF)
    assert "explode" in plans[0]
    assert "Exchange hashpartitioning(scene_id" not in "".join(p for p in plans if "explode" in p)


def closed(mask):
    """Dilation and erosion with the 3x3 cross, cell by cell; outside the image nothing erodes."""
    h, w = len(mask), len(mask[0])

    def around(m, y, x):
        return [m[a][b] for a, b in ((y, x), (y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= a < h and 0 <= b < w]

    wide = [[any(around(mask, y, x)) for x in range(w)] for y in range(h)]
    return [[all(around(wide, y, x)) for x in range(w)] for y in range(h)]


def test_closing_across_the_words_of_a_line(spark):
    rnd, rows, want = random.Random(3), [], set()
    sizes = [(1, 1, 0, 0), (1, 70, 0, 0), (70, 1, 0, 0), (5, 33, 2, 31), (8, 64, 0, 0), (9, 65, 3, 7), (20, 100, 1, 30), (6, 40, 0, -20)]
    for k, (h, w, top, left) in enumerate(sizes):
        mask = [[rnd.random() < (0.3, 0.6, 1.0)[k % 3] for _ in range(w)] for _ in range(h)]
        kept = closed(mask)
        for y in range(h):
            for x in range(w):
                p = (k, y + top, x + left, 0.6 + rnd.random() / 4 if mask[y][x] else rnd.choice([None, 0.3]))
                rows.append(p)
                if kept[y][x]:
                    want.add(p)
    got = [tuple(r) for r in raster.closed_mask(spark.createDataFrame(rows, "scene_id long, row long, col long, prob double")).collect()]
    assert len(got) == len(want) and set(got) == want
