"""Cases that once lost rows or answered wrongly."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wakeline.functions.geo import haversine_km
from wakeline.functions.grid import cell_x, cell_y, cells_around
from wakeline.operators import contacts, integrity, scoring
from wakeline.operators.drift import portable_uniform
from wakeline.session import work_path
from wakeline.sources import tables


def test_append_to_week_chunks_keeps_everything(spark):
    path = work_path(spark, "weeks")
    schema = "mmsi string, ts_s long, seq long"
    tables.write_tracks(spark.createDataFrame([("1", 10, 1), ("1", 700_000, 2)], schema), path)
    new = spark.createDataFrame([("1", 700_000, 9), ("2", 20, 3), ("2", 2_000_000, 4)], schema)
    for _ in range(2):
        tables.append_if_absent(spark, path, new, ["mmsi", "ts_s"], "seq", ts="ts_s")
        tables.append_if_absent(spark, path, new, ["mmsi", "ts_s"], "seq")
    got = sorted(map(tuple, tables.read_tracks(spark, path).select("mmsi", "ts_s", "seq").collect()))
    assert got == [("1", 10, 1), ("1", 700_000, 2), ("2", 20, 3), ("2", 2_000_000, 4)]


@pytest.mark.parametrize("lat", [0.0, 60.0, 80.0, 85.0, -85.0, 89.5, -89.9])
@pytest.mark.parametrize("lon", [0.0, 179.9])
def test_cells_hold_the_whole_circle(spark, lat, lon):
    rng, km = random.Random(1), 500.0
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)]
    for _ in range(1500):  # around the centre, where circle and box part
        d, turn = math.radians(rng.uniform(0, 5)), rng.uniform(0, 2 * math.pi)
        a = math.asin(math.sin(math.radians(lat)) * math.cos(d) + math.cos(math.radians(lat)) * math.sin(d) * math.cos(turn))
        b = math.radians(lon) + math.atan2(math.sin(turn) * math.sin(d) * math.cos(math.radians(lat)), math.cos(d) - math.sin(math.radians(lat)) * math.sin(a))
        points.append((math.degrees(a), (math.degrees(b) + 180) % 360 - 180))
    p = spark.createDataFrame(points, "lat double, lon double")
    inside = p.where(haversine_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= km)
    cells = spark.range(1).select(F.explode(cells_around(F.lit(lat), F.lit(lon), km, 2.0)).alias("c")).select("c.*").distinct()
    found = inside.join(cells, (cell_y(F.col("lat"), 2.0) == F.col("cy")) & (cell_x(F.col("lon"), 2.0) == F.col("cx")))
    assert found.count() == inside.count() > 0


def test_draws_of_neighbouring_seeds_are_unrelated(spark):
    d = spark.range(2000).select(*[portable_uniform(F.col("id") + k, seed=s).alias(f"u{s}_{k}") for s in (42, 43) for k in (0, 1)])
    pairs = [("u43_0", "u42_1"), ("u43_0", "u42_0"), ("u42_0", "u42_1")]
    row = d.agg(*[F.abs(F.corr(a, b)) for a, b in pairs], F.avg("u42_0")).first()
    assert max(row[:3]) < 0.1 and abs(row[3] - 0.5) < 0.05


def test_runs_without_scores_have_crashed(spark):
    rows = [("s", m, r, None if r > 15 else 0.9 - 0.1 * int(m[-1])) for m in ("000000001", "000000002") for r in range(21)]
    got = scoring.sensitivity_test(spark.createDataFrame(rows, "scene_id string, mmsi string, run long, score double"), 20).first()
    assert got.n_runs_completed == 15 and got.stability_index == 1.0 and "UNSTABLE_WEATHER" in got.sensitivity_reason


def test_rule_of_an_absent_column_raises(spark):
    d = spark.createDataFrame([(1, 120.0)], "id long, speed_knots double")
    with pytest.raises(ValueError, match="course_degrees"):
        integrity.violations(d, "tracks", "id")
    assert [r.rule for r in integrity.violations(d, "tracks", "id", ["speed_range"]).collect()] == ["speed_range"]
    for table, rules in integrity.RULES.items():  # every rule names the columns it needs
        with pytest.raises(ValueError):
            integrity.violations(spark.range(1), table, "id", [rules[0][0]])


def test_outlines_of_several_parts_and_holes(spark):
    def square(x, y, r):
        return [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]

    rings = [(0, 0, square(1, 1, 0.5)), (0, 1, square(1, 1, 0.2)), (1, 0, square(3, 1, 0.5))]
    v = spark.createDataFrame(
        [("s", p, k, i, x, y) for p, k, pts in rings for i, (x, y) in enumerate(pts)], "scene_id string, polygon int, ring int, vertex int, lon double, lat double"
    )
    outline = contacts.rings_of(v, "scene_id")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.35), (3, 1.0, 3.0), (4, 1.0, 2.0)], "id long, lat double, lon double")
    assert sorted(r.id for r in contacts.points_in_rings(points, outline, "scene_id").collect()) == [2, 3]
    scenes = spark.createDataFrame([("s", 10_000)], "scene_id string, captured_s long")
    c = contacts.spill_with_scene(outline, scenes).first()
    assert c.n_vertices == 12 and abs(c.centroid_lat - 1) < 1e-9 and abs(c.centroid_lon - (1 * 0.84 + 3 * 1.0) / 1.84) < 1e-9
    tracks = points.selectExpr("cast(id as string) mmsi", "9000L ts_s", "lat", "lon")
    assert sorted(r.mmsi for r in contacts.vessels_near_spill(outline, scenes, tracks, 5000.0).collect()) == ["2", "3"]
    assert sorted(r.mmsi for r in contacts.vessels_near_spill(outline, scenes, tracks, 30_000.0).collect()) == ["1", "2", "3"]
