"""The fleet of a scene is found on a vessel's line of positions, not on rows of every scene and point."""

import random

import pytest

from tests.test_shuffled import SF, shuffled_rows
from wakeline import catalog
from wakeline.fixtures import view
from wakeline.operators.contacts import fleet_at, position_at, scene_points

T = 1704067200
TRACK = "mmsi string, seq long, ts_s long, lat double, lon double, speed_knots double, course double"


def test_only_keys_of_scenes_and_vessels_are_shuffled(spark):
    fleet, points = catalog.queries()["position_at"](spark, SF).count(), view(spark, SF, "fx_tracks").count()
    # positions: deduplicated, then dealt to two buckets; pairs of a scene and a vessel: once, half as many again by their cells
    assert shuffled_rows(spark, "position_at") < 1.5 * fleet + 4 * points


@pytest.mark.parametrize("lat0, lon0", [(18.0, 70.0), (-1.0, 179.5), (62.0, -180.0), (88.5, 10.0), (89.9, 0.0)])
def test_fleet_equals_points_and_their_aggregate(spark, lat0, lon0):
    rnd = random.Random(5)
    t, seq = [], 0
    for v in range(30):
        wide = (0.02, 0.5, 4.0)[v % 3]
        y, x, start = lat0 + rnd.uniform(-1.5, 1.5), lon0 + rnd.uniform(-2, 2), T + rnd.randrange(86400)
        for _ in range(20):
            seq += 1
            lat, lon = min(90.0, max(-90.0, y + rnd.uniform(-wide, wide))), (x + rnd.uniform(-wide, wide) + 180) % 360 - 180
            t.append((f"{v:09d}", seq, start + seq * 1777 % 90000, lat, lon, rnd.choice([None, 3.5, 9.0]), float(seq % 360)))
    # no place, no course, off the globe, and at the very edges of a window
    t += [("000000001", seq + 1, T + 50001, None, lon0, 1.0, 1.0), ("000000002", seq + 2, T + 50002, lat0, None, 1.0, 1.0)]
    t += [("000000003", seq + 3, T + 50003, lat0, lon0, 1.0, None), ("000000004", seq + 4, T + 50004, 95.0, lon0, 1.0, 1.0)]
    t += [("000000031", seq + 5, T + 43200 - 21600, lat0, lon0, 1.0, 1.0), ("000000032", seq + 6, T + 43200 + 21600, lat0, lon0, 1.0, 1.0)]
    t += [("000000033", seq + 7, T + 43200 - 21601, lat0, lon0, 1.0, 1.0), ("000000034", seq + 8, T + 43200 + 21601, lat0, lon0, 1.0, 1.0)]
    s = [(i, T + 43200 * (i % 4) + (i // 4) * 7000, min(90.0, lat0 + (i % 5) * 0.3), lon0 + (i % 3) * 0.4) for i in range(20)]
    tracks = spark.createDataFrame(t, TRACK)
    scenes = spark.createDataFrame(s, "scene_id long, captured_s long, spill_lat double, spill_lon double")

    # a position without a place is near nothing
    want = position_at(scene_points(scenes, tracks.dropna(subset=["lat", "lon"])), ["scene_id", "mmsi"], "captured_s")
    got = fleet_at(scenes, tracks)
    assert got.columns == want.columns and got.count() > 50
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_distance_is_rounded_as_before(spark):
    """150.004 km rounds to the radius, 150.006 km does not; a line around the edge is measured point by point."""
    km = 6371.0 * 3.141592653589793 / 180
    t = [(f"{i:09d}", i, T + i, 18.0 + d / km, 70.0, 1.0, 1.0) for i, d in enumerate([149.0, 150.004, 150.006, 151.0])]
    t += [("000000009", 10 + i, T + 10 * i, 18.0 + d / km, 70.0, 1.0, 1.0) for i, d in enumerate([149.9, 150.1, 150.004, 150.006])]
    scenes = spark.createDataFrame([(1, T, 18.0, 70.0)], "scene_id long, captured_s long, spill_lat double, spill_lon double")
    got = {r.mmsi: r.n_points for r in fleet_at(scenes, spark.createDataFrame(t, TRACK)).collect()}
    assert got == {"000000000": 1, "000000001": 1, "000000009": 2}


def test_no_positions(spark):
    scenes = spark.createDataFrame([(1, T, 18.0, 70.0)], "scene_id long, captured_s long, spill_lat double, spill_lon double")
    assert fleet_at(scenes, spark.createDataFrame([], TRACK)).count() == 0
