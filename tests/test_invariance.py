"""Results do not depend on how the input is split or ordered."""

import pytest
from pyspark.sql import functions as F

from wakeline.fixtures import view
from wakeline.operators import tracks
from wakeline.operators.contacts import candidate_filter, nearest_vessel, position_at, scene_points

SF = "/root/testdata/sf0.001"


def arrangements(df):
    return [df.repartition(1), df.orderBy(F.xxhash64(*df.columns)).repartition(7)]


def same(frames):
    a, b = (sorted(map(str, f.collect())) for f in frames)
    assert a == b and a


@pytest.mark.parametrize("name", ["gaps", "fleet", "nearest"])
def test_tracks(spark, name):
    scenes, targets = view(spark, SF, "fx_scenes"), view(spark, SF, "fx_sar_targets")

    def run(t):
        d = tracks.dedupe_track(t)
        if name == "gaps":
            return tracks.ais_gaps(d)
        fleet = position_at(scene_points(scenes, d), ["scene_id", "mmsi"], "captured_s")
        return fleet if name == "fleet" else nearest_vessel(targets, fleet)

    same([run(t) for t in arrangements(view(spark, SF, "fx_tracks"))])


def test_candidate_boxes(spark):
    s = view(spark, SF, "fx_scenes").selectExpr(
        "scene_id", "captured_s", "spill_lat - 0.3 AS min_lat", "spill_lat + 0.3 AS max_lat", "spill_lon - 0.3 AS min_lon", "spill_lon + 0.3 AS max_lon"
    )
    same([candidate_filter(s, t) for t in arrangements(view(spark, SF, "fx_tracks"))])
