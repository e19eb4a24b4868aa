"""Lines are found for matched contacts alone."""

from pyspark.sql import functions as F

from wakeline.catalog.tracks import deduped
from wakeline.fixtures import view
from wakeline.operators.contacts import points_of_pairs, scene_points

SF = "/root/testdata/sf0.001"


def test_points_of_pairs_equal_those_of_scenes(spark):
    scenes, tracks = view(spark, SF, "fx_scenes"), deduped(spark, SF)
    every = scene_points(scenes, tracks)
    pairs = every.where(F.col("scene_id") % 3 != 0).select("scene_id", "mmsi").distinct().where(F.xxhash64("scene_id", "mmsi") % 2 == 0)
    # given twice, never near, and without a position at all
    odd = spark.createDataFrame([(1, "000000000"), (-1, "419000001")], pairs.schema)
    got = points_of_pairs(pairs.union(pairs).union(odd), scenes, tracks)
    want = every.join(pairs, ["scene_id", "mmsi"], "left_semi").select(got.columns)
    rows = sorted(map(str, got.collect()))
    assert rows == sorted(map(str, want.collect())) and len(rows) > 20
