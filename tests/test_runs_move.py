"""Runs go to their vessel's positions: what the pillars find there equals what they find on rows of a pair and a point."""

from pyspark.sql import functions as F

from wakeline import catalog
from wakeline.catalog.tracks import deduped, pair_points, run_drift
from wakeline.fixtures import view
from wakeline.operators import tracks
from wakeline.operators.sequences import neighbours

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_approaches_of_runs_equal_those_of_pair_points(spark):
    points, scenes = pair_points(spark, SF), view(spark, SF, "fx_scenes")
    track = neighbours(deduped(spark, SF), ["mmsi"], "ts_s", ["lat", "lon", "speed_knots"])
    sims, drift = view(spark, SF, "fx_sims"), run_drift(spark, SF)
    # a run without a drift, one whose drift has no times, and one of which only the first half has
    odd = F.col("run_id") % 7
    drift = drift.where(odd != 1).withColumn("ts_s", F.when((odd != 2) & ~((odd == 3) & (F.col("step") > 5)), F.col("ts_s")))
    got = tracks.approaches_of_runs(sims, scenes, track, drift)
    has = {r.run_id for r in drift.select("run_id").distinct().collect()}
    assert all(bool(r.drifted) == (r.run_id in has) for r in got.collect())
    want = tracks.closest_approach(points, drift, sims)
    assert rows(got.drop("drifted").select(want.columns)) == rows(want) and want.count() > 50

    runs, drift = view(spark, SF, "fx_runs"), view(spark, SF, "fx_drift")
    want = tracks.closest_approach(points, drift)
    assert rows(tracks.approaches_of_runs(runs, scenes, track, drift).select(want.columns)) == rows(want)


def test_episodes_equal_with_and_without_tracks(spark):
    points = pair_points(spark, SF, ports=True)
    want = rows(tracks.loitering_episodes(points))
    assert want == rows(tracks.loitering_episodes(points, deduped(spark, SF))) and want


def test_points_are_not_moved_by_run(spark):
    plan = catalog.queries()["closest_approach_of_runs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # instants are made by the uppermost generator, above the join of runs and positions, and stay in its tasks
    assert "Exchange" not in plan[: plan.index("SortMergeJoin")]
