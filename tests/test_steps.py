"""Joins that make many rows of few keep their tasks, and their exploded keys stay out of the driver."""

import pytest

from tests.test_sides import broadcast_rows
from wakeline.catalog.tracks import deduped
from wakeline.fixtures import view
from wakeline.operators.contacts import scene_points
from wakeline.operators.windows import facts_of_runs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["first_in_window"])
def test_exploded_runs_are_not_broadcast(spark, name):
    assert max(broadcast_rows(spark, name), default=0) <= 200


def test_joins_use_all_shuffle_partitions(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scenes, runs = view(spark, SF, "fx_scenes"), view(spark, SF, "fx_runs")
    assert scene_points(scenes, deduped(spark, SF)).rdd.getNumPartitions() == n
    assert facts_of_runs(runs, scenes, view(spark, SF, "fx_tracks"), "ts_s", 43200, 0, dealt=True).rdd.getNumPartitions() == n
