"""Queries over the whole registry and all runs read no view with gaps."""

import pytest
from pyspark.sql import functions as F

from wakeline import catalog
from wakeline.fixtures import view

SF = "/root/testdata/sf0.001"
WHOLE = (
    "map_oil_type tracks_in_scene_window gaps_in_window drafts_in_window capacity_defaults dark_windows dark_scores loitering_episodes "
    "loitering_scores behaviour_anomaly closest_approach correlate_scenes first_in_window capacity_veto permutation_test sensitivity_test "
    "attribute_all rank_candidates classify_outcome cpa_events forward_scores dedupe_runs check_constraints"
).split()


@pytest.mark.parametrize("name", WHOLE)
def test_sql_has_no_gaps(name):
    sql = catalog.oracle_sql()[name]
    assert "% 17 <> 3" not in sql and "% 13 <> 5" not in sql


def test_every_vessel_and_every_scene_with_runs_is_there(spark):
    vessels = view(spark, SF, "customer").select(F.floor(F.col("c_custkey") / 10)).distinct().count()
    assert catalog.queries()["map_oil_type"](spark, SF).count() == vessels
    found = catalog.queries()["rank_candidates"](spark, SF).select("scene_id").distinct()
    gaps = view(spark, SF, "fx_all_runs").where("scene_id % 13 = 5").select("scene_id").distinct().count()
    assert gaps > 0 and found.where("scene_id % 13 = 5").count() == gaps


def test_other_queries_keep_the_views_with_gaps(spark):
    catalog.queries()["map_oil_type"](spark, SF)
    assert view(spark, SF, "fx_runs").where("scene_id % 13 = 5").isEmpty()
    assert catalog.queries()["dark_scenarios"](spark, SF).count() > 0
