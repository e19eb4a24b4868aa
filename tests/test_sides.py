"""Joins of pixel tables never hold the pixels: exploded from few rows, they look small to Spark's estimates."""

import re

import pytest

from wakeline import catalog

SF = "/root/testdata/sf0.01"
PIXELS = 100 * 64 * 64


def broadcast_rows(spark, name):
    """Rows of every broadcast that running the query makes."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    catalog.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    runs = store.executionsList(before, store.executionsCount() - before)
    found = []
    for run in (runs.apply(i) for i in range(runs.size())):
        values, nodes = store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if node.name().startswith("BroadcastExchange") and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    found.append(int(re.sub(r"\D", "", values.apply(m.accumulatorId())) or 0))
    return found


@pytest.mark.parametrize("name", "component_stats damping_rule normalise_bytes normalise_scene patch_features ca_cfar clean_mask clusters sar_contacts".split())
def test_no_pixel_table_is_broadcast(spark, name):
    rows = broadcast_rows(spark, name)
    assert rows or name == "clusters"
    assert max(rows, default=0) < PIXELS / 20


def test_exploded_keys_of_scenes_are_not_broadcast(spark):
    assert max(broadcast_rows(spark, "position_at"), default=0) <= 100


def test_blended_lines_are_shuffled_once(spark):
    plan = catalog.queries()["blend_tiles"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(scene_id") == 1
