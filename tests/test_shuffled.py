"""Points are not shuffled once more for every run or scene that looks at them."""

import re

import pytest

from wakeline import catalog
from wakeline.fixtures import view

SF = "/root/testdata/sf0.01"


def shuffled_rows(spark, name):
    """Rows that running the query writes into shuffles."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    catalog.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    runs = store.executionsList(before, store.executionsCount() - before)
    total = 0
    for run in (runs.apply(i) for i in range(runs.size())):
        values, nodes = store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if node.name() == "Exchange" and m.name() == "shuffle records written" and values.contains(m.accumulatorId()):
                    total += int(re.sub(r"\D", "", values.apply(m.accumulatorId())) or 0)
    return total


# pairs of a run and a point near it, as many as one shuffle of them would write
POINTS = {"closest_approach": 0.5, "closest_approach_of_runs": 0.8, "cpa_events": 0.5, "dark_scores": 0.5, "loitering_scores": 3}


@pytest.mark.parametrize("name", list(POINTS))
def test_points_of_pairs_stay_where_they_are(spark, name):
    r, s, t = (view(spark, SF, f"fx_{n}") for n in ("all_runs", "scenes", "tracks"))
    near = r.join(s.select("scene_id", "captured_s"), "scene_id").join(t.select("mmsi", "ts_s"), "mmsi").where("abs(ts_s - captured_s) <= 21600").count()
    got = shuffled_rows(spark, name)
    assert got < POINTS[name] * near
