"""Nearest environment, cooldown by days, drift per run, and what else round 3 added."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import alerts, cleaning, contacts, evaluation, raster, sequences, tracks
from wakeline.sources import drift, tables


def plain_nearest(p, cells):
    out = []
    for a in range(3):
        axis = sorted({c[a] for c in cells}, reverse=True)
        out.append(min(axis, key=lambda x: (abs(x - p[a]), -x)))
    found = [c[3] for c in cells if tuple(c[:3]) == tuple(out)]
    return min(found) if found else None


def test_nearest_env_equals_plain_search(spark):
    rng = random.Random(5)
    lats, lons, times = [10.0, 10.5, 12.0, 13.0], [0.0, 90.0, 200.0, 359.0], [0, 3600, 90000]
    cells = [(a, o, t, rng.random()) for a in lats for o in lons for t in times if rng.random() < 0.8]
    cells += [(*cells[0][:3], 2.0)]
    points = [(k, rng.uniform(8, 15), rng.uniform(-180, 180), rng.randint(-10**5, 10**6)) for k in range(200)] + [(900, 10.25, 45.0, 1800), (901, 11.25, -1.0, 46800)]
    p = spark.createDataFrame([*points, (999, None, 1.0, 0)], "id long, lat double, lon double, ts_s long")
    e = spark.createDataFrame([*cells, (None, 1.0, 5, 7.0)], "lat double, lon double, ts_s long, u10 double")
    got = {r.id: r.u10 for r in contacts.nearest_env(p, e).collect()}
    assert got.pop(999) is None
    assert got == {k: plain_nearest((a, o % 360, t), cells) for k, a, o, t in points}


def test_nearest_env_has_a_grid_per_key(spark):
    e = spark.createDataFrame([("a", 1.0, -5.0, 0, 1.5), ("b", 1.0, 300.0, 0, 2.5)], "region string, lat double, lon double, ts_s long, u10 double")
    p = spark.createDataFrame([(k, 80.0, -60.0, 10**9, 1) for k in "abc"], "region string, lat double, lon double, ts_s long, other int")
    d = contacts.nearest_env(p, e, keys=("region",))
    assert d.columns == [*p.columns, "u10"]
    assert {r.region: r.u10 for r in d.collect()} == {"a": 1.5, "b": 2.5, "c": None}
    assert contacts.nearest_env(p, e.limit(0), keys=("region",)).where("u10 is null").count() == 3


def test_join_weather_is_idempotent(spark):
    e = spark.createDataFrame([(1.0, 1.0, 0, 3.0, 4.0)], "lat double, lon double, ts_s long, u10 double, v10 double")
    rows = [(1, 1.0, 9.0, 9.0, None), (2, 1.0, 9.0, None, None), (3, 1.0, 9.0, 9.0, "Regional Physics"), (4, None, None, None, "x")]
    r = spark.createDataFrame([(k, lat, 1.0, 0, u, v, s) for k, lat, u, v, s in rows], "id long, lat double, lon double, ts_s long, u10 double, v10 double, wind_source string")
    first = contacts.join_weather(r, e)
    assert sorted((x.id, x.u10, x.v10, x.joined) for x in first.collect()) == [(1, 9.0, 9.0, "skipped"), (2, 3.0, 4.0, "joined"), (3, 3.0, 4.0, "joined"), (4, None, None, "missing")]
    again = contacts.join_weather(first.drop("joined"), e)
    assert {x.id: x.joined for x in again.collect()} == {1: "skipped", 2: "skipped", 3: "skipped", 4: "missing"}
    assert {x.id: x.u10 for x in contacts.join_weather(r, e, overwrite=True).collect()} == {1: 3.0, 2: 3.0, 3: 3.0, 4: None}


def plain_cooldown(seconds, cooldown_s):
    kept, last = set(), None
    for s in sorted(set(seconds)):
        if last is None or s - last > cooldown_s:
            kept.add(s)
            last = s
    return kept


@pytest.mark.parametrize("cooldown_s", [0, 600, 1800, 86400])
def test_cooldown_of_a_station_that_never_pauses(spark, cooldown_s):
    rng = random.Random(cooldown_s)
    busy = [s for s in range(-86400, 30 * 86400, 40) if rng.random() < 0.9]
    bursts = [day * 86400 + off for day in range(20) for off in (5, 1799, 1800, 1801, 86390, 86399) if rng.random() < 0.7]
    rows = [(1, s) for s in busy] + [(2, s) for s in bursts] + [(2, bursts[0])] + [(None, 5), (None, 6)]
    d = spark.createDataFrame([(i, st, s, None) for i, (st, s) in enumerate(rows)], "request_id long, station_id long, requested_s long, reason string")
    sent = alerts.cooldown(d.where("station_id is not null"), cooldown_s).where("reason is null").groupBy("station_id").agg(F.collect_list("requested_s").alias("s"))
    got = {r.station_id: sorted(r.s) for r in sent.collect()}
    assert got == {1: sorted(plain_cooldown(busy, cooldown_s)), 2: sorted(plain_cooldown(bursts, cooldown_s))}


def test_run_positions_keep_what_can_be_read(spark):
    texts = [
        '{"particle_geometries": [{"lat": 1.5, "lon": "2.5", "time": "2024-01-01T00:00:10+00:00"}, 7, {"lat": 1}, "x", null, {"lat": "north", "lon": 1}, {"lat": 3, "lon": 4, "time": "soon", "more": []}]}',
        '{"particle_geometries": {"lat": 1, "lon": 2}}', '{"other": 1}', "no json", "[]", None, '{"particle_geometries": []}',
        '{"particle_geometries": [{"lat": 5, "lon": 6, "time": "2024-01-01T05:30:00+05:30"}]}',
    ]
    d = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "run_id long, result_summary string, step int")
    got = sorted(tuple(r) for r in drift.run_positions(d).select("run_id", "step", "ts_s", "lat", "lon").collect())
    assert got == [(0, 0, 1704067210, 1.5, 2.5), (0, 6, None, 3.0, 4.0), (7, 0, 1704067200, 5.0, 6.0)]


def test_run_positions_parse_a_summary_and_each_element_once(spark):
    d = spark.createDataFrame([(1, '{"particle_geometries": [{"lat": 1, "lon": 2}]}')], "run_id long, result_summary string").repartition(2)
    found = drift.run_positions(d)
    assert [tuple(r) for r in found.collect()] == [(1, 0, None, 1.0, 2.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 2


def test_two_simulations_of_one_scene_are_two_rows(spark):
    points = spark.createDataFrame([(9, 1, "v", t, 10.0, 20.0 + t / 1e6, 1000) for t in (0, 600, 1200)], "run_id long, scene_id long, mmsi string, ts_s long, lat double, lon double, captured_s long")
    runs = spark.createDataFrame([(5, 1, "v"), (6, 1, "v"), (7, 1, "v"), (8, 2, "v")], "run_id long, scene_id long, mmsi string")
    far = [(5, 0, t, 10.0, 20.0) for t in (0, 1200)] + [(6, 0, t, 10.05, 20.0) for t in (0, 1200)] + [(7, 0, None, 10.0, 20.0)]
    stored = spark.createDataFrame(far, "run_id long, step int, ts_s long, lat double, lon double")
    got = {r.run_id: r for r in tracks.closest_approach(points, stored, runs).collect()}
    assert set(got) == {5, 6, 7}
    assert got[5].min_distance_m == 0 and 5500 < got[6].min_distance_m < 5600 and got[7].min_distance_m is None


def test_quantiles_equal_plain_ones_under_outliers(spark):
    rng = random.Random(2)
    values = {
        "outlier": [rng.uniform(0.05, 0.1) for _ in range(3000)] + [1e12], "ties": [0.5] * 2000 + [0.25] * 10 + [-3.0], "one": [7.0],
        "signs": [rng.gauss(0, 1) for _ in range(500)] + [0.0, -0.0, 1e-300, -1e300], "near": [1 + k * 2.0**-52 for k in range(900)],
    }
    d = spark.createDataFrame([(k, float(x)) for k, xs in values.items() for x in xs] + [("one", None)], "k string, value double")
    probs = {"_a": 0.0, "_b": 0.01, "_c": 0.5, "_d": 0.99, "_e": 1.0}
    got = {r.k: r for r in sequences.exact_quantiles(d, ["k"], "value", probs, bins=8, most=50).collect()}
    for k, xs in values.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(float(np.quantile(xs, p)), rel=1e-12, abs=1e-12), (k, name)


def test_bins_of_an_outlier_scene_stay_small(spark):
    rows = [(1, 0.05 + k / 10**6) for k in range(20000)] + [(1, 1e12)]
    d = spark.createDataFrame(rows, "scene_id int, _v double")
    found = spark.createDataFrame([(1, "q", "lo", 10000, 20001, 0.0, 1e12, 0)], "scene_id int, q string, side string, rank long, _c long, _lo double, _hi double, _from long")
    counted = sequences._counted(d.withColumn("_bin", F.floor(F.log2("_v"))), ["scene_id"]).collect()
    assert sorted(r._c for r in counted)[0] == 1 and len(counted) == 3
    assert sequences._narrowed(d, found, ["scene_id"], 1024).first()._c == 20000


def plain_closing(on, h, w):
    cross = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
    inside = lambda r, c: 0 <= r < h and 0 <= c < w
    wide = {(r + a, c + b) for r, c in on for a, b in cross if inside(r + a, c + b)}
    return {(r, c) for r, c in wide if all((r + a, c + b) in wide for a, b in cross if inside(r + a, c + b))}


def test_closing_equals_plain_version(spark):
    rng = random.Random(4)
    rows = [(s, r, c, rng.choice([0.9, 0.5, 0.2, 0.1] if s else [0.1])) for s in range(3) for r in range(13) for c in range(9)]
    got = {}
    for r in raster.closed_mask(spark.createDataFrame(rows, "scene_id long, row long, col long, prob double")).collect():
        got.setdefault(r.scene_id, {})[(r.row, r.col)] = r.prob
    given = {(s, r, c): p for s, r, c, p in rows}
    for s in range(3):
        on = {(r, c) for (x, r, c), p in given.items() if x == s and p >= 0.5}
        assert got.get(s, {}) == {(r, c): given[s, r, c] for r, c in plain_closing(on, 13, 9)}


def test_detector_takes_missing_numbers_as_zero(spark):
    rows = [(1, r, c, float("nan") if (r, c) in ((3, 3), (8, 9)) else None if (r, c) == (5, 9) else 5.0 if (r, c) == (6, 6) else 0.1) for r in range(16) for c in range(16)]
    d = spark.createDataFrame(rows, "scene_id long, row long, col long, value double")
    assert [(r.row, r.col) for r in raster.ca_cfar(d).collect()] == [(6, 6)]


def test_every_run_has_a_row_of_evidence(spark):
    runs = spark.createDataFrame([(k, 1, m) for k, m in enumerate("abcd")], "run_id long, scene_id long, mmsi string")
    scenes = spark.createDataFrame([(1, 10_000)], "scene_id long, captured_s long")
    drafts = spark.createDataFrame([("a", 9_000, 1, 9.0), ("a", 11_000, 2, 7.0), ("b", 9_000, 1, 9.0), ("c", 9_000, 1, None)], "mmsi string, ts_s long, seq long, draft_m double")
    vessels = spark.createDataFrame([("d", "Fishing")], "mmsi string, vessel_type string")
    got = {r.mmsi: (r.draft_score, r.draft_reason) for r in tracks.draft_change(runs, scenes, drafts, vessels).collect()}
    few = (0.0, "insufficient_draft_data")
    assert got == {"a": (0.7, "significant_draft_decrease_detected"), "b": few, "c": few, "d": (0.0, "fishing_vessel_excluded")}
    points = spark.createDataFrame([("a", 0), ("a", 60), ("b", 0)], "mmsi string, ts_s long").withColumn("scene_id", F.lit(1).cast("long"))
    windows = spark.createDataFrame([], "scene_id long, mmsi string, flag string, coastal boolean, raw_score double")
    dark = {r.mmsi: (r.dark_score, r.n_gaps, r.dark_reason) for r in tracks.dark_evidence(runs, points, windows).collect()}
    assert dark == {m: (0.0, 0, "no_suspicious_gaps_detected" if m == "a" else "INSUFFICIENT_EVIDENCE") for m in "abcd"}


def test_small_rules_of_ingest(spark, tmp_path):
    cargo = spark.createDataFrame([("Crude_Oil",), ("gasoline",), ("tea",), (None,)], "c string").select(cleaning.oil_type_of_cargo(F.col("c")))
    assert [r[0] for r in cargo.collect()] == ["GENERIC HEAVY CRUDE", "GASOLINE", "GENERIC MEDIUM CRUDE", "GENERIC MEDIUM CRUDE"]
    bad = spark.createDataFrame([("x", 1)], "reject_reason string, utc_s long")
    with pytest.raises(ValueError):
        cleaning.kept(bad, required=True)
    assert cleaning.kept(bad).count() == 0
    path = str(tmp_path / "registry")
    spark.createDataFrame([("1", "cargo")], "mmsi string, vessel_type string").write.parquet(path)
    for _ in range(2):
        tables.upsert_vessels(spark, path, spark.createDataFrame([("1",), ("2",), ("2",)], "mmsi string"))
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("1", "cargo"), ("2", "unknown")]
    once = tracks.assemble_tracks(spark.createDataFrame([("v", 5, 1, 1.0, 2.0), ("v", 5, 2, 3.0, 4.0)], "mmsi string, ts_s long, seq long, lat double, lon double").withColumns({"speed_knots": F.lit(1.0), "course": F.lit(0.0)}))
    assert [(r.n_points, r.track[0].lat) for r in once.collect()] == [(1, 3.0)]


@pytest.mark.parametrize("wanted", [0.1, 1.0, 12.0])
def test_free_temperature_is_found(spark, wanted):
    # each score stands with both truths in the shares that the wanted temperature predicts
    rng = random.Random(6)
    zs = [rng.gauss(0, 2 * wanted) for _ in range(200)]
    share = [1 / (1 + np.exp(-z / wanted)) for z in zs]
    d = spark.createDataFrame([(float(z), float(p)) for z, p in zip(zs, share)], "z double, truth double")
    at, nll = evaluation.best_log_temperature(d)
    assert np.exp(at) == pytest.approx(wanted, abs=1e-6)
    assert nll == pytest.approx(float(np.mean([-(p * np.log(p) + (1 - p) * np.log(1 - p)) for p in share])), abs=1e-9)


def test_free_temperature_without_an_optimum(spark):
    d = spark.createDataFrame([(1.0, 1), (-1.0, 0)], "z double, truth int")
    assert evaluation.best_log_temperature(d)[0] < -2.5
    assert evaluation.best_log_temperature(d.limit(0)) == (0.0, 0.0)


def test_auc_of_saturated_scores_spreads(spark):
    rng = random.Random(11)
    rows = [(k, 1 - rng.random() * 1e-6 if rng.random() < 0.9 else rng.random(), rng.randint(0, 1)) for k in "ab" for _ in range(3000)]
    rows += [("a", 0.5, t) for t in (0, 1, 1, 0)] + [("one", 0.3, 1)]
    preds = spark.createDataFrame(rows, "k string, prob double, truth int")
    got = {r.k: r.auc for r in evaluation.roc_auc(preds, ["k"]).collect()}
    for k in "ab":
        yes, no = [np.array([p for key, p, t in rows if key == k and t == y]) for y in (1, 0)]
        want = ((yes[:, None] > no).sum() + 0.5 * (yes[:, None] == no).sum()) / (len(yes) * len(no))
        assert got[k] == pytest.approx(want, abs=1e-12)
    assert got["one"] == 0.5
    stepped = sequences.value_steps(preds.select("k", "prob").distinct(), ["k"], "prob", "step")
    assert stepped.groupBy("k", "step").count().agg(F.max("count")).first()[0] <= 3 * 3000 / 256
