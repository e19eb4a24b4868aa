"""Capacity, significance, stability, fusion, verdicts, and the flagship attribution."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from wakeline.catalog import Registry
from wakeline.catalog.contacts import WIND_SQL, _km, rings
from wakeline.catalog.sqltext import of_runs, uniform_sql
from wakeline.catalog.tracks import CPA_SQL, DARK_SQL, DRAFT_SQL, LOITER_SQL, PAIRS_SQL, RUN_CPA_SQL, pair_points, run_drift
from wakeline.fixtures import view
from wakeline.operators import scoring as sc
from wakeline.operators import tracks as tr
from wakeline.operators.drift import portable_uniform
from wakeline.plans import attribution as plan
from wakeline.sources.tables import absent_rows

R = Registry()
N_RUNS = 100

TOTAL_SQL = (
    "CAST(round(100 * (CAST(cpa_score AS DECIMAL(9,6)) * 0.20 + CAST(dark_score AS DECIMAL(9,6)) * 0.15 + CAST(loiter_score AS DECIMAL(9,6)) * 0.15 "
    "+ CAST(capacity_multiplier AS DECIMAL(9,6)) * 0.10 + CAST(draft_score AS DECIMAL(9,6)) * 0.10 + CAST(greatest(0e0, 1 - p_value) AS DECIMAL(9,6)) * 0.15 "
    "+ CAST(stability_index AS DECIMAL(9,6)) * 0.15), 2) AS DOUBLE)"
)


def _cap_sql(source: str, fuel: str) -> str:
    return f"""SELECT *, CASE WHEN area_m2 IS NULL OR area_m2 <= 0 THEN 1e0 WHEN litres > 3e9 THEN 0e0 WHEN litres < 100 THEN 1e0 WHEN tons IS NULL THEN 0.5e0
   WHEN litres > 0.05e0 * round(tons * 1000, 1) THEN 0e0 ELSE 1e0 END AS capacity_multiplier,
  CASE WHEN area_m2 IS NULL OR area_m2 <= 0 THEN 'invalid_spill_area' WHEN litres > 3e9 THEN 'NATURAL_SEEP_HYPOTHESIS_volume_exceeds_threshold' WHEN litres < 100 THEN 'tiny_spill_pass_below_100L'
   WHEN tons IS NULL THEN 'missing_dwt_unknown_type_LOW_CONFIDENCE' WHEN litres > 0.05e0 * round(tons * 1000, 1) THEN 'capacity_veto_spill_exceeds_5_percent' ELSE 'capacity_pass' END AS capacity_base
  FROM (SELECT *, round(area_m2 * CASE {fuel} WHEN 'light' THEN 0.0001e0 WHEN 'heavy' THEN 0.001e0 ELSE 0.0005e0 END * 1000, 3) AS litres,
    coalesce(CASE WHEN dwt > 0 THEN dwt END, CASE vessel_type WHEN 'crude_tanker' THEN 300000e0 WHEN 'chemical_tanker' THEN 50000e0 WHEN 'cargo' THEN 80000e0 WHEN 'container' THEN 100000e0 WHEN 'fishing' THEN 500e0 END) AS tons FROM ({source}))"""


@R.query(
    "capacity_veto",
    f"""WITH cap AS ({_cap_sql("SELECT r.run_id, s.area_sq_km * 1e6 AS area_m2, v.dwt, v.vessel_type, s.fuel_type FROM fx_runs r JOIN fx_scenes s USING (scene_id) JOIN fx_vessels v USING (mmsi)", "fuel_type")})
    SELECT run_id, capacity_multiplier, CASE WHEN capacity_multiplier = 0 THEN 0 ELSE 1 END AS capacity_db, CASE WHEN area_m2 > 0 THEN litres ELSE 0e0 END AS spill_litres,
    capacity_base || CASE WHEN area_m2 > 0 AND litres BETWEEN 100 AND 3e9 AND dwt <= 0 THEN ' [negative_dwt_treated_as_none]' ELSE '' END || CASE WHEN area_m2 > 0 AND fuel_type = 'bunker' THEN ' [ESTIMATED_THICKNESS]' ELSE '' END AS capacity_reason FROM cap""",
    whole=True,
)
def _(spark, sf):
    d = view(spark, sf, "fx_runs").join(view(spark, sf, "fx_scenes"), "scene_id").join(view(spark, sf, "fx_vessels"), "mmsi")
    d = sc.capacity_veto(d.withColumn("area_m2", F.col("area_sq_km") * 1e6))
    return d.select("run_id", "capacity_multiplier", F.col("capacity_db").cast("long").alias("capacity_db"), "spill_litres", "capacity_reason")


def _scores(spark, sf):
    """A score per (scene, vessel) run from its order value."""
    o = view(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), "o_totalprice")
    return view(spark, sf, "fx_runs").join(o, "run_id").select(
        "run_id", "scene_id", "mmsi", F.round((F.floor(F.col("o_totalprice") * 100) % 1000) / 1000.0 * F.when(F.col("scene_id") % 9 == 0, 0.2).otherwise(1.0), 4).alias("score")
    )


SCORES_SQL = """scr AS (SELECT r.run_id, r.scene_id, r.mmsi, round((CAST(floor(o_totalprice * 100) AS BIGINT) % 1000) / 1000e0 * CASE WHEN scene_id % 9 = 0 THEN 0.2e0 ELSE 1e0 END, 4) AS score
  FROM fx_runs r JOIN orders o ON o.o_orderkey = r.run_id)"""
PERM_SQL = """permt AS (SELECT scene_id, count(*) AS vessels, min_by(mmsi, (-score, mmsi)) AS top_mmsi, max(score) AS top, count(DISTINCT score) AS nd FROM {src} GROUP BY 1),
permb AS (SELECT p.scene_id, count(*) FILTER (s.score >= p.top) AS m, count(*) AS n, max(s.score) AS bg FROM permt p JOIN {src} s ON s.scene_id = p.scene_id AND s.mmsi <> p.top_mmsi GROUP BY 1),
perm AS (SELECT t.scene_id, vessels, top_mmsi, round(top, 4) AS top_score, CASE WHEN vessels = 1 THEN 0.5e0 WHEN nd = 1 OR top < 0.3 THEN 1e0 ELSE round(1 - pow(1 - m::DOUBLE / n, n), 4) END AS p_value,
  round(CASE WHEN vessels = 1 OR nd = 1 OR top < 0.3 THEN top ELSE bg END, 4) AS baseline_99th,
  CASE WHEN vessels = 1 THEN 'single_suspect' WHEN nd = 1 THEN 'all_scores_identical' WHEN top < 0.3 THEN 'all_scores_low' WHEN 1 - pow(1 - m::DOUBLE / n, n) > 0.05 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'statistically_significant' END AS permutation_reason
  FROM permt t LEFT JOIN permb USING (scene_id))"""


@R.query("permutation_test", f"WITH {SCORES_SQL}, {PERM_SQL.format(src='scr')} SELECT * FROM perm", whole=True)
def _(spark, sf):
    return sc.permutation_test(_scores(spark, sf))


def currents(spark, sf):
    return view(spark, sf, "fx_scenes").select(
        "scene_id", (((F.col("scene_id") * 7) % 20 - 10) / 50.0).alias("cur_u"), (((F.col("scene_id") * 11) % 20 - 10) / 50.0).alias("cur_v")
    )


def inputs(spark, sf) -> plan.Inputs:
    v = {n: view(spark, sf, f"fx_{n}") for n in ("runs", "scenes", "tracks", "vessels", "drift", "drafts")}
    ports = rings(spark, sf).withColumnRenamed("scene_id", "port_id")
    return plan.Inputs(**v, ports=ports, currents=currents(spark, sf))


_U = uniform_sql
CAND_SQL = f"""{WIND_SQL}, cand AS (SELECT p.*, s.captured_s, s.spill_lat, s.spill_lon, coalesce(w.u, 0e0) AS wind_u, coalesce(w.v, 0e0) AS wind_v,
   ((scene_id * 7) % 20 - 10) / 50e0 AS cur_u, ((scene_id * 11) % 20 - 10) / 50e0 AS cur_v
  FROM (SELECT r.scene_id, r.mmsi, min_by(f.ts_s, (f.ts_s, f.seq)) AS release_s, min_by(f.lat, (f.ts_s, f.seq)) AS lat, min_by(f.lon, (f.ts_s, f.seq)) AS lon FROM {of_runs('fx_tracks', 'ts_s', 43200, 0)} GROUP BY 1, 2) p
  JOIN fx_scenes s USING (scene_id) JOIN wind w USING (scene_id))"""


def _sens_sql(cand: str) -> str:
    return f"""weather AS (SELECT run, CASE WHEN run = 0 THEN 1e0 ELSE 0.85e0 + 0.3e0 * {_U(['run'], 42)} END AS wf, radians(CASE WHEN run = 0 THEN 0e0 ELSE -10e0 + 20e0 * {_U(['run'], 43)} END) AS turn
  FROM (SELECT unnest(generate_series(0, {N_RUNS})) AS run)),
drifted AS (SELECT c.scene_id, c.mmsi, w.run, c.lat AS lat0, c.lon AS lon0, captured_s - release_s AS dt, spill_lat, spill_lon,
   cur_u * cos(turn) - cur_v * sin(turn) + 0.035e0 * (wind_u * wf * cos(radians(15)) - wind_v * wf * sin(radians(15))) AS u,
   cur_u * sin(turn) + cur_v * cos(turn) + 0.035e0 * (wind_u * wf * sin(radians(15)) + wind_v * wf * cos(radians(15))) AS v FROM {cand} c, weather w),
runsc AS (SELECT scene_id, mmsi, run, round(greatest(0e0, 1 - {_km('elat', 'elon', 'spill_lat', 'spill_lon')} / 30), 6) AS score
  FROM (SELECT *, lat0 + v * dt / 111320 AS elat, lon0 + u * dt / (111320 * cos(radians(lat0))) AS elon FROM drifted)),
wins AS (SELECT scene_id, run, min_by(mmsi, (-score, mmsi)) AS winner FROM runsc GROUP BY 1, 2),
wc AS (SELECT scene_id, winner, count(*) AS c FROM wins WHERE run > 0 GROUP BY 1, 2)"""


@R.query(
    "sensitivity_test",
    f"""WITH {CAND_SQL}, {_sens_sql('cand')}, base AS (SELECT scene_id, winner AS base_top FROM wins WHERE run = 0), nv AS (SELECT scene_id, count(*) AS n FROM cand GROUP BY 1),
    top2 AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY c DESC, winner) AS rn FROM wc),
    agg AS (SELECT b.scene_id, any_value(base_top) AS base_top, sum(c) AS done, coalesce(sum(c) FILTER (winner = base_top), 0) AS won, max(c) FILTER (rn = 1) AS c1, max(c) FILTER (rn = 2) AS c2 FROM base b JOIN top2 USING (scene_id) GROUP BY 1)
    SELECT scene_id, base_top, CASE WHEN n = 1 THEN 1e0 ELSE round(won::DOUBLE / done::DOUBLE, 4) END AS stability_index, CAST(CASE WHEN n = 1 THEN {N_RUNS} ELSE won END AS BIGINT) AS consistency, CAST(CASE WHEN n = 1 THEN {N_RUNS} ELSE done END AS BIGINT) AS n_runs_completed,
    CASE WHEN n = 1 THEN 'single_vessel_stable' ELSE concat_ws(';', CASE WHEN (c1 + c2)::DOUBLE / done::DOUBLE >= 0.9 AND c1::DOUBLE / done::DOUBLE < 0.85 THEN 'MULTIPLE_CANDIDATES' END,
     CASE WHEN round(won::DOUBLE / done::DOUBLE, 4) < 0.5 THEN 'INCONCLUSIVE' WHEN round(won::DOUBLE / done::DOUBLE, 4) >= 0.9 THEN 'HIGH_STABILITY' END) END AS sensitivity_reason FROM agg JOIN nv USING (scene_id)""",
    whole=True,
)
def _(spark, sf):
    runs = sc.perturbed_scores(plan.candidates(inputs(spark, sf)), N_RUNS, 42, portable_uniform)
    return sc.sensitivity_test(runs, N_RUNS)


_PILL_SQL = f"""{PAIRS_SQL}, {DARK_SQL}, {LOITER_SQL}, {CPA_SQL}, {DRAFT_SQL},
dsc AS (SELECT scene_id, mmsi, round(max(raw), 4) AS dark_score FROM dark GROUP BY 1, 2), lsc AS (SELECT scene_id, mmsi, max(score) AS loiter_score FROM loiter GROUP BY 1, 2),
wide0 AS (SELECT r.run_id, r.scene_id, r.mmsi, c.n_points IS NOT NULL AS has_track, c.min_distance_m, coalesce(c.cpa_score, 0e0) AS cpa_score, coalesce(d.dark_score, 0e0) AS dark_score,
   CASE WHEN v.vessel_type = 'fishing' THEN 0e0 ELSE coalesce(l.loiter_score, 0e0) END AS loiter_score, coalesce(f.draft_score, 0e0) AS draft_score, coalesce(s.area_sq_km * 1e6, 10000e0) AS area_m2, v.dwt, coalesce(v.vessel_type, 'unknown') AS vessel_type
  FROM fx_runs r JOIN fx_scenes s USING (scene_id) LEFT JOIN cpa c USING (scene_id, mmsi) LEFT JOIN dsc d USING (scene_id, mmsi) LEFT JOIN lsc l USING (scene_id, mmsi) LEFT JOIN draft f USING (scene_id, mmsi) LEFT JOIN fx_vessels v USING (mmsi)),
wide AS (SELECT *, round((cpa_score + dark_score + loiter_score + draft_score) / 4, 6) AS score FROM ({_cap_sql('SELECT * FROM wide0', "'medium'")})),
inplay AS (SELECT scene_id, mmsi, max(score) AS score FROM wide WHERE has_track AND capacity_multiplier <> 0 GROUP BY 1, 2)"""
_FINAL = f"""WITH {_PILL_SQL}, {PERM_SQL.format(src='inplay')}, {CAND_SQL}, cin AS (SELECT c.* FROM cand c SEMI JOIN inplay USING (scene_id, mmsi)), {_sens_sql('cin')},
sh AS (SELECT w.scene_id, w.winner AS mmsi, round(c::DOUBLE / n, 4) AS stab FROM wc w JOIN (SELECT scene_id, count(*) AS n FROM wins WHERE run > 0 GROUP BY 1) USING (scene_id)),
j AS (SELECT w.*, CASE WHEN capacity_multiplier = 0 THEN 1e0 ELSE coalesce(p.p_value, 1e0) END AS p_value, CASE WHEN capacity_multiplier = 0 THEN 0e0 ELSE coalesce(sh.stab, 0e0) END AS stability_index
  FROM wide w LEFT JOIN perm p ON p.scene_id = w.scene_id AND p.top_mmsi = w.mmsi LEFT JOIN sh ON sh.scene_id = w.scene_id AND sh.mmsi = w.mmsi),
fz AS (SELECT *, capacity_multiplier = 0 AS veto, cpa_score = 0 AND dark_score = 0 AND loiter_score = 0 AND draft_score = 0 AND capacity_multiplier = 0 AND p_value = 1 AND stability_index = 0 AS nothing,
  {TOTAL_SQL} AS t FROM j),
tot AS (SELECT *, CASE WHEN veto OR nothing OR NOT has_track THEN 0e0 ELSE t END AS total_score, CASE WHEN veto OR nothing THEN 0e0 ELSE round(1 / (1 + exp(5 - 2 * t / 100 * 5)), 4) END AS cal FROM fz),
vd AS (SELECT *, CASE WHEN NOT has_track THEN 'no_track_or_drift_data' WHEN veto THEN 'capacity_veto' WHEN nothing THEN 'all_pillars_zero' WHEN p_value > 0.05 THEN 'H0_null_hypothesis_accepted'
  WHEN p_value < 0.01 AND cal >= 0.8 AND stability_index >= 0.9 THEN 'tier1_prosecutable' WHEN p_value < 0.05 AND cal >= 0.6 THEN 'tier2_person_of_interest' ELSE 'tier3_insufficient_evidence' END AS verdict_reason FROM tot)
SELECT run_id, scene_id, mmsi, cpa_score, dark_score, loiter_score, capacity_multiplier, draft_score, p_value, stability_index, total_score, CASE WHEN has_track THEN cal ELSE 0e0 END AS calibrated_score, verdict_reason,
  CASE verdict_reason WHEN 'tier1_prosecutable' THEN 'PROSECUTABLE' WHEN 'tier2_person_of_interest' THEN 'PERSON_OF_INTEREST' ELSE 'INSUFFICIENT_EVIDENCE' END AS verdict"""


def attributed(spark, sf):
    return plan.attribute_all(inputs(spark, sf), N_RUNS, 42, portable_uniform)


VERDICT_COLUMNS = (
    "run_id", "scene_id", "mmsi", "cpa_score", "dark_score", "loiter_score", "capacity_multiplier", "draft_score", "p_value",
    "stability_index", "total_score", "calibrated_score", "verdict_reason", "verdict",
)


@R.query("attribute_all", f"{_FINAL} FROM vd", whole=True)
def _(spark, sf):
    return attributed(spark, sf).select(*VERDICT_COLUMNS)


_RUNS_FINAL = (
    _FINAL.replace(CPA_SQL, f"{RUN_CPA_SQL}, rcpa AS (SELECT scene_id AS run_id, n_points, min_distance_m, cpa_score FROM cpa)")
    .replace("c.n_points IS NOT NULL AS has_track", "c.n_points IS NOT NULL AND r.run_id IN (SELECT run_id FROM fx_run_drift) AS has_track")
    .replace("FROM fx_runs r JOIN fx_scenes s USING (scene_id) LEFT JOIN cpa c USING (scene_id, mmsi)", "FROM (SELECT * FROM fx_sims WHERE spill_id IS NOT NULL) r JOIN fx_scenes s USING (scene_id) LEFT JOIN rcpa c USING (run_id)")
)


@R.query(
    "attribute_runs",
    f"""{_RUNS_FINAL} FROM vd UNION ALL SELECT run_id, scene_id, mmsi, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0e0, 0e0, 'no_spill_linked', 'INSUFFICIENT_EVIDENCE' FROM fx_sims WHERE spill_id IS NULL""",
)
def _(spark, sf):
    """Every run by its own stored simulation."""
    i = replace(inputs(spark, sf), runs=view(spark, sf, "fx_sims"), drift=run_drift(spark, sf))
    return plan.attribute_all(i, N_RUNS, 42, portable_uniform).select(*VERDICT_COLUMNS)


def _pillar_like(spark, sf):
    """Pillar columns for the fusion queries, from each run's order."""
    o = view(spark, sf, "orders")
    cents = F.floor(F.col("o_totalprice") * 100).cast("long")

    def part(k: int, top: float = 1.0):
        return F.round((F.floor(cents / k) % 1000) / 1000.0 * top, 4)

    d = o.select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 97).alias("scene_id"), F.lpad((F.col("o_orderkey") + 100000000).cast("string"), 9, "0").alias("mmsi"),
        part(1).alias("cpa_score"), part(7).alias("dark_score"), part(11, 0.4).alias("loiter_score"), part(13, 0.8).alias("draft_score"),
        F.when(cents % 17 == 0, 0.0).when(cents % 5 == 0, 0.5).otherwise(1.0).alias("capacity_multiplier"),
        F.round((F.floor(cents / 19) % 100) / 1000.0, 4).alias("p_value"), part(3).alias("stability_index"),
    )
    return d


PILLAR_SQL = f"""pl AS (SELECT run_id, scene_id, mmsi, round((c % 1000) / 1000e0, 4) AS cpa_score, round((CAST(floor(c / 7e0) AS BIGINT) % 1000) / 1000e0, 4) AS dark_score, round((CAST(floor(c / 11e0) AS BIGINT) % 1000) / 1000e0 * 0.4e0, 4) AS loiter_score,
   round((CAST(floor(c / 13e0) AS BIGINT) % 1000) / 1000e0 * 0.8e0, 4) AS draft_score, CASE WHEN c % 17 = 0 THEN 0e0 WHEN c % 5 = 0 THEN 0.5e0 ELSE 1e0 END AS capacity_multiplier,
   round((CAST(floor(c / 19e0) AS BIGINT) % 100) / 1000e0, 4) AS p_value, round((CAST(floor(c / 3e0) AS BIGINT) % 1000) / 1000e0, 4) AS stability_index
  FROM (SELECT o_orderkey AS run_id, o_custkey % 97 AS scene_id, lpad(CAST(o_orderkey + 100000000 AS VARCHAR), 9, '0') AS mmsi, CAST(floor(o_totalprice * 100) AS BIGINT) AS c FROM orders)),
fu AS (SELECT *, CASE WHEN capacity_multiplier = 0 THEN 0e0 ELSE {TOTAL_SQL} END AS t FROM pl)"""


@R.query("fuse_scores", f"WITH {PILLAR_SQL} SELECT run_id, t AS total_score, CASE WHEN capacity_multiplier = 0 THEN 'capacity_veto' ELSE 'fused_attribution' END AS fusion_reason FROM fu")
def _(spark, sf):
    return sc.fuse(_pillar_like(spark, sf)).select("run_id", "total_score", "fusion_reason")


@R.query("platt_calibration", f"WITH {PILLAR_SQL} SELECT run_id, round(1 / (1 + exp(5 - 10 * cpa_score)), 4) AS calibrated, 0e0 AS of_null, 1e0 AS of_huge FROM pl")
def _(spark, sf):
    d = _pillar_like(spark, sf)
    return d.select("run_id", sc.platt(F.col("cpa_score") * 5).alias("calibrated"), sc.platt(F.lit(None).cast("double")).alias("of_null"), sc.platt(F.col("cpa_score") + 1000).alias("of_huge"))


@R.query(
    "classify_verdict",
    f"""WITH {PILLAR_SQL} SELECT run_id, CASE WHEN capacity_multiplier = 0 THEN 'capacity_veto' WHEN run_id % 50 = 0 THEN 'invalid_score' WHEN p_value > 0.05 THEN 'H0_null_hypothesis_accepted' WHEN p_value < 0.01 AND s >= 0.8 AND stability_index >= 0.9 THEN 'tier1_prosecutable'
     WHEN p_value < 0.05 AND s >= 0.6 THEN 'tier2_person_of_interest' ELSE 'tier3_insufficient_evidence' END || CASE WHEN capacity_multiplier <> 0 AND run_id % 50 <> 0 AND s > 1 THEN ' [score_clamped_to_1.0]' ELSE '' END AS verdict_reason
    FROM (SELECT *, cpa_score * 1.2e0 AS s FROM pl)""",
)
def _(spark, sf):
    d = _pillar_like(spark, sf).withColumns(
        {
            "calibrated_score": F.when(F.col("run_id") % 50 == 0, None).otherwise(F.col("cpa_score") * 1.2),
            "fusion_reason": F.when(F.col("capacity_multiplier") == 0, "capacity_veto").otherwise("fused_attribution"),
        }
    )
    return sc.verdict(d).select("run_id", "verdict_reason")


@R.query("rank_candidates", f"WITH {SCORES_SQL} SELECT run_id, scene_id, mmsi, score AS forward_score, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, mmsi) AS rank FROM scr WHERE score > 0", whole=True)
def _(spark, sf):
    return sc.rank_candidates(_scores(spark, sf).withColumnRenamed("score", "forward_score"))


@R.query(
    "classify_outcome",
    f"""WITH {SCORES_SQL}, r AS (SELECT scene_id, score, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, mmsi) AS rn FROM scr WHERE score > 0),
    t AS (SELECT scene_id, max(score) FILTER (rn = 1) AS top, max(score) FILTER (rn = 2) AS second FROM r GROUP BY 1)
    SELECT s.scene_id, top, second, CASE WHEN top IS NULL OR top < 0.4 THEN 'INSUFFICIENT' WHEN top - second < 0.1 THEN 'INCONCLUSIVE' ELSE 'STRONG' END AS outcome FROM fx_scenes s LEFT JOIN t USING (scene_id)""",
    whole=True,
)
def _(spark, sf):
    r = sc.rank_candidates(_scores(spark, sf).withColumnRenamed("score", "forward_score"))
    return sc.classify_outcome(r, view(spark, sf, "fx_scenes"))


RANK_SQL = """rk AS (SELECT *, CASE WHEN capacity_multiplier <> 0 THEN row_number() OVER (PARTITION BY scene_id, capacity_multiplier = 0 ORDER BY t DESC, dark_score DESC, loiter_score DESC, p_value, mmsi) END AS rank FROM fu)"""


def _ranked(spark, sf):
    return sc.rank_verdicts(sc.fuse(_pillar_like(spark, sf)))


@R.query("rank_verdicts", f"WITH {PILLAR_SQL}, {RANK_SQL} SELECT run_id, scene_id, t AS total_score, rank FROM rk")
def _(spark, sf):
    return _ranked(spark, sf).select("run_id", "scene_id", "total_score", "rank")


@R.query(
    "score_rows",
    f"""WITH {PILLAR_SQL} SELECT run_id AS drift_run_id, 'v1' AS scoring_version, CAST(CAST(cpa_score AS DECIMAL(4,3)) AS DOUBLE) AS cpa_score, CAST(CAST(p_value AS DECIMAL(6,5)) AS DOUBLE) AS permutation_p_value,
    CAST(CAST(t AS DECIMAL(5,2)) AS DOUBLE) AS total_score, 'insufficient_evidence' AS verdict, '{{"capacity_reason":"m' || CAST(CAST(capacity_multiplier * 10 AS INTEGER) AS VARCHAR) || '","verdict_reason":"v"}}' AS explanation FROM fu""",
)
def _(spark, sf):
    d = _ranked(spark, sf).withColumns(
        {
            "capacity_db": F.lit(1), "verdict_reason": F.lit("v"), "verdict": F.lit("INSUFFICIENT_EVIDENCE"),
            "capacity_reason": F.concat(F.lit("m"), (F.col("capacity_multiplier") * 10).cast("int").cast("string")),
        }
    )
    r = sc.score_rows(d, "v1")
    return r.select("drift_run_id", "scoring_version", *[F.col(c).cast("double").alias(c) for c in ("cpa_score", "permutation_p_value", "total_score")], "verdict", "explanation")


@R.query(
    "cpa_events",
    f"WITH {PAIRS_SQL}, {CPA_SQL} SELECT scene_id, mmsi, cpa_s, CAST(CAST(CAST(CAST(min_distance_m AS VARCHAR) AS DECIMAL(12,3)) AS DECIMAL(10,2)) AS DOUBLE) AS min_distance_m, CAST(tcpa_seconds AS DOUBLE) AS tcpa_seconds FROM cpa WHERE min_distance_m IS NOT NULL",
    whole=True,
)
def _(spark, sf):
    d = sc.cpa_events(tr.closest_approach(pair_points(spark, sf), view(spark, sf, "fx_drift")))
    return d.select("scene_id", "mmsi", "cpa_s", F.col("min_distance_m").cast("double").alias("min_distance_m"), F.col("tcpa_seconds").cast("double").alias("tcpa_seconds"))


def _stored_scores(spark, sf):
    return view(spark, sf, "orders").select(
        F.col("o_orderkey").alias("score_id"), F.col("o_custkey").alias("drift_run_id"), F.col("o_orderpriority").alias("scoring_version"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("calculated_s"), F.round(F.col("o_totalprice") % 100, 2).alias("total_score"),
    )


_STORED = "st AS (SELECT o_orderkey AS score_id, o_custkey AS drift_run_id, o_orderpriority AS scoring_version, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS calculated_s, round(o_totalprice % 100, 2) AS total_score FROM orders)"


@R.query("latest_scores", f"WITH {_STORED} SELECT score_id, drift_run_id, scoring_version, calculated_s, total_score FROM st QUALIFY row_number() OVER (PARTITION BY drift_run_id ORDER BY calculated_s DESC, score_id DESC) = 1")
def _(spark, sf):
    return sc.latest_scores(_stored_scores(spark, sf))


@R.query("score_history", f"WITH {_STORED} SELECT * FROM st WHERE drift_run_id = 7 ORDER BY calculated_s DESC")
def _(spark, sf):
    return sc.score_history(_stored_scores(spark, sf), 7)


@R.query("score_per_version_once", f"WITH {_STORED} SELECT drift_run_id, scoring_version, min(score_id) AS score_id FROM st WHERE (drift_run_id, scoring_version) NOT IN (SELECT DISTINCT drift_run_id, scoring_version FROM st WHERE calculated_s < 820454400) GROUP BY 1, 2")
def _(spark, sf):
    s = _stored_scores(spark, sf)
    old = s.filter("calculated_s < 820454400")
    return absent_rows(old, s.select("drift_run_id", "scoring_version", "score_id"), ["drift_run_id", "scoring_version"], "score_id")


@R.query(
    "evidence_bullets",
    f"""WITH {PILLAR_SQL}, {RANK_SQL}, b AS (SELECT scene_id, max(t) FILTER (rank = 1) AS t1, max(t) FILTER (rank = 2) AS t2 FROM rk GROUP BY 1),
    k AS (SELECT *, (CAST(floor(cpa_score * 1000 + 0.5) AS BIGINT) % 200) AS tenth FROM rk)
    SELECT run_id, rank, 2 + CASE WHEN dark_score > 0 THEN 1 ELSE 0 END + CASE WHEN loiter_score > 0 THEN 1 ELSE 0 END + CASE WHEN draft_score > 0 THEN 1 ELSE 0 END AS n_bullets,
    CASE WHEN tenth <= 50 THEN '✅' ELSE '❌' END || ' Proximity: closest approach ' || CAST(CAST(tenth // 10 AS BIGINT) AS VARCHAR) || '.' || CAST(CAST(tenth % 10 AS BIGINT) AS VARCHAR) || ' km from the drifting slick.' AS first_bullet,
    CASE WHEN t1 - t2 <= 0.05 * t1 THEN 'AMBIGUOUS_EVIDENCE' ELSE 'CLEAR_RANKING' END AS scene_note FROM k LEFT JOIN b USING (scene_id)""",
)
def _(spark, sf):
    tenth = F.floor(F.col("cpa_score") * 1000 + 0.5).cast("long") % 200
    d = _ranked(spark, sf).withColumns({"min_distance_m": (tenth * 100).cast("double"), "capacity_reason": F.lit("capacity_pass")})
    e = sc.evidence_bullets(d)
    return e.select("run_id", "rank", F.size("bullets").cast("long").alias("n_bullets"), F.col("bullets")[0].alias("first_bullet"), "scene_note")


@R.query("dark_scenarios", "SELECT scene_id, spill_lat, spill_lon, 'DARK_VESSEL_SCENARIO' AS scene_note FROM fx_scenes WHERE scene_id NOT IN (SELECT scene_id FROM fx_runs)")
def _(spark, sf):
    return sc.dark_scenarios(view(spark, sf, "fx_scenes"), view(spark, sf, "fx_runs"))
