"""Track-sequence queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.catalog import Registry
from wakeline.catalog.sqltext import DED_SQL, GAPS_SQL, geodesic_sql, hav_sql, of_runs
from wakeline.fixtures import view
from wakeline.functions.geo import with_geodesic
from wakeline.operators import tracks as op
from wakeline.operators.contacts import points_in_rings, rings_of
from wakeline.operators.sequences import neighbours
from wakeline.operators.windows import steps_of_runs
from wakeline.sources.drift import run_positions, run_summaries

R = Registry()


def deduped(spark, sf, name="fx_tracks") -> DataFrame:
    return op.dedupe_track(view(spark, sf, name))


def pair_points(spark, sf, ports: bool = False) -> DataFrame:
    """Deduplicated positions of every (scene, vessel) run within six hours of the scene, with their neighbours."""
    scenes, t = view(spark, sf, "fx_scenes"), deduped(spark, sf)
    if ports:
        t = with_ports(spark, sf, t)
    p = steps_of_runs(view(spark, sf, "fx_runs"), scenes, neighbours(t, ["mmsi"], "ts_s", ["lat", "lon", "speed_knots"]))
    return p.join(scenes.select("scene_id", "spill_lat", "spill_lon"), "scene_id")


def with_ports(spark, sf, points: DataFrame) -> DataFrame:
    """Flag points inside a port polygon; the slick squares stand in for ports here."""
    rings = rings_of(view(spark, sf, "fx_spill_vertices"), "scene_id").withColumnRenamed("scene_id", "port_id")
    t = deduped(spark, sf).select("mmsi", "ts_s", "lat", "lon")
    inside = points_in_rings(t, rings, "port_id").select("mmsi", "ts_s").distinct().withColumn("_in", F.lit(True))
    return points.join(inside, ["mmsi", "ts_s"], "left").withColumn("in_port", F.coalesce("_in", F.lit(False))).drop("_in")


# Points of a run with neighbours, as SQL.
PAIRS_SQL = f"""{DED_SQL}, pts AS (SELECT r.run_id, r.scene_id, r.mmsi, s.captured_s, s.spill_lat, s.spill_lon, f.ts_s, f.seq, f.lat, f.lon, f.speed_knots, f.course
  FROM {of_runs('ded', 'ts_s', 21600, 21600)}),
seqd AS (SELECT *, lag(ts_s) OVER w AS p_s, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(speed_knots) OVER w AS p_speed, lead(ts_s) OVER w AS n_s
  FROM pts WINDOW w AS (PARTITION BY scene_id, mmsi ORDER BY ts_s))"""

_HOPS = geodesic_sql("(SELECT *, (p_lat + lat) / 2 AS mid_lat, (p_lon + lon) / 2 AS mid_lon FROM seqd WHERE ts_s - p_s >= 600)", "p_lat", "p_lon", "lat", "lon", "hop_m")
DARK_SQL = f"""hops AS ({geodesic_sql(f'({_HOPS})', 'spill_lat', 'spill_lon', 'mid_lat', 'mid_lon', 'spill_m')}),
dark AS (SELECT *, CASE WHEN ts_s - p_s > 86400 OR nm > 50 THEN 0e0 WHEN captured_s BETWEEN p_s AND ts_s THEN least(1e0, base * 1.2) ELSE base END AS raw,
   CASE WHEN ts_s - p_s > 86400 THEN 'PERMANENT_BLACKOUT' WHEN nm > 50 THEN 'EXCLUDED_BEYOND_50NM' WHEN kn > 30 THEN 'AIS_SPOOFING_SUSPECTED' END AS flag
 FROM (SELECT *, least(1e0, (ts_s - p_s) / 3600e0) * greatest(0e0, 1 - nm / 50) * CASE WHEN kn > 30 THEN 0.5e0 ELSE 1e0 END AS base
  FROM (SELECT *, spill_m / 1852 AS nm, (hop_m / 1852) / ((ts_s - p_s) / 3600e0) AS kn FROM hops)))"""


@R.query("dedupe_track", f"WITH {DED_SQL} SELECT mmsi, ts_s, seq, lat, lon FROM ded")
def _(spark, sf):
    return deduped(spark, sf).select("mmsi", "ts_s", "seq", "lat", "lon")


@R.query("ais_gaps", f"WITH {DED_SQL}, {GAPS_SQL} SELECT mmsi, gap_start_s, gap_end_s, duration_min, p_lat AS start_lat, p_lon AS start_lon, lat AS end_lat, lon AS end_lon, jump_km FROM gaps")
def _(spark, sf):
    return op.ais_gaps(deduped(spark, sf))


@R.query(
    "geodesic_hops",
    f"""WITH {DED_SQL}, hops AS ({geodesic_sql("(SELECT * FROM (SELECT *, lead(lat) OVER w AS n_lat, lead(lon) OVER w AS n_lon FROM ded WINDOW w AS (PARTITION BY mmsi ORDER BY ts_s)) WHERE n_lat IS NOT NULL)", 'lat', 'lon', 'n_lat', 'n_lon', 'm', 'az')})
    SELECT mmsi, ts_s, round(m, 3) AS metres, round(az, 4) AS azimuth FROM hops""",
)
def _(spark, sf):
    t = neighbours(deduped(spark, sf).select("mmsi", "ts_s", "lat", "lon"), ["mmsi"], "ts_s", ["lat", "lon"])
    t = t.filter("next is not null").select("mmsi", "ts_s", "lat", "lon", F.col("next.lat").alias("n_lat"), F.col("next.lon").alias("n_lon"))
    d = with_geodesic(t, "lat", "lon", "n_lat", "n_lon", "m", "az")
    return d.select("mmsi", "ts_s", F.round("m", 3).alias("metres"), F.round("az", 4).alias("azimuth"))


@R.query(
    "dark_windows",
    f"""WITH {PAIRS_SQL}, {DARK_SQL} SELECT scene_id, mmsi, p_s AS gap_start_s, ts_s AS gap_end_s, round((ts_s - p_s) / 60e0, 1) AS gap_duration_min,
    round(nm, 2) AS distance_to_spill_nm, round(kn, 2) AS speed_knots, flag, round(raw, 4) AS score FROM dark""",
    whole=True,
)
def _(spark, sf):
    d = op.dark_windows(pair_points(spark, sf))
    return d.select("scene_id", "mmsi", "gap_start_s", "gap_end_s", "gap_duration_min", "distance_to_spill_nm", "speed_knots", "flag", "score")


@R.query(
    "dark_evidence",
    f"""WITH {PAIRS_SQL}, {DARK_SQL}, ds AS (SELECT scene_id, mmsi, round(max(raw), 4) AS s, count(*) AS n_gaps, concat_ws('; ', CASE WHEN count(*) FILTER (flag = 'AIS_SPOOFING_SUSPECTED') > 0 THEN 'AIS_SPOOFING_SUSPECTED_speed_jump' END,
      CASE WHEN count(*) FILTER (flag = 'PERMANENT_BLACKOUT') > 0 THEN 'PERMANENT_BLACKOUT_gap_exceeds_24h' END) AS notes FROM dark GROUP BY 1, 2),
    np AS (SELECT scene_id, mmsi, count(*) AS n FROM pts GROUP BY 1, 2)
    SELECT r.scene_id, r.mmsi, coalesce(s, 0e0) AS dark_score, coalesce(n_gaps, 0) AS n_gaps, CASE WHEN coalesce(n, 0) < 2 THEN 'INSUFFICIENT_EVIDENCE'
      WHEN s > 0 THEN 'dark_vessel_anomaly_detected (max_gap_score=' || printf('%.4f', s) || ')' || CASE WHEN notes = '' THEN '' ELSE ' [' || notes || ']' END
      WHEN coalesce(notes, '') = '' THEN 'no_suspicious_gaps_detected' ELSE notes END AS dark_reason
    FROM (SELECT DISTINCT scene_id, mmsi FROM fx_runs) r LEFT JOIN np USING (scene_id, mmsi) LEFT JOIN ds USING (scene_id, mmsi)""",
)
def _(spark, sf):
    p = pair_points(spark, sf)
    return op.dark_evidence(view(spark, sf, "fx_runs"), p, op.dark_windows(p))


@R.query(
    "dark_scores",
    f"""WITH {PAIRS_SQL}, {DARK_SQL} SELECT scene_id, mmsi, round(max(raw), 4) AS dark_score, count(*) AS n_gaps,
    CASE WHEN count(*) FILTER (flag = 'AIS_SPOOFING_SUSPECTED') > 0 THEN 'AIS_SPOOFING_SUSPECTED_speed_jump' ELSE '' END AS dark_notes FROM dark GROUP BY 1, 2""",
    whole=True,
)
def _(spark, sf):
    return op.dark_scores(op.dark_windows(pair_points(spark, sf))).drop("n_scored")


@R.query(
    "permanent_blackouts",
    f"""WITH ded AS (SELECT mmsi, ts_s, max_by(lat, seq) AS lat, max_by(lon, seq) AS lon FROM fx_tracks_raw GROUP BY 1, 2)
    SELECT mmsi, p_s AS gap_start_s, ts_s AS gap_end_s, {hav_sql('p_lat', 'p_lon', 'lat', 'lon')} AS jump_km
    FROM (SELECT *, lag(ts_s) OVER w AS p_s, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM ded WINDOW w AS (PARTITION BY mmsi ORDER BY ts_s)) WHERE ts_s - p_s > 86400""",
)
def _(spark, sf):
    return op.ais_gaps(deduped(spark, sf, "fx_tracks_raw"), max_gap_s=86400).select("mmsi", "gap_start_s", "gap_end_s", "jump_km")


_HOLED = "(SELECT mmsi, ts_s, lat, lon, CASE WHEN seq % 4 <> 0 THEN speed_knots END AS sp, CASE WHEN seq % 6 <> 0 THEN course END AS co FROM ded)"
_LEGS = f"""(SELECT *, CASE WHEN n_s IS NULL THEN p_lat ELSE lat END AS a_lat, CASE WHEN n_s IS NULL THEN p_lon ELSE lon END AS a_lon, CASE WHEN n_s IS NULL THEN p_s ELSE ts_s END AS a_s,
   CASE WHEN n_s IS NULL THEN lat ELSE n_lat END AS b_lat, CASE WHEN n_s IS NULL THEN lon ELSE n_lon END AS b_lon, coalesce(n_s, ts_s) AS b_s
  FROM (SELECT *, lead(ts_s) OVER w AS n_s, lead(lat) OVER w AS n_lat, lead(lon) OVER w AS n_lon, lag(ts_s) OVER w AS p_s, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon,
    lag(sp) OVER w AS p_sp, lag(co) OVER w AS p_co FROM {_HOLED} WINDOW w AS (PARTITION BY mmsi ORDER BY ts_s)))"""


@R.query(
    "derive_sog_cog",
    f"""WITH {DED_SQL}, legs AS ({geodesic_sql(_LEGS, 'a_lat', 'a_lon', 'b_lat', 'b_lon', 'm', 'az')}), v AS (SELECT *, (m / 1852) / ((b_s - a_s) / 3600e0) AS made FROM legs)
    SELECT mmsi, ts_s, round(CASE WHEN sp IS NOT NULL THEN sp WHEN n_s IS NOT NULL THEN made WHEN p_s IS NULL THEN 0 ELSE coalesce(p_sp, made) END, 4) AS speed_knots,
    round(CASE WHEN sp IS NOT NULL THEN co WHEN n_s IS NOT NULL THEN coalesce(co, az) WHEN p_s IS NULL THEN co ELSE coalesce(p_co, CASE WHEN p_sp IS NULL THEN az END) END, 3) AS course FROM v""",
)
def _(spark, sf):
    t = deduped(spark, sf).select(
        "mmsi", "ts_s", "lat", "lon", F.when(F.col("seq") % 4 != 0, F.col("speed_knots")).alias("speed_knots"),
        F.when(F.col("seq") % 6 != 0, F.col("course")).alias("course"),
    )
    d = op.derive_sog_cog(t)
    return d.select("mmsi", "ts_s", F.round("speed_knots", 4).alias("speed_knots"), F.round("course", 3).alias("course"))


def episodes(spark, sf):
    return op.loitering_episodes(pair_points(spark, sf, ports=True))


# The slick squares are axis-aligned, so "inside" is a pair of range tests.
LOITER_SQL = """
inport AS (SELECT DISTINCT d.mmsi, d.ts_s FROM ded d JOIN fx_scenes z ON d.lat > z.spill_lat - 0.0201e0 AND d.lat <= z.spill_lat + 0.0201e0 AND d.lon >= z.spill_lon - 0.0201e0 AND d.lon < z.spill_lon + 0.0201e0),
marks AS (SELECT q.*, q.speed_knots < 5 AS slow,
   q.speed_knots < 5 AND (q.p_s IS NULL OR q.p_speed >= 5) AS begins,
   q.speed_knots < 5 AND i.mmsi IS NULL AND q.n_s IS NOT NULL AND abs(q.ts_s - q.captured_s) <= 21600 AS may
  FROM seqd q LEFT JOIN inport i ON i.mmsi = q.mmsi AND i.ts_s = q.ts_s),
isl AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY scene_id, mmsi ORDER BY ts_s) AS island FROM marks),
st AS (SELECT scene_id, mmsi, island, min(ts_s) FILTER (may) AS start_s FROM isl WHERE slow GROUP BY ALL HAVING min(ts_s) FILTER (may) IS NOT NULL),
ep AS (SELECT i.scene_id, i.mmsi, i.island, s.start_s, max(i.ts_s) AS end_s, avg(i.speed_knots) AS avg_slow, min(i.speed_knots) AS min_slow, list(i.course) AS cs
  FROM isl i JOIN st s USING (scene_id, mmsi, island) WHERE i.slow AND i.ts_s >= s.start_s GROUP BY ALL),
turn AS (SELECT *, (SELECT max(least(abs(a - b) % 360, 360 - abs(a - b) % 360)) FROM unnest(cs) x(a), unnest(cs) y(b)) AS max_turn FROM ep WHERE end_s - start_s >= 1800),
cruise AS (SELECT t.*, (SELECT max(p.speed_knots) FROM pts p WHERE p.scene_id = t.scene_id AND p.mmsi = t.mmsi AND p.ts_s < t.start_s AND p.ts_s >= t.start_s - 3600) AS prev_max FROM turn t),
loiter AS (SELECT scene_id, mmsi, start_s, end_s, round((end_s - start_s) / 60e0, 1) AS duration_min, round(prev_max, 1) AS initial_speed_knots, round(min_slow, 1) AS min_speed_knots,
  CASE WHEN max_turn >= 60 THEN 'true' ELSE 'false' END AS course_boost,
  round(least(0.4e0, CASE WHEN end_s - start_s >= 3600 THEN 0.35e0 ELSE 0.3e0 END * CASE WHEN max_turn >= 60 THEN 1.2e0 ELSE 1e0 END), 3) AS score
  FROM cruise WHERE (prev_max > 0 AND (prev_max - avg_slow) / prev_max >= 0.5) OR prev_max >= 10)"""


@R.query("loitering_episodes", f"WITH {PAIRS_SQL}, {LOITER_SQL} SELECT * FROM loiter", whole=True)
def _(spark, sf):
    return episodes(spark, sf).withColumn("course_boost", F.col("course_boost").cast("string"))


@R.query("loitering_scores", f"WITH {PAIRS_SQL}, {LOITER_SQL} SELECT scene_id, mmsi, max(score) AS loiter_score, count(*) AS n_episodes FROM loiter GROUP BY ALL", whole=True)
def _(spark, sf):
    return op.loitering_scores(episodes(spark, sf))


ANOMALY_SQL = f"""latest AS (SELECT mmsi, max_by(speed_knots, (ts_s, seq)) AS speed_knots FROM fx_tracks GROUP BY mmsi),
anomaly AS (SELECT v.mmsi, least(100e0, CASE WHEN s > 1 AND s <= 5.5 THEN 35e0 WHEN s <= 1 THEN 15e0 ELSE 0e0 END + CASE WHEN g.n > 0 THEN 40e0 ELSE 0e0 END
  + CASE WHEN vessel_type LIKE '%tanker%' THEN 30e0 WHEN vessel_type = 'cargo' THEN 10e0 ELSE 0e0 END) AS anomaly_score,
  concat_ws(';', CASE WHEN s > 1 AND s <= 5.5 THEN 'SLOW_TRANSIT_ANOMALY' WHEN s <= 1 THEN 'DRIFTING_OR_ANCHORED' END, CASE WHEN g.n > 0 THEN 'TRANSPONDER_BLACKOUT_DETECTED' END,
  CASE WHEN vessel_type LIKE '%tanker%' THEN 'HIGH_RISK_CARGO_CATEGORY' WHEN vessel_type = 'cargo' THEN 'COMMERCIAL_CARGO_CATEGORY' END) AS flags,
  coalesce(g.n, 0) AS n_gaps, round(coalesce(g.minutes, 0), 1) AS gap_minutes
  FROM (SELECT v.*, coalesce(l.speed_knots, 10e0) AS s FROM fx_vessels v LEFT JOIN latest l USING (mmsi)) v
  LEFT JOIN (SELECT mmsi, count(*) AS n, sum(duration_min) AS minutes FROM gaps GROUP BY mmsi) g USING (mmsi))"""


def anomalies(spark, sf):
    v = view(spark, sf, "fx_vessels").join(op.latest_positions(view(spark, sf, "fx_tracks")).select("mmsi", "speed_knots"), "mmsi", "left")
    return op.behaviour_anomaly(v, op.ais_gaps(deduped(spark, sf)))


@R.query("behaviour_anomaly", f"WITH {DED_SQL}, {GAPS_SQL}, {ANOMALY_SQL} SELECT * FROM anomaly", whole=True)
def _(spark, sf):
    d = anomalies(spark, sf)
    return d.withColumn("flags", F.concat_ws(";", "flags")).withColumn("gap_minutes", F.round("gap_minutes", 1))


@R.query(
    "assemble_tracks",
    f"""WITH {DED_SQL} SELECT mmsi, CAST(floor(ts_s / 86400e0) AS BIGINT) AS chunk, count(*) AS n_points,
    string_agg(CAST(ts_s AS VARCHAR) || '@' || CAST(CAST(round(lat * 10000) AS BIGINT) AS VARCHAR), ' ' ORDER BY ts_s, lat, lon) AS track FROM ded GROUP BY 1, 2""",
)
def _(spark, sf):
    d = op.assemble_tracks(view(spark, sf, "fx_tracks"))
    text = F.transform("track", lambda p: F.concat(p["ts_s"].cast("string"), F.lit("@"), F.round(p["lat"] * 10000).cast("long").cast("string")))
    return d.select("mmsi", "chunk", F.col("n_points").cast("long").alias("n_points"), F.array_join(text, " ").alias("track"))


@R.query(
    "latest_positions",
    """SELECT mmsi, count(*) AS n_points, max(ts_s) AS ts_s, max_by(lat, (ts_s, seq)) AS lat, max_by(lon, (ts_s, seq)) AS lon,
    max_by(speed_knots, (ts_s, seq)) AS speed_knots, max_by(course, (ts_s, seq)) AS course FROM fx_tracks GROUP BY mmsi""",
)
def _(spark, sf):
    return op.latest_positions(view(spark, sf, "fx_tracks"))


def static_messages(spark, sf):
    t = deduped(spark, sf)
    k = F.col("seq")
    return t.select(
        "mmsi", "ts_s", F.when(k % 5 == 0, F.concat(F.lit("9"), F.lpad((k % 1000000).cast("string"), 6, "0"))).alias("imo"),
        F.when(k % 3 == 0, F.concat(F.lit("MV "), k.cast("string"))).when(k % 3 == 1, F.lit(" ")).alias("name"),
        F.when(k % 7 == 0, F.lit("cargo")).alias("vessel_type"),
        (k % 4 * 30).alias("dim_a"), (k % 2 * 20).alias("dim_b"), (k % 3 * 5).alias("dim_c"), (k % 5 * 2).alias("dim_d"),
    )


@R.query(
    "merge_static",
    f"""WITH {DED_SQL} SELECT mmsi, max_by('9' || lpad(CAST(seq % 1000000 AS VARCHAR), 6, '0'), ts_s) FILTER (seq % 5 = 0) AS imo, max_by('MV ' || CAST(seq AS VARCHAR), ts_s) FILTER (seq % 3 = 0) AS name,
    max_by('cargo', ts_s) FILTER (seq % 7 = 0) AS vessel_type, max_by((seq % 4 * 30 + seq % 2 * 20) * 1e0, ts_s) FILTER (seq % 4 * 30 + seq % 2 * 20 > 0) AS length,
    max_by((seq % 3 * 5 + seq % 5 * 2) * 1e0, ts_s) FILTER (seq % 3 * 5 + seq % 5 * 2 > 0) AS beam FROM ded GROUP BY mmsi""",
)
def _(spark, sf):
    return op.merge_static(static_messages(spark, sf))


DRAFT_SQL = f"""dr AS (SELECT r.scene_id, r.mmsi, s.captured_s, f.ts_s, f.seq, f.draft_m FROM {of_runs('fx_drafts', 'ts_s', 172800, 172800)} WHERE f.draft_m IS NOT NULL),
dn AS (SELECT *, row_number() OVER (PARTITION BY scene_id, mmsi ORDER BY ts_s, seq) AS rn, count(*) OVER w AS n, sum(CASE WHEN ts_s <= captured_s THEN 1 ELSE 0 END) OVER w AS nb,
  min(draft_m) OVER w AS lo, max(draft_m) OVER w AS hi FROM dr WINDOW w AS (PARTITION BY scene_id, mmsi)),
dk AS (SELECT *, CASE WHEN nb > 0 AND nb < n THEN nb ELSE floor(n / 2) END AS k FROM dn),
dm AS (SELECT scene_id, mmsi, any_value(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi, round(median(draft_m) FILTER (rn <= k AND rn > k - 3), 3) AS b, round(median(draft_m) FILTER (rn > k AND rn <= k + 3), 3) AS a FROM dk GROUP BY 1, 2),
draft AS (SELECT scene_id, mmsi, CASE WHEN vessel_type = 'fishing' OR coalesce(n, 0) < 2 OR lo = hi OR b - a < 0.5 THEN 0e0 WHEN b - a > 5 THEN 0.8e0 ELSE round(least(0.8e0, 0.4e0 + (b - a - 0.5e0) / 2 * 0.4e0), 3) END AS draft_score,
  CASE WHEN vessel_type = 'fishing' OR coalesce(n, 0) < 2 THEN NULL WHEN lo = hi THEN round(lo, 2) ELSE b END AS draft_before, CASE WHEN vessel_type = 'fishing' OR coalesce(n, 0) < 2 THEN NULL WHEN lo = hi THEN round(lo, 2) ELSE a END AS draft_after,
  CASE WHEN vessel_type = 'fishing' THEN 'fishing_vessel_excluded' WHEN coalesce(n, 0) < 2 THEN 'insufficient_draft_data' WHEN lo = hi THEN 'all_drafts_identical' WHEN b - a < 0 THEN 'ballast_taken'
   WHEN b - a < 0.5 THEN 'draft_change_below_threshold' WHEN b - a > 5 THEN 'DATA_ERROR_LARGE_CHANGE' ELSE 'significant_draft_decrease_detected' END AS draft_reason
  FROM (SELECT DISTINCT scene_id, mmsi FROM fx_runs) LEFT JOIN (SELECT * FROM dm) USING (scene_id, mmsi) LEFT JOIN fx_vessels USING (mmsi))"""


@R.query("draft_change", f"WITH {DRAFT_SQL} SELECT * FROM draft")
def _(spark, sf):
    return op.draft_change(*[view(spark, sf, f"fx_{n}") for n in ("runs", "scenes", "drafts", "vessels")])


_CPA_POS = """
ends AS (SELECT scene_id, mmsi, min(ts_s) AS v0, max(ts_s) AS v1, count(*) AS n_points, min(captured_s) AS captured_s, min(lat) = max(lat) AND min(lon) = max(lon) AS still FROM pts GROUP BY 1, 2),
dends AS (SELECT scene_id, min(ts_s) AS d0, max(ts_s) AS d1 FROM fx_drift GROUP BY 1),
ov AS (SELECT e.*, greatest(v0, d0) AS lo, least(v1, d1) AS hi FROM ends e JOIN dends USING (scene_id) WHERE n_points >= 2 AND greatest(v0, d0) <= least(v1, d1)),
inst AS (SELECT o.scene_id, o.mmsi, p.ts_s FROM ov o JOIN pts p ON p.scene_id = o.scene_id AND p.mmsi = o.mmsi AND p.ts_s BETWEEN o.lo AND o.hi
  UNION SELECT o.scene_id, o.mmsi, d.ts_s FROM ov o JOIN fx_drift d ON d.scene_id = o.scene_id AND d.ts_s BETWEEN o.lo AND o.hi),
vs AS (SELECT scene_id, mmsi, ts_s, lat, lon, lead(ts_s) OVER w AS n_s, lead(lat) OVER w AS n_lat, lead(lon) OVER w AS n_lon FROM pts WINDOW w AS (PARTITION BY scene_id, mmsi ORDER BY ts_s)),
ds AS (SELECT scene_id, ts_s, lat, lon, lead(ts_s) OVER w AS n_s, lead(lat) OVER w AS n_lat, lead(lon) OVER w AS n_lon FROM fx_drift WINDOW w AS (PARTITION BY scene_id ORDER BY ts_s)),
pos AS (SELECT i.scene_id, i.mmsi, i.ts_s, i.ts_s - lag(i.ts_s) OVER (PARTITION BY i.scene_id, i.mmsi ORDER BY i.ts_s) AS step,
   CASE WHEN i.ts_s = v.ts_s THEN v.lat ELSE v.lat + (i.ts_s - v.ts_s)::DOUBLE / (v.n_s - v.ts_s) * (v.n_lat - v.lat) END AS v_lat, CASE WHEN i.ts_s = v.ts_s THEN v.lon ELSE v.lon + (i.ts_s - v.ts_s)::DOUBLE / (v.n_s - v.ts_s) * (v.n_lon - v.lon) END AS v_lon,
   CASE WHEN i.ts_s = d.ts_s THEN d.lat ELSE d.lat + (i.ts_s - d.ts_s)::DOUBLE / (d.n_s - d.ts_s) * (d.n_lat - d.lat) END AS d_lat, CASE WHEN i.ts_s = d.ts_s THEN d.lon ELSE d.lon + (i.ts_s - d.ts_s)::DOUBLE / (d.n_s - d.ts_s) * (d.n_lon - d.lon) END AS d_lon
  FROM inst i ASOF JOIN vs v ON i.scene_id = v.scene_id AND i.mmsi = v.mmsi AND i.ts_s >= v.ts_s ASOF JOIN ds d ON i.scene_id = d.scene_id AND i.ts_s >= d.ts_s)"""
CPA_SQL = f"""{_CPA_POS}, cdist AS ({geodesic_sql('pos', 'v_lat', 'v_lon', 'd_lat', 'd_lon', 'dist_m')}),
cbest AS (SELECT scene_id, mmsi, min(dist_m) AS m, min_by(ts_s, (dist_m, ts_s)) AS cpa_s, max(step) AS step FROM cdist GROUP BY 1, 2),
cpa AS (SELECT e.scene_id, e.mmsi, e.n_points, round(m, 3) AS min_distance_m, cpa_s, cpa_s - captured_s AS tcpa_seconds,
  round(CASE WHEN m IS NULL OR still OR m >= 10000 THEN 0e0 WHEN m <= 100 THEN 1e0 ELSE 1 - (m - 100) / 9900 END * CASE WHEN step > 1800 THEN 0.5 ELSE 1 END, 4) AS cpa_score,
  CASE WHEN step > 1800 OR m IS NULL THEN 'true' ELSE 'false' END AS low_confidence FROM ends e LEFT JOIN cbest USING (scene_id, mmsi))"""


# The same per run: its own positions and trajectory, under the run's number.
RUN_CPA_SQL = f"""rpts AS (SELECT m.run_id AS scene_id, p.mmsi, p.captured_s, p.ts_s, p.lat, p.lon FROM pts p JOIN fx_sims m ON m.scene_id = p.scene_id AND m.mmsi = p.mmsi),
rdrift AS (SELECT run_id AS scene_id, ts_s, lat, lon FROM fx_run_drift), {re.sub(r"\bpts\b", "rpts", CPA_SQL.replace("fx_drift", "rdrift"))}"""


def run_drift(spark, sf) -> DataFrame:
    """Positions of every run, through the JSON text they are stored as."""
    return run_positions(run_summaries(view(spark, sf, "fx_run_drift")))


@R.query("run_positions", "SELECT * FROM fx_run_drift")
def _(spark, sf):
    return run_drift(spark, sf)


@R.query("closest_approach_of_runs", f"WITH {PAIRS_SQL}, {RUN_CPA_SQL} SELECT c.scene_id AS run_id, m.scene_id, c.* EXCLUDE (scene_id) FROM cpa c JOIN fx_sims m ON m.run_id = c.scene_id")
def _(spark, sf):
    track = neighbours(deduped(spark, sf), ["mmsi"], "ts_s", ["lat", "lon"])
    d = op.approaches_of_runs(view(spark, sf, "fx_sims"), view(spark, sf, "fx_scenes"), track, run_drift(spark, sf))
    return d.drop("drifted", "vessel_lat", "vessel_lon", "slick_lat", "slick_lon").withColumn("low_confidence", F.col("low_confidence").cast("string"))


@R.query("closest_approach", f"WITH {PAIRS_SQL}, {CPA_SQL} SELECT * FROM cpa", whole=True)
def _(spark, sf):
    d = op.closest_approach(pair_points(spark, sf), view(spark, sf, "fx_drift"))
    return d.drop("vessel_lat", "vessel_lon", "slick_lat", "slick_lon").withColumn("low_confidence", F.col("low_confidence").cast("string"))
