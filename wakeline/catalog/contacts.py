"""Radar contacts, lookups around slicks, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.catalog import Registry
from wakeline.catalog.sqltext import DED_SQL, GAPS_SQL, hav_sql, of_runs
from wakeline.catalog.tracks import ANOMALY_SQL, anomalies, deduped
from wakeline.fixtures import view
from wakeline.operators import contacts as op
from wakeline.operators.windows import facts_of_runs
from wakeline.plans.correlation import aligned_fleet, correlate
from wakeline.session import cut_lineage, work_path
from wakeline.sources import geojson

R = Registry()


def _km(a, b, c, d):
    """Unrounded haversine."""
    return hav_sql(a, b, c, d)[len("round("):-len(", 2)")]


_SP = f"""sp AS (SELECT s.scene_id, s.captured_s, t.* FROM fx_scenes s JOIN ded t ON t.ts_s BETWEEN s.captured_s - 21600 AND s.captured_s + 21600
  AND t.lat BETWEEN s.spill_lat - 1.4 AND s.spill_lat + 1.4 AND t.lon BETWEEN s.spill_lon - 4 AND s.spill_lon + 4
  WHERE {hav_sql('s.spill_lat', 's.spill_lon', 't.lat', 't.lon')} <= 150)"""
FLEET_SQL = f"""{DED_SQL}, {_SP},
ab AS (SELECT scene_id, mmsi, any_value(captured_s) AS c, count(*) AS n_points, max(ts_s) AS z_s, max(ts_s) FILTER (ts_s < captured_s) AS a_s, min(ts_s) FILTER (ts_s >= captured_s) AS b_s FROM sp GROUP BY 1, 2),
fleet AS (SELECT ab.scene_id, ab.mmsi, c AS captured_s, n_points,
   CASE WHEN a_s IS NULL THEN b.lat WHEN c >= z_s THEN z.lat ELSE CAST(CAST(CAST(a.lat + (c - a_s)::DOUBLE / (b_s - a_s) * (b.lat - a.lat) AS VARCHAR) AS DECIMAL(18, 5)) AS DOUBLE) END AS lat,
   CASE WHEN a_s IS NULL THEN b.lon WHEN c >= z_s THEN z.lon ELSE CAST(CAST(CAST(a.lon + (c - a_s)::DOUBLE / (b_s - a_s) * (b.lon - a.lon) AS VARCHAR) AS DECIMAL(18, 5)) AS DOUBLE) END AS lon,
   CASE WHEN a_s IS NULL THEN b.speed_knots WHEN c >= z_s THEN z.speed_knots ELSE a.speed_knots END AS speed_knots
  FROM ab LEFT JOIN ded a ON a.mmsi = ab.mmsi AND a.ts_s = a_s LEFT JOIN ded b ON b.mmsi = ab.mmsi AND b.ts_s = b_s JOIN ded z ON z.mmsi = ab.mmsi AND z.ts_s = z_s)"""
NEAR_SQL = f"""{FLEET_SQL}, nd AS (SELECT t.target_id, t.scene_id, t.lat, t.lon, t.confidence, f.mmsi, {_km('t.lat', 't.lon', 'f.lat', 'f.lon')} AS km FROM fx_sar_targets t LEFT JOIN fleet f USING (scene_id)),
near AS (SELECT target_id, scene_id, any_value(lat) AS lat, any_value(lon) AS lon, any_value(confidence) AS confidence, min_by(mmsi, (km, mmsi)) AS nearest_mmsi, min(km) AS km FROM nd GROUP BY 1, 2)"""


@R.query("position_at", f"WITH {FLEET_SQL} SELECT scene_id, mmsi, captured_s, n_points, round(lat, 5) AS lat, round(lon, 5) AS lon, speed_knots FROM fleet")
def _(spark, sf):
    d = aligned_fleet(view(spark, sf, "fx_scenes"), deduped(spark, sf))
    return d.select("scene_id", "mmsi", "captured_s", "n_points", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "speed_knots")


@R.query("nearest_vessel", f"WITH {NEAR_SQL} SELECT target_id, scene_id, nearest_mmsi, round(km, 2) AS nearest_km, CASE WHEN km <= 5 THEN 'true' ELSE 'false' END AS matched FROM near")
def _(spark, sf):
    fleet = cut_lineage(aligned_fleet(view(spark, sf, "fx_scenes"), deduped(spark, sf)))
    d = op.nearest_vessel(view(spark, sf, "fx_sar_targets"), fleet)
    return d.select("target_id", "scene_id", "nearest_mmsi", F.round("nearest_km", 2).alias("nearest_km"), F.col("matched").cast("string").alias("matched"))


CONTACTS_SQL = f"""{NEAR_SQL}, {GAPS_SQL}, {ANOMALY_SQL},
contacts AS (SELECT n.target_id, n.scene_id, n.lat, n.lon, n.confidence, CASE WHEN km <= 5 THEN 'MATCHED' ELSE 'DARK_VESSEL' END AS status, CASE WHEN km <= 5 THEN nearest_mmsi END AS mmsi,
  CASE WHEN km <= 5 THEN v.vessel_name END AS vessel_name, CASE WHEN km <= 5 THEN coalesce(v.vessel_type, 'Unknown') ELSE 'Unidentified Radar Contact' END AS vessel_type, round(km, 2) AS distance_km,
  CASE WHEN km <= 5 THEN coalesce(a.anomaly_score, 0e0) ELSE 90e0 END AS anomaly_score, CASE WHEN km <= 5 THEN coalesce(a.flags, '') ELSE 'AIS_TRANSPONDER_INACTIVE' END AS flags
  FROM near n LEFT JOIN fx_vessels v ON v.mmsi = n.nearest_mmsi LEFT JOIN anomaly a ON a.mmsi = n.nearest_mmsi)"""


def contacts(spark, sf):
    return correlate(
        view(spark, sf, "fx_scenes"), view(spark, sf, "fx_sar_targets").drop("intensity"), deduped(spark, sf),
        view(spark, sf, "fx_vessels"), anomalies(spark, sf),
    )


@R.query("correlate_scenes", f"WITH {CONTACTS_SQL} SELECT * EXCLUDE (confidence) FROM contacts", whole=True)
def _(spark, sf):
    return contacts(spark, sf).drop("confidence").withColumn("flags", F.concat_ws(";", "flags"))


@R.query("dark_contacts", f"WITH {CONTACTS_SQL} SELECT target_id, scene_id, vessel_type, distance_km, anomaly_score, flags FROM contacts WHERE status = 'DARK_VESSEL'")
def _(spark, sf):
    d = contacts(spark, sf).filter("status = 'DARK_VESSEL'").withColumn("flags", F.concat_ws(";", "flags"))
    return d.select("target_id", "scene_id", "vessel_type", "distance_km", "anomaly_score", "flags")


@R.query(
    "link_correlations",
    f"""WITH {CONTACTS_SQL} SELECT c.target_id, c.scene_id, v.mmsi AS vessel_id, CASE WHEN status = 'MATCHED' AND v.mmsi IS NOT NULL THEN 'matched' WHEN status = 'MATCHED' THEN 'borderline' ELSE 'dark_vessel' END AS match_status,
    round(distance_km * 1000, 2) AS haversine_distance_m, least(1e0, greatest(0e0, coalesce(confidence, 0.85e0))) AS confidence FROM contacts c LEFT JOIN fx_vessels v ON v.mmsi = c.mmsi""",
)
def _(spark, sf):
    return op.link_correlations(contacts(spark, sf), view(spark, sf, "fx_vessels"))


@R.query(
    "run_summary",
    f"""WITH {CONTACTS_SQL}, tc AS (SELECT scene_id, count(*) AS targets, count(*) FILTER (status = 'MATCHED') AS matched, count(*) FILTER (status = 'DARK_VESSEL') AS dark FROM contacts GROUP BY 1),
    vc AS (SELECT scene_id, count(*) AS vessels, count(*) FILTER (n_points >= 2) AS tracks FROM fleet GROUP BY 1),
    gc AS (SELECT f.scene_id, count(*) AS gaps FROM fleet f JOIN gaps g ON g.mmsi = f.mmsi AND g.gap_start_s BETWEEN f.captured_s - 21600 AND f.captured_s + 21600 GROUP BY 1)
    SELECT s.scene_id, coalesce(targets, 0) AS targets, coalesce(vessels, 0) AS vessels, coalesce(matched, 0) AS matched, coalesce(dark, 0) AS dark, coalesce(tracks, 0) AS tracks, coalesce(gaps, 0) AS gaps
    FROM fx_scenes s LEFT JOIN tc USING (scene_id) LEFT JOIN vc USING (scene_id) LEFT JOIN gc USING (scene_id)""",
)
def _(spark, sf):
    from wakeline.operators.integrity import run_summary
    from wakeline.operators.tracks import ais_gaps

    scenes = view(spark, sf, "fx_scenes")
    fleet = cut_lineage(aligned_fleet(scenes, deduped(spark, sf)))
    pairs = fleet.select("scene_id", "mmsi", F.lit(0).alias("run_id"))
    gaps = facts_of_runs(pairs, scenes, ais_gaps(deduped(spark, sf)), "gap_start_s", 21600, 21600)
    near = op.nearest_vessel(view(spark, sf, "fx_sar_targets"), fleet.select("scene_id", "mmsi", "lat", "lon"))
    return run_summary(scenes, near, fleet, gaps)


@R.query(
    "contact_properties",
    f"""WITH {CONTACTS_SQL}, lv AS (SELECT mmsi, max_by(speed_knots, (ts_s, seq)) AS speed, max_by(course, (ts_s, seq)) AS heading FROM fx_tracks GROUP BY 1)
    SELECT c.scene_id, target_id, CAST(v.flag_key AS VARCHAR) AS flag, round(v.dwt, 2) AS dwt, round(l.speed, 2) AS speed_knots, l.heading, NULL AS imo
    FROM contacts c LEFT JOIN fx_vessels v ON v.mmsi = c.mmsi LEFT JOIN lv l ON l.mmsi = c.mmsi""",
)
def _(spark, sf):
    t = view(spark, sf, "fx_tracks")
    newest = F.struct("ts_s", "seq")
    latest = t.groupBy("mmsi").agg(F.max_by("speed_knots", newest).alias("speed_knots"), F.max_by("course", newest).alias("heading"))
    vessels = view(spark, sf, "fx_vessels").select("mmsi", F.col("flag_key").cast("string").alias("flag"), "dwt")
    d = geojson.contact_features(geojson.with_details(contacts(spark, sf), vessels, latest))

    def prop(k: str):
        return F.get_json_object("feature", f"$.properties.{k}")

    return d.select(
        "scene_id", "target_id", prop("flag").alias("flag"), F.round(prop("dwt").cast("double"), 2).alias("dwt"),
        F.round(prop("speed_knots").cast("double"), 2).alias("speed_knots"), prop("heading").cast("double").alias("heading"), prop("imo").alias("imo"),
    )


@R.query(
    "geojson_features",
    f"""WITH {CONTACTS_SQL}, sc AS (SELECT r.scene_id, r.mmsi, count(*) AS n FROM (SELECT scene_id, mmsi FROM sp) r GROUP BY 1, 2)
    SELECT scene_id, 'spill_origin' AS entity_type, NULL AS target_id, '#FF3B30' AS color, 'Reported Oil Spill Origin' AS name, NULL AS waypoints FROM fx_scenes
    UNION ALL SELECT scene_id, 'vessel_contact', target_id, CASE WHEN status = 'MATCHED' THEN '#34C759' ELSE '#FF9500' END, coalesce(vessel_name, 'Dark Vessel (SAR #' || target_id || ')'), NULL FROM contacts
    UNION ALL SELECT c.scene_id, 'vessel_track', NULL, '#34C759', coalesce(c.vessel_name, 'Vessel #' || c.target_id), n FROM contacts c JOIN sc ON sc.scene_id = c.scene_id AND sc.mmsi = c.mmsi AND n >= 2""",
)
def _(spark, sf):
    scenes = view(spark, sf, "fx_scenes")
    path = work_path(spark, "geojson")
    geojson.write_geojson(geojson.to_geojson_features(scenes, contacts(spark, sf), deduped(spark, sf)), path)
    d = spark.read.text(path)

    def prop(k: str):
        return F.get_json_object("value", f"$.properties.{k}")

    return d.select(
        prop("scene_id").cast("long").alias("scene_id"), prop("entity_type").alias("entity_type"), "value"
    ).select(
        "scene_id", "entity_type",
        F.coalesce(prop("sar_id"), F.get_json_object("value", "$.properties.sar_id")).cast("long").alias("target_id"),
        F.coalesce(prop("marker_color"), prop("line_color")).alias("color"),
        F.coalesce(prop("name"), prop("vessel_name")).alias("name"),
        prop("num_waypoints").cast("long").alias("waypoints"),
    )


@R.query(
    "first_in_window",
    f"""WITH p AS (SELECT r.run_id, r.scene_id, r.mmsi, min_by(f.ts_s, (f.ts_s, f.seq)) AS release_s, min_by(f.lat, (f.ts_s, f.seq)) AS lat, min_by(f.lon, (f.ts_s, f.seq)) AS lon
    FROM {of_runs('fx_tracks', 'ts_s', 43200, 0)} GROUP BY 1, 2, 3) SELECT p.*, coalesce(vessel_name, 'unknown') AS vessel_name, coalesce(vessel_type, 'unknown') AS vessel_type, CASE WHEN vessel_type LIKE '%crude%' THEN 'GENERIC HEAVY CRUDE' WHEN vessel_type = 'cargo' THEN 'FUEL OIL NO. 6'
    WHEN vessel_type = 'fishing' THEN 'DIESEL' ELSE 'GENERIC MEDIUM CRUDE' END AS oil_type FROM p LEFT JOIN fx_vessels USING (mmsi)""",
    whole=True,
)
def _(spark, sf):
    return op.first_of_runs(*[view(spark, sf, f"fx_{n}") for n in ("runs", "scenes", "tracks", "vessels")], 43200)


def rings(spark, sf):
    return op.rings_of(view(spark, sf, "fx_spill_vertices"), "scene_id")




@R.query(
    "vessels_near_spill",
    """WITH c AS (SELECT s.scene_id, t.mmsi, radians(1) * 6371000 AS ky, cos(radians(t.lat)) * radians(1) * 6371000 AS kx, t.lat, t.lon, s.spill_lat, s.spill_lon
      FROM fx_scenes s JOIN fx_tracks t ON t.ts_s BETWEEN s.captured_s - 43200 AND s.captured_s AND t.lat BETWEEN s.spill_lat - 0.1 AND s.spill_lat + 0.1 AND t.lon BETWEEN s.spill_lon - 0.2 AND s.spill_lon + 0.2)
    SELECT DISTINCT scene_id, mmsi FROM c WHERE sqrt(pow(greatest(0, abs(lat - spill_lat) - 0.0201) * ky, 2) + pow(greatest(0, abs(lon - spill_lon) - 0.0201) * kx, 2)) <= 5000""",
)
def _(spark, sf):
    return op.vessels_near_spill(rings(spark, sf), view(spark, sf, "fx_scenes"), view(spark, sf, "fx_tracks"))


@R.query(
    "points_in_ports",
    """SELECT z.scene_id AS port_id, count(*) AS n, CAST(sum(d.seq) AS BIGINT) AS seqs FROM fx_tracks d JOIN fx_scenes z ON d.lat > z.spill_lat - 0.0201e0 AND d.lat <= z.spill_lat + 0.0201e0
    AND d.lon >= z.spill_lon - 0.0201e0 AND d.lon < z.spill_lon + 0.0201e0 GROUP BY 1""",
)
def _(spark, sf):
    r = rings(spark, sf).withColumnRenamed("scene_id", "port_id")
    d = op.points_in_rings(view(spark, sf, "fx_tracks"), r, "port_id")
    return d.groupBy("port_id").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


STATION_SQL = f"""stn AS (SELECT i.scene_id AS incident_id, t.station_id, t.station_name, {_km('i.spill_lat', 'i.spill_lon', 't.lat', 't.lon').replace('6371e0', '6371.0088e0')} AS km FROM fx_scenes i, fx_stations t),
near_st AS (SELECT incident_id, station_id, station_name, round(km, 1) AS distance_km, row_number() OVER (PARTITION BY incident_id ORDER BY round(km, 1), station_id) AS rank FROM stn WHERE km <= 500)"""


def incidents(spark, sf):
    return view(spark, sf, "fx_scenes").select(F.col("scene_id").alias("incident_id"), F.col("spill_lat").alias("lat"), F.col("spill_lon").alias("lon"))


@R.query("nearest_stations", f"WITH {STATION_SQL} SELECT * FROM near_st WHERE rank <= 3")
def _(spark, sf):
    d = op.nearest_stations(incidents(spark, sf), view(spark, sf, "fx_stations"))
    return d.select("incident_id", "station_id", "station_name", "distance_km", F.col("rank").cast("long").alias("rank"))


ASSETS_SQL = f"""assets AS (SELECT mmsi, name, type, lat, lon FROM fx_interceptors WHERE CAST(mmsi AS BIGINT) % 2 = 0
  UNION ALL SELECT mmsi, upper(name), type, lat + 0.01, lon FROM fx_interceptors WHERE CAST(mmsi AS BIGINT) % 2 = 1),
near_as AS (SELECT i.scene_id AS incident_id, a.mmsi AS asset_mmsi, a.name AS asset_name, {hav_sql('i.spill_lat', 'i.spill_lon', 'a.lat', 'a.lon', 1, '6371.0088e0')} AS asset_km
  FROM fx_scenes i JOIN assets a ON a.lat BETWEEN i.spill_lat - 1 AND i.spill_lat + 1 AND a.lon BETWEEN i.spill_lon - 3 AND i.spill_lon + 3
  WHERE a.type IN ('Ocean Tug', 'Patrol Vessel', 'Pollution Control', 'SAR') AND {_km('i.spill_lat', 'i.spill_lon', 'a.lat', 'a.lon').replace('6371e0', '6371.0088e0')} <= 100)"""


def assets(spark, sf):
    """Live sightings of every other asset take the place of its registry entry."""
    fallback = view(spark, sf, "fx_interceptors")
    live = fallback.filter(F.col("mmsi").cast("long") % 2 == 1).select("mmsi", F.upper("name").alias("name"), "type", (F.col("lat") + 0.01).alias("lat"), "lon")
    return op.merge_registry(live, fallback)


@R.query("merge_registry", f"WITH {ASSETS_SQL} SELECT mmsi, name, type, round(lat, 6) AS lat, lon FROM assets")
def _(spark, sf):
    return assets(spark, sf).withColumn("lat", F.round("lat", 6))


@R.query("interceptors_near", f"WITH {ASSETS_SQL} SELECT * FROM near_as")
def _(spark, sf):
    return op.interceptors_near(incidents(spark, sf), assets(spark, sf)).select("incident_id", "asset_mmsi", "asset_name", "asset_km")


@R.query(
    "nearest_grid_env",
    """SELECT s.scene_id, round(e.u10, 4) AS u10, round(e.v10, 4) AS v10 FROM fx_scenes s LEFT JOIN fx_env e ON round(e.lat / 0.25) = round(s.spill_lat / 0.25) AND round(e.lon / 0.25) = round(s.spill_lon / 0.25)""",
)
def _(spark, sf):
    p = view(spark, sf, "fx_scenes").select("scene_id", F.col("spill_lat").alias("lat"), F.col("spill_lon").alias("lon"))
    d = op.nearest_grid_env(p, view(spark, sf, "fx_env"))
    return d.select("scene_id", F.round("u10", 4).alias("u10"), F.round("v10", 4).alias("v10"))


_AXIS = """{a}x AS (SELECT scene_id, x FROM (SELECT s.scene_id, e.x, row_number() OVER (PARTITION BY s.scene_id ORDER BY abs(e.x - s.{a}), e.x DESC) AS rn
  FROM sp s JOIN (SELECT DISTINCT sector, {a} AS x FROM fx_env_hours) e USING (sector)) WHERE rn = 1)"""
ENV_SQL = f"""sp AS (SELECT scene_id, CAST(floor(scene_id / 100e0) AS BIGINT) AS sector, spill_lat AS lat, spill_lon AS lon, captured_s AS ts_s, meta_u, meta_v, wind_speed FROM fx_scenes),
{", ".join(_AXIS.format(a=a) for a in ("lat", "lon", "ts_s"))},
env AS (SELECT sp.*, e.u10, e.v10 FROM sp LEFT JOIN latx a USING (scene_id) LEFT JOIN lonx o USING (scene_id) LEFT JOIN ts_sx t USING (scene_id)
  LEFT JOIN fx_env_hours e ON e.sector = sp.sector AND e.lat = a.x AND e.lon = o.x AND e.ts_s = t.x)"""


def _scene_points(spark, sf):
    s = view(spark, sf, "fx_scenes")
    return s.select(
        "scene_id", F.floor(F.col("scene_id") / 100.0).alias("sector"), F.col("spill_lat").alias("lat"), F.col("spill_lon").alias("lon"), F.col("captured_s").alias("ts_s"),
        F.col("meta_u").alias("u10"), F.col("meta_v").alias("v10"), F.when(F.col("wind_speed").isNull(), "Regional Physics").alias("wind_source"),
    )


@R.query("nearest_env", f"WITH {ENV_SQL} SELECT scene_id, u10, v10 FROM env")
def _(spark, sf):
    p = _scene_points(spark, sf).drop("u10", "v10", "wind_source")
    return op.nearest_env(p, view(spark, sf, "fx_env_hours"), keys=("sector",)).select("scene_id", "u10", "v10")


@R.query(
    "join_weather",
    f"""WITH {ENV_SQL} SELECT scene_id, CASE WHEN own THEN meta_u ELSE u10 END AS u10, CASE WHEN own THEN meta_v ELSE v10 END AS v10,
    CASE WHEN own THEN 'skipped' WHEN u10 IS NOT NULL THEN 'joined' ELSE 'missing' END AS joined, CASE WHEN wind_speed IS NULL AND u10 IS NULL THEN 'Regional Physics' END AS wind_source
    FROM (SELECT *, meta_u IS NOT NULL AND wind_speed IS NOT NULL AS own FROM env)""",
)
def _(spark, sf):
    d = op.join_weather(_scene_points(spark, sf), view(spark, sf, "fx_env_hours"), keys=("sector",))
    return d.select("scene_id", "u10", "v10", "joined", "wind_source")


WIND_SQL = """wind AS (SELECT scene_id, u, v, sqrt(u * u + v * v) AS ms, ((degrees(atan2(u, v)) + 360) % 360 + 360) % 360 AS dir, src FROM (SELECT scene_id,
   CASE WHEN wind_speed IS NOT NULL THEN wind_speed * sin(radians(wind_direction)) ELSE meta_u END AS u, CASE WHEN wind_speed IS NOT NULL THEN wind_speed * cos(radians(wind_direction)) ELSE meta_v END AS v,
   CASE WHEN wind_speed IS NOT NULL THEN 'scene_derived' WHEN meta_u IS NOT NULL THEN 'metadata_json' ELSE 'none' END AS src FROM fx_scenes))"""


@R.query("resolve_wind", f"WITH {WIND_SQL} SELECT scene_id, round(u, 4) AS u10, round(v, 4) AS v10, round(ms, 4) AS wind_ms, round(dir, 3) AS wind_from_deg, src AS wind_source FROM wind")
def _(spark, sf):
    d = op.resolve_wind(view(spark, sf, "fx_scenes"))
    return d.select("scene_id", F.round("u10", 4).alias("u10"), F.round("v10", 4).alias("v10"), F.round("wind_ms", 4).alias("wind_ms"), F.round("wind_from_deg", 3).alias("wind_from_deg"), "wind_source")


@R.query("spill_with_scene", "SELECT scene_id, captured_s, status, 5 AS n_vertices, round(spill_lon, 6) AS centroid_lon, round(spill_lat, 6) AS centroid_lat FROM fx_scenes")
def _(spark, sf):
    d = op.spill_with_scene(rings(spark, sf), view(spark, sf, "fx_scenes").select("scene_id", "captured_s", "status"))
    return d.withColumn("centroid_lon", F.round("centroid_lon", 6)).withColumn("centroid_lat", F.round("centroid_lat", 6))


@R.query(
    "candidate_filter",
    """SELECT s.scene_id, t.mmsi, count(*) AS n, min(t.ts_s) AS first_s FROM fx_scenes s JOIN fx_tracks t ON t.ts_s BETWEEN s.captured_s - 43200 AND s.captured_s
    AND t.lat BETWEEN s.spill_lat - 0.3 AND s.spill_lat + 0.3 AND t.lon BETWEEN s.spill_lon - 0.3 AND s.spill_lon + 0.3 GROUP BY 1, 2""",
)
def _(spark, sf):
    s = view(spark, sf, "fx_scenes")
    boxes = s.select(
        "scene_id", "captured_s", (F.col("spill_lat") - 0.3).alias("min_lat"), (F.col("spill_lat") + 0.3).alias("max_lat"),
        (F.col("spill_lon") - 0.3).alias("min_lon"), (F.col("spill_lon") + 0.3).alias("max_lon"),
    )
    d = op.candidate_filter(boxes, view(spark, sf, "fx_tracks"))
    return d.groupBy("scene_id", "mmsi").agg(F.count(F.lit(1)).alias("n"), F.min("ts_s").alias("first_s"))


@R.query(
    "scene_track_window",
    f"""WITH {DED_SQL}, {_SP} SELECT scene_id, count(*) AS n, count(DISTINCT mmsi) AS vessels FROM sp GROUP BY 1""",
)
def _(spark, sf):
    d = op.scene_points(view(spark, sf, "fx_scenes"), deduped(spark, sf))
    return d.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("mmsi").alias("vessels"))
