"""Sources, validation and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.catalog import Registry
from wakeline.catalog.sqltext import DED_SQL, GAPS_SQL, hav_sql
from wakeline.fixtures import T0, view
from wakeline.functions import angles, geo
from wakeline.operators import cleaning as op
from wakeline.operators import windows
from wakeline.operators.tracks import ais_gaps, dedupe_track
from wakeline.session import work_path
from wakeline.sources import ais, geojson, tables

R = Registry()

BBOX = (70.0, 17.5, 71.4, 19.8)
MID_S = T0 + 54000

_REASON = f"""CASE
  WHEN coalesce(trim("MMSI"), '') = '' OR coalesce(trim("LON"), '') = '' OR coalesce(trim("LAT"), '') = '' OR coalesce(trim("UTC"), '') = '' THEN 'empty_row'
  WHEN TRY_CAST("MMSI" AS BIGINT) IS NULL OR TRY_CAST("MMSI" AS BIGINT) NOT BETWEEN 100000000 AND 999999999 THEN 'bad_mmsi'
  WHEN TRY_CAST("LAT" AS DOUBLE) IS NULL OR TRY_CAST("LON" AS DOUBLE) IS NULL OR TRY_CAST("LAT" AS DOUBLE) NOT BETWEEN -90 AND 90
       OR TRY_CAST("LON" AS DOUBLE) NOT BETWEEN -180 AND 180 THEN 'bad_coordinates'
  WHEN NOT (TRY_CAST("LON" AS DOUBLE) BETWEEN {BBOX[0]} AND {BBOX[2]} AND TRY_CAST("LAT" AS DOUBLE) BETWEEN {BBOX[1]} AND {BBOX[3]}) THEN 'outside_bbox'
  WHEN TRY_CAST("UTC" AS TIMESTAMP) IS NULL THEN 'bad_utc'
  WHEN epoch(TRY_CAST("UTC" AS TIMESTAMP)) NOT BETWEEN {MID_S - 43200} AND {MID_S + 43200} THEN 'outside_window' END"""


@R.query("read_ais_csv", 'SELECT "MMSI", count(*) AS n, min("UTC") AS first_utc FROM fx_raw_ais WHERE "MMSI" <> \' \' GROUP BY 1')
def _(spark, sf):
    path = work_path(spark, "ais-csv")
    view(spark, sf, "fx_raw_ais").drop("seq").write.csv(path, header=True)
    d = ais.read_ais_csv(spark, path).filter(F.trim("MMSI") != "")
    return d.groupBy("MMSI").agg(F.count(F.lit(1)).alias("n"), F.min("UTC").alias("first_utc"))


def _presence(spark, sf):
    """Presence records in report shape: one per position, some fields missing."""
    t = view(spark, sf, "fx_tracks")
    return t.select(
        "mmsi", "lat", "lon",
        F.when(F.col("seq") % 3 > 0, F.date_format(F.timestamp_seconds("ts_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("entryTimestamp"),
        F.when(F.col("seq") % 3 < 2, F.date_format(F.timestamp_seconds("ts_s"), "yyyy-MM-dd")).alias("date"),
        F.when(F.col("seq") % 4 > 0, F.concat(F.lit("SHIP "), "mmsi")).alias("shipName"),
        F.when(F.col("seq") % 5 > 0, F.lit("IND")).alias("flag"),
        F.col("seq"),
    )


_PRESENCE_SQL = """
SELECT mmsi, CASE WHEN seq % 4 > 0 THEN 'SHIP ' || mmsi ELSE 'Vessel-' || right(mmsi, 4) END AS name, '9000000' AS imo,
       CASE WHEN seq % 5 > 0 THEN 'IND' ELSE 'Unknown' END AS flag, 'Commercial Vessel' AS vessel_type, 50000e0 AS dwt,
       180e0 AS length, 28e0 AS beam, 10e0 AS speed_knots, 0e0 AS heading,
       CASE WHEN seq % 3 > 0 THEN ts_s ELSE CAST(floor(ts_s / 86400e0) AS BIGINT) * 86400 END AS ts_s, lat, lon
FROM fx_tracks"""


@R.query("read_presence_json", _PRESENCE_SQL)
def _(spark, sf):
    path = work_path(spark, "presence")
    _presence(spark, sf).drop("seq").write.json(path)
    return ais.read_presence_json(spark, path, multiline=False)


@R.query(
    "explode_report",
    "SELECT scene_id, 'sar:' || (scene_id % 2) AS dataset, count(*) AS n, round(sum(lat), 6) AS sum_lat FROM fx_sar_targets GROUP BY scene_id, scene_id % 2",
)
def _(spark, sf):
    # one report text per contact keeps every text small, however many contacts a scene has
    t = view(spark, sf, "fx_sar_targets")
    recs = F.array(F.struct("target_id", "lat"))
    name = F.concat(F.lit("sar:"), (F.col("scene_id") % 2).cast("string"))
    body = F.to_json(F.struct(F.array(F.create_map(name, recs)).alias("entries")))
    d = ais.explode_report(t.select("scene_id", body.alias("body")), "body", "struct<target_id:bigint,lat:double>")
    return d.groupBy("scene_id", "dataset").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("lat"), 6).alias("sum_lat"))


@R.query(
    "parse_feature",
    f"""SELECT i.mmsi, i.name, '9000000' AS imo, 'Unknown' AS flag, i.type AS vessel_type, 50000e0 AS dwt, 180e0 AS length, 28e0 AS beam,
       10e0 AS speed_knots, 0e0 AS heading, i.lat, i.lon, {hav_sql('s.spill_lat', 's.spill_lon', 'i.lat', 'i.lon')} AS distance_km
    FROM fx_interceptors i JOIN fx_scenes s ON CAST(i.mmsi AS BIGINT) - 500000000 = s.scene_id""",
)
def _(spark, sf):
    i, s = view(spark, sf, "fx_interceptors"), view(spark, sf, "fx_scenes")
    body = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
            F.struct(F.col("mmsi").alias("MMSI"), F.col("name").alias("VesselName"), F.col("type").alias("VesselType")).alias("properties"),
        )
    )
    d = i.select((F.col("mmsi").cast("long") - 500000000).alias("scene_id"), body.alias("body"))
    d = d.join(s.select("scene_id", "spill_lat", "spill_lon"), "scene_id")
    return ais.parse_feature(d, "body", F.col("spill_lat"), F.col("spill_lon")).drop("scene_id", "spill_lat", "spill_lon")


@R.query("read_registry", "SELECT CAST(station_id AS STRING) AS id, station_name AS name, lat, lon FROM fx_stations")
def _(spark, sf):
    from wakeline.sources.registry import read_registry

    path = work_path(spark, "stations")
    s = view(spark, sf, "fx_stations")
    s.select(F.col("station_id").cast("string").alias("id"), F.col("station_name").alias("name"), "lat", "lon").write.json(path)
    return read_registry(spark, "stations", path, multiline=False).select("id", "name", "lat", "lon")


@R.query(
    "week_chunked_tracks",
    f"SELECT mmsi, count(*) AS n, min(ts_s) AS first_s, max(ts_s) AS last_s FROM fx_tracks_raw WHERE ts_s BETWEEN {T0 + 6 * 86400} AND {T0 + 16 * 86400} GROUP BY mmsi",
)
def _(spark, sf):
    path = work_path(spark, "tracks")
    tables.write_tracks(view(spark, sf, "fx_tracks_raw"), path)
    d = tables.read_tracks(spark, path, T0 + 6 * 86400, T0 + 16 * 86400)
    return d.groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"))


@R.query(
    "append_if_absent",
    f"""SELECT mmsi || ':' || strftime(make_timestamp(ts_s * 1000000), '%Y-%m-%d %H:%M:%S') AS source_record_id, ts_s, min(seq) AS seq
    FROM fx_tracks WHERE ts_s >= {MID_S} GROUP BY mmsi, ts_s
    UNION ALL SELECT mmsi || ':' || strftime(make_timestamp(ts_s * 1000000), '%Y-%m-%d %H:%M:%S'), ts_s, seq FROM fx_tracks WHERE ts_s < {MID_S}""",
)
def _(spark, sf):
    # the first half of the day is stored already; the whole feed arrives again
    path = work_path(spark, "appended")
    feed = tables.track_record_id(view(spark, sf, "fx_tracks")).select("source_record_id", "mmsi", "ts_s", "seq")
    tables.write_tracks(feed.filter(F.col("ts_s") < MID_S), path)
    tables.append_if_absent(spark, path, feed, ["source_record_id", "ts_s"], "seq", ts="ts_s")
    tables.append_if_absent(spark, path, feed, ["source_record_id", "ts_s"], "seq", ts="ts_s")
    return tables.read_tracks(spark, path).select("source_record_id", "ts_s", "seq")


@R.query(
    "upsert_vessels",
    "SELECT mmsi, vessel_type, vessel_name FROM fx_vessels UNION ALL SELECT DISTINCT mmsi, 'unknown', NULL FROM fx_tracks WHERE mmsi NOT IN (SELECT mmsi FROM fx_vessels)",
)
def _(spark, sf):
    path = work_path(spark, "registry")
    view(spark, sf, "fx_vessels").select("mmsi", "vessel_type", "vessel_name").write.parquet(path)
    for _again in range(2):
        tables.upsert_vessels(spark, path, view(spark, sf, "fx_tracks"))
    return spark.read.parquet(path)


def _outlines(spark, sf):
    return view(spark, sf, "fx_spill_vertices").select(
        "scene_id", F.lit(0).alias("polygon"), F.lit(0).alias("ring"), "vertex", "lon", "lat"
    )


_VERT_SQL = "SELECT scene_id, 0 AS polygon, 0 AS ring, vertex, round(lon, 6) AS lon, round(lat, 6) AS lat FROM fx_spill_vertices"


def _rounded(d):
    return d.withColumn("lon", F.round("lon", 6)).withColumn("lat", F.round("lat", 6))


@R.query("spill_vertices_wkt", _VERT_SQL)
def _(spark, sf):
    return _rounded(geojson.spill_vertices(geojson.vertices_to_wkt(_outlines(spark, sf), ["scene_id"])))


@R.query("spill_vertices_geojson", _VERT_SQL)
def _(spark, sf):
    return _rounded(geojson.spill_vertices(geojson.vertices_to_geojson(_outlines(spark, sf), ["scene_id"])))


def _validated(spark, sf):
    return op.validate_ais(view(spark, sf, "fx_raw_ais"), BBOX, MID_S, 12)


@R.query("validate_ais_counts", f"SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM fx_raw_ais GROUP BY 1")
def _(spark, sf):
    return op.reject_counts(_validated(spark, sf))


@R.query(
    "validate_ais_kept",
    f"""SELECT seq, CAST("MMSI" AS BIGINT) AS mmsi_n, CAST("LAT" AS DOUBLE) AS lat_d, CAST("LON" AS DOUBLE) AS lon_d,
    CAST(epoch(CAST("UTC" AS TIMESTAMP)) AS BIGINT) AS utc_s FROM fx_raw_ais WHERE {_REASON} IS NULL""",
)
def _(spark, sf):
    return op.kept(_validated(spark, sf)).select("seq", "mmsi_n", "lat_d", "lon_d", "utc_s")


@R.query(
    "clamp_kinematics",
    """SELECT seq, coalesce(least(100e0, greatest(0e0, TRY_CAST("SOG" AS DOUBLE))), 0e0) AS speed_knots,
    coalesce(least(360e0, greatest(0e0, TRY_CAST("COG" AS DOUBLE))), 0e0) AS course,
    CASE WHEN TRY_CAST(nullif("HEADING", '') AS DOUBLE) BETWEEN 0 AND 360 THEN TRY_CAST(nullif("HEADING", '') AS DOUBLE) END AS heading FROM fx_raw_ais""",
)
def _(spark, sf):
    return op.clamp_kinematics(view(spark, sf, "fx_raw_ais")).select("seq", "speed_knots", "course", "heading")


@R.query(
    "normalise_mmsi",
    """SELECT "MMSI" AS raw, CASE WHEN regexp_full_match(trim("MMSI"), '[0-9]{1,9}') THEN lpad(trim("MMSI"), 9, '0') END AS mmsi, count(*) AS n
    FROM fx_raw_ais GROUP BY 1, 2""",
)
def _(spark, sf):
    d = view(spark, sf, "fx_raw_ais").select(F.col("MMSI").alias("raw"), op.normalise_mmsi(F.col("MMSI")).alias("mmsi"))
    return d.groupBy("raw", "mmsi").agg(F.count(F.lit(1)).alias("n"))


@R.query("canonical_points", "SELECT seq, mmsi, lat, lon, ts_s, speed_knots, course FROM fx_tracks")
def _(spark, sf):
    # four feeds that name and format the same facts differently
    t = view(spark, sf, "fx_tracks")
    iso = F.date_format(F.timestamp_seconds("ts_s"), "yyyy-MM-dd'T'HH:mm:ss")
    plus = F.date_format(F.timestamp_seconds(F.col("ts_s") + 19800), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("seq") % 4
    d = t.select(
        "seq", "mmsi",
        F.when(k < 2, F.col("lat")).alias("lat"), F.when(k >= 2, F.col("lat")).alias("latitude"),
        F.when(k == 0, F.col("lon")).alias("lon"), F.when(k == 1, F.col("lon")).alias("lng"),
        F.when(k > 1, F.col("lon")).alias("longitude"),
        F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.col("ts_s").cast("string")).alias("time"),
        F.when(k == 2, F.concat(plus, F.lit("+05:30"))).when(k == 3, iso).alias("timestamp"),
        F.when(k == 0, F.col("speed_knots")).alias("speed"), F.when(k > 0, F.col("speed_knots")).alias("sog"),
        F.when(k == 0, F.col("course")).alias("course"), F.when(k == 1, F.col("course")).alias("cog"),
        F.when(k > 1, F.col("course")).alias("heading"),
    )
    return op.canonical_points(d)


@R.query(
    "bbox_around",
    """SELECT scene_id, round(spill_lat - degrees(150 / 6371e0), 6) AS min_lat, round(spill_lat + degrees(150 / 6371e0), 6) AS max_lat,
    round(spill_lon - degrees(150 / (6371e0 * greatest(0.01, cos(radians(spill_lat))))), 6) AS min_lon,
    round(spill_lon + degrees(150 / (6371e0 * greatest(0.01, cos(radians(spill_lat))))), 6) AS max_lon FROM fx_scenes""",
)
def _(spark, sf):
    d = op.bbox_around(view(spark, sf, "fx_scenes"), "spill_lat", "spill_lon", 150.0)
    return d.select("scene_id", *[F.round(c, 6).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])


@R.query(
    "assign_area",
    """SELECT CASE WHEN lat BETWEEN 18 AND 20.5 AND lon BETWEEN 71 AND 73.5 THEN 'mumbai_high' WHEN lat BETWEEN 21.5 AND 23.5 AND lon BETWEEN 68 AND 70.5 THEN 'gulf_of_kutch'
    WHEN lat BETWEEN 12.5 AND 14.2 AND lon BETWEEN 80 AND 81.5 THEN 'chennai_ennore' WHEN lat BETWEEN 21 AND 22.6 AND lon BETWEEN 87.5 AND 89.2 THEN 'haldia_sundarbans' END AS area,
    count(*) AS n, count(DISTINCT mmsi) AS vessels FROM fx_tracks GROUP BY 1""",
)
def _(spark, sf):
    d = op.assign_area(view(spark, sf, "fx_tracks"))
    return d.groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("mmsi").alias("vessels"))


@R.query(
    "radius_filter",
    f"""SELECT s.scene_id AS centre_id, count(*) AS n, round(sum({hav_sql('s.spill_lat', 's.spill_lon', 't.lat', 't.lon')}), 2) AS sum_km
    FROM fx_tracks t JOIN fx_scenes s ON t.lat BETWEEN s.spill_lat - 0.4 AND s.spill_lat + 0.4 AND t.lon BETWEEN s.spill_lon - 1 AND s.spill_lon + 1
    WHERE {hav_sql('s.spill_lat', 's.spill_lon', 't.lat', 't.lon')} <= 30 GROUP BY 1""",
)
def _(spark, sf):
    s = view(spark, sf, "fx_scenes").select(
        F.col("scene_id").alias("centre_id"), F.col("spill_lat").alias("centre_lat"), F.col("spill_lon").alias("centre_lon")
    )
    d = op.radius_filter(view(spark, sf, "fx_tracks"), s, 30.0, deg=0.5)
    return d.groupBy("centre_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("distance_km"), 2).alias("sum_km"))


@R.query(
    "map_oil_type",
    """SELECT mmsi, CASE WHEN vessel_type LIKE '%crude%' THEN 'GENERIC HEAVY CRUDE' WHEN vessel_type LIKE '%chemical%' THEN 'GENERIC MEDIUM CRUDE'
    WHEN vessel_type LIKE '%cargo%' OR vessel_type LIKE '%container%' THEN 'FUEL OIL NO. 6' WHEN vessel_type LIKE '%fishing%' THEN 'DIESEL'
    ELSE 'GENERIC MEDIUM CRUDE' END AS oil_type FROM fx_vessels""",
    whole=True,
)
def _(spark, sf):
    return view(spark, sf, "fx_vessels").select("mmsi", op.oil_type_of_vessel(F.col("vessel_type")).alias("oil_type"))


@R.query(
    "map_cargo_oil",
    """SELECT o_orderkey AS run_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'GENERIC HEAVY CRUDE' WHEN '2-HIGH' THEN 'DIESEL' WHEN '3-MEDIUM' THEN 'FUEL OIL NO. 6' WHEN '5-LOW' THEN 'GASOLINE' ELSE 'GENERIC MEDIUM CRUDE' END AS oil_type FROM orders""",
)
def _(spark, sf):
    cargo = F.create_map(*[F.lit(x) for x in ("1-URGENT", "Crude_Oil", "2-HIGH", "diesel", "3-MEDIUM", "fuel_oil", "4-NOT SPECIFIED", "unknown", "5-LOW", "gasoline")])
    return view(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), op.oil_type_of_cargo(cargo[F.col("o_orderpriority")]).alias("oil_type"))


@R.query("list_spills_of_scene", "SELECT scene_id, captured_s, status, area_sq_km FROM fx_scenes WHERE scene_id = 9 AND status = 'confirmed'")
def _(spark, sf):
    s = view(spark, sf, "fx_scenes")
    d = op.list_spills(s.select("scene_id", "status", "area_sq_km"), s.select("scene_id", "captured_s"), "confirmed", 20, 0, scene_id=9)
    return d.select("scene_id", "captured_s", "status", "area_sq_km")


@R.query(
    "list_spills",
    "SELECT scene_id, captured_s, status, area_sq_km FROM fx_scenes WHERE status = 'confirmed' ORDER BY captured_s DESC, scene_id LIMIT 20 OFFSET 5",
)
def _(spark, sf):
    s = view(spark, sf, "fx_scenes")
    d = op.list_spills(s.select("scene_id", "status", "area_sq_km"), s.select("scene_id", "captured_s"), "confirmed", 20, 5)
    return d.select("scene_id", "captured_s", "status", "area_sq_km")


@R.query(
    "tracks_in_scene_window",
    """SELECT r.run_id, r.scene_id, r.mmsi, count(*) AS n, min(t.ts_s) AS first_s, max(t.ts_s) AS last_s, CAST(sum(t.seq) AS BIGINT) AS seqs
    FROM fx_runs r JOIN fx_scenes s USING (scene_id) JOIN fx_tracks t ON t.mmsi = r.mmsi AND t.ts_s BETWEEN s.captured_s - 21600 AND s.captured_s + 21600
    GROUP BY ALL""",
    whole=True,
)
def _(spark, sf):
    d = windows.tracks_of_runs(view(spark, sf, "fx_runs"), view(spark, sf, "fx_scenes"), view(spark, sf, "fx_tracks"))
    return d.groupBy("run_id", "scene_id", "mmsi").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"), F.sum("seq").alias("seqs")
    )


@R.query(
    "gaps_in_window",
    f"""WITH {DED_SQL}, {GAPS_SQL} SELECT r.run_id, count(*) AS n, round(sum(duration_min), 1) AS minutes FROM fx_runs r JOIN fx_scenes s USING (scene_id)
    JOIN gaps g ON g.mmsi = r.mmsi AND g.gap_start_s BETWEEN s.captured_s - 21600 AND s.captured_s + 21600 GROUP BY r.run_id""",
    whole=True,
)
def _(spark, sf):
    gaps = ais_gaps(dedupe_track(view(spark, sf, "fx_tracks")))
    d = windows.gaps_of_runs(view(spark, sf, "fx_runs"), view(spark, sf, "fx_scenes"), gaps)
    return d.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration_min"), 1).alias("minutes"))


@R.query(
    "drafts_in_window",
    """SELECT r.run_id, count(*) AS n, round(sum(draft_m), 1) AS metres FROM fx_runs r JOIN fx_scenes s USING (scene_id)
    JOIN fx_drafts d ON d.mmsi = r.mmsi AND d.ts_s BETWEEN s.captured_s - 172800 AND s.captured_s + 172800 WHERE draft_m IS NOT NULL GROUP BY r.run_id""",
    whole=True,
)
def _(spark, sf):
    d = windows.drafts_of_runs(view(spark, sf, "fx_runs"), view(spark, sf, "fx_scenes"), view(spark, sf, "fx_drafts"))
    return d.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("draft_m"), 1).alias("metres"))


@R.query(
    "capacity_defaults",
    """SELECT mmsi, coalesce(CASE WHEN dwt > 0 THEN dwt END, CASE WHEN vessel_type LIKE '%tanker%' THEN 85000e0 ELSE 45000e0 END) AS dwt,
    coalesce(CASE WHEN flag_key % 2 = 0 THEN vessel_name END, 'Vessel-' || right(mmsi, 4)) AS vessel_name FROM fx_vessels""",
    whole=True,
)
def _(spark, sf):
    v = view(spark, sf, "fx_vessels").select(
        "mmsi", "vessel_type", F.when(F.col("dwt") > 0, F.col("dwt")).alias("dwt"),
        F.when(F.col("flag_key") % 2 == 0, F.col("vessel_name")).alias("vessel_name"),
    )
    return op.with_capacity_defaults(v).select("mmsi", "dwt", "vessel_name")


@R.query(
    "wind_vectors",
    """SELECT scene_id, round(wind_speed * sin(radians(wind_direction)), 6) AS u, round(wind_speed * cos(radians(wind_direction)), 6) AS v,
    round(wind_speed, 6) AS speed_back, greatest(-1e0, least(1e0, round(wind_speed * sin(radians(wind_direction)), 6) / 25)) AS u_ch,
    greatest(-1e0, least(1e0, round(wind_speed * cos(radians(wind_direction)), 6) / 25)) AS v_ch, greatest(0e0, least(1e0, wind_speed / 25)) AS speed_ch,
    round(((degrees(atan2(u0, v0)) + 360) % 360 + 360) % 360, 4) AS dir_back
    FROM (SELECT *, wind_speed * sin(radians(wind_direction)) AS u0, wind_speed * cos(radians(wind_direction)) AS v0 FROM fx_scenes) WHERE wind_speed IS NOT NULL""",
)
def _(spark, sf):
    s = view(spark, sf, "fx_scenes").filter("wind_speed is not null")
    u, v = angles.wind_to_uv(F.col("wind_speed"), F.col("wind_direction"))
    speed, direction = angles.uv_to_wind(u, v)
    chans = angles.wind_channels(F.round(u, 6), F.round(v, 6), F.col("wind_speed"))
    return s.select(
        "scene_id", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"), F.round(speed, 6).alias("speed_back"),
        F.round(direction, 4).alias("dir_back"), chans[0].alias("u_ch"), chans[1].alias("v_ch"), chans[2].alias("speed_ch"),
    )
