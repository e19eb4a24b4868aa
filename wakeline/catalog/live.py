"""Streaming queries: each drains the derived feed through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.catalog import Registry
from wakeline.catalog.sqltext import hav_sql
from wakeline.fixtures import view
from wakeline.session import work_path
from wakeline.streaming import live

R = Registry()
DELAY_S = 600


def feed(spark, sf) -> str:
    """AIS envelopes of the whole track table, as JSON files in the shared folder."""
    path = work_path(spark, "feed")
    t = view(spark, sf, "fx_tracks")
    static = F.col("seq") % 10 == 0
    report = F.struct(
        F.when(F.col("seq") % 50 != 3, F.col("lat")).alias("Latitude"), F.col("lon").alias("Longitude"), F.col("speed_knots").alias("Sog"),
        F.when(F.col("seq") % 7 == 0, 511).otherwise(F.col("course").cast("int")).alias("TrueHeading"),
    )
    facts = F.struct(
        F.concat(F.lit("9"), F.col("seq").cast("string")).alias("ImoNumber"), F.lit("MV").alias("Name"), F.lit("cargo").alias("Type"),
        F.struct(F.lit(100).alias("A"), F.lit(20).alias("B"), F.lit(10).alias("C"), F.lit(12).alias("D")).alias("Dimension"),
    )
    t.select(
        F.when(static, "ShipStaticData").otherwise("PositionReport").alias("MessageType"),
        F.struct(F.when(F.col("seq") % 60 != 7, F.col("mmsi")).otherwise(" ").alias("MMSI"), F.concat(F.lit("SHIP "), "mmsi").alias("ShipName")).alias("MetaData"),
        F.struct(F.when(~static, report).alias("PositionReport"), F.when(static, facts).alias("ShipStaticData")).alias("Message"),
        F.timestamp_seconds("ts_s").alias("received_at"), F.col("seq").alias("number"),
    ).write.json(path)
    return path


def messages(spark, sf) -> DataFrame:
    return live.read_messages(spark, feed(spark, sf))


# The valid position reports of the feed.
_POS = "lp AS (SELECT mmsi, ts_s, seq, lat, lon, speed_knots, CASE WHEN seq % 7 <> 0 THEN CAST(course AS INTEGER) END AS heading FROM fx_tracks WHERE seq % 10 <> 0 AND seq % 50 <> 3 AND seq % 60 <> 7)"
_MARK = f"(SELECT max(ts_s) - {DELAY_S} FROM lp)"


@R.query("live_positions", f"WITH {_POS} SELECT mmsi, count(*) AS n, count(heading) AS with_heading, round(sum(lat), 4) AS sum_lat FROM lp GROUP BY 1")
def _(spark, sf):
    d = live.run_to_table(live.positions(messages(spark, sf)), "positions")
    return d.groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"), F.count("heading").alias("with_heading"), F.round(F.sum("lat"), 4).alias("sum_lat"))


@R.query(
    "live_positions_near",
    f"""WITH {_POS} SELECT s.scene_id AS centre_id, count(*) AS n FROM lp JOIN fx_scenes s ON lp.lat BETWEEN spill_lat - 0.4 AND spill_lat + 0.4 AND lp.lon BETWEEN spill_lon - 1 AND spill_lon + 1
    WHERE {hav_sql('spill_lat', 'spill_lon', 'lp.lat', 'lp.lon')} <= 30 GROUP BY 1""",
)
def _(spark, sf):
    c = view(spark, sf, "fx_scenes").select(F.col("scene_id").alias("centre_id"), F.col("spill_lat").alias("centre_lat"), F.col("spill_lon").alias("centre_lon"))
    d = live.run_to_table(live.positions_near(messages(spark, sf), c, 30.0), "near")
    return d.groupBy("centre_id").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    "live_message_counts",
    f"""SELECT CAST(floor(ts_s / 3600e0) AS BIGINT) * 3600 AS start_s, CASE WHEN seq % 10 = 0 THEN 'ShipStaticData' ELSE 'PositionReport' END AS "MessageType", count(*) AS n FROM fx_tracks GROUP BY 1, 2
    HAVING CAST(floor(ts_s / 3600e0) AS BIGINT) * 3600 + 3600 <= (SELECT max(ts_s) - {DELAY_S} FROM fx_tracks)""",
)
def _(spark, sf):
    return live.run_to_table(live.message_counts(messages(spark, sf)), "counts")


@R.query("live_latest_state", f"WITH {_POS} SELECT mmsi, max(ts_s) AS ts_s, round(max_by(lat, ts_s), 6) AS lat, 'SHIP ' || mmsi AS name FROM lp GROUP BY 1")
def _(spark, sf):
    d = live.run_upsert(live.latest_state(live.positions(messages(spark, sf))), "state", ["mmsi"])
    return d.select("mmsi", F.unix_seconds("ts").alias("ts_s"), F.round("lat", 6).alias("lat"), "name")


@R.query("live_static_reports", "SELECT mmsi, '9' || CAST(max_by(seq, ts_s) AS VARCHAR) AS imo, 120e0 AS length, 22e0 AS beam FROM fx_tracks WHERE seq % 10 = 0 AND seq % 60 <> 7 GROUP BY 1")
def _(spark, sf):
    from wakeline.operators.tracks import merge_static

    d = live.run_to_table(live.static_reports(messages(spark, sf)).filter("mmsi <> ''"), "static")
    return merge_static(d).select("mmsi", "imo", "length", "beam")


@R.query("live_dedupe", f"WITH {_POS} SELECT DISTINCT mmsi, ts_s FROM lp")
def _(spark, sf):
    p = live.positions(messages(spark, sf))
    twice = p.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    d = live.run_to_table(live.deduplicated(twice, ["mmsi", "ts"]), "dedupe")
    return d.select("mmsi", F.unix_seconds("ts").alias("ts_s"))


@R.query(
    "live_sessions",
    f"""WITH {_POS}, b AS (SELECT *, CASE WHEN ts_s - lag(ts_s) OVER (PARTITION BY mmsi ORDER BY ts_s) <= 1800 THEN 0 ELSE 1 END AS new FROM lp), s AS (SELECT *, sum(new) OVER (PARTITION BY mmsi ORDER BY ts_s) AS k FROM b)
    SELECT mmsi, min(ts_s) AS start_s, max(ts_s) AS last_s, count(*) AS n FROM s GROUP BY mmsi, k HAVING max(ts_s) + 1800 <= {_MARK}""",
)
def _(spark, sf):
    return live.run_to_table(live.track_sessions(live.positions(messages(spark, sf))), "sessions")


@R.query(
    "live_gap_alerts",
    f"""WITH {_POS}, d AS (SELECT mmsi, ts_s, min_by(lat, (lat, lon)) AS lat FROM lp GROUP BY 1, 2) SELECT mmsi, p AS gap_start_s, ts_s AS gap_end_s, round(lat, 6) AS end_lat
    FROM (SELECT *, lag(ts_s) OVER (PARTITION BY mmsi ORDER BY ts_s) AS p FROM d) WHERE ts_s - p > 1800 AND ts_s <= {_MARK}""",
)
def _(spark, sf):
    d = live.run_to_table(live.gap_alerts(live.positions(messages(spark, sf))), "gaps")
    return d.select("mmsi", "gap_start_s", "gap_end_s", F.round("end_lat", 6).alias("end_lat"))


_RQ = """q AS (SELECT request_id, (request_id * 31) % 7 AS station_id, requested_s AS ts FROM fx_requests), keep AS (SELECT station_id, min(ts) AS t FROM q GROUP BY 1
  UNION ALL SELECT k.station_id, min(q.ts) FROM keep k JOIN q ON q.station_id = k.station_id AND q.ts > k.t + 1800 GROUP BY 1)"""


@R.query(
    "live_cooldown",
    f"WITH RECURSIVE {_RQ} SELECT q.station_id, min(request_id) AS request_id, t AS requested_s FROM keep k JOIN q ON q.station_id = k.station_id AND q.ts = k.t WHERE t <= (SELECT max(ts) - {DELAY_S} FROM q) GROUP BY q.station_id, t",
)
def _(spark, sf):
    path = work_path(spark, "requests")
    q = view(spark, sf, "fx_requests").select("request_id", (F.col("request_id") * 31 % 7).alias("station_id"), F.timestamp_seconds("requested_s").alias("ts"))
    q.write.parquet(path)
    return live.run_to_table(live.dispatched_alerts(spark.readStream.schema(q.schema).parquet(path)), "dispatched")


@R.query("live_enrich", f"WITH {_POS} SELECT vessel_type, count(*) AS n FROM lp LEFT JOIN fx_vessels USING (mmsi) GROUP BY 1")
def _(spark, sf):
    v = view(spark, sf, "fx_vessels")
    d = live.run_to_table(live.enriched(live.positions(messages(spark, sf)), v), "enriched")
    return d.groupBy("vessel_type").agg(F.count(F.lit(1)).alias("n"))


@R.query("live_track_sink", f"WITH {_POS} SELECT mmsi, count(DISTINCT ts_s) AS n, max(ts_s) AS last_s FROM lp GROUP BY 1")
def _(spark, sf):
    p = live.positions(messages(spark, sf)).withColumn("ts_s", F.unix_seconds("ts"))
    d = live.run_track_sink(p.select("mmsi", "ts_s", "lat", "lon"), "sink", ["mmsi", "ts_s"], "lat")
    return d.groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"), F.max("ts_s").alias("last_s"))
