"""Alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.catalog import Registry
from wakeline.catalog.contacts import ASSETS_SQL, _km, assets
from wakeline.fixtures import view
from wakeline.operators import alerts as op

R = Registry()
_K = "6371.0088e0"

GATE_SQL = f"""rq AS (SELECT *, coalesce(nullif(filter_confidence, 0), nullif(detection_confidence, 0), 0e0) AS confidence FROM fx_requests),
sst AS (SELECT s.scene_id, t.station_id, t.station_name, round({_km('s.spill_lat', 's.spill_lon', 't.lat', 't.lon').replace('6371e0', _K)}, 1) AS distance_km FROM fx_scenes s, fx_stations t
  WHERE {_km('s.spill_lat', 's.spill_lon', 't.lat', 't.lon').replace('6371e0', _K)} <= 500),
srk AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY distance_km, station_id) AS rank FROM sst),
gate AS (SELECT q.request_id, q.scene_id, q.requested_s, q.confidence, CASE WHEN verified AND confidence >= 0.75 THEN p.station_id END AS station_id, p.station_name, p.distance_km,
  CASE WHEN NOT verified THEN 'not_verified_oil' WHEN confidence < 0.75 THEN 'below_confidence_threshold' WHEN p.station_id IS NULL THEN 'no_station_in_range' END AS reason
  FROM rq q LEFT JOIN srk p ON p.scene_id = q.scene_id AND p.rank = 1)"""
COOL_SQL = f"""{GATE_SQL}, tick AS (SELECT station_id, requested_s, min(request_id) AS request_id FROM gate WHERE reason IS NULL GROUP BY 1, 2),
keep AS (SELECT station_id, min(requested_s) AS t FROM tick GROUP BY 1 UNION ALL SELECT k.station_id, min(e.requested_s) FROM keep k JOIN tick e ON e.station_id = k.station_id AND e.requested_s > k.t + 1800 GROUP BY 1),
dec AS (SELECT g.*, CASE WHEN g.reason IS NOT NULL THEN g.reason WHEN k.request_id IS NULL THEN 'cooldown' END AS final FROM gate g
  LEFT JOIN (SELECT t.request_id FROM keep k JOIN tick t ON t.station_id = k.station_id AND t.requested_s = k.t) k USING (request_id))"""
ALERT_SQL = f"""{COOL_SQL}, {ASSETS_SQL}, nas AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY asset_km, asset_mmsi) AS rn FROM near_as),
alert AS (SELECT request_id AS incident_id, station_id, station_name, distance_km AS station_distance_km, coalesce((SELECT string_agg(station_name, ';' ORDER BY rank) FROM srk WHERE srk.scene_id = d.scene_id AND rank BETWEEN 2 AND 3), '') AS backup_stations,
  CASE WHEN confidence >= 0.9 THEN 'HIGH' ELSE 'MODERATE' END AS severity, round(confidence, 3) AS confidence, (SELECT count(*) FROM nas WHERE nas.incident_id = d.scene_id) AS interception_count,
  coalesce((SELECT string_agg(asset_name, ';' ORDER BY rn) FROM nas WHERE nas.incident_id = d.scene_id AND rn <= 5), '') AS nearest_vessels, round(distance_km / (18 * 1.852e0), 2) AS eta_hours, requested_s AS created_s
  FROM dec d WHERE final IS NULL)"""


def _gated(spark, sf):
    return op.gate_incidents(view(spark, sf, "fx_requests"), view(spark, sf, "fx_stations"))


def _alerts(spark, sf):
    return op.build_alerts(op.cooldown(_gated(spark, sf)), view(spark, sf, "fx_stations"), assets(spark, sf))


@R.query("gate_incidents", f"WITH {GATE_SQL} SELECT request_id, station_id, reason, confidence FROM gate")
def _(spark, sf):
    return _gated(spark, sf).select("request_id", "station_id", "reason", "confidence")


@R.query("cooldown", f"WITH RECURSIVE {COOL_SQL} SELECT request_id, final AS reason FROM dec")
def _(spark, sf):
    return op.cooldown(_gated(spark, sf)).select("request_id", "reason")


@R.query("build_alerts", f"WITH RECURSIVE {ALERT_SQL} SELECT * FROM alert")
def _(spark, sf):
    d = _alerts(spark, sf)
    return d.withColumns({c: F.concat_ws(";", c) for c in ("backup_stations", "nearest_vessels")})


@R.query("list_alerts", f"WITH RECURSIVE {COOL_SQL} SELECT request_id AS incident_id, station_id, requested_s AS created_s FROM dec WHERE final IS NULL ORDER BY created_s DESC, incident_id DESC LIMIT 50")
def _(spark, sf):
    return op.list_alerts(_alerts(spark, sf), 50).select("incident_id", "station_id", "created_s")


def _acks(spark, sf):
    """Two acknowledgements for every third request, dispatched or not."""
    q = view(spark, sf, "fx_requests").filter("request_id % 3 = 0")
    return q.select(
        F.col("request_id").alias("incident_id"), F.explode(F.array(F.lit(60), F.lit(120))).alias("_d"), "requested_s"
    ).select("incident_id", F.concat(F.lit("officer-"), F.col("_d").cast("string")).alias("acked_by"), (F.col("requested_s") + F.col("_d")).alias("acked_s"))


@R.query(
    "apply_acks",
    f"WITH RECURSIVE {COOL_SQL} SELECT request_id AS incident_id, CASE WHEN request_id % 3 = 0 THEN 'officer-120' END AS acked_by, CASE WHEN request_id % 3 = 0 THEN requested_s + 120 END AS acked_s FROM dec WHERE final IS NULL",
)
def _(spark, sf):
    sent = op.cooldown(_gated(spark, sf)).filter("reason is null").select(F.col("request_id").alias("incident_id"))
    return op.apply_acks(sent, _acks(spark, sf))


@R.query("unknown_acks", f"WITH RECURSIVE {COOL_SQL} SELECT request_id AS incident_id FROM dec WHERE final IS NOT NULL AND request_id % 3 = 0")
def _(spark, sf):
    sent = op.cooldown(_gated(spark, sf)).filter("reason is null").select(F.col("request_id").alias("incident_id"))
    return op.unknown_acks(sent, _acks(spark, sf))
