"""Constraint, audit and dossier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.catalog import Registry
from wakeline.fixtures import view
from wakeline.operators import integrity as op

R = Registry()


@R.query(
    "check_constraints",
    """WITH v AS (SELECT 'tracks' AS t, 'speed_range' AS rule FROM fx_tracks WHERE speed_knots * 6 > 100 UNION ALL SELECT 'tracks', 'course_range' FROM fx_tracks WHERE course + 20 > 360
    UNION ALL SELECT 'vessels', 'dwt_positive' FROM fx_vessels WHERE NOT dwt > 0 UNION ALL SELECT 'scenes', 'wind_direction_range' FROM fx_scenes WHERE wind_direction + 30 > 360
    UNION ALL SELECT 'spills', 'area_positive' FROM fx_scenes WHERE NOT area_sq_km - 5 > 0) SELECT t AS table_name, rule, count(*) AS n FROM v GROUP BY 1, 2""",
    whole=True,
)
def _(spark, sf):
    scenes = view(spark, sf, "fx_scenes")
    cases = {
        "tracks": (view(spark, sf, "fx_tracks").select("seq", (F.col("speed_knots") * 6).alias("speed_knots"), (F.col("course") + 20).alias("course_degrees")), "seq", ["speed_range", "course_range"]),
        "vessels": (view(spark, sf, "fx_vessels").select("mmsi", F.col("dwt").alias("deadweight_tonnage")), "mmsi", ["mmsi_format", "dwt_positive"]),
        "scenes": (scenes.select("scene_id", (F.col("wind_direction") + 30).alias("wind_direction")), "scene_id", ["wind_direction_range"]),
        "spills": (scenes.select("scene_id", (F.col("area_sq_km") - 5).alias("area_sq_km")), "scene_id", None),
    }
    parts = [op.violation_counts(op.violations(d, t, k, rules)).select(F.lit(t).alias("table_name"), "rule", "n") for t, (d, k, rules) in cases.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@R.query("check_unique", "SELECT mmsi, ts_s, count(*) AS n FROM fx_tracks GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return op.duplicate_keys(view(spark, sf, "fx_tracks"), ["mmsi", "ts_s"])


@R.query("check_fk", "SELECT run_id, mmsi FROM fx_runs WHERE mmsi NOT IN (SELECT mmsi FROM fx_vessels)")
def _(spark, sf):
    return op.orphans(view(spark, sf, "fx_runs").select("run_id", "mmsi"), "mmsi", view(spark, sf, "fx_vessels"), "mmsi")


CHAIN_SQL = """ev AS (SELECT id, entity_type, entity_id, occurred_s, '{"action":"' || action || '","actor_type":"' || actor_type || '","entity_id":"' || entity_id || '","entity_type":"' || entity_type || '","payload":"' || replace(payload, '"', '\\"') || '"}' AS js,
  row_number() OVER (PARTITION BY entity_id ORDER BY occurred_s, id) AS rn FROM fx_audit),
ch AS (SELECT id, entity_id, rn, CAST(NULL AS VARCHAR) AS prev, sha256(js) AS h FROM ev WHERE rn = 1 UNION ALL SELECT e.id, e.entity_id, e.rn, c.h, sha256(c.h || e.js) FROM ch c JOIN ev e ON e.entity_id = c.entity_id AND e.rn = c.rn + 1)"""


def _events(spark, sf):
    e = view(spark, sf, "fx_audit")
    return e.withColumn("payload_json", op.canonical_payload(["action", "actor_type", "entity_id", "entity_type", "payload"]))


@R.query("hash_chain", f"WITH RECURSIVE {CHAIN_SQL} SELECT id, entity_id, prev AS hash_chain_previous, h AS event_hash FROM ch")
def _(spark, sf):
    return op.hash_chain(_events(spark, sf)).select("id", "entity_id", "hash_chain_previous", "event_hash")


@R.query("verify_chain", "SELECT id, 'vessel' AS entity_type, entity_id, 'bad_hash' AS problem FROM fx_audit WHERE id % 97 = 5")
def _(spark, sf):
    # every 97th payload is altered after the chain was written
    c = op.hash_chain(_events(spark, sf))
    changed = F.when(F.col("id") % 97 == 5, F.concat("payload_json", F.lit(" "))).otherwise(F.col("payload_json"))
    return op.verify_chain(c.withColumn("payload_json", changed))


SEGMENT_SQL = f"""{CHAIN_SQL},
sg AS (SELECT id, entity_id, js, occurred_s // 3600 AS segment, row_number() OVER (PARTITION BY entity_id, occurred_s // 3600 ORDER BY occurred_s, id) AS k FROM ev),
sc AS (SELECT id, entity_id, segment, k, CAST(NULL AS VARCHAR) AS prev, sha256(js) AS h FROM sg WHERE k = 1
  UNION ALL SELECT g.id, g.entity_id, g.segment, g.k, c.h, sha256(c.h || g.js) FROM sc c JOIN sg g ON g.entity_id = c.entity_id AND g.segment = c.segment AND g.k = c.k + 1)"""


@R.query("segmented_chain", f"WITH RECURSIVE {SEGMENT_SQL} SELECT id, entity_id, segment, prev AS hash_chain_previous, h AS event_hash FROM sc")
def _(spark, sf):
    return op.segmented_chain(_events(spark, sf), 3600).select("id", "entity_id", "segment", "hash_chain_previous", "event_hash")


@R.query(
    "segment_links",
    f"""WITH RECURSIVE {SEGMENT_SQL},
    rt AS (SELECT entity_id, segment, count(*) AS n_events, max_by(h, k) AS root FROM sc GROUP BY 1, 2),
    nm AS (SELECT *, segment || ':' || n_events || ':' || root AS body, row_number() OVER (PARTITION BY entity_id ORDER BY segment) AS m FROM rt),
    ln AS (SELECT entity_id, segment, n_events, root, m, CAST(NULL AS VARCHAR) AS previous_link, sha256(body) AS link FROM nm WHERE m = 1
      UNION ALL SELECT n.entity_id, n.segment, n.n_events, n.root, n.m, l.link, sha256(l.link || n.body) FROM ln l JOIN nm n ON n.entity_id = l.entity_id AND n.m = l.m + 1)
    SELECT entity_id, segment, n_events, root, previous_link, link FROM ln""",
)
def _(spark, sf):
    return op.segment_links(op.segmented_chain(_events(spark, sf), 3600)).drop("entity_type")


@R.query(
    "verify_segments",
    """WITH sg AS (SELECT DISTINCT entity_id, occurred_s // 3600 AS segment FROM fx_audit),
    nb AS (SELECT *, lag(segment) OVER (PARTITION BY entity_id ORDER BY segment) AS p FROM sg)
    SELECT entity_id, occurred_s // 3600 AS segment, id, 'bad_hash' AS problem FROM fx_audit WHERE id % 97 = 5
    UNION ALL SELECT entity_id, segment, NULL, 'unlinked_segment' FROM nb WHERE segment % 7 = 3
    UNION ALL SELECT entity_id, segment, NULL, 'broken_segment_link' FROM nb WHERE segment % 7 <> 3 AND p % 7 = 3""",
)
def _(spark, sf):
    # every 97th payload is altered and the links of every 7th hour are lost after the chain was written
    c = op.segmented_chain(_events(spark, sf), 3600)
    changed = F.when(F.col("id") % 97 == 5, F.concat("payload_json", F.lit(" "))).otherwise(F.col("payload_json"))
    links = op.segment_links(c).filter("segment % 7 <> 3")
    return op.verify_segments(c.withColumn("payload_json", changed), links).select("entity_id", "segment", "id", "problem")


@R.query("audit_history", "SELECT id, occurred_s, action FROM fx_audit WHERE entity_id = '7' ORDER BY occurred_s DESC")
def _(spark, sf):
    return op.audit_history(view(spark, sf, "fx_audit"), "vessel", "7").select("id", "occurred_s", "action")


@R.query("finalise_dossiers", "SELECT dossier_id, 'finalized' AS status, CASE WHEN status = 'draft' THEN sha256(snapshot) END AS sha256 FROM fx_dossiers")
def _(spark, sf):
    d = view(spark, sf, "fx_dossiers").withColumn("sha256", F.lit(None).cast("string"))
    return op.finalise_dossiers(d).select("dossier_id", "status", "sha256")


@R.query("changed_finals", "SELECT dossier_id, CASE WHEN dossier_id % 41 = 0 THEN 'deleted' ELSE 'updated' END AS mutation FROM fx_dossiers WHERE status = 'finalized' AND (dossier_id % 41 = 0 OR dossier_id % 29 = 0)")
def _(spark, sf):
    d = view(spark, sf, "fx_dossiers")
    after = d.filter("dossier_id % 41 <> 0").withColumn("snapshot", F.when(F.col("dossier_id") % 29 == 0, F.lit("{}")).otherwise(F.col("snapshot")))
    return op.changed_finals(d, after, "dossier_id", ["snapshot"])


_TAGGED = {"fx_tracks": "seq", "fx_drafts": "seq", "fx_sar_targets": "target_id"}


def _sourced(spark, sf):
    return {n[3:]: view(spark, sf, n).withColumn("source", F.when(F.col(k) % 6 == 0, "demo").otherwise("live")) for n, k in _TAGGED.items()}


@R.query("tagged_counts", " UNION ALL ".join(f"SELECT '{n[3:]}' AS table_name, count(*) AS n FROM {n} WHERE {k} % 6 = 0" for n, k in _TAGGED.items()))
def _(spark, sf):
    return op.tagged_counts(_sourced(spark, sf), "demo")


@R.query("purge_source", "SELECT mmsi, count(*) AS n FROM fx_tracks WHERE seq % 6 <> 0 GROUP BY 1")
def _(spark, sf):
    return op.purge(_sourced(spark, sf)["tracks"], "demo").groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"))
