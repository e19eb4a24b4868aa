"""Drift-ensemble queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.catalog import Registry
from wakeline.catalog.contacts import _km
from wakeline.catalog.sqltext import of_runs
from wakeline.fixtures import view
from wakeline.operators import drift as op
from wakeline.operators.contacts import candidate_filter
from wakeline.operators.windows import facts_of_runs

R = Registry()
WINDOW_S = 12 * 3600

# what is mapped are the positions of all vessels around a scene before its capture
ENDS_SQL = f"""bnd AS (SELECT scene_id, captured_s, spill_lat - 0.31 AS lat_lo, spill_lat + 0.31 AS lat_hi, spill_lon - 0.31 AS lon_lo, spill_lon + 0.31 AS lon_hi FROM fx_scenes),
ept AS (SELECT b.scene_id, t.lat, t.lon FROM bnd b JOIN fx_tracks t ON t.ts_s BETWEEN captured_s - {WINDOW_S} AND captured_s AND t.lat BETWEEN lat_lo AND lat_hi AND t.lon BETWEEN lon_lo AND lon_hi)"""
HEAT_SQL = f"""{ENDS_SQL}, cell AS (SELECT e.scene_id, least(CAST(floor((lat - lat_lo) / 0.02) AS INTEGER), 29) AS iy, least(CAST(floor((lon - lon_lo) / 0.02) AS INTEGER), 29) AS ix FROM ept e JOIN bnd USING (scene_id)
   WHERE lat >= lat_lo AND lat <= lat_lo + 30 * 0.02 AND lon >= lon_lo AND lon <= lon_lo + 30 * 0.02),
heat AS (SELECT *, CAST(sum(n) OVER (PARTITION BY scene_id) AS BIGINT) AS total FROM (SELECT scene_id, iy, ix, count(*) AS n FROM cell GROUP BY 1, 2, 3)),
cont AS (SELECT h.*, level FROM (SELECT *, sum(n) OVER (PARTITION BY scene_id ORDER BY n DESC, iy, ix ROWS UNBOUNDED PRECEDING) - n AS before FROM heat) h, (VALUES (0.5e0), (0.75e0), (0.9e0)) l(level) WHERE before < level * total)"""


def _bounds(spark, sf):
    s = view(spark, sf, "fx_scenes")
    return s.select(
        "scene_id", (F.col("spill_lat") - 0.31).alias("lat_lo"), (F.col("spill_lat") + 0.31).alias("lat_hi"),
        (F.col("spill_lon") - 0.31).alias("lon_lo"), (F.col("spill_lon") + 0.31).alias("lon_hi"),
    )


def _heat(spark, sf):
    b = _bounds(spark, sf)
    boxes = b.join(view(spark, sf, "fx_scenes").select("scene_id", "captured_s"), "scene_id").select(
        "scene_id", "captured_s", *[F.col(f"{c}_{e}").alias(f"{m}_{c}") for c in ("lat", "lon") for e, m in (("lo", "min"), ("hi", "max"))]
    )
    points = candidate_filter(boxes, view(spark, sf, "fx_tracks"), WINDOW_S).select("scene_id", "lat", "lon")
    return op.heatmap(points.join(b, "scene_id"))


@R.query("heatmap", f"WITH {HEAT_SQL} SELECT scene_id, iy, ix, n, total, round(n::DOUBLE / total, 6) AS prob FROM heat")
def _(spark, sf):
    return _heat(spark, sf).withColumn("prob", F.round("prob", 6))


@R.query("contours", f"WITH {HEAT_SQL} SELECT scene_id, level, count(*) AS cells, CAST(sum(n) AS BIGINT) AS mass, CAST(sum(iy * 100 + ix) AS BIGINT) AS cell_sum FROM cont GROUP BY 1, 2")
def _(spark, sf):
    d = op.contours(_heat(spark, sf))
    return d.groupBy("scene_id", "level").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("mass"), F.sum(F.col("iy") * 100 + F.col("ix")).alias("cell_sum"))


_PEAK = "peak AS (SELECT h.scene_id, round(lat_lo + (iy + 0.5) * 0.02, 6) AS peak_lat, round(lon_lo + (ix + 0.5) * 0.02, 6) AS peak_lon, round(n::DOUBLE / total, 6) AS peak_prob FROM heat h JOIN bnd USING (scene_id) QUALIFY row_number() OVER (PARTITION BY h.scene_id ORDER BY n DESC, iy, ix) = 1)"


@R.query("peak_cell", f"WITH {HEAT_SQL}, {_PEAK} SELECT * FROM peak")
def _(spark, sf):
    d = op.peak_cell(_heat(spark, sf), _bounds(spark, sf))
    return d.select("scene_id", *[F.round(c, 6).alias(c) for c in ("peak_lat", "peak_lon", "peak_prob")])


_BOX = "box AS (SELECT scene_id, level, count(*) AS n_cells, round(any_value(lat_lo) + min(iy) * 0.02, 6) AS min_lat, round(any_value(lat_lo) + max(iy) * 0.02, 6) AS max_lat, round(any_value(lon_lo) + min(ix) * 0.02, 6) AS min_lon, round(any_value(lon_lo) + max(ix) * 0.02, 6) AS max_lon FROM cont JOIN bnd USING (scene_id) GROUP BY 1, 2)"


@R.query("contour_boxes", f"WITH {HEAT_SQL}, {_BOX} SELECT *, 5 AS ring_size FROM box")
def _(spark, sf):
    d = op.contour_boxes(op.contours(_heat(spark, sf)), _bounds(spark, sf))
    return d.select("scene_id", "level", "n_cells", *[F.round(c, 6).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")], F.size("ring").alias("ring_size"))


@R.query(
    "origin_summary",
    f"WITH {HEAT_SQL}, {_PEAK}, {_BOX} SELECT p.scene_id, p.peak_lat, p.peak_lon, captured_s - 43200 AS window_start_s, captured_s AS window_end_s, (SELECT string_agg(CAST(n_cells AS VARCHAR), ',' ORDER BY level) FROM box b WHERE b.scene_id = p.scene_id) AS contour_cells FROM peak p JOIN fx_scenes USING (scene_id)",
)
def _(spark, sf):
    d = op.origin_summary(_heat(spark, sf), _bounds(spark, sf), view(spark, sf, "fx_scenes"))
    cells = F.from_json("summary", "struct<contours:array<struct<level:double,n_cells:bigint>>>")["contours"]
    return d.select(
        "scene_id", F.round("peak_lat", 6).alias("peak_lat"), F.round("peak_lon", 6).alias("peak_lon"), "window_start_s", "window_end_s",
        F.array_join(F.transform(cells, lambda c: c["n_cells"].cast("string")), ",").alias("contour_cells"),
    )


@R.query(
    "contour_candidates",
    f"""WITH {HEAT_SQL}, box75 AS (SELECT scene_id, any_value(lat_lo) + min(iy) * 0.02 AS min_lat, any_value(lat_lo) + max(iy) * 0.02 AS max_lat, any_value(lon_lo) + min(ix) * 0.02 AS min_lon, any_value(lon_lo) + max(ix) * 0.02 AS max_lon FROM cont JOIN bnd USING (scene_id) WHERE level = 0.75 GROUP BY 1)
    SELECT b.scene_id, t.mmsi, count(*) AS n FROM box75 b JOIN fx_scenes s USING (scene_id) JOIN fx_tracks t ON t.ts_s BETWEEN captured_s - 43200 AND captured_s AND t.lat BETWEEN min_lat AND max_lat AND t.lon BETWEEN min_lon AND max_lon GROUP BY 1, 2""",
)
def _(spark, sf):
    boxes = op.contour_boxes(op.contours(_heat(spark, sf), (0.75,)), _bounds(spark, sf)).join(view(spark, sf, "fx_scenes").select("scene_id", "captured_s"), "scene_id")
    d = candidate_filter(boxes.drop("ring", "level", "n_cells"), view(spark, sf, "fx_tracks"))
    return d.groupBy("scene_id", "mmsi").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    "forward_scores",
    f"""WITH fc AS (SELECT r.run_id, r.scene_id, r.mmsi, avg(f.lat) AS c_lat, avg(f.lon) AS c_lon FROM {of_runs('fx_tracks', 'ts_s', WINDOW_S, 0)} GROUP BY 1, 2, 3)
    SELECT run_id, scene_id, mmsi, round({_km('c_lat', 'c_lon', 'spill_lat', 'spill_lon')}, 4) AS distance_km, round(greatest(0e0, 1 - {_km('c_lat', 'c_lon', 'spill_lat', 'spill_lon')} / 30), 5) AS forward_score FROM fc JOIN fx_scenes USING (scene_id)""",
    whole=True,
)
def _(spark, sf):
    scenes = view(spark, sf, "fx_scenes")
    points = facts_of_runs(view(spark, sf, "fx_runs"), scenes, view(spark, sf, "fx_tracks"), "ts_s", WINDOW_S, 0)
    d = op.forward_scores(points.select("run_id", "scene_id", "mmsi", "lat", "lon"), scenes)
    return d.select("run_id", "scene_id", "mmsi", F.round("distance_km", 4).alias("distance_km"), F.round("forward_score", 5).alias("forward_score"))


def _requested(spark, sf):
    r = view(spark, sf, "fx_runs").join(view(spark, sf, "fx_scenes"), "scene_id")
    fp = op.run_fingerprint(F.col("scene_id"), F.col("scene_id"), F.col("spill_lon"), F.col("spill_lat"), F.col("captured_s"), 12, 100, "wave")
    return r.select("run_id", "scene_id", fp.alias("run_fingerprint"), F.col("captured_s").alias("started_s"), F.when(F.col("scene_id") % 3 == 0, "completed").otherwise("failed").alias("status"))


_FP = "sha256(scene_id || ':' || scene_id || ':' || printf('%.5f', spill_lon) || ':' || printf('%.5f', spill_lat) || ':' || strftime(make_timestamp(captured_s * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00:12:100:wave')"


@R.query("dedupe_runs", f"SELECT {_FP} AS run_fingerprint, min(run_id) AS run_id FROM fx_runs JOIN fx_scenes USING (scene_id) WHERE scene_id % 3 <> 0 GROUP BY 1", whole=True)
def _(spark, sf):
    r = _requested(spark, sf)
    return op.new_runs(r, r)


@R.query("runs_by_scene", "SELECT run_id, scene_id, captured_s AS started_s FROM fx_runs JOIN fx_scenes USING (scene_id) WHERE scene_id = 4 ORDER BY started_s DESC, run_id DESC")
def _(spark, sf):
    return op.runs_of(_requested(spark, sf), "scene_id", 4).select("run_id", "scene_id", "started_s")
