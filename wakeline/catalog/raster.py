"""Pixel-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.catalog import Registry
from wakeline.catalog.contacts import WIND_SQL
from wakeline.fixtures import view
from wakeline.operators import raster as op
from wakeline.operators.contacts import resolve_wind

R = Registry()


@R.query(
    "normalise_scene",
    """WITH q AS (SELECT scene_id, quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.99) AS p99 FROM fx_pixels GROUP BY 1)
    SELECT scene_id, count(*) AS n, round(sum(least(1e0, greatest(0e0, (value - p1) / (p99 - p1)))), 5) AS total, count(*) FILTER (value >= p99) AS saturated FROM fx_pixels JOIN q USING (scene_id) GROUP BY 1""",
)
def _(spark, sf):
    d = op.normalise(view(spark, sf, "fx_pixels"))
    return d.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 5).alias("total"), F.count_if(F.col("value") >= 1).alias("saturated"))


@R.query(
    "normalise_bytes",
    "SELECT scene_id, round(sum(value * CASE WHEN scene_id % 2 = 0 THEN 200e0 / 255 ELSE 1e0 END), 4) AS total FROM fx_pixels GROUP BY 1",
)
def _(spark, sf):
    p = view(spark, sf, "fx_pixels").withColumn("value", F.col("value") * F.when(F.col("scene_id") % 2 == 0, 200.0).otherwise(1.0))
    return op.normalise(p, "bytes").groupBy("scene_id").agg(F.round(F.sum("value"), 4).alias("total"))


CFAR_SQL = """med AS (SELECT scene_id, median(value) AS md FROM fx_pixels GROUP BY 1),
b1 AS (SELECT scene_id, row, col, value, sum(value) OVER o AS so, count(*) OVER o AS co, sum(value) OVER i AS si, count(*) OVER i AS ci FROM fx_pixels
  WINDOW o AS (PARTITION BY scene_id, row ORDER BY col RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING), i AS (PARTITION BY scene_id, row ORDER BY col RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
b2 AS (SELECT scene_id, row, col, value, sum(so) OVER o AS so, sum(co) OVER o AS co, sum(si) OVER i AS si, sum(ci) OVER i AS ci FROM b1
  WINDOW o AS (PARTITION BY scene_id, col ORDER BY row RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING), i AS (PARTITION BY scene_id, col ORDER BY row RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
cfar AS (SELECT scene_id, row, col, value FROM b2 JOIN med USING (scene_id) WHERE value > 8 * ((so + (169 - co) * md) - (si + (25 - ci) * md)) / 144)"""


@R.query("ca_cfar", f"WITH {CFAR_SQL} SELECT * FROM cfar")
def _(spark, sf):
    return op.ca_cfar(view(spark, sf, "fx_pixels"))


@R.query(
    "sar_contacts",
    f"""WITH {CFAR_SQL} SELECT scene_id, n AS sar_id, 'SAR-' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS target_id, round(spill_lat + (row / 64 - 0.5) * 0.4, 5) AS lat, round(spill_lon + (col / 64 - 0.5) * 0.4, 5) AS lon,
    round(value, 3) AS intensity, round(40 + value * 260, 1) AS length_m, round(least(0.99, 0.65 + value * 0.3), 2) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY row, col) AS n FROM cfar) JOIN fx_scenes USING (scene_id)""",
)
def _(spark, sf):
    d = op.contacts(op.ca_cfar(view(spark, sf, "fx_pixels")), view(spark, sf, "fx_scenes"), 64, 0.4)
    return d.drop("row", "col")


def _components(runs: str) -> str:
    """Components by reachability over pixel runs: quadratic per component, but exact."""
    return f"""g AS (SELECT *, col - row_number() OVER (PARTITION BY scene_id, row ORDER BY col) AS gid FROM {runs}),
rn AS (SELECT scene_id, row, min(col) AS c0, max(col) AS c1, sum(prob) AS w, row * 16777216 + min(col) AS id FROM g GROUP BY scene_id, row, gid),
ed AS (SELECT a.scene_id, a.id AS s, b.id AS t FROM rn a JOIN rn b ON a.scene_id = b.scene_id AND abs(a.row - b.row) = 1 AND a.c0 <= b.c1 + 1 AND b.c0 <= a.c1 + 1),
reach AS (SELECT scene_id, id, id AS label FROM rn UNION SELECT e.scene_id, e.t, r.label FROM reach r JOIN ed e ON e.scene_id = r.scene_id AND e.s = r.id AND e.t > r.label),
lab AS (SELECT rn.*, l.label FROM rn JOIN (SELECT scene_id, id, min(label) AS label FROM reach GROUP BY 1, 2) l USING (scene_id, id))"""


_RAW = "rawon AS (SELECT * FROM fx_mask WHERE prob >= 0.5)"
_CLOSED = """dil AS (SELECT *, greatest(max(o) OVER (PARTITION BY scene_id, row ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), max(o) OVER (PARTITION BY scene_id, col ORDER BY row ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS d
  FROM (SELECT *, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS o FROM fx_mask)),
ero AS (SELECT *, least(min(d) OVER (PARTITION BY scene_id, row ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), min(d) OVER (PARTITION BY scene_id, col ORDER BY row ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS e FROM dil),
closed AS (SELECT scene_id, row, col, prob FROM ero WHERE e = 1)"""


@R.query("clusters", f"WITH RECURSIVE {_RAW}, {_components('rawon')} SELECT scene_id, label, CAST(sum(c1 - c0 + 1) AS BIGINT) AS area, round(sum(row * (c1 - c0 + 1)) / sum(c1 - c0 + 1), 4) AS row_centroid, round(sum((c0 + c1) * (c1 - c0 + 1) / 2) / sum(c1 - c0 + 1), 4) AS col_centroid FROM lab GROUP BY 1, 2 HAVING sum(c1 - c0 + 1) >= 2")
def _(spark, sf):
    d = op.clusters(op.label_components(op.pixel_runs(view(spark, sf, "fx_mask").filter("prob >= 0.5"), "prob")), 2)
    return d.withColumn("row_centroid", F.round("row_centroid", 4)).withColumn("col_centroid", F.round("col_centroid", 4))


@R.query("clean_mask", f"WITH RECURSIVE {_CLOSED}, {_components('closed')} SELECT scene_id, label, CAST(sum(c1 - c0 + 1) AS BIGINT) AS pixels, min(row) AS top, max(c1) AS right_col FROM lab GROUP BY 1, 2 HAVING sum(c1 - c0 + 1) >= 50")
def _(spark, sf):
    d = op.clean_mask(view(spark, sf, "fx_mask"))
    return d.groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("pixels"), F.min("row").alias("top"), F.max("col").alias("right_col"))


@R.query(
    "component_stats",
    f"""WITH RECURSIVE {_CLOSED}, {_components('closed')}, cs AS (SELECT scene_id, label, min(row) AS y0, max(row) + 1 AS y1, min(c0) AS x0, max(c1) + 1 AS x1, CAST(sum(c1 - c0 + 1) AS BIGINT) AS pixel_area, round(sum(w) / sum(c1 - c0 + 1), 4) AS confidence,
     sum(row * (c1 - c0 + 1)) / sum(c1 - c0 + 1) AS rc, sum((c0 + c1) * (c1 - c0 + 1) / 2) / sum(c1 - c0 + 1) AS cc FROM lab GROUP BY 1, 2)
    SELECT c.scene_id, label, y0, y1, x0, x1, pixel_area, c.confidence, greatest(0.001e0, round(pixel_area * 100 / 1e6, 4)) AS area_sq_km, round(spill_lon - 0.2 + cc / 64 * 0.4, 6) AS lon, round(spill_lat + 0.2 - rc / 64 * 0.4, 6) AS lat FROM cs c JOIN fx_scenes USING (scene_id)""",
)
def _(spark, sf):
    s = view(spark, sf, "fx_scenes")
    boxes = s.select(
        "scene_id", (F.col("spill_lon") - 0.2).alias("min_lon"), (F.col("spill_lat") - 0.2).alias("min_lat"),
        (F.col("spill_lon") + 0.2).alias("max_lon"), (F.col("spill_lat") + 0.2).alias("max_lat"),
    )
    runs = op.label_components(op.pixel_runs(op.closed_mask(view(spark, sf, "fx_mask")), "prob"))
    d = op.pixel_to_geo(op.component_stats(runs), boxes, 64, 64)
    return d.select("scene_id", "label", "y0", "y1", "x0", "x1", "pixel_area", "confidence", "area_sq_km", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


_TILE = "im AS (SELECT s_suppkey AS scene_id, 100 + (s_suppkey * 37) % 900 AS h, 100 + (s_suppkey * 53) % 900 AS w FROM supplier)"


@R.query(
    "tiles",
    f"""WITH {_TILE}, y AS (SELECT scene_id, h, w, unnest(CASE WHEN h <= 256 AND w <= 256 THEN [0] ELSE list_distinct(list_concat(generate_series(0, greatest(0, h - 256), 192), [greatest(0, h - 256)])) END) AS y0 FROM im),
    x AS (SELECT scene_id, h, w, y0, unnest(CASE WHEN h <= 256 AND w <= 256 THEN [0] ELSE list_distinct(list_concat(generate_series(0, greatest(0, w - 256), 192), [greatest(0, w - 256)])) END) AS x0 FROM y)
    SELECT scene_id, h, w, y0, x0, least(h, y0 + 256) AS y1, least(w, x0 + 256) AS x1 FROM x""",
)
def _(spark, sf):
    s = view(spark, sf, "supplier")
    return op.tiles(s.select(F.col("s_suppkey").alias("scene_id"), (100 + (F.col("s_suppkey") * 37) % 900).alias("h"), (100 + (F.col("s_suppkey") * 53) % 900).alias("w")))


@R.query(
    "blend_tiles",
    """WITH w AS (SELECT scene_id, tile_row + row AS row, tile_col + col AS col, prob, greatest(0.05e0, 0.5e0 * (1 + cos(pi() * least(1e0, sqrt(pow(-1 + 2 * row / 31, 2) + pow(-1 + 2 * col / 31, 2)))))) AS w FROM fx_tile_preds),
    b AS (SELECT scene_id, row, col, sum(w * prob) / greatest(sum(w), 1e-6) AS p FROM w GROUP BY 1, 2, 3) SELECT scene_id, row, count(*) AS n, round(sum(p), 5) AS total FROM b GROUP BY 1, 2""",
)
def _(spark, sf):
    d = op.blend(view(spark, sf, "fx_tile_preds"), 32)
    return d.groupBy("scene_id", "row").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("prob"), 5).alias("total"))


@R.query(
    "crop_boxes",
    """WITH g AS (SELECT scene_id, max(row) + 1 AS h, max(col) + 1 AS w, count(*) FILTER (prob > 0.9) AS oil_pixels, min(row) FILTER (prob > 0.9) AS r0, max(row) FILTER (prob > 0.9) AS r1, min(col) FILTER (prob > 0.9) AS c0, max(col) FILTER (prob > 0.9) AS c1 FROM fx_mask GROUP BY 1),
    b AS (SELECT scene_id, oil_pixels, greatest(0, r0 - 4) AS y0, least(h, r1 + 5) AS y1, greatest(0, c0 - 4) AS x0, least(w, c1 + 5) AS x1 FROM g WHERE oil_pixels > 0)
    SELECT *, round(oil_pixels / ((y1 - y0) * (x1 - x0)), 6) AS oil_fraction, CASE WHEN oil_pixels / ((y1 - y0) * (x1 - x0)) >= 0.05 THEN 'true' ELSE 'false' END AS valid FROM b""",
)
def _(spark, sf):
    d = op.crop_boxes(view(spark, sf, "fx_mask"), pad=4, thr=0.9)
    return d.withColumn("oil_fraction", F.round("oil_fraction", 6)).withColumn("valid", F.col("valid").cast("string"))


FEAT_SQL = """px AS (SELECT scene_id, row AS r, col AS c, value * 255 AS v FROM fx_pixels),
gr AS (SELECT *, CASE WHEN c = 0 THEN xr - v WHEN c = 63 THEN v - xl ELSE (xr - xl) / 2 END AS gx, CASE WHEN r = 0 THEN yd - v WHEN r = 63 THEN v - yu ELSE (yd - yu) / 2 END AS gy FROM
  (SELECT *, lag(v) OVER a AS xl, lead(v) OVER a AS xr, lag(v) OVER b AS yu, lead(v) OVER b AS yd, avg(v) OVER (PARTITION BY scene_id) AS m, stddev_pop(v) OVER (PARTITION BY scene_id) AS s FROM px
   WINDOW a AS (PARTITION BY scene_id, r ORDER BY c), b AS (PARTITION BY scene_id, c ORDER BY r))),
fe AS (SELECT scene_id, any_value(m) AS mean, any_value(s) AS std, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.15) AS p15, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.85) AS p85, quantile_cont(v, 0.95) AS p95,
   avg(pow(v - m, 2)) AS m2, avg(pow(v - m, 3)) AS m3, avg(pow(v - m, 4)) AS m4, avg(sqrt(gx * gx + gy * gy)) AS grad_mean, stddev_pop(sqrt(gx * gx + gy * gy)) AS grad_std, quantile_cont(sqrt(gx * gx + gy * gy), 0.9) AS grad_p90,
   avg(CASE WHEN v < m - 0.5 * s THEN 1 ELSE 0 END) AS dark_05, avg(CASE WHEN v < m - s THEN 1 ELSE 0 END) AS dark_10, avg(CASE WHEN v < m - 1.5 * s THEN 1 ELSE 0 END) AS dark_15, min(v) AS mn, max(v) AS mx, avg(v) FILTER (r >= 16 AND r < 48 AND c >= 16 AND c < 48) AS ce FROM gr GROUP BY 1),
feat AS (SELECT scene_id, mean, std, p5, p15, p25, p50, p75, p85, p95, p75 - p25 AS iqr, p95 - p5 AS spread, p95 / greatest(1, p5) AS contrast, std / greatest(1, mean) AS cv, m3 / (pow(m2, 1.5) + 1e-7) AS skew, m4 / (m2 * m2 + 1e-7) - 3 AS kurtosis,
   grad_mean, grad_std, grad_p90, dark_05, dark_10, dark_15, mn AS min, mx AS max, mx - mn AS range, ce / greatest(1, mean) AS centre_ratio FROM fe)"""


def _features(spark, sf):
    return op.patch_features(view(spark, sf, "fx_pixels").withColumn("value", F.col("value") * 255))


@R.query("patch_features", f"WITH {FEAT_SQL} SELECT scene_id, {', '.join(f'round({c}, 5) AS {c}' for c in op.FEATURES)} FROM feat")
def _(spark, sf):
    return _features(spark, sf).select("scene_id", *[F.round(c, 5).alias(c) for c in op.FEATURES])


@R.query("damping_rule", f"WITH {FEAT_SQL} SELECT scene_id, CASE WHEN std < 18 AND contrast < 2.5 THEN 0.85e0 WHEN cv > 0.22 OR contrast > 4 THEN 0.1e0 ELSE 0.5e0 END AS prob FROM feat")
def _(spark, sf):
    return op.damping_rule(_features(spark, sf)).select("scene_id", "prob")


@R.query(
    "filter_candidates",
    f"""WITH {WIND_SQL} SELECT s.scene_id, CASE WHEN confidence >= 0.75 THEN 'confirmed' ELSE 'rejected' END AS status, round(confidence, 4) AS filter_confidence, round(w.ms, 4) AS wind_ms, CASE WHEN w.u IS NULL THEN 'None' ELSE 'ERA5' END AS source,
    CASE WHEN confidence < 0.75 THEN 'Lookalike detected (P(Oil)=' || printf('%.2f', confidence) || ' < 0.75). Damping / Wind profile matches low-wind shadow or biogenic film.' END AS review_notes FROM fx_scenes s JOIN wind w USING (scene_id)""",
)
def _(spark, sf):
    c = resolve_wind(view(spark, sf, "fx_scenes")).select("scene_id", F.col("confidence").alias("prob"), "u10", "v10")
    d = op.filter_candidates(c, 0.75)
    return d.select("scene_id", "status", "filter_confidence", F.round("wind_ms", 4).alias("wind_ms"), "source", "review_notes")
