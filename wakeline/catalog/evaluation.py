"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.catalog import Registry
from wakeline.catalog.sqltext import uniform_sql
from wakeline.fixtures import view
from wakeline.operators import evaluation as op
from wakeline.operators.drift import portable_uniform

R = Registry()

BIN_SQL = """bm AS (SELECT mode, tp, fp, tn, fn, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0) AS fpr
  FROM (SELECT mode, count(*) FILTER (prob >= 0.5 AND truth = 1) AS tp, count(*) FILTER (prob >= 0.5 AND truth = 0) AS fp, count(*) FILTER (prob < 0.5 AND truth = 0) AS tn, count(*) FILTER (prob < 0.5 AND truth = 1) AS fn FROM fx_preds GROUP BY mode)),
auc AS (SELECT mode, coalesce((sum(r) FILTER (truth = 1) - count(*) FILTER (truth = 1) * (count(*) FILTER (truth = 1) + 1) / 2) / nullif(count(*) FILTER (truth = 1) * count(*) FILTER (truth = 0), 0), 0.5) AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY mode ORDER BY prob) + (count(*) OVER (PARTITION BY mode, prob) - 1) / 2 AS r FROM fx_preds) GROUP BY mode),
ece AS (SELECT mode, sum(n * abs(c - a)) / sum(n) AS ece FROM (SELECT mode, least(floor(prob * 15), 14) AS b, count(*) AS n, avg(prob) AS c, avg(truth) AS a FROM fx_preds GROUP BY 1, 2) GROUP BY mode)"""


def _r(d, *cols):
    for c in cols:
        d = d.withColumn(c, F.round(c, 6))
    return d


@R.query("binary_metrics", f"WITH {BIN_SQL} SELECT mode, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, round(fpr, 6) AS fpr FROM bm")
def _(spark, sf):
    return _r(op.binary_metrics(view(spark, sf, "fx_preds"), ["mode"]), "precision", "recall", "f1", "fpr")


@R.query("roc_auc", f"WITH {BIN_SQL} SELECT mode, round(auc, 6) AS auc FROM auc")
def _(spark, sf):
    return _r(op.roc_auc(view(spark, sf, "fx_preds"), ["mode"]), "auc")


@R.query("calibration_error", f"WITH {BIN_SQL} SELECT mode, round(ece, 6) AS ece FROM ece")
def _(spark, sf):
    return _r(op.calibration_error(view(spark, sf, "fx_preds"), ["mode"]), "ece")


@R.query("ablation_table", f"WITH {BIN_SQL} SELECT mode, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, round(fpr, 6) AS fpr, round(auc, 6) AS auc, round(ece, 6) AS ece FROM bm JOIN auc USING (mode) JOIN ece USING (mode)")
def _(spark, sf):
    return _r(op.ablation_table(view(spark, sf, "fx_preds")), "precision", "recall", "f1", "fpr", "auc", "ece")


@R.query(
    "mask_overlap",
    """SELECT scene_id, round((i + 1e-6) / (u + 1e-6), 6) AS iou, round((2 * i + 1e-6) / (i + u + 1e-6), 6) AS f1 FROM (SELECT scene_id, count(*) FILTER (prob >= 0.5 AND (row + col) % 5 <> 0) AS i, count(*) FILTER (prob >= 0.5) AS u FROM fx_mask GROUP BY 1)""",
)
def _(spark, sf):
    m = view(spark, sf, "fx_mask")
    pred = m.select("scene_id", "row", "col", (F.col("prob") >= 0.5).alias("on"))
    truth = m.select("scene_id", "row", "col", ((F.col("prob") >= 0.5) & ((F.col("row") + F.col("col")) % 5 != 0)).alias("on"))
    return _r(op.mask_overlap(pred, truth), "iou", "f1")


@R.query(
    "fit_temperature",
    """WITH z AS (SELECT doc_id, truth, ln(q / (1 - q)) AS z FROM (SELECT *, least(1 - 1e-6, greatest(1e-6, prob)) AS q FROM fx_preds)),
    nll AS (SELECT round(0.5 + 0.05e0 * i, 2) AS t, avg(ln(1 + exp(-abs(z / round(0.5 + 0.05e0 * i, 2)))) + greatest(z / round(0.5 + 0.05e0 * i, 2), 0) - z / round(0.5 + 0.05e0 * i, 2) * truth) AS nll FROM z, unnest(generate_series(0, 90)) g(i) WHERE doc_id % 2 = 0 GROUP BY 1),
    best AS (SELECT t, nll FROM nll ORDER BY nll, t LIMIT 1), p AS (SELECT truth, 1 / (1 + exp(-z / t)) AS prob, t, nll FROM z, best WHERE doc_id % 2 = 1)
    SELECT t AS temperature, round(nll, 6) AS nll, round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM (SELECT t, nll, least(floor(prob * 15), 14) AS b, count(*) AS n, avg(prob) AS c, avg(truth) AS a FROM p GROUP BY 1, 2, 3) GROUP BY t, nll""",
)
def _(spark, sf):
    return _r(op.fit_temperature(view(spark, sf, "fx_preds"), F.col("doc_id") % 2 == 0), "nll", "ece")


_LEANT = "SELECT doc_id, CASE WHEN (doc_id * 613) % 1000 / 1000e0 < 0.3e0 + prob * 0.4e0 THEN 1 ELSE 0 END AS truth, prob FROM fx_preds"


@R.query(
    "fit_free_temperature",
    f"""WITH RECURSIVE z AS (SELECT doc_id, truth, ln(q / (1 - q)) AS z FROM (SELECT *, least(1 - 1e-6, greatest(1e-6, prob)) AS q FROM ({_LEANT}))),
    cut(k, low, high) AS (SELECT 0, -20e0, 20e0 UNION ALL
      SELECT k + 1, CASE WHEN slope > 0 THEN low ELSE mid END, CASE WHEN slope > 0 THEN mid ELSE high END FROM (
        SELECT k, low, high, (low + high) / 2 AS mid, avg((truth - 1 / (1 + exp(-z * exp(-(low + high) / 2)))) * z * exp(-(low + high) / 2)) AS slope
        FROM cut, z WHERE doc_id % 2 = 0 AND k < 60 GROUP BY k, low, high)),
    best AS (SELECT exp(max((low + high) / 2) FILTER (k = 60)) AS t FROM cut),
    fitted AS (SELECT avg(ln(1 + exp(-abs(z / t))) + greatest(z / t, 0) - z / t * truth) AS nll FROM z, best WHERE doc_id % 2 = 0),
    p AS (SELECT truth, 1 / (1 + exp(-z / t)) AS prob FROM z, best WHERE doc_id % 2 = 1)
    SELECT round(any_value(t), 5) AS temperature, round(any_value(nll), 6) AS nll, round(sum(n * abs(c - a)) / sum(n), 6) AS ece
    FROM (SELECT least(floor(prob * 15), 14) AS b, count(*) AS n, avg(prob) AS c, avg(truth) AS a FROM p GROUP BY 1), best, fitted""",
)
def _(spark, sf):
    preds = view(spark, sf, "fx_preds").withColumn("truth", F.when((F.col("doc_id") * 613) % 1000 / 1000.0 < 0.3 + F.col("prob") * 0.4, 1).otherwise(0))
    d = op.fit_free_temperature(preds, F.col("doc_id") % 2 == 0)
    return _r(d, "nll", "ece").withColumn("temperature", F.round("temperature", 5))


@R.query(
    "stratified_split",
    f"""SELECT doc_id, truth, CASE WHEN row_number() OVER (PARTITION BY truth ORDER BY {uniform_sql(['doc_id'], 42)}, doc_id) <= floor(count(*) OVER (PARTITION BY truth) * 0.2e0) THEN 'validation' ELSE 'train' END AS split FROM fx_preds""",
)
def _(spark, sf):
    return op.stratified_split(view(spark, sf, "fx_preds").select("doc_id", "truth"), "truth", "doc_id", uniform=portable_uniform)
