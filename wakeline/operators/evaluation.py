"""Quality measures of detectors, as aggregations over prediction tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.operators.drift import Uniform, hashed_uniform
from wakeline.operators.sequences import rank_in_group, running_total, value_steps
from wakeline.session import cut_lineage


def binary_metrics(preds: DataFrame, keys: list[str], thr: float = 0.5) -> DataFrame:
    """Confusion counts, precision, recall, F1 and false-positive rate (truth 0/1, prob)."""
    hit, pos = F.col("prob") >= thr, F.col("truth") == 1
    c = preds.groupBy(*keys).agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(~hit & pos).alias("fn")
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return c.select(
        *keys, "tp", "fp", "tn", "fn", precision.alias("precision"), recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"), ratio(fp, fp + tn).alias("fpr"),
    )


def roc_auc(preds: DataFrame, keys: list[str], steps: int = 256) -> DataFrame:
    """Rank AUC with half credit for ties; 0.5 when one class is missing.

    Equal probabilities are merged first and the running count is taken in two levels,
    so no single task sorts all predictions, saturated ones included.
    """
    g = preds.groupBy(*keys, "prob").agg(F.count_if(F.col("truth") == 1).alias("_p"), F.count_if(F.col("truth") != 1).alias("_q"))
    g = value_steps(g, keys, "prob", "_step", steps)
    c = running_total(g, keys, [F.col("prob")], F.col("_step"), F.col("_q"), "_cum")
    area = F.sum(F.col("_p") * (F.col("_cum") - F.col("_q") + F.col("_q") / 2))
    both = F.sum("_p") * F.sum("_q")
    return c.groupBy(*keys).agg(F.coalesce(F.try_divide(area, both.cast("double")), F.lit(0.5)).alias("auc"))


def calibration_error(preds: DataFrame, keys: list[str], bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins; the last bin is closed."""
    b = preds.withColumn("_bin", F.least(F.floor(F.col("prob") * bins), F.lit(bins - 1)))
    g = b.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.avg("prob").alias("_conf"), F.avg("truth").alias("_acc"))
    return g.groupBy(*keys).agg((F.sum(F.col("_n") * F.abs(F.col("_conf") - F.col("_acc"))) / F.sum("_n")).alias("ece"))


def mask_overlap(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """IoU and F1 of two pixel masks (scene_id, row, col, on) per scene."""
    eps = 1e-6
    j = pred.withColumnRenamed("on", "_a").join(truth.withColumnRenamed("on", "_b"), ["scene_id", "row", "col"], "full_outer")
    a, b = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    g = j.groupBy("scene_id").agg(F.count_if(a & b).alias("_i"), F.count_if(a | b).alias("_u"))
    return g.select(
        "scene_id", ((F.col("_i") + eps) / (F.col("_u") + eps)).alias("iou"),
        ((2 * F.col("_i") + eps) / (F.col("_i") + F.col("_u") + eps)).alias("f1"),
    )


def _logit(p: Column) -> Column:
    q = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(q / (1 - q))


def fit_temperature(preds: DataFrame, fit_half: Column, grid: list[float] | None = None, bins: int = 15) -> DataFrame:
    """Temperature with the least cross-entropy on one half, calibration error on the other.

    All grid values are measured in one aggregation: no row is repeated per value.
    """
    ts = grid or [round(0.5 + 0.05 * i, 2) for i in range(91)]
    d = preds.withColumn("_z", _logit(F.col("prob"))).withColumn("_fit", fit_half)

    def loss(t: float) -> Column:
        z = F.col("_z") / t
        # log(1 + exp(-|z|)) + max(z, 0) - z*y is the stable form of the cross-entropy
        return F.avg(F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - z * F.col("truth"))

    losses = d.filter("_fit").agg(F.array(*[F.struct(loss(t).alias("nll"), F.lit(t).alias("t")) for t in ts]).alias("l"))
    best = losses.select(F.array_min("l").alias("b")).first()["b"]  # two numbers: the fitted parameter
    scaled = d.filter(~F.col("_fit")).select(
        "truth", (1 / (1 + F.exp(-F.col("_z") / best["t"]))).alias("prob"), F.lit(best["t"]).alias("temperature"), F.lit(best["nll"]).alias("nll")
    )
    return calibration_error(scaled, ["temperature", "nll"], bins)


def best_log_temperature(scores: DataFrame, tolerance: float = 1e-9) -> tuple[float, float]:
    """log T and the cross-entropy at the temperature that minimises it, for rows (z, truth); T is not confined to a grid.

    The loss is convex in 1/T, so its slope along log T changes sign once. Safeguarded Newton: each round takes slope
    and curvature from one aggregation, narrows the bracket by the slope's sign, and halves the bracket where the
    Newton step would leave it. Data without a finite optimum (separable, or worse than a coin) end at the bracket's
    edge, log T = -20 or 20.
    """
    low, high, at = -20.0, 20.0, 0.0
    y = F.col("truth")
    for _ in range(100):
        u = F.col("z") * math.exp(-at)
        p = 1 / (1 + F.exp(-u))
        loss = F.log1p(F.exp(-F.abs(u))) + F.greatest(u, F.lit(0.0)) - u * y
        found = scores.agg(F.avg((y - p) * u).alias("slope"), F.avg(p * (1 - p) * u * u + (p - y) * u).alias("bend"), F.avg(loss).alias("nll")).first()
        slope, bend, nll = found
        if slope is None:
            return 0.0, 0.0
        low, high = (low, at) if slope > 0 else (at, high)
        step = at - slope / bend if bend > 0 else math.inf
        after = step if low < step < high else (low + high) / 2
        if slope == 0 or abs(after - at) <= tolerance:
            break
        at = after
    return at, nll


def fit_free_temperature(preds: DataFrame, fit_half: Column, bins: int = 15) -> DataFrame:
    """Like ``fit_temperature``, with the temperature found exactly (``best_log_temperature``) instead of on a grid."""
    d = preds.select("truth", _logit(F.col("prob")).alias("z"), fit_half.alias("_fit"))
    at, nll = best_log_temperature(cut_lineage(d.filter("_fit").select("z", "truth")))
    scaled = d.filter(~F.col("_fit")).select(
        "truth", (1 / (1 + F.exp(-F.col("z") * math.exp(-at)))).alias("prob"), F.lit(math.exp(at)).alias("temperature"), F.lit(nll).alias("nll")
    )
    return calibration_error(scaled, ["temperature", "nll"], bins)


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42, uniform: Uniform = hashed_uniform) -> DataFrame:
    """Mark int(n * share) rows of each label as validation, in pseudo-random order of the key."""
    d = rows.withColumn("_u", uniform(F.col(key), seed=seed))
    ranked = rank_in_group(d, [label], [F.col("_u"), F.col(key)], F.floor(F.col("_u") * 1024), "_rn")
    sizes = rows.groupBy(label).agg(F.floor(F.count(F.lit(1)) * share).alias("_k"))
    return ranked.join(sizes, label).withColumn("split", F.when(F.col("_rn") <= F.col("_k"), "validation").otherwise("train")).drop("_u", "_rn", "_k")


def ablation_table(preds: DataFrame, thr: float = 0.5) -> DataFrame:
    """All measures side by side per input mode."""
    k = ["mode"]
    return binary_metrics(preds, k, thr).join(roc_auc(preds, k), k).join(calibration_error(preds, k), k)
