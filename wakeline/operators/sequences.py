"""Ordered-sequence primitives that never put one whole vessel into one task.

A plain window over (vessel order by time) sends every row of a vessel to one
task. One vessel may hold a third of all rows, so the primitives here partition
by (keys, time bucket) and carry only one summary row per bucket across bucket
borders. The result is the same as with the plain window. After deduplication a
vessel has at most one row per second, so no bucket can exceed its width in rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.session import cut_lineage, small_side

BUCKET_S = 6 * 3600


def _bucketed(df: DataFrame, keys: list[str], ts: str, bucket_s: int, bucket: Column | None = None) -> DataFrame:
    """One shuffle on (keys, bucket), shared by the windows and the summaries."""
    b = F.floor(F.col(ts) / bucket_s).cast("long") if bucket is None else bucket
    return df.withColumn("_b", b).repartition(
        *[F.col(k) for k in keys], F.col("_b")
    )


def neighbours(
    df: DataFrame, keys: list[str], ts: str, cols: list[str], bucket_s: int = BUCKET_S, bucket: Column | None = None
) -> DataFrame:
    """Add structs ``prev`` and ``next``: the adjacent row of the same keys in ts order.

    ``(keys, ts)`` must be unique (see ``dedupe_track``). ``bucket`` replaces the time
    bucket where ``ts`` is not a number; it must not decrease along ``ts``.
    """
    rows = _bucketed(df, keys, ts, bucket_s, bucket)
    item = F.struct(ts, *cols)
    # one aggregate per column keeps the buffers primitive, hence hash aggregation
    edges = rows.groupBy(*keys, "_b").agg(
        *[F.min_by(F.col(c), F.col(ts)).alias(f"_f_{c}") for c in (ts, *cols)],
        *[F.max_by(F.col(c), F.col(ts)).alias(f"_l_{c}") for c in (ts, *cols)],
    )
    by_bucket = Window.partitionBy(*keys).orderBy("_b")

    def whole(side: str) -> Column:
        return F.struct(*[F.col(f"_{side}_{c}").alias(c) for c in (ts, *cols)])

    edges = edges.select(
        *keys, "_b",
        F.lag(whole("l")).over(by_bucket).alias("_before"),
        F.lead(whole("f")).over(by_bucket).alias("_after"),
    )
    w = Window.partitionBy(*keys, "_b").orderBy(ts)
    out = rows.select("*", F.lag(item).over(w).alias("_p"), F.lead(item).over(w).alias("_n"))
    return (
        out.join(edges, [*keys, "_b"])
        .withColumn("prev", F.coalesce("_p", "_before"))
        .withColumn("next", F.coalesce("_n", "_after"))
        .drop("_p", "_n", "_before", "_after", "_b")
    )


def fill_known(
    df: DataFrame,
    keys: list[str],
    ts: str,
    groups: dict[str, list[str]],
    bucket_s: int = BUCKET_S,
    after: bool = True,
    history: bool = False,
) -> DataFrame:
    """Carry known values along each sequence.

    A group names columns that are null together. Per group this adds the structs
    ``<name>_before`` (last known at or before the row) and, with ``after``,
    ``<name>_after`` (first known at or after it). ``history`` adds ``<name>_since``
    (time of the first known value so far) and ``prev_ts`` (time of the row before).
    """
    rows = _bucketed(df, keys, ts, bucket_s)
    lead_col = {g: cols[0] for g, cols in groups.items()}

    def known_at(g: str) -> Column:
        return F.when(F.col(lead_col[g]).isNotNull(), F.col(ts))

    def whole(g: str, tail: str = "") -> Column:
        return F.struct(*[F.col(f"{c}{tail}").alias(c) for c in groups[g]])

    aggs = [F.max(ts).alias("_end")]
    for g, cols in groups.items():
        aggs += [F.max_by(F.col(c), known_at(g)).alias(f"{c}_l") for c in cols]
        if after:
            aggs += [F.min_by(F.col(c), known_at(g)).alias(f"{c}_f") for c in cols]
        if history:
            aggs.append(F.min(known_at(g)).alias(f"_s_{g}"))
    edges = rows.groupBy(*keys, "_b").agg(*aggs)
    up = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    sel = []
    for g in groups:
        c = lead_col[g]
        sel.append(F.last(F.when(F.col(f"{c}_l").isNotNull(), whole(g, "_l")), ignorenulls=True).over(up).alias(f"_pb_{g}"))
        if after:
            sel.append(F.last(F.when(F.col(f"{c}_f").isNotNull(), whole(g, "_f")), ignorenulls=True).over(down).alias(f"_pa_{g}"))
        if history:
            sel.append(F.min(f"_s_{g}").over(up).alias(f"_ps_{g}"))
    if history:
        sel.append(F.max("_end").over(up).alias("_pe"))
    edges = edges.select(*keys, "_b", *sel)

    order = Window.partitionBy(*keys, "_b").orderBy(ts)
    asc = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    desc = Window.partitionBy(*keys, "_b").orderBy(F.desc(ts)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local, res = [], []
    for g in groups:
        item = F.when(F.col(lead_col[g]).isNotNull(), whole(g))
        local.append(F.last(item, ignorenulls=True).over(asc).alias(f"_b_{g}"))
        res.append(F.coalesce(f"_b_{g}", f"_pb_{g}").alias(f"{g}_before"))
        if after:
            local.append(F.last(item, ignorenulls=True).over(desc).alias(f"_a_{g}"))
            res.append(F.coalesce(f"_a_{g}", f"_pa_{g}").alias(f"{g}_after"))
        if history:
            local.append(F.min(known_at(g)).over(asc).alias(f"_c_{g}"))
            res.append(F.coalesce(f"_ps_{g}", f"_c_{g}").alias(f"{g}_since"))
    if history:
        local.append(F.lag(ts).over(order).alias("_pt"))
        res.append(F.coalesce("_pt", "_pe").alias("prev_ts"))
    return rows.select("*", *local).join(edges, [*keys, "_b"]).select(*df.columns, *res)


def running_total(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: Column, name: str
) -> DataFrame:
    """Running sum within keys, in two levels.

    ``bucket`` must not decrease along ``order``. Buckets are summed first (map-side
    combine), then only their totals are accumulated per key.
    """
    rows = df.withColumn("_b", bucket).withColumn("_v", value)
    totals = rows.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    w_tot = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", F.coalesce(F.sum("_t").over(w_tot), F.lit(0)).alias("_o"))
    w = (
        Window.partitionBy(*keys, "_b")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("_r", F.sum("_v").over(w))
        .join(offsets.hint("merge"), [*keys, "_b"])
        .withColumn(name, F.col("_r") + F.col("_o"))
        .drop("_b", "_v", "_r", "_o")
    )


def value_steps(df: DataFrame, keys: list[str], value: str, name: str, steps: int = 256) -> DataFrame:
    """Adds ``name``: a step of ``value`` within keys, non-decreasing along it, each with about equally many rows.

    The borders are approximate quantiles, one bounded array per key, so values crowded into a narrow range spread as
    well as others. They may differ between two evaluations; the result is therefore written once. Null stays null.
    """
    at = F.array(*[F.lit(i / steps) for i in range(1, steps)])
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, at, 10 * steps).alias("_cuts"))
    passed = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    stepped = df.join(cuts, keys).withColumn(name, F.when(F.col(value).isNotNull(), passed)).drop("_cuts")
    return cut_lineage(stepped)


def rank_in_group(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """row_number() within keys for groups of any size (see ``running_total``)."""
    return running_total(df, keys, order, bucket, F.lit(1).cast("long"), name)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], bins: int = 1024, most: int = 65536
) -> DataFrame:
    """Linear-interpolation quantiles per key without collecting the values of a key.

    Radix selection: values are counted by sign and power of two first, so an outlier of any size is a bin of its own
    and leaves the others as they are; the bins that hold wanted ranks are then cut into ``bins`` equal steps, again
    and again, until each holds at most ``most`` rows or one value. A level reads the values once and narrows a bin by
    ``bins``, so a double is settled after seven levels at the latest, and in practice after two. Only the rows of the
    last bins are ordered; equal values are counted before that. Numbers come before NaN; null values do not count.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    v = F.col("_v")
    magnitude = F.when(F.isnan(v), 9999).when(v == float("inf"), 5000).when(v == float("-inf"), -5000).when(v == 0, 0).otherwise(
        (F.signum(v) * (F.floor(F.log2(F.abs(v))) + 1100)).cast("int")
    )
    first = cut_lineage(_counted(rows.withColumn("_bin", magnitude), keys))
    sizes = first.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    wanted = F.array(
        *[
            F.struct(F.lit(k).alias("q"), F.lit(side).alias("side"), (fn(F.lit(p) * (F.col("_n") - 1))).cast("long").alias("rank"))
            for k, p in probs.items()
            for side, fn in (("lo", F.floor), ("hi", F.ceil))
        ]
    )
    targets = sizes.select(*keys, F.explode(wanted).alias("t")).select(*keys, "t.*")
    below = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = first.withColumn("_from", F.sum("_c").over(below) - F.col("_c"))
    found = cut_lineage(_holding(targets.join(start.hint("merge"), keys)).drop("_bin"))
    while not found.filter((F.col("_lo") < F.col("_hi")) & (F.col("_c") > most)).isEmpty():
        found = cut_lineage(_narrowed(rows, found, keys, bins))
    inside = rows.join(small_side(found.select(*keys, "_lo", "_hi", "_from").distinct()), keys).filter(v.between(F.col("_lo"), F.col("_hi")))
    counts = inside.groupBy(*keys, "_lo", "_from", "_v").agg(F.count(F.lit(1)).alias("_k"))
    up = Window.partitionBy(*keys, "_lo").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.select(*keys, "_lo", "_v", (F.col("_from") + F.sum("_k").over(up)).alias("_z"), "_k")
    hit = (F.col("rank") >= F.col("_z") - F.col("_k")) & (F.col("rank") < F.col("_z"))
    settled = found.select(*keys, "q", "side", "rank", "_lo").join(placed.hint("merge"), [*keys, "_lo"]).filter(hit)
    picked = settled.groupBy(*keys).agg(
        *[F.max(F.when((F.col("q") == k) & (F.col("side") == s), v)).alias(f"_{k}_{s}") for k in probs for s in ("lo", "hi")]
    )
    out = picked.join(sizes.hint("merge"), keys)
    cols = []
    for k, p in probs.items():
        pos = F.lit(p) * (F.col("_n") - 1)
        low, high, frac = F.col(f"_{k}_lo"), F.col(f"_{k}_hi"), pos - F.floor(pos)
        cols.append(F.when(low == high, low).otherwise(low + (high - low) * frac).alias(k))
    return out.select(*keys, *cols)


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))


def _holding(bins: DataFrame) -> DataFrame:
    """The bins (_from, _c) that hold the ranks beside them."""
    return bins.filter((F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_from") + F.col("_c")))


def _narrowed(rows: DataFrame, found: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """``found`` with each bin replaced by the step of it that holds the rank."""
    wide = found.select(*keys, F.col("_lo").alias("_l"), F.col("_hi").alias("_h"), F.col("_from").alias("_f")).distinct()
    inside = rows.join(small_side(wide), keys).filter(F.col("_v").between(F.col("_l"), F.col("_h")))
    part = (F.col("_v") - F.col("_l")) / F.nullif(F.col("_h") - F.col("_l"), F.lit(0.0))
    inside = inside.withColumn("_bin", F.coalesce(F.least(F.floor(part * bins).cast("int"), F.lit(bins - 1)), F.lit(0)))
    steps = _counted(inside, [*keys, "_l", "_f"])
    up = Window.partitionBy(*keys, "_l").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("_from", F.col("_f") + F.sum("_c").over(up) - F.col("_c"))
    asked = found.select(*keys, "q", "side", "rank", F.col("_lo").alias("_l"))
    return _holding(asked.join(steps.hint("merge"), [*keys, "_l"])).select(*keys, "q", "side", "rank", "_c", "_lo", "_hi", "_from")
