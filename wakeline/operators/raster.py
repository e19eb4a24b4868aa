"""Radar scenes and probability masks as long pixel tables (scene_id, row, col, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.angles import uv_to_wind
from wakeline.operators.sequences import exact_quantiles, rank_in_group
from wakeline.session import cut_lineage, places_kept, small_side

# Fixed values of detector, tiler, mask cleaning and patch filter.
GUARD, TRAIN, CFAR_FACTOR = 2, 4, 8.0
TILE, STRIDE = 256, 192
MIN_BLEND = 0.05
MASK_THRESHOLD, MIN_PIXELS = 0.5, 50
PIXEL_M = 10.0
CROP_PAD, MIN_OIL = 32, 0.05
_ROW_ID = 2**24  # run id = row * _ROW_ID + first column


def _known(value: str) -> Column:
    """A pixel without a number counts as 0."""
    return F.when(F.isnan(value) | F.col(value).isNull(), 0.0).otherwise(F.col(value))


def normalise(pixels: DataFrame, mode: str = "percentile") -> DataFrame:
    """Values to [0, 1]: between the 1st and 99th percentile of the scene, or /255 for 8-bit data."""
    v = pixels.withColumn("value", _known("value"))
    if mode == "bytes":
        top = v.groupBy("scene_id").agg(F.max("value").alias("_max"))
        return v.join(small_side(top), "scene_id").withColumn("value", F.when(F.col("_max") > 1, F.col("value") / 255.0).otherwise(F.col("value"))).drop("_max")
    q = exact_quantiles(v, ["scene_id"], "value", {"_p1": 0.01, "_p99": 0.99})
    width = F.col("_p99") - F.col("_p1")
    scaled = F.when(width > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("value") - F.col("_p1")) / F.nullif(width, F.lit(0.0))))).otherwise(0.0)
    return v.join(small_side(q), "scene_id").withColumn("value", scaled).drop("_p1", "_p99")


def _along_row(n: int) -> Window:
    return Window.partitionBy("scene_id", "row").orderBy("col").rangeBetween(-n, n)


def _along_col(n: int) -> Window:
    return Window.partitionBy("scene_id", "col").orderBy("row").rangeBetween(-n, n)


def ca_cfar(pixels: DataFrame, guard: int = GUARD, train: int = TRAIN, k: float = CFAR_FACTOR) -> DataFrame:
    """Pixels brighter than k times the mean of their training ring.

    Box sums are separable: one window along the row, one along the column, each over
    a single line of the image. Cells outside the scene count as the scene median, pixels without a number as 0.
    """
    pixels = pixels.withColumn("value", _known("value"))
    outer = guard + train
    n_out, n_in = (2 * outer + 1) ** 2, (2 * guard + 1) ** 2
    med = exact_quantiles(pixels, ["scene_id"], "value", {"_median": 0.5})
    rows = pixels.select(
        "scene_id", "row", "col", "value",
        F.sum("value").over(_along_row(outer)).alias("_so"), F.count("value").over(_along_row(outer)).alias("_co"),
        F.sum("value").over(_along_row(guard)).alias("_si"), F.count("value").over(_along_row(guard)).alias("_ci"),
    )
    box = rows.select(
        "scene_id", "row", "col", "value",
        F.sum("_so").over(_along_col(outer)).alias("_so"), F.sum("_co").over(_along_col(outer)).alias("_co"),
        F.sum("_si").over(_along_col(guard)).alias("_si"), F.sum("_ci").over(_along_col(guard)).alias("_ci"),
    ).join(small_side(med), "scene_id")
    outer_sum = F.col("_so") + (n_out - F.col("_co")) * F.col("_median")
    inner_sum = F.col("_si") + (n_in - F.col("_ci")) * F.col("_median")
    mean = (outer_sum - inner_sum) / (n_out - n_in)
    return box.filter(F.col("value") > k * mean).select("scene_id", "row", "col", "value")


def contacts(detections: DataFrame, scenes: DataFrame, grid: int, span_deg: float) -> DataFrame:
    """Detected pixels as radar contacts, numbered in row-major order. They are counted and read, so they are written once."""
    d = rank_in_group(cut_lineage(detections), ["scene_id"], [F.col("row"), F.col("col")], F.col("row"), "sar_id")
    i = F.col("value")
    return d.join(scenes.select("scene_id", "spill_lat", "spill_lon"), "scene_id").select(
        "scene_id", "sar_id", F.format_string("SAR-%03d", F.col("sar_id")).alias("target_id"), "row", "col",
        F.round(F.col("spill_lat") + (F.col("row") / grid - 0.5) * span_deg, 5).alias("lat"),
        F.round(F.col("spill_lon") + (F.col("col") / grid - 0.5) * span_deg, 5).alias("lon"),
        F.round(i, 3).alias("intensity"), F.round(40 + i * 260, 1).alias("length_m"),
        F.round(F.least(F.lit(0.99), 0.65 + i * 0.3), 2).alias("confidence"),
    )


def pixel_runs(mask: DataFrame, weight: str | None = None) -> DataFrame:
    """Horizontal runs of mask pixels: scene_id, row, c0, c1, id, sums. One image line per window."""
    w = Window.partitionBy("scene_id", "row").orderBy("col")
    g = mask.withColumn("_g", F.col("col") - F.row_number().over(w))
    value = F.sum(weight) if weight else F.lit(None).cast("double")
    r = g.groupBy("scene_id", "row", "_g").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), value.alias("weight"))
    return r.withColumn("id", F.col("row").cast("long") * _ROW_ID + F.col("c0"))


def label_components(runs: DataFrame) -> DataFrame:
    """8-connected components of pixel runs: adds ``label``, the id of the component's first run.

    Neighbouring lines meet on (scene, row). Labels then fall to the smallest among
    the neighbours and jump along label pointers, so rounds grow with the logarithm
    of a component's extent. Every round is a reliable checkpoint.
    """
    with places_kept(runs.sparkSession):  # the pixels of a closed mask, where they lie by scene
        runs = cut_lineage(runs)
    a = runs.select("scene_id", F.col("row"), F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col("id").alias("src"))
    b = runs.select("scene_id", (F.col("row") - 1).alias("row"), F.col("c0").alias("b0"), F.col("c1").alias("b1"), F.col("id").alias("dst"))
    touch = a.join(b.hint("merge"), ["scene_id", "row"]).filter((F.col("a0") <= F.col("b1") + 1) & (F.col("b0") <= F.col("a1") + 1)).select("scene_id", "src", "dst")
    edges = cut_lineage(touch.unionByName(touch.select("scene_id", F.col("dst").alias("src"), F.col("src").alias("dst"))))
    labels = cut_lineage(runs.select("scene_id", "id", F.col("id").alias("label")))
    while True:
        near = edges.join(labels.select("scene_id", F.col("id").alias("dst"), "label").hint("merge"), ["scene_id", "dst"]).groupBy(
            "scene_id", F.col("src").alias("id")
        ).agg(F.min("label").alias("_m"))
        low = labels.join(near.hint("merge"), ["scene_id", "id"], "left").select(
            "scene_id", "id", F.col("label").alias("_old"), F.least("label", F.coalesce("_m", "label")).alias("label")
        )
        jump = labels.select("scene_id", F.col("id").alias("label"), F.col("label").alias("_j"))
        low = cut_lineage(low.join(jump.hint("merge"), ["scene_id", "label"]).select("scene_id", "id", "_old", F.least("label", "_j").alias("label")))
        if low.filter(F.col("label") != F.col("_old")).isEmpty():
            return runs.join(low.select("scene_id", "id", "label").hint("merge"), ["scene_id", "id"])
        labels = low.select("scene_id", "id", "label")


def clusters(labelled: DataFrame, min_area: int = 1) -> DataFrame:
    """Centroid and area of every component."""
    n = F.col("c1") - F.col("c0") + 1
    g = labelled.groupBy("scene_id", "label").agg(
        F.sum(n).alias("area"), F.sum(F.col("row") * n).alias("_r"), F.sum((F.col("c0") + F.col("c1")) * n / 2).alias("_c")
    )
    return g.filter(F.col("area") >= min_area).select(
        "scene_id", "label", "area", (F.col("_r") / F.col("area")).alias("row_centroid"), (F.col("_c") / F.col("area")).alias("col_centroid")
    )


def tiles(images: DataFrame, size: int = TILE, stride: int = STRIDE) -> DataFrame:
    """Tile boxes that cover each image (scene_id, h, w); the last tile is flush with the edge."""

    def starts(n: Column) -> Column:
        last = n - size
        regular = F.sequence(F.lit(0), F.greatest(F.lit(0), last), F.lit(stride))
        return F.array_distinct(F.when(F.element_at(regular, -1) + size < n, F.concat(regular, F.array(last))).otherwise(regular))

    h, w = F.col("h").cast("int"), F.col("w").cast("int")
    small = (h <= size) & (w <= size)
    zero = F.array(F.lit(0))
    return (
        images.withColumn("y0", F.explode(F.when(small, zero).otherwise(starts(h))))
        .withColumn("x0", F.explode(F.when(small, zero).otherwise(starts(w))))
        .withColumn("y1", F.least(h, F.col("y0") + size)).withColumn("x1", F.least(w, F.col("x0") + size))
    )


def blend(preds: DataFrame, size: int) -> DataFrame:
    """Merge overlapping tile predictions (scene_id, tile_row, tile_col, row, col, prob) by cosine weight.

    One shuffle by image line: what is then aggregated by line stays in its task.
    """
    x, y = -1 + 2 * F.col("col") / (size - 1), -1 + 2 * F.col("row") / (size - 1)
    r = F.least(F.lit(1.0), F.sqrt(x * x + y * y))
    wt = F.greatest(F.lit(MIN_BLEND), 0.5 * (1 + F.cos(r * math.pi)))
    placed = preds.select(
        "scene_id", (F.col("tile_row") + F.col("row")).alias("row"), (F.col("tile_col") + F.col("col")).alias("col"),
        (wt * F.col("prob")).alias("_p"), wt.alias("_wt"),
    ).repartition("scene_id", "row")
    g = placed.groupBy("scene_id", "row", "col").agg(F.sum("_p").alias("_s"), F.sum("_wt").alias("_w"))
    value = F.col("_s") / F.greatest(F.col("_w"), F.lit(1e-6))
    return g.select("scene_id", "row", "col", F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("prob"))


#: Pixels of an image line whose mask is one number.
WORD = 32
_ALL, _TOP = 2**WORD - 1, 2 ** (WORD - 1)


def _told(words: DataFrame, *own: str) -> DataFrame:
    """What each word of a mask (scene_id, row, word, bits) says: to itself its columns ``own``, to the words above and
    below its bits (``across``), to those beside it, where it is on at that end, the bit it is to them (``along``)."""
    bits, none = F.col("bits"), F.lit(None).cast("long")

    def say(row: int, word: int, across: Column = none, along: Column = none) -> Column:
        kept = [(F.col(c) if row == word == 0 else none).alias(c) for c in own]
        return F.struct((F.col("row") + row).alias("row"), (F.col("word") + word).alias("word"), across.alias("across"), along.alias("along"), *kept)

    beside = [
        F.when(bits.bitwiseAND(F.lit(1)) != 0, say(0, -1, along=F.lit(_TOP))), F.when(bits.bitwiseAND(F.lit(_TOP)) != 0, say(0, 1, along=F.lit(1).cast("long"))),
    ]
    said = F.array_compact(F.array(say(0, 0), say(-1, 0, across=bits), say(1, 0, across=bits), *beside))
    return words.select("scene_id", F.explode(said).alias("_m")).select("scene_id", "_m.*")


def _shifted(bits: Column) -> tuple[Column, Column]:
    """Each pixel's neighbour on the left, and on the right, within the word."""
    return F.shiftleft(bits, 1).bitwiseAND(F.lit(_ALL)), F.shiftright(bits, 1)


def closed_mask(probs: DataFrame, thr: float = MASK_THRESHOLD) -> DataFrame:
    """scene_id, row, col, prob of the mask after closing with the 3x3 cross: dilation, then erosion.

    A line's mask is cut into words of ``WORD`` pixels, one number each, and only words with a pixel on are aggregated
    and moved. They tell the words around them what those need to shift their own bits: once for the dilation, once for
    the erosion, where pixels outside the image do not count. ``probs`` is a full raster (one row per pixel); its pixels
    meet the closed words at the end.
    """
    frame = probs.groupBy("scene_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    word = F.floor(F.col("col") / WORD).cast("long")
    bit = F.expr(f"shiftleft(1L, int(pmod(col, {WORD})))")
    lit = probs.where(F.col("prob") >= thr).select("scene_id", "row", word.alias("word"), bit.alias("_bit"))
    lit = lit.groupBy("scene_id", "row", "word").agg(F.bit_or("_bit").alias("bits"))
    wide = _told(lit, "bits").groupBy("scene_id", "row", "word").agg(*[F.coalesce(F.bit_or(c), F.lit(0).cast("long")).alias(c) for c in ("bits", "across", "along")])
    left, right = _shifted(F.col("bits"))
    grown = F.col("bits").bitwiseOR(left).bitwiseOR(right).bitwiseOR(F.col("across")).bitwiseOR(F.col("along"))
    # the part of the word that lies in the image
    ends = [F.least(F.lit(WORD), F.greatest(F.lit(0), c - F.col("word") * WORD)).cast("int") for c in (F.col("c0"), F.col("c1") + 1)]
    wide = wide.join(small_side(frame), "scene_id").where(F.col("row").between(F.col("r0"), F.col("r1")))
    wide = wide.withColumns({"_grown": grown, "_from": ends[0], "_to": ends[1]})
    wide = wide.withColumn("_image", F.expr("shiftleft(1L, _to) - shiftleft(1L, _from)"))
    wide = wide.withColumn("bits", F.col("_grown").bitwiseAND(F.col("_image"))).where(F.col("bits") != 0)
    left, right = _shifted(F.col("bits").bitwiseOR(F.lit(_ALL).bitwiseXOR(F.col("_image"))))
    start, end = F.col("word") * WORD, F.col("word") * WORD + (WORD - 1)
    wide = wide.select(
        "scene_id", "row", "word", "bits",
        left.bitwiseOR(F.when(start <= F.col("c0"), 1).otherwise(0).cast("long")).alias("left"),
        right.bitwiseOR(F.when(end >= F.col("c1"), F.lit(_TOP)).otherwise(0).cast("long")).alias("right"),
        ((F.col("row") > F.col("r0")).cast("long") + (F.col("row") < F.col("r1")).cast("long")).alias("lines"),
    )
    own = ["bits", "left", "right", "lines"]
    told = _told(wide, *own).groupBy("scene_id", "row", "word").agg(
        *[F.max(c).alias(c) for c in own], F.bit_and("across").alias("across"), F.count("across").alias("_n"), F.coalesce(F.bit_or("along"), F.lit(0).cast("long")).alias("along")
    )
    beside = F.col("left").bitwiseOR(F.col("along").bitwiseAND(F.lit(1))).bitwiseAND(F.col("right").bitwiseOR(F.col("along").bitwiseAND(F.lit(_TOP))))
    kept = F.col("bits").bitwiseAND(beside).bitwiseAND(F.coalesce("across", F.lit(_ALL)))
    words = told.where(F.col("_n") == F.col("lines")).select("scene_id", "row", "word", kept.alias("bits")).where(F.col("bits") != 0)
    pixels = probs.select("scene_id", "row", "col", "prob", word.alias("word"), bit.alias("_bit"))
    # unwritten, the words keep the place of their scene, and so do the pixels they meet
    met = pixels.join(words.hint("shuffle_hash"), ["scene_id", "row", "word"]).where(F.col("bits").bitwiseAND(F.col("_bit")) != 0)
    return met.select("scene_id", "row", "col", "prob")


def clean_mask(probs: DataFrame, thr: float = MASK_THRESHOLD, min_pixels: int = MIN_PIXELS) -> DataFrame:
    """Pixels of closed components with at least ``min_pixels``, with their label."""
    runs = label_components(pixel_runs(closed_mask(probs, thr), "prob"))
    big = clusters(runs, min_pixels).select("scene_id", "label")
    kept = runs.join(big.hint("merge"), ["scene_id", "label"])
    return kept.withColumn("col", F.explode(F.sequence("c0", "c1"))).select("scene_id", "row", "col", "label")


def component_stats(labelled: DataFrame, pixel_m: float = PIXEL_M) -> DataFrame:
    """Box, area, mean probability and centroid of every component of weighted runs."""
    n = F.col("c1") - F.col("c0") + 1
    g = labelled.groupBy("scene_id", "label").agg(
        F.min("row").alias("y0"), (F.max("row") + 1).alias("y1"), F.min("c0").alias("x0"), (F.max("c1") + 1).alias("x1"),
        F.sum(n).alias("pixel_area"), F.sum("weight").alias("_w"), F.sum(F.col("row") * n).alias("_r"), F.sum((F.col("c0") + F.col("c1")) * n / 2).alias("_c"),
    )
    area = F.col("pixel_area")
    return g.select(
        "scene_id", "label", "y0", "y1", "x0", "x1", "pixel_area", F.round(F.col("_w") / area, 4).alias("confidence"),
        (F.col("_r") / area).alias("row_centroid"), (F.col("_c") / area).alias("col_centroid"),
        F.greatest(F.lit(0.001), F.round(area * pixel_m * pixel_m / 1e6, 4)).alias("area_sq_km"),
    )


def pixel_to_geo(stats: DataFrame, boxes: DataFrame, h: int, w: int) -> DataFrame:
    """Centroids in degrees, linearly within each scene's (min_lon, min_lat, max_lon, max_lat)."""
    return stats.join(boxes, "scene_id").withColumns(
        {
            "lon": F.col("min_lon") + F.col("col_centroid") / max(1, w) * (F.col("max_lon") - F.col("min_lon")),
            "lat": F.col("max_lat") - F.col("row_centroid") / max(1, h) * (F.col("max_lat") - F.col("min_lat")),
        }
    )


def affine_to_geo(px: Column, py: Column, t: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    a, b, c, d, e, f = t
    return a * px + b * py + c, d * px + e * py + f


def crop_boxes(probs: DataFrame, pad: int = CROP_PAD, thr: float = MASK_THRESHOLD, min_oil: float = MIN_OIL) -> DataFrame:
    """Padded box of the oil pixels of each scene, clamped to the image, and its oil share."""
    oil = F.col("prob") > thr
    g = probs.groupBy("scene_id").agg(
        (F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"), F.count_if(oil).alias("oil_pixels"),
        F.min(F.when(oil, F.col("row"))).alias("_r0"), F.max(F.when(oil, F.col("row"))).alias("_r1"),
        F.min(F.when(oil, F.col("col"))).alias("_c0"), F.max(F.when(oil, F.col("col"))).alias("_c1"),
    ).filter(F.col("oil_pixels") > 0)
    b = g.select(
        "scene_id", "oil_pixels",
        F.greatest(F.lit(0), F.col("_r0") - pad).alias("y0"), F.least(F.col("h"), F.col("_r1") + pad + 1).alias("y1"),
        F.greatest(F.lit(0), F.col("_c0") - pad).alias("x0"), F.least(F.col("w"), F.col("_c1") + pad + 1).alias("x1"),
    )
    share = F.col("oil_pixels") / ((F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")))
    return b.withColumn("oil_fraction", share).withColumn("valid", share >= min_oil)


FEATURES = [
    "mean", "std", "p5", "p15", "p25", "p50", "p75", "p85", "p95", "iqr", "spread", "contrast", "cv", "skew", "kurtosis",
    "grad_mean", "grad_std", "grad_p90", "dark_05", "dark_10", "dark_15", "min", "max", "range", "centre_ratio",
]


def patch_features(pixels: DataFrame) -> DataFrame:
    """25 texture features of each patch, on every max(1, side // 100)-th pixel.

    The subsampled patch has fewer than 200 x 200 pixels whatever its size, so it may be
    one window partition; the final aggregation reuses that partitioning.
    """
    size = pixels.groupBy("scene_id").agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    p = pixels.join(small_side(size), "scene_id")
    sy, sx = F.greatest(F.lit(1), F.floor(F.col("_h") / 100)), F.greatest(F.lit(1), F.floor(F.col("_w") / 100))
    p = p.filter((F.col("row") % sy == 0) & (F.col("col") % sx == 0)).select(
        "scene_id", (F.col("row") / sy).cast("int").alias("r"), (F.col("col") / sx).cast("int").alias("c"), "value"
    ).repartition("scene_id")
    patch = Window.partitionBy("scene_id")
    across = Window.partitionBy("scene_id", "r").orderBy("c")
    down = Window.partitionBy("scene_id", "c").orderBy("r")

    def slope(w: Window) -> Column:
        left, right = F.lag("value").over(w), F.lead("value").over(w)
        return F.when(left.isNull(), right - F.col("value")).when(right.isNull(), F.col("value") - left).otherwise((right - left) / 2)

    g = p.withColumn("_gx", slope(across)).withColumn("_gy", slope(down))
    g = g.withColumn("grad", F.sqrt(F.coalesce(F.col("_gx") * F.col("_gx"), F.lit(0.0)) + F.coalesce(F.col("_gy") * F.col("_gy"), F.lit(0.0))))
    g = g.select("scene_id", "r", "c", "value", "grad", F.avg("value").over(patch).alias("_mean"), F.stddev_pop("value").over(patch).alias("_std"),
                 (F.max("r").over(patch) + 1).alias("_ch"), (F.max("c").over(patch) + 1).alias("_cw"))
    cy, cx = F.floor(F.col("_ch") / 2), F.floor(F.col("_cw") / 2)
    ry, rx = F.greatest(F.lit(4), F.floor(F.col("_ch") / 4)), F.greatest(F.lit(4), F.floor(F.col("_cw") / 4))
    centre = (F.col("r") >= cy - ry) & (F.col("r") < cy + ry) & (F.col("c") >= cx - rx) & (F.col("c") < cx + rx)
    d, v = F.col("value") - F.col("_mean"), F.col("value")

    def darker(k: float) -> Column:
        return F.avg((v < F.col("_mean") - k * F.col("_std")).cast("double"))

    qs = F.percentile("value", F.array(*[F.lit(x) for x in (0.05, 0.15, 0.25, 0.5, 0.75, 0.85, 0.95)]))
    a = g.groupBy("scene_id").agg(
        F.first("_mean").alias("mean"), F.first("_std").alias("std"), qs.alias("_q"),
        F.avg(d * d).alias("_m2"), F.avg(d * d * d).alias("_m3"), F.avg(d * d * d * d).alias("_m4"),
        F.avg("grad").alias("grad_mean"), F.stddev_pop("grad").alias("grad_std"), F.percentile("grad", 0.9).alias("grad_p90"),
        darker(0.5).alias("dark_05"), darker(1.0).alias("dark_10"), darker(1.5).alias("dark_15"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg(F.when(centre, v)).alias("_centre"),
    )
    for i, k in enumerate(("p5", "p15", "p25", "p50", "p75", "p85", "p95")):
        a = a.withColumn(k, F.col("_q")[i])
    one = F.lit(1.0)
    a = a.withColumns(
        {
            "iqr": F.col("p75") - F.col("p25"), "spread": F.col("p95") - F.col("p5"), "contrast": F.col("p95") / F.greatest(one, F.col("p5")),
            "cv": F.col("std") / F.greatest(one, F.col("mean")), "skew": F.col("_m3") / (F.pow("_m2", F.lit(1.5)) + 1e-7),
            "kurtosis": F.col("_m4") / (F.col("_m2") * F.col("_m2") + 1e-7) - 3, "range": F.col("max") - F.col("min"),
            "centre_ratio": F.coalesce("_centre", "mean") / F.greatest(one, F.col("mean")),
        }
    )
    return a.select("scene_id", *FEATURES)


def damping_rule(features: DataFrame) -> DataFrame:
    """Oil probability by texture alone."""
    calm = (F.col("std") < 18) & (F.col("contrast") < 2.5)
    rough = (F.col("cv") > 0.22) | (F.col("contrast") > 4)
    return features.withColumn("prob", F.when(calm, 0.85).when(rough, 0.10).otherwise(0.5))


def filter_candidates(candidates: DataFrame, thr: float = 0.5) -> DataFrame:
    """Confirm or reject candidates (prob, u10, v10, wind_source) and attach wind fields."""
    ok, wind = F.col("prob") >= thr, F.col("u10").isNotNull() & F.col("v10").isNotNull()
    speed, direction = uv_to_wind(F.col("u10"), F.col("v10"))
    text = F.format_string(
        f"Lookalike detected (P(Oil)=%.2f < {thr:.2f}). Damping / Wind profile matches low-wind shadow or biogenic film.", F.col("prob")
    )
    return candidates.withColumns(
        {
            "is_verified_oil": ok, "status": F.when(ok, "confirmed").otherwise("rejected"), "filter_confidence": F.round("prob", 4),
            "wind_ms": F.when(wind, speed), "wind_from_deg": F.when(wind, direction), "source": F.when(wind, "ERA5").otherwise("None"),
            "review_notes": F.when(~ok, text),
        }
    )
