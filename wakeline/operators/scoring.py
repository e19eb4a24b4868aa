"""Capacity, significance, stability, fusion, calibration, verdicts and rankings."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.geo import haversine_km
from wakeline.functions.text import tag
from wakeline.operators.drift import FORWARD_KM, Uniform, deflection, displaced, hashed_uniform, metres_per_lon, velocity
from wakeline.operators.sequences import rank_in_group
from wakeline.session import by_keys, cut_lineage

# Slick thickness in metres, fallback tonnage, volume limits in litres.
THICKNESS_M = {"light": 0.0001, "medium": 0.0005, "heavy": 0.001}
FALLBACK_DWT = {"crude_tanker": 300000.0, "chemical_tanker": 50000.0, "cargo": 80000.0, "container": 100000.0, "fishing": 500.0}
SEEP_LITRES, TINY_LITRES, VETO_SHARE = 3e9, 100.0, 0.05
# Fusion weights, calibration, verdict thresholds.
WEIGHTS = {"cpa": 0.20, "dark": 0.15, "loiter": 0.15, "capacity": 0.10, "draft": 0.10, "permutation": 0.15, "sensitivity": 0.15}
PLATT_A, PLATT_B = 2.0, 5.0
NULL_CUTOFF = 0.05
TIER1 = {"p": 0.01, "score": 0.80, "stability": 0.90}
TIER2 = {"p": 0.05, "score": 0.60}
MIN_TOP = 0.30
MIN_RUNS, WIND_SPREAD, TURN_DEG, CRASH_SHARE = 10, 0.15, 10.0, 0.10


def _lookup(c: Column, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in reversed(table.items()):
        out = F.when(c == k, v).otherwise(out)
    return out


def capacity_veto(df: DataFrame) -> DataFrame:
    """Add capacity columns from area_m2, dwt, vessel_type, fuel_type."""
    fuel = F.lower(F.trim(F.coalesce("fuel_type", F.lit("medium"))))
    known = _lookup(fuel, THICKNESS_M)
    litres = F.round(F.col("area_m2") * F.coalesce(known, F.lit(THICKNESS_M["medium"])) * 1000.0, 3)
    fallback = _lookup(tag(F.coalesce("vessel_type", F.lit(""))), FALLBACK_DWT)
    own = F.when(F.col("dwt") > 0, F.col("dwt"))
    tonnage = F.coalesce(own, fallback)
    capacity = F.round(tonnage * 1000.0, 1)
    bad_area = F.col("area_m2").isNull() | (F.col("area_m2") <= 0)
    seep, tiny, over = litres > SEEP_LITRES, litres < TINY_LITRES, litres > VETO_SHARE * capacity
    multiplier = (
        F.when(bad_area, 1.0).when(seep, 0.0).when(tiny, 1.0).when(tonnage.isNull(), 0.5).when(over, 0.0).otherwise(1.0)
    )
    reason = (
        F.when(bad_area, "invalid_spill_area").when(seep, "NATURAL_SEEP_HYPOTHESIS_volume_exceeds_threshold")
        .when(tiny, "tiny_spill_pass_below_100L").when(tonnage.isNull(), "missing_dwt_unknown_type_LOW_CONFIDENCE")
        .when(over, "capacity_veto_spill_exceeds_5_percent").otherwise("capacity_pass")
    )
    note = F.concat_ws(
        "",
        F.when(~bad_area & ~seep & ~tiny & own.isNull() & F.col("dwt").isNotNull(), " [negative_dwt_treated_as_none]"),
        F.when(~bad_area & known.isNull(), " [ESTIMATED_THICKNESS]"),
    )
    return df.withColumns(
        {
            "capacity_multiplier": multiplier,
            "capacity_db": F.when(multiplier == 0, 0).otherwise(1),
            "spill_litres": F.when(bad_area, 0.0).otherwise(litres),
            "capacity_litres": F.when(bad_area | seep, 0.0).otherwise(F.coalesce(capacity, F.lit(0.0))),
            "capacity_reason": F.concat(reason, note),
        }
    )


def permutation_test(scores: DataFrame) -> DataFrame:
    """Significance of the best score of each scene (scene_id, mmsi, score) against the others.

    The null is the largest of n draws with replacement from the n other scores, so
    p = 1 - (1 - m/n)^n with m others at or above the best. The 99th percentile of that
    largest draw is the largest other score, since (1 - 1/n)^n < 0.99 for every n.
    Scores are counted per distinct value first; ties of the best go to the smallest id.
    """
    counted = scores.groupBy("scene_id", "score").agg(F.count(F.lit(1)).alias("c"), F.min(F.col("mmsi").cast("long")).alias("first"))
    w = Window.partitionBy("scene_id").orderBy(F.desc("score"))
    heads = counted.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    best = heads.groupBy("scene_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rn") == 1, F.col("c"))).alias("at_top"),
        F.max(F.when(F.col("rn") == 1, F.col("first"))).alias("top_mmsi"), F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("second"),
    )
    sizes = counted.groupBy("scene_id").agg(F.sum("c").alias("vessels"), F.count(F.lit(1)).alias("_distinct"))
    d = best.join(sizes, "scene_id")
    single, same, low = F.col("vessels") == 1, F.col("_distinct") == 1, F.col("top") < MIN_TOP
    others = (F.col("vessels") - 1).cast("double")
    p = 1 - F.pow(1 - F.try_divide(F.col("at_top") - 1, others), others)
    background = F.when(F.col("at_top") > 1, F.col("top")).otherwise(F.col("second"))
    p_value = F.when(single, 0.5).when(same | low, 1.0).otherwise(F.round(p, 4))
    return d.select(
        "scene_id", "vessels", F.lpad(F.col("top_mmsi").cast("string"), 9, "0").alias("top_mmsi"), F.round("top", 4).alias("top_score"),
        p_value.alias("p_value"), F.round(F.when(single | same | low, F.col("top")).otherwise(background), 4).alias("baseline_99th"),
        F.when(single, "single_suspect").when(same, "all_scores_identical").when(low, "all_scores_low")
        .when(p > NULL_CUTOFF, "INSUFFICIENT_EVIDENCE").otherwise("statistically_significant").alias("permutation_reason"),
    )


def perturbed_scores(candidates: DataFrame, n_runs: int = 100, seed: int = 42, uniform: Uniform = hashed_uniform) -> DataFrame:
    """Forward score of every candidate in the baseline (run 0) and in n perturbed weathers.

    ``candidates``: scene_id, mmsi, lat, lon, release_s, captured_s, spill_lat, spill_lon,
    wind_u, wind_v, cur_u, cur_v. A run has the same weather for all vessels.
    """
    n = max(MIN_RUNS, n_runs)
    turn = -TURN_DEG + 2 * TURN_DEG * uniform(F.col("run"), seed=seed + 1)
    base = F.col("run") == 0
    weather = candidates.sparkSession.range(0, n + 1, 1, 1).select(F.col("id").alias("run")).select(
        "run", F.when(base, 1.0).otherwise(1 - WIND_SPREAD + 2 * WIND_SPREAD * uniform(F.col("run"), seed=seed)).alias("_factor"),
        F.radians(F.when(base, 0.0).otherwise(turn)).alias("_turn"),
    ).select("run", "_factor", F.cos("_turn").alias("_cos"), F.sin("_turn").alias("_sin"))
    # what depends on the candidate or on the weather alone is found once, not for every pair of them
    c = candidates.withColumns({"_wind_cos": deflection(F.col("lat"))[0], "_wind_sin": deflection(F.col("lat"))[1], "_lon_m": metres_per_lon(F.col("lat"))})
    # dealt by scene once, so that the weathers of a scene are compared where they are made
    c = by_keys(c, "scene_id").crossJoin(F.broadcast(weather))
    u, v = velocity(
        F.col("wind_u") * F.col("_factor"), F.col("wind_v") * F.col("_factor"), F.col("cur_u"), F.col("cur_v"),
        (F.col("_wind_cos"), F.col("_wind_sin")), (F.col("_cos"), F.col("_sin")),
    )
    lat, lon = displaced(F.col("lat"), F.col("lon"), u, v, F.col("captured_s") - F.col("release_s"), F.col("_lon_m"))
    km = haversine_km(lat, lon, F.col("spill_lat"), F.col("spill_lon"))
    near = c.select("scene_id", "mmsi", "run", F.greatest(F.lit(0.0), 1 - km / FORWARD_KM).alias("_s"))
    return near.select("scene_id", "mmsi", "run", F.when(F.col("_s") == 0, 0.0).otherwise(F.round("_s", 6)).alias("score"))


def run_winners(run_scores: DataFrame) -> DataFrame:
    """Best vessel of each (scene, run); ties go to the smallest MMSI.

    Score and MMSI are packed into one integer, so this is a plain hash aggregation
    with a partial step before the shuffle. A run without any score has crashed and has no winner.
    """
    return _run_facts(run_scores).where(F.col("winner").isNotNull()).select("scene_id", "run", "winner")


def _run_facts(run_scores: DataFrame) -> DataFrame:
    """Winner (null without any score) and number of vessels of each (scene, run)."""
    packed = F.floor(F.col("score") * 1e6 + 0.5).cast("long") * 10**10 + (F.lit(10**10 - 1) - F.col("mmsi").cast("long"))
    best = run_scores.groupBy("scene_id", "run").agg(F.max(packed).alias("_p"), F.count(F.lit(1)).alias("vessels"))
    return best.select("scene_id", "run", (F.lit(10**10 - 1) - F.pmod("_p", F.lit(10**10))).alias("winner"), "vessels")


def sensitivity_test(run_scores: DataFrame, n_runs: int = 100) -> DataFrame:
    """Stability of the baseline winner (run 0) over the perturbed runs of each scene."""
    total = max(MIN_RUNS, n_runs)
    # all weathers are scored in one pass
    each = cut_lineage(_run_facts(run_scores))
    win = each.where(F.col("winner").isNotNull())
    base = win.filter("run = 0").select("scene_id", F.col("winner").alias("base_top"))
    vessels = each.filter("run = 0").select("scene_id", "vessels")
    counts = win.filter("run > 0").groupBy("scene_id", "winner").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("scene_id").orderBy(F.desc("c"), "winner")  # at most n_runs winners
    ranked = counts.withColumn("rn", F.row_number().over(order)).join(base, "scene_id")
    s = ranked.groupBy("scene_id").agg(
        F.sum("c").alias("completed"), F.sum(F.when(F.col("winner") == F.col("base_top"), F.col("c")).otherwise(0)).alias("consistency"),
        F.max(F.when(F.col("rn") == 1, F.col("c"))).alias("c1"), F.max(F.when(F.col("rn") == 2, F.col("c"))).alias("c2"),
    )
    d = base.join(vessels, "scene_id").join(s, "scene_id", "left")
    single = F.col("vessels") == 1
    done = F.coalesce("completed", F.lit(0))
    stability = F.when(single, 1.0).when(done == 0, 0.0).otherwise(F.round(F.col("consistency") / F.nullif(done, F.lit(0)), 4))
    multi = ((F.col("c1") + F.col("c2")) / F.nullif(done, F.lit(0)) >= 0.90) & (F.col("c1") / F.nullif(done, F.lit(0)) < 0.85)
    flags = F.concat_ws(
        ";",
        F.when(F.lit(n_runs < MIN_RUNS), "forced_n_runs_min_10"),
        F.when((F.lit(total) - done) / total > CRASH_SHARE, "UNSTABLE_WEATHER"),
        F.when(multi, "MULTIPLE_CANDIDATES"),
        F.when(stability < 0.5, "INCONCLUSIVE").when(stability >= 0.9, "HIGH_STABILITY"),
    )
    return d.select(
        "scene_id", F.lpad(F.col("base_top").cast("string"), 9, "0").alias("base_top"), stability.alias("stability_index"),
        F.when(single, total).otherwise(F.coalesce("consistency", F.lit(0))).cast("long").alias("consistency"),
        F.when(single, total).otherwise(done).cast("long").alias("n_runs_completed"),
        F.when(single, "single_vessel_stable").when(done == 0, "all_runs_failed").otherwise(flags).alias("sensitivity_reason"),
    )


def platt(x: Column, a: float = PLATT_A, b: float = PLATT_B) -> Column:
    z = -a * x + b
    value = F.when(z > 100, 0.0).when(z < -100, 1.0).otherwise(F.round(1 / (1 + F.exp(F.least(z, F.lit(100.0)))), 4))
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(value)


def fuse(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Total 0..100, calibrated probability and contributions from the pillar columns
    cpa_score, dark_score, loiter_score, capacity_multiplier, draft_score, p_value, stability_index."""
    w = weights or WEIGHTS
    scale = sum(w.values())
    share = {k: Decimal(str(round(v / scale, 6))) for k, v in w.items()}
    score = {
        "cpa": F.col("cpa_score"), "dark": F.col("dark_score"), "loiter": F.col("loiter_score"), "capacity": F.col("capacity_multiplier"),
        "draft": F.col("draft_score"), "permutation": F.greatest(F.lit(0.0), 1 - F.col("p_value")), "sensitivity": F.col("stability_index"),
    }
    veto = F.col("capacity_multiplier") == 0
    nothing, weighted = F.lit(True), F.lit(Decimal(0))
    # pillar scores carry a few decimals, so decimal arithmetic makes the sum and its rounding exact
    points = {k: c.cast("decimal(9,6)") * F.lit(share[k]) * F.lit(100) for k, c in score.items()}
    for k, c in score.items():
        nothing = nothing & (c == 0)
        weighted = weighted + points[k]
    total = F.when(veto | nothing, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(weighted, 2).cast("double"))))
    out = df.withColumn("total_score", total).withColumn(
        "fusion_reason", F.when(veto, "capacity_veto").when(nothing, "all_pillars_zero").otherwise("fused_attribution")
    )
    shares = {f"share_{k}": F.when(veto | nothing, 0.0).otherwise(F.round(points[k], 2).cast("double")) for k in score}
    calibrated = F.when(F.col("fusion_reason") != "fused_attribution", 0.0).otherwise(platt(F.col("total_score") / 100 * 5))
    return out.withColumns({**shares, "calibrated_score": calibrated})


def verdict(df: DataFrame) -> DataFrame:
    """Verdict, reason and strength from calibrated_score, p_value, stability_index, fusion_reason."""
    raw, p, stab, ctx = F.col("calibrated_score"), F.col("p_value"), F.col("stability_index"), F.coalesce("fusion_reason", F.lit(""))

    def unit(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    def missing(c: Column) -> Column:
        return c.isNull() | F.isnan(c)

    s, pc, st = unit(raw), unit(p), unit(stab)
    veto = F.contains(ctx, F.lit("capacity_veto"))
    zero = F.contains(ctx, F.lit("all_pillars_zero")) | ((raw == 0) & p.isNull())
    invalid = missing(raw) | missing(p) | missing(stab)
    accepted = pc > NULL_CUTOFF
    tier1 = (pc < TIER1["p"]) & (s >= TIER1["score"]) & (st >= TIER1["stability"])
    tier2 = (pc < TIER2["p"]) & (s >= TIER2["score"])

    def pick(values: list[str]) -> Column:
        out = F.when(F.coalesce(veto, F.lit(False)), values[0]).when(F.coalesce(zero, F.lit(False)), values[1]).when(invalid, values[2])
        return out.when(accepted, values[3]).when(tier1, values[4]).when(tier2, values[5]).otherwise(values[6])

    none = "INSUFFICIENT_EVIDENCE"
    clamp = F.when(raw > 1, " [score_clamped_to_1.0]").when(raw < 0, " [score_clamped_to_0.0]").otherwise("")
    return df.withColumns(
        {
            "verdict": pick([none, none, none, none, "PROSECUTABLE", "PERSON_OF_INTEREST", none]),
            "verdict_reason": F.concat(
                pick(["capacity_veto", "all_pillars_zero", "invalid_score", "H0_null_hypothesis_accepted", "tier1_prosecutable", "tier2_person_of_interest", "tier3_insufficient_evidence"]),
                F.when(veto | zero | invalid, "").otherwise(clamp),
            ),
            "evidence_strength": pick(["NONE", "NONE", "NONE", "WEAK", "STRONG", "MODERATE", "WEAK"]),
        }
    )


def rank_candidates(scores: DataFrame) -> DataFrame:
    """Positive forward scores (scene_id, mmsi, forward_score) ranked within each scene.

    The rank comes from score steps of 1e-4 and MMSI blocks, so a scene of any size spreads.
    """
    d = scores.filter(F.col("forward_score") > 0).withColumn("_s", F.round("forward_score", 4)).withColumn("_m", F.col("mmsi").cast("long"))
    step = F.round((1 - F.col("_s")) * 10000).cast("long") * 10**8 + F.floor(F.col("_m") / 1000)
    return rank_in_group(d, ["scene_id"], [F.desc("_s"), F.col("_m")], step, "rank").drop("_s", "_m")


def classify_outcome(ranked: DataFrame, scenes: DataFrame) -> DataFrame:
    """STRONG, INCONCLUSIVE or INSUFFICIENT for every scene from its two best scores."""
    t = ranked.filter("rank <= 2").groupBy("scene_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("forward_score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("forward_score"))).alias("second")
    )
    d = scenes.select("scene_id").join(t, "scene_id", "left")
    weak, tie = F.coalesce(F.col("top") < 0.4, F.lit(True)), F.coalesce(F.col("top") - F.col("second") < 0.1, F.lit(False))
    return d.select("scene_id", "top", "second", F.when(weak, "INSUFFICIENT").when(tie, "INCONCLUSIVE").otherwise("STRONG").alias("outcome"))


def rank_verdicts(df: DataFrame) -> DataFrame:
    """Final rank in each scene: total, then dark, loitering, p-value, MMSI; vetoed vessels get none."""
    live = df.filter(F.col("capacity_multiplier") != 0).withColumn("_m", F.col("mmsi").cast("long"))
    order = [F.desc("total_score"), F.desc("dark_score"), F.desc("loiter_score"), F.col("p_value"), F.col("_m")]
    step = F.round((100 - F.col("total_score")) * 100).cast("long") * 10**5 + F.round((1 - F.col("dark_score")) * 10000).cast("long")
    ranked = rank_in_group(live, ["scene_id"], order, step, "rank").drop("_m")
    return ranked.unionByName(df.filter(F.col("capacity_multiplier") == 0).withColumn("rank", F.lit(None).cast("long")))


def score_rows(df: DataFrame, version: str) -> DataFrame:
    """Rows for the score table: clamped, at storage precision, with the reasons as JSON."""

    def unit(c: str, scale: int, default: float = 0.0) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(default)))).cast(f"decimal({scale + 1},{scale})")

    reasons = ["dark_notes", "capacity_reason", "draft_reason", "permutation_reason", "verdict_reason"]
    return df.select(
        F.col("run_id").alias("drift_run_id"), F.lit(version).alias("scoring_version"), unit("cpa_score", 3).alias("cpa_score"),
        unit("dark_score", 3).alias("dark_vessel_score"), unit("loiter_score", 3).alias("loitering_score"),
        F.col("capacity_db").cast("decimal(4,3)").alias("capacity_multiplier"), unit("draft_score", 3).alias("draft_change_score"),
        unit("p_value", 5, 1.0).alias("permutation_p_value"), unit("stability_index", 3).alias("stability_index"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("total_score"))).cast("decimal(5,2)").alias("total_score"),
        F.lower("verdict").alias("verdict"), F.to_json(F.struct(*[c for c in reasons if c in df.columns])).alias("explanation"),
    )


def cpa_events(approaches: DataFrame) -> DataFrame:
    """Stored closest approaches: pairs that have one, metres and seconds at storage precision."""
    return approaches.filter(F.col("min_distance_m").isNotNull()).withColumns(
        {
            "min_distance_m": F.greatest(F.lit(0.0), F.round("min_distance_m", 2)).cast("decimal(10,2)"),
            "tcpa_seconds": F.col("tcpa_seconds").cast("decimal(10,2)"),
        }
    )


def latest_scores(scores: DataFrame, key: str = "drift_run_id") -> DataFrame:
    """Newest score row of each run."""
    w = Window.partitionBy(key).orderBy(F.desc("calculated_s"), F.desc("score_id"))
    return scores.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def score_history(scores: DataFrame, run_id) -> DataFrame:
    return scores.filter(F.col("drift_run_id") == run_id).orderBy(F.desc("calculated_s"), F.desc("score_id"))


def evidence_bullets(df: DataFrame) -> DataFrame:
    """Neutral findings for every candidate, and the scene's ambiguity note.

    Two best totals within 5 % mark the scene as ambiguous.
    """
    ok, bad, warn = "✅", "❌", "⚠️"
    km = F.col("min_distance_m") / 1000
    near = F.coalesce(km <= 5, F.lit(False))
    bullets = F.array_compact(
        F.array(
            F.when(km.isNotNull(), F.concat(F.when(near, ok).otherwise(bad), F.format_string(" Proximity: closest approach %.1f km from the drifting slick.", km))),
            F.when(F.col("dark_score") > 0, F.format_string(f"{warn} AIS discipline: transmission gap score %.4f.", F.col("dark_score"))),
            F.when(F.col("loiter_score") > 0, F.format_string(f"{warn} Movement: slow-speed episode score %.3f.", F.col("loiter_score"))),
            F.concat(F.when(F.col("capacity_multiplier") > 0, ok).otherwise(bad), F.lit(" Capacity: "), F.col("capacity_reason")),
            F.when(F.col("draft_score") > 0, F.format_string(f"{warn} Draft: decrease score %.3f.", F.col("draft_score"))),
        )
    )
    best = df.filter(F.col("rank") <= 2).groupBy("scene_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("total_score"))).alias("_t1"), F.max(F.when(F.col("rank") == 2, F.col("total_score"))).alias("_t2")
    )
    note = F.when(F.col("_t1") - F.col("_t2") <= 0.05 * F.col("_t1"), "AMBIGUOUS_EVIDENCE").otherwise("CLEAR_RANKING")
    return df.join(best, "scene_id", "left").select("run_id", "scene_id", "mmsi", "rank", "total_score", bullets.alias("bullets"), note.alias("scene_note"))


def dark_scenarios(scenes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Scenes without any candidate: the origin to cross-check by radar."""
    return scenes.join(candidates.select("scene_id").distinct(), "scene_id", "left_anti").select(
        "scene_id", "spill_lat", "spill_lon", F.lit("DARK_VESSEL_SCENARIO").alias("scene_note")
    )
