"""Track-sequence operators: gaps, dark windows, loitering, draft change, closest approach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.angles import narrowest_arc
from wakeline.functions.geo import NM_M, haversine_km, knots, with_geodesic
from wakeline.operators.sequences import neighbours, rank_in_group
from wakeline.operators.windows import facts_near_runs, facts_of_runs, steps_of_runs
from wakeline.session import cut_lineage, small_side

PAIR = ["scene_id", "mmsi"]

# Fixed values of the gap, dark-window, loitering, draft and approach rules.
GAP_S = 1800
DARK_MIN_GAP_S = 600
DARK_MAX_GAP_S = 24 * 3600
DARK_RADIUS_NM = 50.0
COAST_NM = 5.0
SPOOF_KNOTS = 30.0
SLOW_KNOTS = 5.0
LOITER_MIN = 30.0
LOITER_CAP = 0.40
SCENE_WINDOW_S = 6 * 3600
DRAFT_MIN_M, DRAFT_MAX_M, DRAFT_CAP = 0.5, 5.0, 0.8
CPA_FULL_M, CPA_ZERO_M, CPA_GAP_S = 100.0, 10000.0, 1800
#: Drift series up to which they are sent to every executor.
SERIES_ROWS = 100_000


def dedupe_track(df: DataFrame, keys: list[str] | None = None, ts: str = "ts_s", seq: str = "seq") -> DataFrame:
    """One row per (vessel, time): the last one observed. Aggregates before the shuffle."""
    keys = keys or ["mmsi"]
    rest = [c for c in df.columns if c not in (*keys, ts)]
    return df.groupBy(*keys, ts).agg(*[F.max_by(F.col(c), F.col(seq)).alias(c) for c in rest])


def ais_gaps(track: DataFrame, max_gap_s: int = GAP_S, keys: list[str] | None = None) -> DataFrame:
    """Silences longer than ``max_gap_s`` with both ends and the distance jumped."""
    keys = keys or ["mmsi"]
    t = neighbours(track.select(*keys, "ts_s", "lat", "lon"), keys, "ts_s", ["lat", "lon"])
    dt = F.col("ts_s") - F.col("prev.ts_s")
    return (
        t.filter(dt > max_gap_s)
        .select(
            *keys, F.col("prev.ts_s").alias("gap_start_s"), F.col("ts_s").alias("gap_end_s"),
            F.round(dt / 60.0, 1).alias("duration_min"),
            F.col("prev.lat").alias("start_lat"), F.col("prev.lon").alias("start_lon"),
            F.col("lat").alias("end_lat"), F.col("lon").alias("end_lon"),
        )
        .withColumn("jump_km", F.round(haversine_km("start_lat", "start_lon", "end_lat", "end_lon"), 2))
    )


def dark_windows(points: DataFrame) -> DataFrame:
    """Scored silences of each pair. ``points``: pair keys, ts_s, lat, lon, struct ``prev``
    (see ``neighbours``), spill_lat, spill_lon, captured_s and optionally coast_nm."""
    coast = F.col("coast_nm") if "coast_nm" in points.columns else F.lit(None).cast("double")
    dt = F.col("ts_s") - F.col("prev.ts_s")
    g = points.filter(dt >= DARK_MIN_GAP_S).select(
        *PAIR, F.col("prev.ts_s").alias("gap_start_s"), F.col("ts_s").alias("gap_end_s"),
        F.col("prev.lat").alias("_la"), F.col("prev.lon").alias("_lo"), "lat", "lon",
        ((F.col("prev.lat") + F.col("lat")) / 2).alias("mid_lat"), ((F.col("prev.lon") + F.col("lon")) / 2).alias("mid_lon"),
        "spill_lat", "spill_lon", "captured_s", coast.alias("coast_nm"),
    )
    g = with_geodesic(g, "_la", "_lo", "lat", "lon", "hop_m")
    g = with_geodesic(g, "spill_lat", "spill_lon", "mid_lat", "mid_lon", "spill_m")
    seconds = F.col("gap_end_s") - F.col("gap_start_s")
    minutes, nm = seconds / 60.0, F.col("spill_m") / NM_M
    speed = knots(F.col("hop_m"), seconds)
    blackout, far, spoof = seconds > DARK_MAX_GAP_S, nm > DARK_RADIUS_NM, speed > SPOOF_KNOTS
    raw = (
        F.least(F.lit(1.0), minutes / 60.0)
        * F.greatest(F.lit(0.0), 1 - nm / DARK_RADIUS_NM)
        * F.when(F.col("coast_nm") <= COAST_NM, 0.5).otherwise(1.0)
        * F.when(spoof, 0.5).otherwise(1.0)
    )
    overlap = F.col("captured_s").between(F.col("gap_start_s"), F.col("gap_end_s"))
    score = F.when(blackout | far, 0.0).when(overlap, F.least(F.lit(1.0), raw * 1.2)).otherwise(raw)
    return g.select(
        *PAIR, "gap_start_s", "gap_end_s", F.round(minutes, 1).alias("gap_duration_min"),
        F.round(nm, 2).alias("distance_to_spill_nm"), F.round(speed, 2).alias("speed_knots"),
        F.when(blackout, "PERMANENT_BLACKOUT").when(far, "EXCLUDED_BEYOND_50NM").when(spoof, "AIS_SPOOFING_SUSPECTED").alias("flag"),
        (overlap & ~blackout & ~far).alias("spill_overlap"),
        (F.coalesce(F.col("coast_nm") <= COAST_NM, F.lit(False)) & ~blackout & ~far).alias("coastal"),
        score.alias("raw_score"), F.round(score, 4).alias("score"),
    )


def dark_scores(windows: DataFrame) -> DataFrame:
    """Pillar score of each pair: the largest window score, with the flags seen."""
    counted = ~F.coalesce(F.col("flag").isin("PERMANENT_BLACKOUT", "EXCLUDED_BEYOND_50NM"), F.lit(False))

    def seen(cond: Column, text: str) -> Column:
        return F.when(F.bool_or(F.coalesce(cond, F.lit(False))), F.lit(text))

    return windows.groupBy(*PAIR).agg(
        F.round(F.max("raw_score"), 4).alias("dark_score"),
        F.count(F.lit(1)).alias("n_gaps"),
        F.count_if(counted).alias("n_scored"),
        F.concat_ws(
            "; ",
            seen(F.col("flag") == "AIS_SPOOFING_SUSPECTED", "AIS_SPOOFING_SUSPECTED_speed_jump"),
            seen(F.col("flag") == "PERMANENT_BLACKOUT", "PERMANENT_BLACKOUT_gap_exceeds_24h"),
            seen(F.col("coastal"), "coastal_departure_half_weight"),
        ).alias("dark_notes"),
    )


def dark_evidence(runs: DataFrame, points: DataFrame, windows: DataFrame) -> DataFrame:
    """Dark pillar of every run's pair, with a reason, also where there is nothing to score.

    Fewer than two positions (``points``) are no evidence; a track without scored silences is unsuspicious.
    """
    seen = points.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_points"))
    d = runs.select(*PAIR).distinct().join(seen, PAIR, "left").join(dark_scores(windows), PAIR, "left")
    score, notes = F.coalesce("dark_score", F.lit(0.0)), F.coalesce("dark_notes", F.lit(""))
    quiet = F.when(notes == "", "no_suspicious_gaps_detected").otherwise(notes)
    found = F.concat(
        F.format_string("dark_vessel_anomaly_detected (max_gap_score=%.4f)", score), F.when(notes == "", "").otherwise(F.concat(F.lit(" ["), notes, F.lit("]")))
    )
    return d.select(
        *PAIR, score.alias("dark_score"), F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"),
        F.when(F.coalesce("n_points", F.lit(0)) < 2, "INSUFFICIENT_EVIDENCE").when(score > 0, found).otherwise(quiet).alias("dark_reason"),
    )


def derive_sog_cog(track: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Fill missing speed from the way to the next point, missing course from its bearing.

    The last point takes over speed and course of the point before it.
    """
    keys = keys or ["mmsi"]
    t = neighbours(track, keys, "ts_s", ["lat", "lon", "speed_knots", "course"])
    last = F.col("next").isNull()

    def leg(end: str, c: str) -> Column:
        here = F.col(c)
        return (F.when(last, F.col(f"prev.{c}")).otherwise(here) if end == "a" else F.when(last, here).otherwise(F.col(f"next.{c}")))

    t = t.select("*", *[leg(e, c).alias(f"_{e}_{c}") for e in "ab" for c in ("lat", "lon", "ts_s")])
    t = with_geodesic(t, "_a_lat", "_a_lon", "_b_lat", "_b_lon", "_leg_m", "_leg_az")
    dt = F.col("_b_ts_s") - F.col("_a_ts_s")
    made = F.when(dt > 0, knots(F.col("_leg_m"), dt)).otherwise(0.0)
    own, before = F.col("speed_knots"), F.col("prev.speed_knots")
    speed = (
        F.when(own.isNotNull(), own)
        .when(~last, made)
        .when(F.col("prev").isNull(), 0.0)
        .otherwise(F.coalesce(before, made))
    )
    # without a speed of its own the previous point also had its course filled
    prev_course = F.coalesce("prev.course", F.when(before.isNull(), F.col("_leg_az")))
    course = (
        F.when(own.isNotNull() | (last & F.col("prev").isNull()), F.col("course"))
        .when(~last, F.coalesce("course", "_leg_az"))
        .otherwise(prev_course)
    )
    return t.select(*[c for c in track.columns if c not in ("speed_knots", "course")], speed.alias("speed_knots"), course.alias("course"))


def loitering_episodes(points: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """Slow episodes of each pair that qualify, one row each.

    ``points``: pair keys, ts_s, speed_knots, course, structs ``prev`` (with
    speed_knots) and ``next``, captured_s and boolean ``in_port``. A pair has at most a point for each second of its
    scene's window. ``tracks`` (mmsi, ts_s, speed_knots): where the points were taken from, ``SCENE_WINDOW_S`` around
    the scene; the speeds before an episode are then looked up there, and only slow points are moved by pair.
    """
    slow = F.col("speed_knots") < SLOW_KNOTS
    begins = slow & (F.col("prev").isNull() | (F.col("prev.speed_knots") >= SLOW_KNOTS))
    near = F.abs(F.col("ts_s") - F.col("captured_s")) <= SCENE_WINDOW_S
    may_start = slow & near & ~F.col("in_port") & F.col("next").isNotNull()
    # what carries on and what is kept are slow points: no other is shuffled
    rows = points.filter(slow).select(
        *PAIR, "ts_s", "speed_knots", "course", "captured_s",
        F.when(begins, F.col("ts_s")).alias("island"), F.when(may_start, F.col("ts_s")).alias("eligible"),
    )
    so_far = Window.partitionBy(*PAIR).orderBy("ts_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumns({f"{c}_before": F.last(c, ignorenulls=True).over(so_far) for c in ("island", "eligible")})
    arc, arc_shifted = narrowest_arc(F.col("course"))
    episodes = cut_lineage(
        marked.filter(F.col("eligible_before") >= F.col("island_before"))
        .groupBy(*PAIR, "island_before")
        .agg(
            F.min("ts_s").alias("start_s"), F.max("ts_s").alias("end_s"), F.min("captured_s").alias("captured_s"),
            F.avg("speed_knots").alias("avg_slow"), F.min("speed_knots").alias("min_slow"),
            F.least(arc, arc_shifted).alias("_arc"),
        )
        .withColumn("minutes", (F.col("end_s") - F.col("start_s")) / 60.0)
        .filter(F.col("minutes") >= LOITER_MIN)
        .drop("island_before")
    )
    hour = 3600
    before = episodes.select(
        *PAIR, "start_s", F.greatest(F.col("start_s") - hour, F.col("captured_s") - SCENE_WINDOW_S).alias("_from"),
        F.explode(F.sequence(F.floor((F.col("start_s") - hour) / hour), F.floor((F.col("start_s") - 1) / hour))).alias("_h"),
    )
    of = ["mmsi"] if tracks is not None else PAIR
    seen = (points if tracks is None else tracks).select(*of, F.col("ts_s").alias("_t"), "speed_knots", F.floor(F.col("ts_s") / hour).alias("_h"))
    cruise = (
        seen.join(before.hint("merge"), [*of, "_h"])
        .filter((F.col("_t") < F.col("start_s")) & (F.col("_t") >= (F.col("start_s") - hour if tracks is None else F.col("_from"))))
        .groupBy(*PAIR, "start_s").agg(F.max("speed_knots").alias("prev_max"))
    )
    drop = F.when(F.col("prev_max") > 0, (F.col("prev_max") - F.col("avg_slow")) / F.nullif(F.col("prev_max"), F.lit(0.0))).otherwise(0.0)
    base = F.when(F.col("minutes") >= 60, 0.35).otherwise(0.30)
    boosted = F.coalesce(F.col("_arc") >= 60, F.lit(False))
    return (
        episodes.join(cruise, [*PAIR, "start_s"])
        .filter((drop >= 0.5) | (F.col("prev_max") >= 10))
        .select(
            *PAIR, "start_s", "end_s", F.round("minutes", 1).alias("duration_min"),
            F.round("prev_max", 1).alias("initial_speed_knots"), F.round("min_slow", 1).alias("min_speed_knots"),
            boosted.alias("course_boost"),
            F.round(F.least(F.lit(LOITER_CAP), base * F.when(boosted, 1.2).otherwise(1.0)), 3).alias("score"),
        )
    )


def loitering_scores(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy(*PAIR).agg(F.max("score").alias("loiter_score"), F.count(F.lit(1)).alias("n_episodes"))


def behaviour_anomaly(vessels: DataFrame, gaps: DataFrame) -> DataFrame:
    """0..100 anomaly of each vessel (mmsi, vessel_type, speed_knots) and its flags."""
    g = gaps.groupBy("mmsi").agg(F.count(F.lit(1)).alias("n_gaps"), F.sum("duration_min").alias("gap_minutes"))
    v = vessels.join(g, "mmsi", "left")
    speed = F.coalesce("speed_knots", F.lit(10.0))
    kind = F.lower(F.coalesce("vessel_type", F.lit("")))

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(kind, F.lit(w))
        return out

    slow = (speed > 1) & (speed <= 5.5)
    risk = [(has("tanker", "crude", "oil"), 30.0, "HIGH_RISK_CARGO_CATEGORY"), (has("chemical", "lpg"), 25.0, "HAZARDOUS_LIQUID_CARRIER"), (has("cargo", "container"), 10.0, "COMMERCIAL_CARGO_CATEGORY")]
    points, label = F.when(risk[0][0], risk[0][1]), F.when(risk[0][0], risk[0][2])
    for cond, n, text in risk[1:]:
        points, label = points.when(cond, n), label.when(cond, text)
    score = (
        F.when(slow, 35.0).when(speed <= 1, 15.0).otherwise(0.0)
        + F.when(F.col("n_gaps") > 0, 40.0).otherwise(0.0)
        + F.coalesce(points, F.lit(0.0))
    )
    flags = F.array_compact(
        F.array(
            F.when(slow, "SLOW_TRANSIT_ANOMALY").when(speed <= 1, "DRIFTING_OR_ANCHORED"),
            F.when(F.col("n_gaps") > 0, "TRANSPONDER_BLACKOUT_DETECTED"),
            label,
        )
    )
    return v.select(
        "mmsi", F.least(F.lit(100.0), score).alias("anomaly_score"), flags.alias("flags"),
        F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), F.coalesce("gap_minutes", F.lit(0.0)).alias("gap_minutes"),
    )


def latest_positions(points: DataFrame, seq: str = "seq") -> DataFrame:
    """Newest position of each vessel; ties go to the later observation."""
    newest = points.groupBy("mmsi", "ts_s").agg(
        F.count(F.lit(1)).alias("_n"), *[F.max_by(F.col(c), F.col(seq)).alias(c) for c in ("lat", "lon", "speed_knots", "course")]
    )
    return newest.groupBy("mmsi").agg(
        F.sum("_n").alias("n_points"), F.max("ts_s").alias("ts_s"),
        *[F.max_by(c, "ts_s").alias(c) for c in ("lat", "lon", "speed_knots", "course")],
    )


def assemble_tracks(points: DataFrame, chunk_s: int = 86400) -> DataFrame:
    """Ordered waypoint arrays, one per vessel and day.

    A whole-life array of a busy vessel would have to fit one task, so the array is
    cut by time; ``chunk`` orders the pieces. Points are deduplicated first, so an array
    is never longer than its seconds.
    """
    numbered = points if "seq" in points.columns else points.withColumn("seq", F.struct("lat", "lon"))
    return (
        dedupe_track(numbered).groupBy("mmsi", F.floor(F.col("ts_s") / chunk_s).cast("long").alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("ts_s", "lat", "lon", "speed_knots", "course"))).alias("track"))
        .withColumn("n_points", F.size("track"))
    )


def merge_static(messages: DataFrame) -> DataFrame:
    """Latest non-empty static facts of each vessel.

    ``messages``: mmsi, ts_s, imo, name, vessel_type, dim_a..dim_d.
    """

    def latest(c: str) -> Column:
        known = F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.col("ts_s"))
        return F.max_by(F.col(c), known).alias(c)

    def extent(a: str, b: str, out: str) -> Column:
        total = F.col(a) + F.col(b)
        return F.max_by(total, F.when(total > 0, F.col("ts_s"))).cast("double").alias(out)

    return messages.groupBy("mmsi").agg(
        latest("imo"), latest("name"), latest("vessel_type"), extent("dim_a", "dim_b", "length"), extent("dim_c", "dim_d", "beam")
    )


def draft_change(runs: DataFrame, scenes: DataFrame, drafts: DataFrame, vessels: DataFrame, hours: int = 48) -> DataFrame:
    """Draft pillar of each run (scene_id, mmsi) from its vessel's readings around the scene time.

    ``drafts``: mmsi, ts_s, seq, draft_m. Readings near a run's window are numbered once per vessel. A run's
    readings are then a range of numbers, found by one aggregation; only the three on
    either side of the dividing reading are fetched. A run without readings has a row too.
    """
    at, ts, pos, draft = F.col("captured_s"), F.col("ts_s"), F.col("pos"), F.col("draft_m")
    known = drafts.filter(draft.isNotNull()).select("mmsi", "ts_s", "seq", "draft_m")
    known = facts_near_runs(runs, scenes, known, "ts_s", hours * 3600, hours * 3600, bucket_s=86400)
    numbered = cut_lineage(rank_in_group(known, ["mmsi"], [ts, F.col("seq")], F.floor(ts / 21600), "pos"))
    readings = facts_of_runs(runs, scenes, numbered, "ts_s", hours * 3600, hours * 3600, bucket_s=86400)
    near = F.abs(ts - at) <= 48 * 3600

    def counted(on: Column, tail: str) -> list[Column]:
        return [
            F.count_if(on).alias(f"n{tail}"), F.count_if(on & (ts <= at)).alias(f"nb{tail}"),
            F.min(F.when(on, draft)).alias(f"lo{tail}"), F.max(F.when(on, draft)).alias(f"hi{tail}"),
            F.min(F.when(on, pos)).alias(f"p0{tail}"), F.max(F.when(on, pos)).alias(f"p1{tail}"),
        ]

    raw = readings.groupBy(*PAIR).agg(
        (F.max(ts) - F.min(ts) > 30 * 86400).alias("_long"), *counted(F.lit(True), "_all"), *counted(near, "_near")
    )
    facts = raw.select(
        *PAIR, *[F.when(F.col("_long"), F.col(f"{c}_near")).otherwise(F.col(f"{c}_all")).alias(f"_{c}") for c in ("n", "nb", "lo", "hi", "p0", "p1")]
    )
    # with readings on one side only, the sequence is divided in the middle
    two_sided = (F.col("_nb") > 0) & (F.col("_nb") < F.col("_n"))
    before = F.when(two_sided, F.col("_nb")).otherwise(F.floor(F.col("_n") / 2)).cast("long")
    last = F.col("_p0") + before - 1
    wanted = (
        facts.filter(F.col("_n") >= 2)
        .select(*PAIR, "_p0", "_p1", last.alias("_last"), F.explode(F.sequence(last - 2, last + 3)).alias("pos"))
        .filter(pos.between(F.col("_p0"), F.col("_p1")))
    )
    picked = wanted.join(numbered.select("mmsi", "pos", "draft_m"), ["mmsi", "pos"])

    def median3(on: Column) -> Column:
        """Median of at most three values from their sum and extremes."""
        v = F.when(on, draft)
        n, rest = F.count_if(on), F.sum(v) - F.min(v) - F.max(v)
        return F.round(F.when(n == 3, rest).otherwise(F.avg(v)), 3)

    medians = picked.groupBy(*PAIR).agg(
        median3(pos <= F.col("_last")).alias("_before"), median3(pos > F.col("_last")).alias("_after")
    )
    d = runs.select(*PAIR).distinct().join(facts, PAIR, "left").join(medians, PAIR, "left").join(vessels.select("mmsi", "vessel_type"), "mmsi", "left")
    delta = F.col("_before") - F.col("_after")
    fishing = F.lower(F.trim(F.coalesce("vessel_type", F.lit("")))) == "fishing"
    few, same = F.coalesce("_n", F.lit(0)) < 2, F.coalesce(F.col("_lo") == F.col("_hi"), F.lit(False))
    reason = (
        F.when(fishing, "fishing_vessel_excluded")
        .when(few, "insufficient_draft_data")
        .when(same, "all_drafts_identical")
        .when(delta < 0, "ballast_taken")
        .when(delta < DRAFT_MIN_M, "draft_change_below_threshold")
        .when(delta > DRAFT_MAX_M, "DATA_ERROR_LARGE_CHANGE")
        .otherwise("significant_draft_decrease_detected")
    )
    scaled = F.least(F.lit(DRAFT_CAP), 0.40 + (delta - 0.50) / 2.00 * 0.40)
    score = (
        F.when(fishing | few | same | (delta < DRAFT_MIN_M), 0.0).when(delta > DRAFT_MAX_M, DRAFT_CAP).otherwise(F.round(scaled, 3))
    )
    blank = fishing | few
    return d.select(
        *PAIR, score.alias("draft_score"),
        F.when(~blank, F.when(same, F.round("_lo", 2)).otherwise(F.col("_before"))).alias("draft_before"),
        F.when(~blank, F.when(same, F.round("_lo", 2)).otherwise(F.col("_after"))).alias("draft_after"),
        reason.alias("draft_reason"),
    )


def drift_series(drift: DataFrame, of: str) -> DataFrame:
    """``of``, _d: each scene's (or run's) positions with a time, ordered; null where none has one."""
    places = drift.groupBy(of, "ts_s").agg(F.max("lat").alias("lat"), F.max_by("lon", "lat").alias("lon"))
    timed = F.when(F.col("ts_s").isNotNull() & F.col("lat").isNotNull(), F.struct(F.col("ts_s").alias("t"), "lat", "lon"))
    series = F.sort_array(F.collect_list(timed))
    return places.groupBy(of).agg(series.alias("_d")).select(of, F.when(F.size("_d") > 0, F.col("_d")).alias("_d"), F.lit(True).alias("_drift"))


def closest_approach(points: DataFrame, drift: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Closest approach of each pair's vessel to its scene's drifting slick.

    ``points``: deduplicated pair points with captured_s; ``drift``: scene_id, ts_s, lat, lon. With ``runs`` (run_id,
    scene_id, mmsi) the drift is keyed by run_id, and each run has a row of its own from its own simulation: two
    simulations of one scene are two rows. Positions of the drift without a time are not used.
    Instants are the times of both series within their common time span; the missing position is interpolated between
    the neighbours of the other series. A scene's (or run's) drift is one array, of the length of a simulation, joined
    to the steps between a vessel's positions (``prev``, see ``neighbours``; made here where it is missing), so the
    positions are neither repeated with the drift nor ordered once more.
    """
    of = "scene_id" if runs is None else "run_id"
    if "prev" not in points.columns:
        points = neighbours(points, PAIR, "ts_s", ["lat", "lon"])
    points, series = points.select(*PAIR, "ts_s", "captured_s", "lat", "lon", "prev"), drift_series(drift, of)
    if runs is None:
        points = points.join(small_side(series, SERIES_ROWS), of, "left")
    else:
        points = points.join(runs.select("run_id", *PAIR).join(series, of, "left").hint("shuffle_hash"), PAIR)
    return _approaches(points, PAIR if runs is None else ["run_id", *PAIR]).drop("drifted")


def approaches_of_runs(runs: DataFrame, scenes: DataFrame, tracks: DataFrame, drift: DataFrame) -> DataFrame:
    """``closest_approach`` of each run (run_id, scene_id, mmsi), and whether it has a drift at all (``drifted``).

    ``tracks``: deduplicated positions with ``prev`` and ``next``; ``drift`` is keyed by run_id or scene_id. A run takes
    its drift along to its vessel's positions, so only runs and vessels are moved, and no positions by run or pair.
    """
    of = "run_id" if "run_id" in drift.columns else "scene_id"
    series = drift_series(drift, of)
    r = runs.select("run_id", *PAIR).join(small_side(series, SERIES_ROWS) if of == "scene_id" else series.hint("shuffle_hash"), of, "left")
    steps = steps_of_runs(r, scenes, tracks.select("mmsi", "ts_s", "lat", "lon", "prev", "next"), SCENE_WINDOW_S // 3600, ("_d", "_drift", "_tb"))
    return _approaches(steps, ["run_id", *PAIR, "_tb"]).drop("_tb")


def _approaches(points: DataFrame, keys: list[str]) -> DataFrame:
    """Closest approach by ``keys`` from points with ``prev`` and the drift ``_d`` they are measured against."""
    steps = points.select(
        *keys, "ts_s", "captured_s", F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"),
        F.col("prev.ts_s").alias("p_s"), F.col("prev.lat").alias("p_lat"), F.col("prev.lon").alias("p_lon"), "_d", "_drift",
    )
    d, t = F.col("_d"), F.col("ts_s")

    def along(x: Column, t0: Column, x0: Column, t1: Column, x1: Column) -> Column:
        share = F.coalesce(F.try_divide((x - t0).cast("double"), (t1 - t0).cast("double")), F.lit(0.0))
        return x0 + share * (x1 - x0)

    # the drift's times are distinct and ordered: two counts tell every place in it
    times = F.col("_d.t")
    steps = steps.withColumns({"_n": F.size(F.filter(times, lambda x: x < t)), "_m": F.size(F.filter(times, lambda x: x <= F.col("p_s")))})
    at = F.get(d, F.col("_n"))
    steps = steps.withColumns(
        {
            "_in": F.when(F.col("p_s").isNotNull(), F.slice(d, F.col("_m") + 1, F.greatest(F.lit(0), F.col("_n") - F.col("_m")))),
            "_a": F.when(at["t"] == t, at).otherwise(F.get(d, F.col("_n") - 1)), "_b": at,
            "_d0": F.get(d, F.lit(0))["t"], "_d1": F.get(d, F.size(d) - 1)["t"],
        }
    ).drop("_d", "_n", "_m")
    a, b = F.col("_a"), F.col("_b")
    own = F.struct(
        t.alias("ts_s"), F.col("v_lat").alias("vlat"), F.col("v_lon").alias("vlon"),
        along(t, a["t"], a["lat"], b["t"], b["lat"]).alias("dlat"), along(t, a["t"], a["lon"], b["t"], b["lon"]).alias("dlon"), F.lit(True).alias("own"),
    )

    def between(x: Column) -> Column:
        lat, lon = (along(x["t"], F.col("p_s"), F.col(f"p_{c}"), t, F.col(f"v_{c}")) for c in ("lat", "lon"))
        return F.struct(x["t"].alias("ts_s"), lat.alias("vlat"), lon.alias("vlon"), x["lat"].alias("dlat"), x["lon"].alias("dlon"), F.lit(False).alias("own"))

    inner = F.coalesce("_in", F.array().cast(steps.schema["_in"].dataType))
    times = F.concat(F.array("p_s"), F.transform(inner, lambda x: x["t"]), F.array("ts_s"))
    steps = steps.withColumn("_times", F.filter(times, lambda x: x.between(F.col("_d0"), F.col("_d1"))))
    apart = F.transform("_times", lambda x, i: x - F.get(F.col("_times"), i - 1))
    grid = steps.select(
        *keys, "captured_s", "_drift", F.array_max(apart).alias("_step"), F.explode(F.concat(F.array(own), F.transform(inner, between))).alias("i")
    ).select(
        *keys, "captured_s", "_drift", "_step", "i.ts_s", "i.vlat", "i.vlon", "i.dlat", "i.dlon",
        *[F.when(F.col("i.own"), F.col(f"i.v{c}")).alias(f"v_{c}") for c in ("lat", "lon")],
    )
    dist = with_geodesic(grid, "vlat", "vlon", "dlat", "dlon", "dist_m")
    place = F.struct("dist_m", "ts_s", "vlat", "vlon", "dlat", "dlon")
    out = dist.groupBy(*keys).agg(
        F.min(F.when(F.col("dist_m").isNotNull(), place)).alias("b"), F.max("_step").alias("_step"),
        F.count("v_lat").alias("n_points"), F.min("captured_s").alias("captured_s"), F.bool_or("_drift").alias("drifted"),
        ((F.min("v_lat") == F.max("v_lat")) & (F.min("v_lon") == F.max("v_lon"))).alias("_still"),
    )
    out = out.withColumn("b", F.when(F.col("n_points") >= 2, F.col("b")))
    m = F.col("b.dist_m")
    low = F.coalesce(F.col("_step") > CPA_GAP_S, F.lit(False)) | m.isNull()
    raw = F.when(m.isNull() | F.col("_still") | (m >= CPA_ZERO_M), 0.0).when(m <= CPA_FULL_M, 1.0).otherwise(1 - (m - CPA_FULL_M) / (CPA_ZERO_M - CPA_FULL_M))
    return out.select(
        *keys, "n_points", F.round(m, 3).alias("min_distance_m"), F.col("b.ts_s").alias("cpa_s"),
        (F.col("b.ts_s") - F.col("captured_s")).alias("tcpa_seconds"),
        F.round(F.when(low, raw * 0.5).otherwise(raw), 4).alias("cpa_score"), low.alias("low_confidence"),
        F.col("b.vlat").alias("vessel_lat"), F.col("b.vlon").alias("vessel_lon"),
        F.col("b.dlat").alias("slick_lat"), F.col("b.dlon").alias("slick_lon"), "drifted",
    )
