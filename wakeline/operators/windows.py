"""Facts of a drift run's vessel around the scene time, by (vessel, time bucket)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.grid import time_bucket, time_buckets
from wakeline.session import by_keys

HOUR = 3600
BUCKET_S = 6 * HOUR


def facts_of_runs(
    runs: DataFrame, scenes: DataFrame, facts: DataFrame, ts: str, before_s: int, after_s: int,
    bucket_s: int = BUCKET_S, dealt: bool = False, keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Join each run (run_id, scene_id, mmsi) with its vessel's facts in
    [captured - before, captured + after], bounds included.

    The time bucket in the key turns the range into an equality and spreads a vessel
    with very many facts over as many partitions as it has buckets. With ``keep``, columns of ``runs`` that go with the
    facts, a run lies in one bucket as wide as its window, and facts lie in the two whose runs can see them: a run, heavy
    with its drift, is then moved once.
    """
    at = F.col("captured_s")
    if keep is not None:
        w = before_s + after_s
        r = runs.join(scenes.select("scene_id", "captured_s"), "scene_id").select(
            "run_id", "scene_id", "mmsi", "captured_s", *[c for c in keep if c != "_tb"], time_bucket(at, w).alias("_tb")
        )
        f = facts.withColumn("_tb", F.explode(time_buckets(F.col(ts) - after_s, F.col(ts) + before_s, w)))
        # exploded facts count as few in Spark's estimates, so the hint keeps either side from the driver
        met = f.join(r.hint("merge"), ["mmsi", "_tb"]).filter(F.col(ts).between(at - before_s, at + after_s))
        return met if "_tb" in keep else met.drop("_tb")
    r = (
        runs.join(scenes.select("scene_id", "captured_s"), "scene_id")
        .select("run_id", "scene_id", "mmsi", "captured_s", F.explode(time_buckets(at - before_s, at + after_s, bucket_s)).alias("_tb"))
    )
    f = facts.withColumn("_tb", time_bucket(F.col(ts), bucket_s))
    if dealt:  # exploded keys count as few in Spark's estimates, so the hint keeps them from the driver
        r = by_keys(r, "mmsi", "_tb").hint("merge")
    return f.join(r, ["mmsi", "_tb"]).filter(F.col(ts).between(at - before_s, at + after_s)).drop("_tb")


def facts_near_runs(
    runs: DataFrame, scenes: DataFrame, facts: DataFrame, ts: str, before_s: int, after_s: int, bucket_s: int = BUCKET_S,
) -> DataFrame:
    """The facts of vessels with a run in the time buckets the run's window touches, and no others.

    A step before costly work on facts: it keeps the vessel and time filter below that work.
    """
    at = F.col("captured_s")
    wanted = (
        runs.join(scenes.select("scene_id", "captured_s"), "scene_id")
        .select("mmsi", F.explode(time_buckets(at - before_s, at + after_s, bucket_s)).alias("_tb")).distinct()
    )
    return facts.withColumn("_tb", time_bucket(F.col(ts), bucket_s)).join(wanted, ["mmsi", "_tb"], "left_semi").drop("_tb")


def tracks_of_runs(runs, scenes, tracks, hours: int = 6, keep: tuple[str, ...] | None = None) -> DataFrame:
    return facts_of_runs(runs, scenes, tracks, "ts_s", hours * HOUR, hours * HOUR, keep=keep)


def steps_of_runs(
    runs: DataFrame, scenes: DataFrame, tracks: DataFrame, hours: int = 6, keep: tuple[str, ...] | None = None
) -> DataFrame:
    """``tracks_of_runs`` of tracks with ``prev`` and ``next`` (see ``neighbours``), which are null outside a run's window.

    A vessel's neighbours are found once, not once more for every run that looks at them.
    """
    p, at = tracks_of_runs(runs, scenes, tracks, hours, keep), F.col("captured_s")
    return p.withColumns(
        {
            "prev": F.when(F.col("prev.ts_s") >= at - hours * HOUR, F.col("prev")),
            "next": F.when(F.col("next.ts_s") <= at + hours * HOUR, F.col("next")),
        }
    )


def gaps_of_runs(runs, scenes, gaps, hours: int = 6) -> DataFrame:
    return facts_of_runs(runs, scenes, gaps, "gap_start_s", hours * HOUR, hours * HOUR)


def drafts_of_runs(runs, scenes, drafts, hours: int = 48) -> DataFrame:
    known = drafts.filter(F.col("draft_m").isNotNull())
    return facts_of_runs(runs, scenes, known, "ts_s", hours * HOUR, hours * HOUR, bucket_s=24 * HOUR)
