"""Gating, cooldown and assembly of coast-guard alerts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.geo import eta_hours
from wakeline.operators.contacts import interceptors_near, nearest_stations

# Fixed values of the response rules.
MIN_CONFIDENCE = 0.75
HIGH_CONFIDENCE = 0.90
COOLDOWN_S = 30 * 60
DAY_S = 86400
BACKUPS = 2
NAMED_ASSETS = 5


def with_confidence(requests: DataFrame) -> DataFrame:
    """Filter confidence, else detection confidence, else 0; a zero counts as absent."""
    zero = F.lit(0.0)
    return requests.withColumn(
        "confidence", F.coalesce(F.nullif("filter_confidence", zero), F.nullif("detection_confidence", zero), zero)
    )


def _places(requests: DataFrame) -> DataFrame:
    """Every distinct location once, named by itself: stations and assets are searched per place, not per request."""
    return requests.select("lat", "lon").distinct().withColumn("incident_id", F.struct("lat", "lon"))


def gate_incidents(requests: DataFrame, stations: DataFrame) -> DataFrame:
    """Add the primary station and the reason for which a request is stopped (null = passes).

    ``requests``: request_id, lat, lon, verified, filter_confidence, detection_confidence, requested_s.
    """
    r = with_confidence(requests)
    early = (
        F.when(~F.coalesce("verified", F.lit(False)), "not_verified_oil")
        .when(F.col("lat").isNull() | F.col("lon").isNull(), "missing_coordinates")
        .when(F.col("confidence") < MIN_CONFIDENCE, "below_confidence_threshold")
    )
    r = r.withColumn("_early", early)
    places = _places(r.filter(F.col("_early").isNull()))
    primary = nearest_stations(places, stations, k=1).select(F.col("incident_id").alias("_place"), "station_id", "station_name", "distance_km")
    d = r.withColumn("_place", F.when(F.col("_early").isNull(), F.struct("lat", "lon"))).join(primary, "_place", "left").drop("_place")
    return d.withColumn(
        "reason", F.coalesce("_early", F.when(F.col("station_id").isNull(), "no_station_in_range"))
    ).drop("_early")


def _day_steps(ticks: pd.DataFrame, cooldown_s: int) -> pd.DataFrame:
    """How a day carries the last dispatch on: ``last`` for every earlier last dispatch under ``below``.

    The steps ascend; a last dispatch at or above all of them passes the day unchanged, all its requests being stopped.
    """
    station, day = ticks["station_id"].iloc[0], ticks["day"].iloc[0]
    s = np.sort(ticks["requested_s"].to_numpy())
    after = np.searchsorted(s, s + cooldown_s, side="right")
    # no dispatch of an earlier day reaches past the first request that lies a cooldown within this day
    n = min(len(s), int(np.searchsorted(s, day * DAY_S + cooldown_s)) + 1)
    at = np.arange(n)
    while (after[at] < len(s)).any():
        at = np.where(after[at] < len(s), after[at], at)
    below, last = s[:n] - cooldown_s, s[at]
    step = np.append(last[1:] != last[:-1], True)
    return pd.DataFrame({"station_id": station, "day": day, "below": below[step], "last": last[step]})


def _carried(days: pd.DataFrame) -> pd.DataFrame:
    """The last dispatch before each day of a station: its days' steps, one after the other."""
    out, last = [], None
    for day, steps in days.sort_values(["day", "below"]).groupby("day", sort=True):
        out.append((steps["station_id"].iloc[0], day, last))
        below = steps["below"].to_numpy()
        k = 0 if last is None else int(np.searchsorted(below, last, side="right"))
        last = int(steps["last"].iloc[k]) if k < len(below) else last
    return pd.DataFrame(out, columns=["station_id", "day", "last"]).astype({"last": "Int64"})


def _dispatched(ticks: pd.DataFrame, carried: pd.DataFrame, cooldown_s: int) -> pd.DataFrame:
    """The seconds of a day that are dispatched, given the last dispatch before it."""
    s = np.sort(ticks["requested_s"].to_numpy())
    last = carried["last"].iloc[0]
    k = 0 if pd.isna(last) else int(np.searchsorted(s, last + cooldown_s, side="right"))
    kept = []
    while k < len(s):
        kept.append(s[k])
        k = int(np.searchsorted(s, s[k] + cooldown_s, side="right"))
    return pd.DataFrame({"station_id": ticks["station_id"].iloc[0], "requested_s": np.array(kept, np.int64)})


def cooldown(gated: DataFrame, cooldown_s: int = COOLDOWN_S) -> DataFrame:
    """Mark requests of a station that come within the cooldown of its last dispatched one.

    Whether a request is dispatched depends on all before it, but a day acts on what came before only as a step
    function: last dispatch before the day -> last dispatch after it, with at most one step per second of the
    cooldown. The steps are found per (station, day) in parallel, composed along the days of a station (only steps
    go into that group, no requests), and every day is then replayed from its own last dispatch, in parallel again. No
    group holds more than a day's distinct seconds, and a station that never pauses is many days. A cooldown may not
    be longer than a day.
    """
    if not 0 <= cooldown_s <= DAY_S:
        raise ValueError("the cooldown may not be longer than a day")
    open_ = gated.filter(F.col("reason").isNull())
    ticks = open_.groupBy("station_id", F.col("requested_s").cast("long").alias("requested_s")).agg(F.min("request_id").alias("request_id"))
    days = ticks.select("station_id", "requested_s", F.floor(F.col("requested_s") / DAY_S).alias("day"))
    station = ticks.schema["station_id"].dataType.simpleString()
    steps = days.groupBy("station_id", "day").applyInPandas(lambda t: _day_steps(t, cooldown_s), f"station_id {station}, day long, below long, last long")
    carried = steps.groupBy("station_id").applyInPandas(_carried, f"station_id {station}, day long, last long")
    sent = (
        days.groupBy("station_id", "day").cogroup(carried.groupBy("station_id", "day"))
        .applyInPandas(lambda t, c: _dispatched(t, c, cooldown_s), f"station_id {station}, requested_s long")
        .join(ticks, ["station_id", "requested_s"]).select("request_id", F.lit(True).alias("_sent"))
    )
    return gated.join(sent, "request_id", "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("_sent").isNull(), "cooldown"))
    ).drop("_sent")


def build_alerts(decided: DataFrame, stations: DataFrame, assets: DataFrame) -> DataFrame:
    """One alert per dispatched request: stations, severity, ETA and nearby response assets."""
    sent = decided.filter(F.col("reason").isNull())
    at = _places(sent)
    names = nearest_stations(at, stations, k=1 + BACKUPS).filter("rank > 1").groupBy("incident_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "station_name"))), lambda s: s["station_name"]).alias("backup_stations")
    )
    near = interceptors_near(at, assets)
    counts = near.groupBy("incident_id").agg(F.count(F.lit(1)).alias("interception_count"))
    w = Window.partitionBy("incident_id").orderBy("asset_km", "asset_mmsi")
    five = near.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= NAMED_ASSETS).groupBy("incident_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "asset_name"))), lambda s: s["asset_name"]).alias("nearest_vessels")
    )
    empty = F.array().cast("array<string>")
    found = [x.withColumnRenamed("incident_id", "_place") for x in (names, counts, five)]
    d = sent.withColumnRenamed("request_id", "incident_id").withColumn("_place", F.struct("lat", "lon"))
    for x in found:
        d = d.join(x, "_place", "left")
    return d.select(
        "incident_id", "station_id", "station_name", F.col("distance_km").alias("station_distance_km"),
        F.coalesce("backup_stations", empty).alias("backup_stations"),
        F.when(F.col("confidence") >= HIGH_CONFIDENCE, "HIGH").otherwise("MODERATE").alias("severity"),
        F.round("confidence", 3).alias("confidence"), F.coalesce("interception_count", F.lit(0)).alias("interception_count"),
        F.coalesce("nearest_vessels", empty).alias("nearest_vessels"), eta_hours(F.col("distance_km")).alias("eta_hours"),
        F.col("requested_s").alias("created_s"),
    )


def list_alerts(alerts: DataFrame, limit: int = 50) -> DataFrame:
    return alerts.orderBy(F.desc("created_s"), F.desc("incident_id")).limit(max(1, min(500, limit)))


def apply_acks(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts with their last acknowledgement (incident_id, acked_by, acked_s)."""
    last = acks.groupBy("incident_id").agg(F.max(F.struct("acked_s", "acked_by")).alias("_a"))
    return alerts.join(last, "incident_id", "left").withColumns({"acked_by": F.col("_a.acked_by"), "acked_s": F.col("_a.acked_s")}).drop("_a")


def unknown_acks(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    return acks.join(alerts.select("incident_id"), "incident_id", "left_anti").select("incident_id").distinct()
