"""Validation, typing and normalisation of AIS input; vessel defaults; areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.geo import bbox_half_extent, haversine_km
from wakeline.functions.grid import cell_x, cell_y, cells_around
from wakeline.functions.text import contains_any

# Reject reasons in the order the rules apply.
REJECT_REASONS = ["empty_row", "bad_mmsi", "bad_coordinates", "outside_bbox", "bad_utc", "outside_window"]

# Named sea areas (min lat, max lat, min lon, max lon).
SEA_AREAS = {
    "mumbai_high": (18.0, 20.5, 71.0, 73.5),
    "gulf_of_kutch": (21.5, 23.5, 68.0, 70.5),
    "chennai_ennore": (12.5, 14.2, 80.0, 81.5),
    "haldia_sundarbans": (21.0, 22.6, 87.5, 89.2),
}

# Oil type by vessel type keyword, and by cargo.
OIL_BY_VESSEL = [
    ("crude", "GENERIC HEAVY CRUDE"),
    ("chemical", "GENERIC MEDIUM CRUDE"),
    ("cargo", "FUEL OIL NO. 6"),
    ("container", "FUEL OIL NO. 6"),
    ("fishing", "DIESEL"),
]
OIL_DEFAULT = "GENERIC MEDIUM CRUDE"
# Fixed oil types of cargo names.
OIL_BY_CARGO = {
    "crude_oil": "GENERIC HEAVY CRUDE",
    "diesel": "DIESEL",
    "fuel_oil": "FUEL OIL NO. 6",
    "gasoline": "GASOLINE",
    "unknown": "GENERIC MEDIUM CRUDE",
}
TANKER_DWT, OTHER_DWT = 85000.0, 45000.0


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c)) == "")


def type_ais(raw: DataFrame) -> DataFrame:
    """Typed copies of the text columns; unparsable text becomes null."""
    return raw.select(
        "*",
        F.trim("MMSI").try_cast("long").alias("mmsi_n"),
        F.trim("LAT").try_cast("double").alias("lat_d"),
        F.trim("LON").try_cast("double").alias("lon_d"),
        F.unix_seconds(F.trim("UTC").try_cast("timestamp")).alias("utc_s"),
    )


def validate_ais(
    raw: DataFrame,
    bbox: tuple[float, float, float, float],
    t0_s: int,
    hours: float,
) -> DataFrame:
    """Add ``reject_reason`` (null when the row is good). bbox = lon/lat min, lon/lat max.

    Every row gets its reason in one pass; ``reject_counts`` and ``kept`` read it.
    """
    lon0, lat0, lon1, lat1 = bbox
    d = type_ais(raw)
    empty = _blank("MMSI") | _blank("LON") | _blank("LAT") | _blank("UTC")
    bad_mmsi = F.col("mmsi_n").isNull() | ~F.col("mmsi_n").between(100000000, 999999999)
    bad_coord = (
        F.col("lat_d").isNull() | F.col("lon_d").isNull()
        | ~F.col("lat_d").between(-90, 90) | ~F.col("lon_d").between(-180, 180)
    )
    outside = ~(F.col("lon_d").between(lon0, lon1) & F.col("lat_d").between(lat0, lat1))
    span = int(hours * 3600)
    late = ~F.col("utc_s").between(t0_s - span, t0_s + span)
    rules = [empty, bad_mmsi, bad_coord, outside, F.col("utc_s").isNull(), late]
    reason = F.when(rules[0], REJECT_REASONS[0])
    for rule, name in zip(rules[1:], REJECT_REASONS[1:]):
        reason = reason.when(rule, name)
    return d.withColumn("reject_reason", reason)


def reject_counts(validated: DataFrame) -> DataFrame:
    return validated.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def kept(validated: DataFrame, limit: int | None = None, required: bool = False) -> DataFrame:
    """Good rows; ``limit`` is the ingest ceiling the caller asks for, in time order. ``required``: raise if there are none."""
    good = validated.filter(F.col("reject_reason").isNull())
    if required and good.isEmpty():
        raise ValueError("no AIS row is left after validation")
    return good if limit is None else good.orderBy("utc_s", "MMSI").limit(limit)


def clamp_kinematics(df: DataFrame) -> DataFrame:
    """SOG to 0..100 and COG to 0..360 (0 when not numeric); odd HEADING becomes null."""

    def clamp(c: str, hi: float) -> Column:
        v = F.trim(F.col(c)).try_cast("double")
        v = F.when(F.isnan(v), None).otherwise(v)
        return F.coalesce(F.least(F.lit(hi), F.greatest(F.lit(0.0), v)), F.lit(0.0))

    heading = F.trim(F.col("HEADING")).try_cast("double")
    return df.select(
        *[c for c in df.columns if c not in ("SOG", "COG", "HEADING")],
        clamp("SOG", 100.0).alias("speed_knots"),
        clamp("COG", 360.0).alias("course"),
        F.when(heading.between(0, 360), heading).alias("heading"),
    )


def normalise_mmsi(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike("^[0-9]{1,9}$"), F.lpad(t, 9, "0"))


def canonical_points(df: DataFrame) -> DataFrame:
    """One canonical shape from the aliases position feeds use.

    Time may be epoch seconds or ISO text; text without an offset means UTC.
    """
    have = set(df.columns)

    def first(*names: str) -> Column:
        cols = [F.col(n).cast("string") for n in names if n in have]
        return F.coalesce(*cols) if cols else F.lit(None).cast("string")

    t = F.trim(first("time", "timestamp"))
    iso = F.regexp_replace(t, "Z$", "+00:00")
    ts = F.coalesce(F.unix_seconds(F.timestamp_seconds(t.try_cast("double"))), F.unix_seconds(iso.try_cast("timestamp")))
    rest = [c for c in df.columns if c not in {"lat", "latitude", "lon", "lng", "longitude", "time", "timestamp", "speed", "sog", "course", "cog", "heading"}]
    return df.select(
        *rest,
        first("lat", "latitude").try_cast("double").alias("lat"),
        first("lon", "lng", "longitude").try_cast("double").alias("lon"),
        ts.alias("ts_s"),
        first("speed", "sog").try_cast("double").alias("speed_knots"),
        first("course", "cog", "heading").try_cast("double").alias("course"),
    )


def bbox_around(df: DataFrame, lat: str, lon: str, radius_km: float) -> DataFrame:
    dlat, dlon = bbox_half_extent(F.col(lat), radius_km)
    return df.select(
        "*",
        (F.col(lat) - dlat).alias("min_lat"), (F.col(lat) + dlat).alias("max_lat"),
        (F.col(lon) - dlon).alias("min_lon"), (F.col(lon) + dlon).alias("max_lon"),
    )


def assign_area(df: DataFrame, areas: dict[str, tuple[float, float, float, float]] | None = None) -> DataFrame:
    """Name of the sea area a position lies in; the areas do not overlap, so no join is needed."""
    name = F.lit(None).cast("string")
    for k, (lat0, lat1, lon0, lon1) in (areas or SEA_AREAS).items():
        name = F.when(F.col("lat").between(lat0, lat1) & F.col("lon").between(lon0, lon1), F.lit(k)).otherwise(name)
    return df.withColumn("area", name)


def radius_filter(points: DataFrame, centres: DataFrame, radius_km: float, deg: float = 1.0) -> DataFrame:
    """Positions within ``radius_km`` of centres (centre_id, centre_lat, centre_lon).

    Centres list the grid cells they can reach and meet the positions on equal cells.
    """
    c = centres.select(
        "centre_id", "centre_lat", "centre_lon",
        F.explode(cells_around(F.col("centre_lat"), F.col("centre_lon"), radius_km, deg)).alias("cell"),
    ).select("centre_id", "centre_lat", "centre_lon", "cell.cy", "cell.cx")
    p = points.withColumn("cy", cell_y(F.col("lat"), deg)).withColumn("cx", cell_x(F.col("lon"), deg))
    d = F.round(haversine_km("centre_lat", "centre_lon", "lat", "lon"), 2)
    return p.join(c, ["cy", "cx"]).withColumn("distance_km", d).filter(F.col("distance_km") <= radius_km).drop("cy", "cx")


def oil_type_of_vessel(vessel_type: Column) -> Column:
    t = F.lower(vessel_type)
    out = F.when(F.contains(t, F.lit(OIL_BY_VESSEL[0][0])), OIL_BY_VESSEL[0][1])
    for word, oil in OIL_BY_VESSEL[1:]:
        out = out.when(F.contains(t, F.lit(word)), oil)
    return out.otherwise(OIL_DEFAULT)


def oil_type_of_cargo(cargo: Column) -> Column:
    """Oil type of a cargo's name; an unknown one, also null, is medium crude."""
    known = F.create_map(*[F.lit(x) for pair in OIL_BY_CARGO.items() for x in pair])
    return F.coalesce(known[F.lower(cargo)], F.lit(OIL_DEFAULT))


def with_capacity_defaults(vessels: DataFrame) -> DataFrame:
    """Missing tonnage by type, missing name from the last four digits of the MMSI."""
    tanker = contains_any(F.lower("vessel_type"), ["tanker"])
    return vessels.withColumn(
        "dwt", F.coalesce("dwt", F.when(tanker, TANKER_DWT).otherwise(OTHER_DWT))
    ).withColumn(
        "vessel_name", F.coalesce("vessel_name", F.concat(F.lit("Vessel-"), F.right("mmsi", F.lit(4))))
    )


def list_spills(spills: DataFrame, scenes: DataFrame, status: str | None, limit: int, offset: int, scene_id=None) -> DataFrame:
    """One page of spills with their scene, newest first; ``status`` and ``scene_id`` narrow it."""
    s = spills if status is None else spills.filter(F.col("status") == status)
    s = s if scene_id is None else s.filter(F.col("scene_id") == scene_id)
    return s.join(scenes, "scene_id").orderBy(F.desc("captured_s"), "scene_id").offset(offset).limit(limit)
