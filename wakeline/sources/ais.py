"""Readers for AIS files and ship-presence reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.geo import haversine_km
from wakeline.schemas import AIS_CSV, PRESENCE

# Defaults for fields a presence report may lack.
DEFAULTS = {
    "imo": "9000000", "flag": "Unknown", "vessel_type": "Commercial Vessel", "dwt": 50000.0,
    "length": 180.0, "beam": 28.0, "speed_knots": 10.0, "heading": 0.0,
}
FALLBACK_TIME = "2017-01-28T00:00:00Z"
FALLBACK_MMSI = "9990000"


def read_ais_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text: typing and rejection belong to ``validate_ais``."""
    return spark.read.schema(AIS_CSV).csv(path, header=True, mode="PERMISSIVE")


def read_presence_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return presence_points(spark.read.schema(PRESENCE).json(path, multiLine=multiline))


def presence_points(records: DataFrame) -> DataFrame:
    """Daily presence records as canonical positions with defaults filled in."""
    d = DEFAULTS
    ts = F.coalesce("entryTimestamp", "date", F.lit(FALLBACK_TIME))
    return records.filter(F.coalesce("mmsi", F.lit("")) != "").select(
        "mmsi",
        F.coalesce("shipName", F.concat(F.lit("Vessel-"), F.right("mmsi", F.lit(4)))).alias("name"),
        F.coalesce("imo", F.lit(d["imo"])).alias("imo"),
        F.coalesce("flag", F.lit(d["flag"])).alias("flag"),
        F.coalesce("vesselType", F.lit(d["vessel_type"])).alias("vessel_type"),
        *[F.lit(d[k]).alias(k) for k in ("dwt", "length", "beam", "speed_knots", "heading")],
        F.unix_seconds(F.regexp_replace(ts, "Z$", "+00:00").try_cast("timestamp")).alias("ts_s"),
        "lat", "lon",
    )


def explode_report(df: DataFrame, body: str, record_schema: str) -> DataFrame:
    """Report text {"entries": [{dataset: [record, ...]}, ...]} -> one row per record."""
    parsed = F.from_json(F.col(body), f"struct<entries:array<map<string,array<{record_schema}>>>>")
    keep = [c for c in df.columns if c != body]
    return (
        df.select(*keep, F.explode(parsed["entries"]).alias("_entry"))
        .select(*keep, F.explode("_entry").alias("dataset", "_records"))
        .select(*keep, "dataset", F.explode("_records").alias("_r"))
        .select(*keep, "dataset", "_r.*")
    )


_FEATURE = (
    "struct<geometry:struct<coordinates:array<double>>,properties:struct<MMSI:string,mmsi_lower:string,"
    "VesselName:string,IMO:string,Flag:string,VesselType:string,DWT:double,Length:double,Beam:double,"
    "Speed:double,Heading:double>>"
)


def parse_feature(df: DataFrame, body: str, lat0: Column, lon0: Column) -> DataFrame:
    """GeoJSON point feature text -> vessel row with defaults and distance to the slick."""
    d = DEFAULTS
    f = F.from_json(F.col(body), _FEATURE)
    p, xy = f["properties"], f["geometry"]["coordinates"]
    mmsi = F.coalesce(p["MMSI"], F.get_json_object(F.col(body), "$.properties.mmsi"), F.lit(FALLBACK_MMSI))
    keep = [c for c in df.columns if c != body]
    out = df.select(
        *keep,
        mmsi.alias("mmsi"),
        F.coalesce(p["VesselName"], F.concat(F.lit("GFW-"), F.right(mmsi, F.lit(4)))).alias("name"),
        F.coalesce(p["IMO"], F.lit(d["imo"])).alias("imo"),
        F.coalesce(p["Flag"], F.lit(d["flag"])).alias("flag"),
        F.coalesce(p["VesselType"], F.lit(d["vessel_type"])).alias("vessel_type"),
        F.coalesce(p["DWT"], F.lit(d["dwt"])).alias("dwt"),
        F.coalesce(p["Length"], F.lit(d["length"])).alias("length"),
        F.coalesce(p["Beam"], F.lit(d["beam"])).alias("beam"),
        F.coalesce(p["Speed"], F.lit(d["speed_knots"])).alias("speed_knots"),
        F.coalesce(p["Heading"], F.lit(d["heading"])).alias("heading"),
        F.coalesce(F.try_element_at(xy, F.lit(2)), lat0).alias("lat"),
        F.coalesce(F.try_element_at(xy, F.lit(1)), lon0).alias("lon"),
        lat0.alias("_lat0"), lon0.alias("_lon0"),
    )
    return out.withColumn("distance_km", F.round(haversine_km("_lat0", "_lon0", "lat", "lon"), 2)).drop("_lat0", "_lon0")
