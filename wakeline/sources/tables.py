"""Track tables chunked by week, and idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEEK_S = 7 * 86400


def write_tracks(tracks: DataFrame, path: str, mode: str = "append") -> None:
    """Seven-day chunks; inside a chunk files are ranges of (vessel, time).

    Range partitioning also splits a vessel with very many rows, and gives the
    files narrow min/max statistics for both columns.
    """
    (
        tracks.withColumn("week", F.floor(F.col("ts_s") / WEEK_S).cast("int"))
        .repartitionByRange("week", "mmsi", "ts_s")
        .sortWithinPartitions("week", "mmsi", "ts_s")
        .write.mode(mode)
        .partitionBy("week")
        .parquet(path)
    )


def read_tracks(spark: SparkSession, path: str, from_s: int | None = None, to_s: int | None = None) -> DataFrame:
    """Read a time span; only the chunks it touches are listed."""
    t = spark.read.parquet(path)
    if from_s is not None:
        t = t.filter((F.col("week") >= from_s // WEEK_S) & (F.col("ts_s") >= from_s))
    if to_s is not None:
        t = t.filter((F.col("week") <= to_s // WEEK_S) & (F.col("ts_s") <= to_s))
    return t.drop("week")


def absent_rows(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows to insert under 'on conflict do nothing': the first of each key, not yet stored."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return first.select(*keys, "_r.*").join(existing.select(*keys).distinct(), keys, "left_anti").select(*incoming.columns)


def same_span(existing: DataFrame, incoming: DataFrame, ts: str) -> DataFrame:
    """Stored rows in the time span of the new ones: the rest cannot collide and is not read.

    Two numbers come to the driver; the filter reaches the scan, and on week-chunked
    tables it prunes whole folders.
    """
    span = incoming.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
    if span["lo"] is None:
        return existing.limit(0)
    rows = existing.filter(F.col(ts).between(span["lo"], span["hi"]))
    if "week" in existing.columns:
        rows = rows.filter(F.col("week").between(span["lo"] // WEEK_S, span["hi"] // WEEK_S))
    return rows


def append_if_absent(
    spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], order: str, ts: str | None = None
) -> None:
    """Append the rows whose key the table lacks; repeating a batch adds nothing.

    With ``ts``, one of the keys, only the stored rows of the same time span are compared.
    A week-chunked table stays one: Spark reads no files beside its ``week=`` folders.
    """
    existing = spark.read.parquet(path)
    chunked = "week" in existing.columns and "week" not in incoming.columns
    if ts:
        existing = same_span(existing, incoming, ts)
    new = absent_rows(existing, incoming, keys, order)
    if chunked:
        write_tracks(new, path)
    else:
        new.write.mode("append").parquet(path)


def track_record_id(df: DataFrame) -> DataFrame:
    """Natural key of a position: '<mmsi>:<utc>'."""
    utc = F.date_format(F.timestamp_seconds("ts_s"), "yyyy-MM-dd HH:mm:ss")
    return df.withColumn("source_record_id", F.concat_ws(":", "mmsi", utc))


def upsert_vessels(spark: SparkSession, path: str, points: DataFrame) -> None:
    """Appends a row to the stored registry for every MMSI seen on the air that it lacks; doing it again adds nothing."""
    known = spark.read.parquet(path)
    new = known.limit(0).unionByName(unknown_vessels(points, known), allowMissingColumns=True)
    new.write.mode("append").parquet(path)


def unknown_vessels(points: DataFrame, vessels: DataFrame) -> DataFrame:
    """MMSIs seen on the air but missing from the registry, as new registry rows."""
    return (
        points.select("mmsi").distinct().join(vessels.select("mmsi"), "mmsi", "left_anti")
        .withColumn("vessel_type", F.lit("unknown"))
    )
