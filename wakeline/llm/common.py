"""Small pieces the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word: ASCII letters and digits, and every character beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def words_of(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % divisor


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def least_hashed(rows: DataFrame, label: str, limit: Column) -> DataFrame:
    """Up to ``limit`` rows of each non-null label, those of least ``h`` (a 64-bit hash), then least ``doc_id``.

    Counts of the hashes' upper 12 bits tell beforehand how far the sample reaches, so that the task that ranks a label
    sees little more than the sample, however many rows or tasks there are.
    """
    rows = rows.withColumn("top", F.shiftright("h", 52))
    counts = rows.groupBy(label, "top").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(label).orderBy("top").rowsBetween(Window.unboundedPreceding, -1))
    reach = counts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < limit)
    reach = reach.groupBy(label).agg(F.max("top").alias("most"))
    near = rows.join(F.broadcast(reach), label).where("top <= most")
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy(label).orderBy("h", "doc_id")))
    return ranked.where(F.col("r") <= limit).drop("top", "most", "r")
