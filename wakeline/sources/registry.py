"""Station and interceptor registries (JSON arrays)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wakeline.schemas import INTERCEPTORS, STATIONS

_SCHEMAS = {"stations": STATIONS, "interceptors": INTERCEPTORS}


def read_registry(spark: SparkSession, kind: str, path: str, multiline: bool = True) -> DataFrame:
    """Spark broadcasts it by itself while it is below the broadcast threshold."""
    return spark.read.schema(_SCHEMAS[kind]).json(path, multiLine=multiline)
