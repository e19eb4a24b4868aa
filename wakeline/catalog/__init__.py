"""Registered queries and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from wakeline.fixtures import oracle, whole_text, whole_views
from wakeline.session import tune

Query = Callable[[SparkSession, str], DataFrame]

GROUPS = ["cleaning", "tracks", "contacts", "attribution", "drift", "raster", "alerting", "evaluation", "integrity", "live"]


class Registry:
    """Collects the queries of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None, whole: bool = False):
        """``whole``: over the whole registry and all runs, in code and SQL."""

        def add(fn: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                tune(spark)
                with whole_views() if whole else nullcontext():
                    return fn(spark, sf_dir)

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = oracle(whole_text(sql) if whole else sql)
            return fn

        return add


def _all() -> list[Registry]:
    return [import_module(f"wakeline.catalog.{g}").R for g in GROUPS]


def queries() -> dict[str, Query]:
    return {k: v for r in _all() for k, v in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for r in _all() for k, v in r.sql.items()}
