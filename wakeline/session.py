"""Session defaults and the shared folder used for checkpoints and work tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "wakeline", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("WAKELINE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> None:
    """Runtime settings every query of this package relies on.

    The JVM never compiles methods above 8000 bytes of bytecode; long arithmetic
    chains then run faster outside whole-stage code generation. Runs, scenes and
    scenarios are small before they fan out, so adaptive execution must not merge
    their shuffle partitions into one.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a scratch folder of its own.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table that cuts lineage."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Rows up to which a side of a join is sent to every executor.
BROADCAST_ROWS = 250_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, written once, as the side that a join holds in memory: of every task if its rows allow, else of a partition.

    Exploded rows count as few in Spark's estimates. Without a hint Spark may hold the large side, through the driver.
    """
    d = cut_lineage(df)
    return F.broadcast(d) if d.count() <= rows else d.hint("shuffle_hash")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local one."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def places_kept(spark: SparkSession) -> Iterator[None]:
    """Within it, joins leave rows that lie by a part of the join's key where they are, if both sides lie so.

    Only what is written within it is planned so (``cut_lineage``), and only for keys whose parts are not skewed.
    """
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def by_keys(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into all shuffle partitions.

    Adaptive execution sizes tasks by what they read. Where a join makes many rows of few, that is too coarse; a number
    given here is kept, also for the join's other side.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
