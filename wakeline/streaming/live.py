"""Live AIS: parsing, counts, sessions, latest state, gap alerts, alert cooldown, idempotent sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wakeline.operators.alerts import COOLDOWN_S
from wakeline.operators.cleaning import radius_filter
from wakeline.operators.tracks import GAP_S
from wakeline.schemas import AIS_MESSAGE
from wakeline.session import work_path
from wakeline.sources.tables import WEEK_S, absent_rows, same_span

NO_HEADING = 511


def read_messages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """AIS envelopes as newline-delimited JSON files; a Kafka value parses with the same schema."""
    r = spark.readStream.schema(AIS_MESSAGE)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.json(path)


def positions(messages: DataFrame) -> DataFrame:
    """Position reports with a vessel and coordinates; the receive time is the event time."""
    p, m = F.col("Message.PositionReport"), F.col("MetaData")
    return (
        messages.filter(F.col("MessageType") == "PositionReport")
        .select(
            F.trim(m["MMSI"]).alias("mmsi"), F.trim(m["ShipName"]).alias("name"), F.col("received_at").alias("ts"),
            p["Latitude"].alias("lat"), p["Longitude"].alias("lon"), p["Sog"].alias("speed_knots"),
            F.when(p["TrueHeading"] != NO_HEADING, p["TrueHeading"]).alias("heading"), "number",
        )
        .filter((F.coalesce("mmsi", F.lit("")) != "") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    )


def positions_near(messages: DataFrame, centres: DataFrame, radius_km: float) -> DataFrame:
    """Positions within reach of the given centres: a stream-static join on grid cells."""
    return radius_filter(positions(messages), centres, radius_km, deg=0.5)


def static_reports(messages: DataFrame) -> DataFrame:
    s, m = F.col("Message.ShipStaticData"), F.col("MetaData")
    return messages.filter(F.col("MessageType") == "ShipStaticData").select(
        F.trim(m["MMSI"]).alias("mmsi"), F.unix_seconds("received_at").alias("ts_s"), s["ImoNumber"].alias("imo"), s["Name"].alias("name"),
        s["Type"].alias("vessel_type"), *[s["Dimension"][d].alias(f"dim_{d.lower()}") for d in "ABCD"],
    )


def message_counts(messages: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    w = F.window("received_at", width)
    return (
        messages.withWatermark("received_at", delay).groupBy(w, "MessageType").agg(F.count(F.lit(1)).alias("n"))
        .select(F.unix_seconds("window.start").alias("start_s"), "MessageType", "n")
    )


def deduplicated(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def track_sessions(pos: DataFrame, silence: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Stretches of a vessel's track without a silence of that length."""
    s = F.session_window("ts", silence)
    return (
        pos.withWatermark("ts", delay).groupBy("mmsi", s).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("_last"))
        .select("mmsi", F.unix_seconds("session_window.start").alias("start_s"), F.unix_seconds("_last").alias("last_s"), "n")
    )


def latest_state(pos: DataFrame) -> DataFrame:
    """Newest position of every vessel; run in update mode and upserted per batch.

    Of positions of one time the first by the receiver's ``number`` counts.
    """
    newest = F.struct("ts", -F.col("number"))
    return pos.groupBy("mmsi").agg(
        F.max("ts").alias("ts"), *[F.max_by(c, newest).alias(c) for c in ("lat", "lon", "speed_knots", "name")]
    )


def enriched(pos: DataFrame, vessels: DataFrame) -> DataFrame:
    return pos.join(vessels.select("mmsi", "vessel_name", "vessel_type"), "mmsi", "left")


def _in_time_order(
    rows: Iterator[pd.DataFrame], state: GroupState, cols: list[str], carry: int, act: Callable[[tuple, tuple], tuple[tuple, Any]]
) -> list:
    """Feed a key's rows to ``act(memory, row)`` in event-time order, once they can no longer be overtaken.

    State = ``carry`` remembered values followed by one list per column of rows still
    newer than the watermark. ``act`` returns the new memory and an output or None.
    """
    mark = state.getCurrentWatermarkMs() / 1000.0
    held = state.get if state.exists else tuple([None] * carry + [[] for _ in cols])
    memory = tuple(held[:carry])
    waiting = list(zip(*held[carry:]))
    for pdf in rows:
        waiting += [tuple(r) for r in pdf[cols].itertuples(index=False)]
    waiting.sort()
    out, later = [], []
    for row in waiting:
        if row[0] > mark:
            later.append(row)
            continue
        memory, result = act(memory, row)
        if result is not None:
            out.append(result)
    state.update(tuple([*memory, *([list(c) for c in zip(*later)] if later else [[] for _ in cols])]))
    if later:
        state.setTimeoutTimestamp(int(max(later[0][0], mark) * 1000) + 1)
    return out


def gap_alerts(pos: DataFrame, max_gap_s: int = GAP_S, delay: str = "10 minutes") -> DataFrame:
    """Silences longer than ``max_gap_s`` of each vessel, across micro-batches and out-of-order arrival."""

    def run(key, rows, state):
        def act(memory, row):
            ts, lat, lon = row
            last = memory[0]
            if last is not None and ts <= last:
                return memory, None
            hit = (key[0], int(last), int(ts), memory[1], memory[2], lat, lon) if last is not None and ts - last > max_gap_s else None
            return (ts, lat, lon), hit

        found = _in_time_order(() if state.hasTimedOut else rows, state, ["ts_s", "lat", "lon"], 3, act)
        names = ["mmsi", "gap_start_s", "gap_end_s", "start_lat", "start_lon", "end_lat", "end_lon"]
        yield pd.DataFrame(found, columns=names)

    keyed = pos.withWatermark("ts", delay).withColumn("ts_s", F.unix_seconds("ts"))
    return keyed.groupBy("mmsi").applyInPandasWithState(
        run,
        "mmsi string, gap_start_s bigint, gap_end_s bigint, start_lat double, start_lon double, end_lat double, end_lon double",
        "last_s bigint, last_lat double, last_lon double, ts_s array<bigint>, lat array<double>, lon array<double>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


#: Requests taken in before those of one second are put together.
TAKEN = 1 << 20


def _first_of_seconds(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (second, request) in order, of each second the one of the smallest request."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, rows[1:, 0] != rows[:-1, 0])] if len(rows) else rows


def _waiting(held: bytes, batches: Iterator[pd.DataFrame]) -> np.ndarray:
    parts, taken = [np.frombuffer(held, np.int64).reshape(-1, 2)], 0
    for pdf in batches:
        parts.append(pdf[["ts_s", "request_id"]].to_numpy(np.int64))
        taken += len(pdf)
        if taken >= TAKEN:
            parts, taken = [_first_of_seconds(parts)], 0
    return _first_of_seconds(parts)


def dispatched_alerts(requests: DataFrame, cooldown_s: int = COOLDOWN_S, delay: str = "10 minutes") -> DataFrame:
    """Requests (station_id, request_id, ts) that pass the station's cooldown, in event-time order.

    Only the smallest request of a second can be dispatched. So a station's state is its last dispatch and, as one flat
    array, one row for each second that the watermark has not passed, however many requests that second has.
    """

    def run(key, rows, state):
        mark = state.getCurrentWatermarkMs() / 1000.0
        last, held = state.get if state.exists else (None, b"")
        waiting = _waiting(held, () if state.hasTimedOut else rows)
        n = int(np.searchsorted(waiting[:, 0], mark, side="right"))
        seconds, found = waiting[:n, 0], []
        k = 0 if last is None else int(np.searchsorted(seconds, last + cooldown_s, side="right"))
        while k < n:
            last = int(seconds[k])
            found.append((key[0], int(waiting[k, 1]), last))
            k = int(np.searchsorted(seconds, last + cooldown_s, side="right"))
        later = waiting[n:]
        state.update((last, later.tobytes()))
        if len(later):
            state.setTimeoutTimestamp(int(max(later[0, 0], mark) * 1000) + 1)
        yield pd.DataFrame(found, columns=["station_id", "request_id", "requested_s"])

    keyed = requests.withWatermark("ts", delay).withColumn("ts_s", F.unix_seconds("ts"))
    return keyed.groupBy("station_id").applyInPandasWithState(
        run, "station_id bigint, request_id bigint, requested_s bigint", "last_s bigint, waiting binary",
        "append", GroupStateTimeout.EventTimeTimeout,
    )


def run_to_table(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Drain the available input into a Parquet table in the shared folder and read it back."""
    spark = stream.sparkSession
    path = path or work_path(spark, name)
    q = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("path", path).option("checkpointLocation", work_path(spark, f"{name}-progress")).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_upsert(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Drain an update-mode stream; the newest batch wins for every key.

    Each batch overwrites its own folder, so a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    path = work_path(spark, name)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    q = (
        stream.writeStream.foreachBatch(write).outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", work_path(spark, f"{name}-progress")).start()
    )
    q.awaitTermination()
    d = spark.read.parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    return d.groupBy(*keys).agg(*[F.max_by(c, "epoch").alias(c) for c in rest])


def run_track_sink(stream: DataFrame, name: str, keys: list[str], order: str, ts: str = "ts_s") -> DataFrame:
    """Idempotent append: per batch, only rows whose key the table lacks.

    A batch writes into week folders, below them into folders of its own, so a retry replaces its earlier attempt and
    a batch is compared with the weeks it touches only.
    """
    spark = stream.sparkSession
    path = work_path(spark, name)
    parts = [T.StructField("week", T.IntegerType()), T.StructField("epoch", T.LongType())]
    stored_schema = T.StructType([*stream.schema.fields, *parts])
    spark.createDataFrame([], stream.schema).write.parquet(path)

    def write(batch: DataFrame, epoch: int) -> None:
        stored = spark.read.schema(stored_schema).parquet(path).filter(F.col("epoch") != epoch)
        stored = same_span(stored, batch, ts)
        new = absent_rows(stored, batch, keys, order)
        new = new.withColumns({"week": F.floor(F.col(ts) / WEEK_S).cast("int"), "epoch": F.lit(epoch).cast("long")})
        writer = new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week", "epoch")
        writer.parquet(path)

    q = (
        stream.writeStream.foreachBatch(write).trigger(availableNow=True)
        .option("checkpointLocation", work_path(spark, f"{name}-progress")).start()
    )
    q.awaitTermination()
    return spark.read.schema(stored_schema).parquet(path).drop("week", "epoch")
