"""The live cooldown keeps seconds, not requests."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wakeline.streaming import live

T = 1704067200


def test_state_holds_one_row_of_each_second(monkeypatch):
    monkeypatch.setattr(live, "TAKEN", 100)
    ts = np.repeat(np.arange(T, T + 50), 40)
    chunks = [pd.DataFrame({"ts_s": ts[i::10], "request_id": np.arange(len(ts))[i::10]}) for i in range(10)]
    got = live._waiting(np.array([[T + 7, 3]], np.int64).tobytes(), iter(chunks))
    assert got[:, 0].tolist() == list(range(T, T + 50))
    assert got[7].tolist() == [T + 7, 3] and got[8].tolist() == [T + 8, 320]


def test_dispatch_over_batches_and_out_of_order(spark, tmp_path):
    schema = "station_id long, request_id long, ts timestamp"
    batches = [[(1, 5, 0), (1, 4, 0), (2, 9, 100)], [(1, 6, 1700), (1, 7, 1801), (2, 8, 50)], [(1, 1, 1801), (1, 2, 3602), (2, 3, 2500)], [(1, 10, 9000)]]
    path = tmp_path / "feed"
    for i, rows in enumerate(batches):
        d = spark.createDataFrame([(s, r, T + t) for s, r, t in rows], "station_id long, request_id long, t long")
        d.select("station_id", "request_id", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.02)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    got = sorted((r.station_id, r.request_id, r.requested_s - T) for r in live.run_to_table(live.dispatched_alerts(stream), "d").collect())
    assert got == [(1, 1, 1801), (1, 2, 3602), (1, 4, 0), (2, 3, 2500), (2, 8, 50)]
