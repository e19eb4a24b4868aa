"""Streams equal their batch twins, in one and in several micro-batches."""

import json

from pyspark.sql import functions as F

from wakeline.operators.tracks import ais_gaps
from wakeline.session import work_path
from wakeline.streaming import live

T = 1704067200


def write_feed(spark, tmp, batches):
    """One JSON file per batch, written in order."""
    import time

    tmp.mkdir(exist_ok=True)
    for i, batch in enumerate(batches):
        lines = [
            json.dumps({
                "MessageType": "PositionReport", "MetaData": {"MMSI": m, "ShipName": f"S{m}"},
                "Message": {"PositionReport": {"Latitude": 18.0, "Longitude": 70.0, "Sog": 5.0, "TrueHeading": 511}},
                "received_at": time.strftime("%Y-%m-%dT%H:%M:%S.000Z", time.gmtime(T + s)),
            })
            for m, s in batch
        ]
        (tmp / f"{i:03d}.json").write_text("\n".join(lines))
        time.sleep(0.02)
    return str(tmp)


def test_gap_alerts_across_batches_and_out_of_order(spark, tmp_path):
    batches = [[("1", 0), ("2", 0), ("1", 600)], [("1", 5000), ("2", 1700)], [("1", 4800), ("2", 3400)], [("1", 5100), ("2", 20000), ("1", 20001)]]
    stream = live.read_messages(spark, write_feed(spark, tmp_path / "feed", batches), files_per_batch=1)
    got = sorted((r.mmsi, r.gap_start_s - T, r.gap_end_s - T) for r in live.run_to_table(live.gap_alerts(live.positions(stream)), "g").collect())
    flat = sorted({(m, T + s, 18.0, 70.0) for b in batches for m, s in b})
    batch = ais_gaps(spark.createDataFrame(flat, "mmsi string, ts_s long, lat double, lon double"))
    want = sorted((r.mmsi, r.gap_start_s - T, r.gap_end_s - T) for r in batch.collect())
    # gaps that end after the final watermark are not final yet
    assert got == [w for w in want if w[2] <= 20001 - 600]
    assert ("1", 600, 4800) in got


def test_sink_is_idempotent(spark, tmp_path):
    batches = [[("1", 0), ("1", 60)], [("1", 60), ("1", 120)], [("1", 0)]]
    stream = live.read_messages(spark, write_feed(spark, tmp_path / "feed", batches), files_per_batch=1)
    p = live.positions(stream).withColumn("ts_s", F.unix_seconds("ts")).select("mmsi", "ts_s", "lat")
    got = live.run_track_sink(p, "sink", ["mmsi", "ts_s"], "lat")
    assert sorted(r.ts_s - T for r in got.collect()) == [0, 60, 120]


def test_latest_state_over_batches(spark, tmp_path):
    batches = [[("1", 50), ("2", 10)], [("1", 20)], [("2", 90)]]
    stream = live.read_messages(spark, write_feed(spark, tmp_path / "feed", batches), files_per_batch=1)
    got = live.run_upsert(live.latest_state(live.positions(stream)), "state", ["mmsi"])
    assert sorted((r.mmsi, r.t) for r in got.select("mmsi", (F.unix_seconds("ts") - T).alias("t")).collect()) == [("1", 50), ("2", 90)]


def test_work_path_is_below_the_shared_folder(spark):
    assert work_path(spark, "x").startswith(spark.sparkContext.getCheckpointDir())


def test_first_of_two_positions_of_one_time_counts(spark, tmp_path):
    import duckdb

    from tests.compare import compare
    from wakeline import catalog

    source = "/root/testdata/sf0.001/events.parquet"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"COPY (SELECT * FROM '{source}' UNION ALL SELECT * REPLACE (event_id + 1000003 AS event_id) FROM '{source}' ORDER BY event_id) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    diff, n = compare(spark, con, str(tmp_path), catalog.queries()["live_latest_state"], catalog.oracle_sql()["live_latest_state"])
    assert diff is None and n > 0
