"""Maritime views derived from the driver's tables, as one SQL text for two engines.

The texts use only syntax Spark SQL and DuckDB share, plus three marks:
``{name}`` a table or another view, ``[[epoch]]`` whole seconds of ``ts``, and
``[[each k a b]]`` one row per integer k in a..b. All views grow linearly with
their base tables: every 150 users / 100 suppliers form a sector of sea of
their own, so density does not change with the scale factor.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from math import prod

from pyspark.sql import DataFrame, SparkSession

T0 = 1704067200
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _sector_lon(s: str) -> str:
    return f"2e0 * ({s} % 50)"


def _sector_lat(s: str) -> str:
    return f"3e0 * (CAST(floor({s} / 50e0) AS BIGINT) % 15)"


_USER_SECTOR = "CAST(floor(user_id / 150e0) AS BIGINT)"
_SUPP_SECTOR = "CAST(floor(s_suppkey / 100e0) AS BIGINT)"



def _vessels_sql(where: str) -> str:
    return f"""
        SELECT CAST(419000000 + CAST(floor(c_custkey / 10e0) AS BIGINT) AS STRING) AS mmsi,
               max_by(c_name, c_custkey) AS vessel_name,
               CASE max_by(c_mktsegment, c_custkey) WHEN 'AUTOMOBILE' THEN 'crude_tanker' WHEN 'BUILDING' THEN 'cargo'
                    WHEN 'FURNITURE' THEN 'fishing' WHEN 'MACHINERY' THEN 'chemical_tanker' ELSE 'unknown' END AS vessel_type,
               round(max_by(c_acctbal, c_custkey) * 20, 2) AS dwt,
               max_by(c_nationkey, c_custkey) AS flag_key
        FROM {{customer}}{where} GROUP BY CAST(floor(c_custkey / 10e0) AS BIGINT)"""


def _runs_sql(where: str) -> str:
    return f"""
        SELECT s.s_suppkey AS scene_id, o.mmsi, min(o.o_orderkey) AS run_id
        FROM (SELECT o_orderkey, CAST(floor(o_custkey / 10e0) AS BIGINT) AS u,
                     CAST(419000000 + CAST(floor(o_custkey / 10e0) AS BIGINT) AS STRING) AS mmsi FROM {{orders}}) o
        JOIN {{supplier}} s ON s.s_suppkey = CAST(floor(o.u / 150e0) AS BIGINT) * 100 + o.o_orderkey % 100
        {where}GROUP BY s.s_suppkey, o.mmsi"""


VIEWS: dict[str, str] = {
    # AIS positions; the median hop is about 18 minutes
    "fx_tracks": f"""
        SELECT CAST(419000000 + user_id AS STRING) AS mmsi, event_id AS seq,
               {T0} + CAST(floor(([[epoch]] - {T0}) / 24e0) AS BIGINT) AS ts_s,
               18e0 + (user_id % 40) / 20e0 + ((event_id * 7919) % 500) / 5000e0 + {_sector_lat(_USER_SECTOR)} AS lat,
               70e0 + (user_id % 30) / 20e0 + ((event_id * 104729) % 500) / 5000e0 + {_sector_lon(_USER_SECTOR)} AS lon,
               round(value % 20, 2) AS speed_knots, ((event_id * 137) % 360) * 1e0 AS course
        FROM {{events}}""",
    "fx_tracks_raw": f"""
        SELECT t.mmsi, t.seq, [[epoch]] AS ts_s, t.lat, t.lon, t.speed_knots, t.course
        FROM {{fx_tracks}} t JOIN {{events}} e ON e.event_id = t.seq""",
    # the whole registry, and one that lacks some vessels
    "fx_all_vessels": _vessels_sql(""),
    "fx_vessels": _vessels_sql(" WHERE CAST(floor(c_custkey / 10e0) AS BIGINT) % 17 <> 3"),
    "fx_scenes": f"""
        SELECT s_suppkey AS scene_id, {T0} + ((s_suppkey * 613) % 1800) * 60 AS captured_s,
               18e0 + ((s_suppkey * 37) % 400) / 200e0 + {_sector_lat(_SUPP_SECTOR)} AS spill_lat,
               70e0 + ((s_suppkey * 53) % 300) / 200e0 + {_sector_lon(_SUPP_SECTOR)} AS spill_lon,
               CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 0.0001e0 + ((s_suppkey * 37) % 500) / 10e0 END AS area_sq_km,
               CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 2e0 + (s_suppkey % 13) END AS wind_speed,
               CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE ((s_suppkey * 29) % 360) * 1e0 END AS wind_direction,
               CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE ((s_suppkey * 17) % 100) / 10e0 - 5 END AS meta_u,
               CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE ((s_suppkey * 19) % 100) / 10e0 - 5 END AS meta_v,
               CASE s_suppkey % 4 WHEN 0 THEN 'detected' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'rejected' ELSE 'under_review' END AS status,
               CASE s_suppkey % 4 WHEN 0 THEN 'light' WHEN 1 THEN 'medium' WHEN 2 THEN 'heavy' ELSE 'bunker' END AS fuel_type,
               0.6e0 + (s_suppkey % 40) / 100e0 AS confidence, s_suppkey % 5 <> 0 AS verified, s_name AS scene_name
        FROM {{supplier}}""",
    # square slick outlines of +-0.0201 degrees (no position lies on an edge), one vertex per row
    "fx_spill_vertices": """
        SELECT scene_id, k AS vertex,
               spill_lon + CASE WHEN k IN (1, 2) THEN 0.0201e0 ELSE -0.0201e0 END AS lon,
               spill_lat + CASE WHEN k IN (2, 3) THEN 0.0201e0 ELSE -0.0201e0 END AS lat
        FROM {fx_scenes} [[each k 0 4]]""",
    "fx_sar_targets": """
        SELECT e.event_id AS target_id, s.s_suppkey AS scene_id,
               t.lat + ((e.event_id * 31) % 100 - 50) / 1000e0 AS lat,
               t.lon + ((e.event_id * 43) % 100 - 50) / 1000e0 AS lon,
               0.3e0 + (e.event_id % 70) / 100e0 AS intensity,
               CASE WHEN e.event_id % 9 = 0 THEN NULL ELSE 0.5e0 + (e.event_id % 60) / 100e0 END AS confidence
        FROM {events} e JOIN {fx_tracks} t ON t.seq = e.event_id
        JOIN {supplier} s ON s.s_suppkey = CAST(floor(e.user_id / 150e0) AS BIGINT) * 100 + e.event_id % 100
        WHERE e.event_type = 'error'""",
    # one drift run per order; pairs of (scene, vessel) are unique; in the second view some scenes have none
    "fx_all_runs": _runs_sql(""),
    "fx_runs": _runs_sql("WHERE s.s_suppkey % 13 <> 5 "),
    # one or two simulations of each pair, some without a spill
    "fx_sims": """
        SELECT scene_id, mmsi, CASE WHEN k = 0 THEN lo ELSE hi END AS run_id,
               CASE WHEN (lo + k) % 23 = 0 THEN NULL ELSE scene_id END AS spill_id
        FROM (SELECT s.s_suppkey AS scene_id, o.mmsi, min(o.o_orderkey) AS lo, max(o.o_orderkey) AS hi
              FROM (SELECT o_orderkey, CAST(floor(o_custkey / 10e0) AS BIGINT) AS u,
                           CAST(419000000 + CAST(floor(o_custkey / 10e0) AS BIGINT) AS STRING) AS mmsi FROM {orders}) o
              JOIN {supplier} s ON s.s_suppkey = CAST(floor(o.u / 150e0) AS BIGINT) * 100 + o.o_orderkey % 100
              WHERE s.s_suppkey % 13 <> 5 GROUP BY s.s_suppkey, o.mmsi) p [[each k 0 1]] WHERE k = 0 OR hi > lo""",
    # every run's own trajectory, every second hour; some runs have none
    "fx_run_drift": """
        SELECT r.run_id, k AS step, s.captured_s + (k - 6) * 7200 AS ts_s,
               s.spill_lat + 0.002e0 * (k - 6) + (r.run_id % 7) * 0.003e0 AS lat,
               s.spill_lon + 0.005e0 * (k - 6) - (r.run_id % 5) * 0.002e0 AS lon
        FROM {fx_sims} r JOIN {fx_scenes} s ON s.scene_id = r.scene_id [[each k 0 12]] WHERE r.run_id % 29 <> 0""",
    "fx_drift": """
        SELECT scene_id, captured_s + (k - 12) * 3600 AS ts_s, spill_lat + 0.002e0 * (k - 12) AS lat,
               spill_lon + 0.005e0 * (k - 12) AS lon
        FROM {fx_scenes} [[each k 0 24]]""",
    "fx_drafts": f"""
        SELECT CAST(419000000 + CAST(floor(o_custkey / 10e0) AS BIGINT) AS STRING) AS mmsi, o_orderkey AS seq,
               {T0} + (o_orderkey * 7919) % 108000 AS ts_s,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 6e0 + ((o_orderkey * 53) % 80) / 10e0 END AS draft_m
        FROM {{orders}}""",
    "fx_env": f"""
        SELECT 15e0 + (o_orderkey % 101) * 0.25e0 + 3e0 * (CAST(floor(o_orderkey / 750000e0) AS BIGINT) % 15) AS lat,
               68e0 + (CAST(floor(o_orderkey / 101e0) AS BIGINT) % 149) * 0.25e0 AS lon,
               max(((o_orderkey * 7) % 200) / 10e0 - 10) AS u10, max(((o_orderkey * 13) % 200) / 10e0 - 10) AS v10
        FROM {{orders}} GROUP BY 1, 2""",
    # one grid per sector with uneven latitudes and hours, some places left out
    "fx_env_hours": f"""
        SELECT sector, 18.15e0 + i * 0.21e0 + (i % 3) * 0.05e0 + {_sector_lat('sector')} AS lat, 70.1e0 + j * 0.23e0 + {_sector_lon('sector')} AS lon,
               {T0} + k * 10800 + (k % 2) * 1800 AS ts_s, max((o_orderkey * 7) % 200 / 10e0 - 10) AS u10, max((o_orderkey * 13) % 200 / 10e0 - 10) AS v10
        FROM (SELECT o_orderkey, CAST(floor(o_custkey / 1500e0) AS BIGINT) AS sector, o_orderkey % 8 AS i,
                     CAST(floor(o_orderkey / 8e0) AS BIGINT) % 6 AS j, CAST(floor(o_orderkey / 48e0) AS BIGINT) % 9 AS k FROM {{orders}}) o
        GROUP BY sector, i, j, k""",
    "fx_stations": """
        SELECT CAST(n_nationkey AS BIGINT) AS station_id, n_name AS station_name,
               10e0 + 4.5e0 * (n_nationkey % 5) AS lat, 66e0 + 3.5e0 * floor(n_nationkey / 5e0) AS lon
        FROM {nation}""",
    "fx_interceptors": f"""
        SELECT CAST(500000000 + s_suppkey AS STRING) AS mmsi, s_name AS name,
               CASE s_suppkey % 6 WHEN 0 THEN 'Ocean Tug' WHEN 1 THEN 'Patrol Vessel' WHEN 2 THEN 'Cargo'
                    WHEN 3 THEN 'Pollution Control' WHEN 4 THEN 'SAR' ELSE 'Fishing' END AS type,
               18e0 + ((s_suppkey * 41) % 400) / 200e0 + {_sector_lat(_SUPP_SECTOR)} AS lat,
               70e0 + ((s_suppkey * 59) % 300) / 200e0 + {_sector_lon(_SUPP_SECTOR)} AS lon
        FROM {{supplier}}""",
    # alert requests: one per order, at a scene
    "fx_requests": f"""
        SELECT o_orderkey AS request_id, s.scene_id, s.spill_lat AS lat, s.spill_lon AS lon, s.verified,
               CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN 0e0 ELSE s.confidence END AS filter_confidence,
               0.7e0 + (o_orderkey % 25) / 100e0 AS detection_confidence,
               {T0} + (o_orderkey * 7919) % 2592000 AS requested_s
        FROM {{orders}} o JOIN {{fx_scenes}} s
          ON s.scene_id = CAST(floor(CAST(floor(o_custkey / 10e0) AS BIGINT) / 150e0) AS BIGINT) * 100 + o_orderkey % 100""",
    # radar amplitude: 64 x 64 pixels per scene
    "fx_pixels": """
        SELECT scene_id, r AS row, c AS col,
               CASE WHEN ((r * 64 + c) * 7919 + scene_id) % 997 < 3 THEN 0.9e0
                    ELSE 0.05e0 + ((r * 131 + c * 17 + scene_id * 7) % 97) / 2000e0 END AS value
        FROM (SELECT s_suppkey AS scene_id FROM {supplier}) s [[each r 0 63]] [[each c 0 63]]""",
    # slick probability: 64 x 64 pixels per scene, blocks that merge into components
    "fx_mask": """
        SELECT scene_id, r AS row, c AS col,
               CASE WHEN (CAST(floor(r / 8e0) AS BIGINT) * 5 + CAST(floor(c / 8e0) AS BIGINT) * 3 + scene_id) % 7 < 2
                         AND (r * 7 + c * 3) % 23 <> 0
                    THEN 0.55e0 + ((r * c) % 40) / 100e0 ELSE 0.1e0 + (r % 8) / 100e0 END AS prob
        FROM (SELECT s_suppkey AS scene_id FROM {supplier}) s [[each r 0 63]] [[each c 0 63]]""",
    # overlapping tile predictions of the same scenes
    "fx_tile_preds": """
        SELECT scene_id, a * 24 AS tile_row, b * 24 AS tile_col, r AS row, c AS col,
               ((r * 31 + c * 17 + a * 24 + b * 72 + scene_id) % 100) / 100e0 AS prob
        FROM (SELECT s_suppkey AS scene_id FROM {supplier}) s
        [[each a 0 1]] [[each b 0 1]] [[each r 0 31]] [[each c 0 31]]""",
    "fx_preds": """
        SELECT doc_id, CAST(quality AS BIGINT) AS truth, ((doc_id * 7919) % 1000) / 1000e0 AS prob,
               CASE doc_id % 3 WHEN 0 THEN 'sar' WHEN 1 THEN 'sar_speed' ELSE 'sar_uv' END AS mode
        FROM {labels}""",
    "fx_audit": f"""
        SELECT event_id AS id, {T0} + CAST(floor(([[epoch]] - {T0}) / 24e0) AS BIGINT) AS occurred_s,
               'system' AS actor_type, event_type AS action, 'vessel' AS entity_type,
               CAST(user_id AS STRING) AS entity_id, props AS payload
        FROM {{events}}""",
    "fx_dossiers": """
        SELECT o_orderkey AS dossier_id, o_custkey AS scene_id, CASE WHEN o_orderstatus = 'O' THEN 'draft' ELSE 'finalized' END AS status,
               concat('{"total":', CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING), ',"scene":', CAST(o_custkey AS STRING), '}') AS snapshot
        FROM {orders}""",
    "fx_raw_ais": """
        SELECT seq, CASE WHEN seq % 17 = 0 THEN ' ' WHEN seq % 23 = 0 THEN '12345' ELSE mmsi END AS MMSI,
               CAST(lon AS STRING) AS LON, CASE WHEN seq % 29 = 0 THEN '95.5' ELSE CAST(lat AS STRING) END AS LAT,
               CASE WHEN seq % 31 = 0 THEN 'yesterday' ELSE [[iso ts_s]] END AS UTC,
               CASE WHEN seq % 37 = 0 THEN 'n/a' ELSE CAST(speed_knots * 8 AS STRING) END AS SOG,
               CAST(course + 20 AS STRING) AS COG,
               CASE WHEN seq % 41 = 0 THEN '' WHEN seq % 43 = 0 THEN '511' ELSE CAST(course AS STRING) END AS HEADING,
               'under way' AS STATUS_DESC
        FROM {fx_tracks}""",
}


def _spark_text(sql: str) -> str:
    sql = sql.replace("[[epoch]]", "unix_seconds(CAST(ts AS TIMESTAMP))")
    sql = re.sub(r"\[\[iso (\w+)\]\]", r"date_format(timestamp_seconds(\1), 'yyyy-MM-dd HH:mm:ss')", sql)
    return re.sub(
        r"\[\[each (\w) (\d+) (\d+)\]\]",
        r"LATERAL VIEW explode(sequence(CAST(\2 AS BIGINT), CAST(\3 AS BIGINT))) v_\1 AS \1",
        sql,
    )


def _duckdb_text(sql: str) -> str:
    sql = sql.replace("[[epoch]]", "CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT)")
    sql = re.sub(r"\[\[iso (\w+)\]\]", r"strftime(make_timestamp(\1 * 1000000), '%Y-%m-%d %H:%M:%S')", sql)
    return re.sub(r"\[\[each (\w) (\d+) (\d+)\]\]", r", unnest(generate_series(\2, \3)) v_\1(\1)", sql)


_REF = re.compile(r"\{(\w+)\}")

# What a query over the whole registry and all runs reads in place of the views with gaps.
_WHOLE = {"fx_vessels": "fx_all_vessels", "fx_runs": "fx_all_runs"}
_whole: ContextVar[bool] = ContextVar("whole", default=False)


@contextmanager
def whole_views() -> Iterator[None]:
    """Within it, ``view`` gives the whole registry and all runs."""
    token = _whole.set(True)
    try:
        yield
    finally:
        _whole.reset(token)


def whole_text(sql: str) -> str:
    """The same for a query text."""
    return re.sub(rf"\b({'|'.join(_WHOLE)})\b", lambda m: _WHOLE[m[0]], sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or derived view as a DataFrame."""
    if _whole.get():
        name = _WHOLE.get(name, name)
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sql = _spark_text(VIEWS[name])
    refs = {r: view(spark, sf_dir, r) for r in set(_REF.findall(sql))}
    if "[[each" in VIEWS[name] and len(refs) == 1:  # a small table makes many rows, so all tasks take part in that
        refs = {r: _dealt(d, _KEY[r], _fan_out(VIEWS[name])) for r, d in refs.items()}
    return spark.sql(_keep_literal_braces(sql), **refs)


# The column that becomes scene_id in the views made of these tables.
_KEY = {"supplier": "s_suppkey", "fx_scenes": "scene_id"}
#: Rows that one task makes of its keys, so that it can order them in memory however large the tables are.
TASK_ROWS = 1_000_000


def _fan_out(sql: str) -> int:
    """Rows that the marks make of one row."""
    return prod(int(b) - int(a) + 1 for a, b in re.findall(r"\[\[each \w (\d+) (\d+)\]\]", sql))


def _dealt(df: DataFrame, key: str, fan_out: int) -> DataFrame:
    """``df`` dealt by ``key`` before its rows are multiplied.

    Spark keeps that partitioning through the generators: what follows by scene, by its image lines or its pixels finds
    a scene's rows in one task and shuffles none of them.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() * fan_out // TASK_ROWS)), key)


def _keep_literal_braces(sql: str) -> str:
    """Double every brace that does not mark a table, as string formatting expects."""
    parts = _REF.split(sql)
    return "".join(
        "{" + p + "}" if i % 2 else p.replace("{", "{{").replace("}", "}}") for i, p in enumerate(parts)
    )


def oracle(sql: str) -> str:
    """DuckDB query text with the views it needs in front as CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(_REF.sub(lambda m: m.group(1), VIEWS[name]))
                if name not in needed:
                    needed.append(name)

    visit(sql)
    body = sql.strip()
    ctes = [f"{n} AS ({_REF.sub(lambda m: m.group(1), _duckdb_text(VIEWS[n]))})" for n in needed]
    if not ctes:
        return body
    recursive = "RECURSIVE " if re.match(r"WITH\s+RECURSIVE\b", body, re.I) else ""
    body_rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body, flags=re.I)
    glue = ", " if body_rest != body else " "
    return f"WITH {recursive}" + ", ".join(ctes) + glue + body_rest
