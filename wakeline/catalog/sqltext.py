"""DuckDB text fragments the oracles share."""

from __future__ import annotations

from wakeline.operators.drift import seed_state

_HAV = "round({r} * 2 * asin(sqrt(least(1e0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))), {n})"


def hav_sql(lat1, lon1, lat2, lon2, digits=2, r="6371e0"):
    return _HAV.format(a=lat1, b=lat2, c=lon1, d=lon2, n=digits, r=r)


GAPS_SQL = f"""
gaps AS (SELECT mmsi, prev_s AS gap_start_s, ts_s AS gap_end_s, round((ts_s - prev_s) / 60e0, 1) AS duration_min, p_lat, p_lon, lat, lon,
  {hav_sql('p_lat', 'p_lon', 'lat', 'lon')} AS jump_km
  FROM (SELECT *, lag(ts_s) OVER w AS prev_s, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM ded WINDOW w AS (PARTITION BY mmsi ORDER BY ts_s))
  WHERE ts_s - prev_s > 1800)"""
DED_SQL = "ded AS (SELECT mmsi, ts_s, max(seq) AS seq, max_by(lat, seq) AS lat, max_by(lon, seq) AS lon, max_by(speed_knots, seq) AS speed_knots, max_by(course, seq) AS course FROM fx_tracks GROUP BY mmsi, ts_s)"


def geodesic_sql(source: str, lat1: str, lon1: str, lat2: str, lon2: str, metres: str, azimuth: str | None = None) -> str:
    """SELECT text that adds the WGS-84 distance to the rows of ``source`` (a table or subquery).

    Six rounds of the textbook inverse formula.
    """
    f, a = 1 / 298.257223563, 6378137.0
    b = a * (1 - f)
    g = f"g_{metres}"
    aux = f"""sqrt(pow({g}_cu2 * sin({g}_lam), 2) + pow({g}_cu1 * {g}_su2 - {g}_su1 * {g}_cu2 * cos({g}_lam), 2)) AS {g}_ss,
        {g}_su1 * {g}_su2 + {g}_cu1 * {g}_cu2 * cos({g}_lam) AS {g}_cs"""
    q = f"""SELECT *, sin(atan((1 - {f!r}::DOUBLE) * tan(radians({lat1})))) AS {g}_su1, cos(atan((1 - {f!r}::DOUBLE) * tan(radians({lat1})))) AS {g}_cu1,
        sin(atan((1 - {f!r}::DOUBLE) * tan(radians({lat2})))) AS {g}_su2, cos(atan((1 - {f!r}::DOUBLE) * tan(radians({lat2})))) AS {g}_cu2,
        radians({lon2}) - radians({lon1}) AS {g}_l, radians({lon2}) - radians({lon1}) AS {g}_lam FROM {source}"""
    sa = f"CASE WHEN {g}_ss = 0 THEN 0e0 ELSE {g}_cu1 * {g}_cu2 * sin({g}_lam) / {g}_ss END"
    for _ in range(6):
        q = f"SELECT *, {sa} AS {g}_sa FROM (SELECT *, {aux} FROM ({q}))"
        q = f"SELECT *, 1 - {g}_sa * {g}_sa AS {g}_c2 FROM ({q})"
        q = f"SELECT *, CASE WHEN {g}_c2 = 0 THEN 0e0 ELSE {g}_cs - 2 * {g}_su1 * {g}_su2 / {g}_c2 END AS {g}_m, {f!r}::DOUBLE / 16 * {g}_c2 * (4 + {f!r}::DOUBLE * (4 - 3 * {g}_c2)) AS {g}_k FROM ({q})"
        lam = f"{g}_l + (1 - {g}_k) * {f!r}::DOUBLE * {g}_sa * (atan2({g}_ss, {g}_cs) + {g}_k * {g}_ss * ({g}_m + {g}_k * {g}_cs * (-1 + 2 * {g}_m * {g}_m)))"
        q = f"SELECT * EXCLUDE ({g}_lam, {g}_ss, {g}_cs, {g}_sa, {g}_c2, {g}_m, {g}_k), {lam} AS {g}_lam FROM ({q})"
    q = f"SELECT *, {sa} AS {g}_sa FROM (SELECT *, {aux} FROM ({q}))"
    q = f"SELECT *, 1 - {g}_sa * {g}_sa AS {g}_c2 FROM ({q})"
    q = f"""SELECT *, CASE WHEN {g}_c2 = 0 THEN 0e0 ELSE {g}_cs - 2 * {g}_su1 * {g}_su2 / {g}_c2 END AS {g}_m,
        {g}_c2 * {(a * a - b * b) / (b * b)!r}::DOUBLE AS {g}_u FROM ({q})"""
    q = f"""SELECT *, 1 + {g}_u / 16384 * (4096 + {g}_u * (-768 + {g}_u * (320 - 175 * {g}_u))) AS {g}_ba,
        {g}_u / 1024 * (256 + {g}_u * (-128 + {g}_u * (74 - 47 * {g}_u))) AS {g}_bb FROM ({q})"""
    delta = f"""{g}_bb * {g}_ss * ({g}_m + {g}_bb / 4 * ({g}_cs * (-1 + 2 * {g}_m * {g}_m)
        - {g}_bb / 6 * {g}_m * (-3 + 4 * {g}_ss * {g}_ss) * (-3 + 4 * {g}_m * {g}_m)))"""
    az = ""
    if azimuth:
        az = f""", (degrees(atan2({g}_cu2 * sin({g}_lam), {g}_cu1 * {g}_su2 - {g}_su1 * {g}_cu2 * cos({g}_lam))) + 360) % 360 AS {azimuth}"""
    drop = ", ".join(f"{g}_{c}" for c in "su1 cu1 su2 cu2 l lam ss cs sa c2 m u ba bb".split())
    return f"SELECT * EXCLUDE ({drop}), {b!r}::DOUBLE * {g}_ba * (atan2({g}_ss, {g}_cs) - ({delta})) AS {metres}{az} FROM ({q})"


def of_runs(facts: str, ts: str, before: int, after: int) -> str:
    """FROM text: runs with the facts of their vessel around the scene time."""
    return (
        f"fx_runs r JOIN fx_scenes s USING (scene_id) JOIN {facts} f "
        f"ON f.mmsi = r.mmsi AND f.{ts} BETWEEN s.captured_s - {before} AND s.captured_s + {after}"
    )


def uniform_sql(keys: list[str], seed: int) -> str:
    """The portable uniform generator as SQL."""
    h = str(seed_state(seed))
    for k in keys:
        h = f"((({h} + {k} + 1) * 48271) % 2147483647)"
        h = f"(({h} * ({h} + 69621) + 12345) % 2147483647)"
    return f"({h} / 2147483647e0)"
