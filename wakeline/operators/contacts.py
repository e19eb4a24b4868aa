"""Radar contacts against AIS, and the spatial lookups around a slick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.angles import uv_to_wind, wind_to_uv
from wakeline.functions.geo import R_RESPONSE_KM, haversine_km, outline_centroid, outline_distance_m, point_in_outline
from wakeline.functions.grid import cell_x, cell_y, cells_around, time_bucket, time_buckets
from wakeline.operators.cleaning import oil_type_of_vessel
from wakeline.operators.sequences import fill_known
from wakeline.operators.windows import facts_of_runs
from wakeline.session import by_keys

# Association threshold, dark-contact wording, response radii and ship types.
MATCH_KM = 5.0
DARK_TYPE = "Unidentified Radar Contact"
DARK_FLAG = "AIS_TRANSPONDER_INACTIVE"
DARK_SCORE = 90.0
STATION_MAX_KM = 500.0
INTERCEPT_KM = 100.0
RESPONSE_TYPES = [
    "Tug", "Towing", "Patrol Vessel", "Law Enforcement", "Oil Recovery", "Pollution Control", "SAR", "Naval Auxiliary",
]
#: Wind that was only guessed from the region.
GUESSED_WIND = "Regional Physics"
KM_PER_DEG = 111.4


def scene_points(
    scenes: DataFrame, tracks: DataFrame, radius_km: float = 150.0, window_s: int = 6 * 3600, deg: float = 1.0
) -> DataFrame:
    """Positions within radius and time window of each scene's slick.

    Scenes list their (time bucket, cell) keys and meet the vessels seen in each, not their positions. A vessel's
    positions then meet its scenes by (vessel, time bucket): those of one pair and bucket come out of one task, so
    that what is aggregated by pair is small before it is shuffled.
    """
    b = 6 * 3600
    at = F.col("captured_s")
    s = (
        scenes.select("scene_id", "captured_s", "spill_lat", "spill_lon")
        .withColumn("_tb", F.explode(time_buckets(at - window_s, at + window_s, b)))
        .withColumn("_c", F.explode(cells_around(F.col("spill_lat"), F.col("spill_lon"), radius_km, deg)))
        .select("scene_id", "_tb", "_c.cy", "_c.cx")
    )
    t = tracks.withColumn("_tb", time_bucket(F.col("ts_s"), b))
    seen = t.select("mmsi", "_tb", cell_y(F.col("lat"), deg).alias("cy"), cell_x(F.col("lon"), deg).alias("cx")).distinct()
    # exploded keys count as few in Spark's estimates, so the hints keep either side from the driver
    pairs = seen.join(s.hint("merge"), ["_tb", "cy", "cx"]).select("scene_id", "mmsi", "_tb")
    pairs = by_keys(pairs, "mmsi", "_tb").distinct()
    pairs = pairs.join(scenes.select("scene_id", "captured_s", "spill_lat", "spill_lon"), "scene_id")
    return (
        t.join(by_keys(pairs, "mmsi", "_tb").hint("merge"), ["mmsi", "_tb"])
        .filter(F.abs(F.col("ts_s") - at) <= window_s)
        .filter(F.round(haversine_km("spill_lat", "spill_lon", "lat", "lon"), 2) <= radius_km)
        .select("scene_id", "captured_s", "spill_lat", "spill_lon", *tracks.columns)
    )


def points_of_pairs(
    pairs: DataFrame, scenes: DataFrame, tracks: DataFrame, radius_km: float = 150.0, window_s: int = 6 * 3600
) -> DataFrame:
    """``scene_points`` of the given pairs (scene_id, mmsi) alone, found without the points of any other.

    Time is cut into buckets twice as wide as the window: a pair lies in one, a position in the two whose scenes can
    see it. A position without a place is near nothing.
    """
    at, ts, w = F.col("captured_s"), F.col("ts_s"), 2 * window_s
    asked = pairs.select("scene_id", "mmsi").distinct().join(scenes.select("scene_id", "captured_s", "spill_lat", "spill_lon"), "scene_id")
    asked = by_keys(asked.withColumn("_b", time_bucket(at, w)), "mmsi", "_b")
    t = tracks.filter("lat is not null and lon is not null").withColumn("_b", F.explode(time_buckets(ts - window_s, ts + window_s, w)))
    # exploded positions count as few in Spark's estimates, so the hint keeps either side from the driver
    return (
        t.join(asked.hint("merge"), ["mmsi", "_b"])
        .filter(F.abs(ts - at) <= window_s)
        .filter(F.round(haversine_km("spill_lat", "spill_lon", "lat", "lon"), 2) <= radius_km)
        .select("scene_id", "captured_s", "spill_lat", "spill_lon", *tracks.columns)
    )


def position_at(points: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Position of each track at column ``at``: linear between the neighbouring points,
    the end point outside; speed and course come from the earlier point.

    Only aggregates: the neighbours are the latest point before and the earliest at or after.
    """
    t, ts = F.col(at), F.col("ts_s")
    cols = ["ts_s", "lat", "lon", "speed_knots", "course"]

    def picked(pick, when: Column, tail: str) -> list[Column]:
        return [pick(F.col(c), when).alias(f"_{tail}_{c}") for c in cols]

    g = points.groupBy(*keys).agg(
        *picked(F.max_by, F.when(ts < t, ts), "a"), *picked(F.min_by, F.when(ts >= t, ts), "b"), *picked(F.max_by, ts, "z"),
        F.min(at).alias(at), F.count(F.lit(1)).alias("n_points"),
    )

    def point(tail: str) -> Column:
        whole = F.struct(*[F.col(f"_{tail}_{c}").alias(c) for c in cols])
        return F.when(F.col(f"_{tail}_ts_s").isNotNull(), whole)

    return g.select(*keys, at, "n_points", *_between(point("a"), point("b"), point("z"), t))


def _between(a: Column, b: Column, z: Column, at: Column) -> list[Column]:
    """Position at ``at`` from the latest point before it, the earliest at or after it and the last of all."""
    share = (at - a["ts_s"]) / (b["ts_s"] - a["ts_s"])
    ends = F.when(a.isNull(), b).when(at >= z["ts_s"], z)

    def coord(c: str) -> Column:
        return F.when(ends.isNotNull(), ends[c]).otherwise(F.round(a[c] + share * (b[c] - a[c]), 5)).alias(c)

    def from_earlier(c: str) -> Column:
        return F.when(ends.isNotNull(), ends[c]).otherwise(a[c]).alias(c)

    return [coord("lat"), coord("lon"), from_earlier("speed_knots"), from_earlier("course"), ends.isNull().alias("interpolated")]


def fleet_at(
    scenes: DataFrame, tracks: DataFrame, radius_km: float = 150.0, window_s: int = 6 * 3600, deg: float = 1.0
) -> DataFrame:
    """``position_at`` of ``scene_points`` for every scene and vessel, without a row of each scene and point.

    Time is cut into buckets twice as wide as the window. A vessel's positions go to the two buckets whose scenes can
    see them and lie there in one line, after deduplication at most a row for each second of two buckets. A scene
    belongs to one bucket and meets a line once, as a whole, so only (scene, vessel) is shuffled, once for each cell of
    the line, and made distinct. Points are measured only where the line's circle (middle, reach) crosses the scene's.
    """
    w = 2 * window_s
    at, ts = F.col("captured_s"), F.col("ts_s")
    cols = ["ts_s", "lat", "lon", "speed_knots", "course"]
    t = tracks.filter("lat is not null and lon is not null").select("mmsi", *cols)
    t = by_keys(t.withColumn("_b", F.explode(time_buckets(ts - window_s, ts + window_s, w))), "mmsi", "_b")
    lines = t.groupBy("mmsi", "_b").agg(
        F.sort_array(F.collect_list(F.struct(*cols))).alias("line"),
        F.collect_set(F.struct(cell_y(F.col("lat"), deg).alias("cy"), cell_x(F.col("lon"), deg).alias("cx"))).alias("cells"),
        ((F.min("lat") + F.max("lat")) / 2).alias("_lat"), ((F.min("lon") + F.max("lon")) / 2).alias("_lon"),
        F.max(F.abs("lat")).alias("_most"),
    )
    # off the globe distances obey no triangle inequality, so there every point is measured
    reach = F.array_max(F.transform("line", lambda p: haversine_km("_lat", "_lon", p["lat"], p["lon"])))
    seen = lines.select(
        "mmsi", "_b", "_lat", "_lon", F.when(F.col("_most") <= 90, reach).otherwise(float("inf")).alias("_reach"), F.explode("cells").alias("_c")
    )
    s = (
        scenes.select("scene_id", "captured_s", "spill_lat", "spill_lon")
        .withColumn("_b", time_bucket(at, w))
        .withColumn("_c", F.explode(cells_around(F.col("spill_lat"), F.col("spill_lon"), radius_km, deg)))
    )
    middle = haversine_km("spill_lat", "spill_lon", "_lat", "_lon")
    apart = (middle - F.col("_reach") > radius_km + 0.1) & (F.abs("spill_lat") <= 90)
    inside = (middle + F.col("_reach") < radius_km - 0.1) & (F.abs("spill_lat") <= 90)
    # exploded keys count as few in Spark's estimates, so the hints keep either side from the driver
    pairs = (
        by_keys(seen.select("*", "_c.cy", "_c.cx").drop("_c"), "_b", "cy", "cx")
        .join(s.select("*", "_c.cy", "_c.cx").drop("_c").hint("merge"), ["_b", "cy", "cx"])
        .filter(~apart)
        .select("mmsi", "_b", "scene_id", "captured_s", "spill_lat", "spill_lon", inside.alias("_inside"))
    )
    met = by_keys(pairs, "mmsi", "_b").distinct().join(lines.select("mmsi", "_b", "line").hint("merge"), ["mmsi", "_b"])

    def close(p: Column) -> Column:
        km = haversine_km("spill_lat", "spill_lon", p["lat"], p["lon"])
        return (km <= radius_km) | ((km < radius_km + 0.1) & (F.round(km, 2) <= radius_km))  # rounding is slow

    def ends(near: Column) -> Column:
        before = F.size(F.filter(near, lambda p: p["ts_s"] < at))
        n = F.size(near)
        return F.struct(
            n.cast("long").alias("n"), F.get(near, before - 1).alias("a"), F.get(near, before).alias("b"), F.get(near, n - 1).alias("z")
        )

    # all inside one generator: a filter on its result would be pushed below and look for the points again
    near = F.filter("line", lambda p: (F.abs(p["ts_s"] - at) <= window_s) & (F.col("_inside") | close(p)))
    found = F.filter(F.transform(F.array(near), ends), lambda r: r["n"] > 0)
    r = met.select("scene_id", "mmsi", "captured_s", F.explode(found).alias("_r"))
    return r.select(
        "scene_id", "mmsi", "captured_s", F.col("_r.n").alias("n_points"), *_between(F.col("_r.a"), F.col("_r.b"), F.col("_r.z"), at)
    )


def nearest_vessel(targets: DataFrame, fleet: DataFrame, match_km: float = MATCH_KM, deg: float = 0.05) -> DataFrame:
    """Exact nearest vessel of the same scene for every radar contact.

    ``targets``: target_id, scene_id, lat, lon; ``fleet``: scene_id, mmsi, lat, lon.
    Pass 1 looks only into the fine cells within the threshold. Contacts without a
    match go to pass 2: occupied coarse cells are bounded from below and above by the
    triangle inequality, and only vessels in cells that can still win are compared.
    """
    v = fleet.select("scene_id", "mmsi", F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"))
    t = targets.select("target_id", "scene_id", "lat", "lon")
    d = haversine_km("lat", "lon", "v_lat", "v_lon")

    def celled(df: DataFrame, size: float) -> DataFrame:
        return df.withColumn("cy", cell_y(F.col("v_lat"), size)).withColumn("cx", cell_x(F.col("v_lon"), size))

    def closest(df: DataFrame) -> DataFrame:
        return df.withColumn("_km", d).groupBy("target_id").agg(F.min(F.struct("_km", "mmsi")).alias("_best"))

    near = t.withColumn("_c", F.explode(cells_around(F.col("lat"), F.col("lon"), match_km, deg))).select("*", "_c.cy", "_c.cx")
    first = closest(near.join(celled(v, deg).hint("merge"), ["scene_id", "cy", "cx"])).filter(F.col("_best._km") <= match_km)
    rest = t.join(first, "target_id", "left_anti")

    coarse = deg * 5
    half_diagonal = coarse * KM_PER_DEG * 0.7072
    occupied = celled(v, coarse).groupBy("scene_id", "cy", "cx").agg(F.min("v_lat").alias("r_lat"), F.min_by("v_lon", "v_lat").alias("r_lon"))
    # at most one entry per cell of a scene's footprint: bounded by its extent, not by its traffic
    cells = occupied.groupBy("scene_id").agg(F.collect_list(F.struct("cy", "cx", "r_lat", "r_lon")).alias("cells"))
    lat, lon = F.col("lat"), F.col("lon")

    def reach(c: Column) -> Column:
        return haversine_km(lat, lon, c["r_lat"], c["r_lon"])

    def floor_km(c: Column) -> Column:
        return haversine_km(lat, lon, (c["cy"] + 0.5) * coarse - 90.0, (c["cx"] + 0.5) * coarse - 180.0) - half_diagonal

    open_cells = (
        rest.join(cells, "scene_id")
        .withColumn("_max", F.array_min(F.transform("cells", reach)))
        .withColumn("_c", F.explode(F.filter("cells", lambda c: floor_km(c) <= F.col("_max"))))
        .select("target_id", "scene_id", "lat", "lon", "_c.cy", "_c.cx")
    )
    second = closest(open_cells.join(celled(v, coarse).hint("merge"), ["scene_id", "cy", "cx"]))
    best = first.unionByName(second)
    return targets.join(best, "target_id", "left").select(
        *targets.columns, F.col("_best.mmsi").alias("nearest_mmsi"), F.col("_best._km").alias("nearest_km"),
        (F.coalesce(F.col("_best._km") <= match_km, F.lit(False))).alias("matched"),
    )


def classify_contacts(nearest: DataFrame, vessels: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Matched contacts take over their vessel's facts; the others become dark contacts."""
    v = vessels.select(F.col("mmsi").alias("nearest_mmsi"), "vessel_name", F.col("vessel_type").alias("_type"))
    a = anomalies.select(F.col("mmsi").alias("nearest_mmsi"), F.col("anomaly_score").alias("_score"), F.col("flags").alias("_flags"))
    m = F.col("matched")
    joined = nearest.join(v, "nearest_mmsi", "left").join(a, "nearest_mmsi", "left")
    return joined.select(
        *[c for c in nearest.columns if c not in ("nearest_mmsi", "nearest_km", "matched")],
        F.when(m, "MATCHED").otherwise("DARK_VESSEL").alias("status"),
        F.when(m, F.col("nearest_mmsi")).alias("mmsi"), F.when(m, F.col("vessel_name")).alias("vessel_name"),
        F.when(m, F.coalesce("_type", F.lit("Unknown"))).otherwise(DARK_TYPE).alias("vessel_type"),
        F.round("nearest_km", 2).alias("distance_km"),
        F.when(m, F.coalesce("_score", F.lit(0.0))).otherwise(DARK_SCORE).alias("anomaly_score"),
        F.when(m, F.coalesce("_flags", F.array().cast("array<string>"))).otherwise(F.array(F.lit(DARK_FLAG))).alias("flags"),
    )


def link_correlations(contacts: DataFrame, vessels: DataFrame) -> DataFrame:
    """Correlation rows for storage: 'matched' only with a vessel on file."""
    known = vessels.select("mmsi", F.col("mmsi").alias("vessel_id"))
    raw = F.upper(F.coalesce("status", F.lit("DARK_VESSEL")))
    linked = contacts.join(known, "mmsi", "left")
    status = (
        F.when((raw == "MATCHED") & F.col("vessel_id").isNotNull(), "matched")
        .when(raw.isin("MATCHED", "BORDERLINE"), "borderline")
        .otherwise("dark_vessel")
    )
    return linked.select(
        "target_id", "scene_id", F.when(status != "dark_vessel", F.col("vessel_id")).alias("vessel_id"), status.alias("match_status"),
        F.round(F.col("distance_km") * 1000.0, 2).alias("haversine_distance_m"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.85)))).alias("confidence"),
    )


def first_of_runs(runs: DataFrame, scenes: DataFrame, tracks: DataFrame, vessels: DataFrame, before_s: int) -> DataFrame:
    """Earliest point of each run's vessel in the ``before_s`` seconds up to its scene, with the oil it may carry.

    Of a vessel's positions of one time the first is found before they are repeated for the runs, so that a run's
    earliest one is a hash aggregate.
    """
    seconds = tracks.groupBy("mmsi", "ts_s").agg(F.min(F.struct("seq", "lat", "lon")).alias("p")).select("mmsi", "ts_s", "p.lat", "p.lon")
    points = facts_of_runs(runs, scenes, seconds, "ts_s", before_s, 0, dealt=True)
    first = points.groupBy("run_id", "scene_id", "mmsi").agg(
        F.min_by("lat", "ts_s").alias("lat"), F.min_by("lon", "ts_s").alias("lon"), F.min("ts_s").alias("ts_s")
    )
    return first.join(vessels.select("mmsi", "vessel_name", "vessel_type"), "mmsi", "left").select(
        "run_id", "scene_id", "mmsi", F.coalesce("vessel_name", F.lit("unknown")).alias("vessel_name"),
        F.coalesce("vessel_type", F.lit("unknown")).alias("vessel_type"), oil_type_of_vessel(F.coalesce("vessel_type", F.lit("unknown"))).alias("oil_type"),
        F.col("ts_s").alias("release_s"), "lat", "lon",
    )


def rings_of(vertices: DataFrame, key: str) -> DataFrame:
    """(key, [polygon, ring,] vertex, lon, lat) -> (key, outline): an outline has few vertices, whatever the data size.

    ``outline`` is an array of structs (hole, ring); ring 0 of a polygon is its border, the others are holes. Without
    the columns polygon and ring all vertices make one border.
    """
    parts = {c: F.col(c) if c in vertices.columns else F.lit(0) for c in ("polygon", "ring")}
    v = vertices.select(key, parts["polygon"].alias("polygon"), parts["ring"].alias("part"), "vertex", "lon", "lat")
    line = F.transform(
        F.array_sort(F.collect_list(F.struct("vertex", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))
    )
    rings = v.groupBy(key, "polygon", "part").agg(line.alias("line"))
    return rings.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("polygon", "part", "line"))),
            lambda r: F.struct((r["part"] > 0).alias("hole"), r["line"].alias("ring")),
        ).alias("outline")
    )


def _ring_cells(rings: DataFrame, key: str, margin_deg: float, deg: float) -> DataFrame:
    points = F.flatten(F.transform("outline", lambda r: r["ring"]))
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    wide = margin_deg / F.greatest(F.lit(0.01), F.cos(F.radians(F.array_max(F.transform(lat, lambda y: F.abs(y))))))
    n = round(360 / deg)
    rows = F.sequence(cell_y(F.array_min(lat) - margin_deg, deg), cell_y(F.array_max(lat) + margin_deg, deg))
    cols = F.sequence(
        F.floor((F.array_min(lon) - wide + 180.0) / deg).cast("int"), F.floor((F.array_max(lon) + wide + 180.0) / deg).cast("int")
    )
    return (
        rings.withColumn("cy", F.explode(rows)).withColumn("_x", F.explode(cols))
        .withColumn("cx", F.pmod("_x", F.lit(n))).drop("_x")
    )


def vessels_near_spill(
    rings: DataFrame, scenes: DataFrame, tracks: DataFrame, metres: float = 5000.0, before_s: int = 12 * 3600, deg: float = 0.1
) -> DataFrame:
    """Distinct vessels with a position within ``metres`` of the outline before detection."""
    b = 6 * 3600
    at = F.col("captured_s")
    r = rings.join(scenes.select("scene_id", "captured_s"), "scene_id")
    keyed = _ring_cells(r, "scene_id", metres / 1000 / KM_PER_DEG * 1.01, deg).withColumn("_tb", F.explode(time_buckets(at - before_s, at, b)))
    t = (
        tracks.select("mmsi", "ts_s", "lat", "lon").withColumn("_tb", time_bucket(F.col("ts_s"), b))
        .withColumn("cy", cell_y(F.col("lat"), deg)).withColumn("cx", cell_x(F.col("lon"), deg))
    )
    near = t.join(keyed, ["_tb", "cy", "cx"]).filter(F.col("ts_s").between(at - before_s, at))
    return near.filter(outline_distance_m(F.col("lat"), F.col("lon"), F.col("outline")) <= metres).select("scene_id", "mmsi").distinct()


def points_in_rings(points: DataFrame, rings: DataFrame, key: str, deg: float = 0.1) -> DataFrame:
    """Pairs (point row, ring key) where the point lies inside the outline; several parts may match a point once only."""
    p = points.withColumn("cy", cell_y(F.col("lat"), deg)).withColumn("cx", cell_x(F.col("lon"), deg))
    return (
        p.join(_ring_cells(rings, key, 0.0, deg), ["cy", "cx"])
        .filter(point_in_outline(F.col("lat"), F.col("lon"), F.col("outline")))
        .drop("cy", "cx", "outline")
    )


def _around(centres: DataFrame, others: DataFrame, km: float, deg: float) -> DataFrame:
    """centres (lat, lon, ..) x others (o_lat, o_lon, ..) within km, through equal grid cells."""
    c = centres.withColumn("cy", cell_y(F.col("lat"), deg)).withColumn("cx", cell_x(F.col("lon"), deg))
    o = (
        others.withColumn("_c", F.explode(cells_around(F.col("o_lat"), F.col("o_lon"), km, deg)))
        .select(*others.columns, "_c.cy", "_c.cx")
    )
    return c.join(o, ["cy", "cx"]).drop("cy", "cx")


def nearest_stations(incidents: DataFrame, stations: DataFrame, k: int = 3, max_km: float = STATION_MAX_KM) -> DataFrame:
    """The k nearest stations of each incident (incident_id, lat, lon) within range, ranked.

    Spark keeps only k rows per incident before the shuffle (rank limit push-down).
    """
    s = stations.filter("lat is not null and lon is not null").select(
        "station_id", "station_name", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon")
    )
    i = incidents.filter("lat is not null and lon is not null")
    km = F.round(haversine_km("lat", "lon", "o_lat", "o_lon", R_RESPONSE_KM), 1)
    near = _around(i, s, max_km, 4.0).withColumn("distance_km", km).filter(haversine_km("lat", "lon", "o_lat", "o_lon", R_RESPONSE_KM) <= max_km)
    w = Window.partitionBy("incident_id").orderBy("distance_km", "station_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("o_lat", "o_lon")


def interceptors_near(
    incidents: DataFrame, assets: DataFrame, km: float = INTERCEPT_KM, types: list[str] | None = None
) -> DataFrame:
    """Assets of a response type within ``km`` of each incident."""
    kind = F.lower("type")
    wanted = F.lit(False)
    for w in types or RESPONSE_TYPES:
        wanted = wanted | F.contains(kind, F.lit(w.lower()))
    a = assets.filter("lat is not null and lon is not null").filter(wanted).select(
        F.col("mmsi").alias("asset_mmsi"), F.col("name").alias("asset_name"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon")
    )
    d = haversine_km("lat", "lon", "o_lat", "o_lon", R_RESPONSE_KM)
    near = _around(incidents.filter("lat is not null and lon is not null"), a, km, 1.0)
    return near.filter(d <= km).withColumn("asset_km", F.round(d, 1)).drop("o_lat", "o_lon")


def merge_registry(live: DataFrame, fallback: DataFrame) -> DataFrame:
    """Live assets first, registry assets where no live one has the key."""
    key = F.when(F.coalesce("mmsi", F.lit("")) != "", F.col("mmsi"))
    a = live.withColumn("_key", F.coalesce(key, F.concat(F.lit("_name:"), F.coalesce("name", F.lit(""))))).withColumn("_rank", F.lit(0))
    b = fallback.withColumn("_key", key).filter(F.col("_key").isNotNull()).withColumn("_rank", F.lit(1))
    both = a.unionByName(b.select(*a.columns))
    item = F.struct(*[c for c in live.columns])
    return both.groupBy("_key").agg(F.min_by(item, F.struct("_rank", "name")).alias("_r")).select("_r.*")


def nearest_grid_env(points: DataFrame, env: DataFrame, step: float = 0.25, lat0: float = 0.0, lon0: float = 0.0, lon_0_360: bool = False) -> DataFrame:
    """Values of the nearest cell of a regular grid: snap the point, then join on equality."""
    lon = F.pmod(F.col("lon"), F.lit(360.0)) if lon_0_360 else F.col("lon")
    p = points.withColumn("_gy", F.round((F.col("lat") - lat0) / step).cast("long")).withColumn("_gx", F.round((lon - lon0) / step).cast("long"))
    e = env.select(
        F.round((F.col("lat") - lat0) / step).cast("long").alias("_gy"), F.round((F.col("lon") - lon0) / step).cast("long").alias("_gx"),
        *[c for c in env.columns if c not in ("lat", "lon")],
    )
    return p.join(e, ["_gy", "_gx"], "left").drop("_gy", "_gx")


def nearest_env(points: DataFrame, env: DataFrame, axes: tuple[str, ...] = ("lat", "lon", "ts_s"), keys: tuple[str, ...] = (), steps: dict[str, float] | None = None) -> DataFrame:
    """Adds to each point the values of the grid cell nearest on every axis, for axes with any spacing.

    ``env``: ``keys`` (one grid per key, such as region and day), ``axes`` and value columns. Per axis the wanted
    numbers and the grid's own are put in one order (``fill_known``): the last grid value before and the first one
    after are known there, the nearer wins, the larger one where both are equally near, and beyond either end the
    last value counts. No step compares points with cells. A negative longitude is taken modulo 360 where the grid
    has none below zero. Cells repeated at one place count once (least values); a place the grid leaves out, a grid
    that does not exist and a point with a null coordinate give null values. ``steps``: width of the buckets an axis
    is ordered in.
    """
    steps = {"lat": 0.25, "lon": 0.25, "ts_s": 6 * 3600.0} | (steps or {})
    values = [c for c in env.columns if c not in axes and c not in keys]
    of = list(keys) or ["_grid"]
    p = points if keys else points.withColumn("_grid", F.lit(0))
    e = env if keys else env.withColumn("_grid", F.lit(0))
    e = e.dropna(subset=list(axes))
    if "lon" in axes:
        positive = e.groupBy(*of).agg((F.min("lon") >= 0).alias("_positive"))
        turned = F.when(F.col("_positive") & (F.col("lon") < 0), F.pmod("lon", F.lit(360.0))).otherwise(F.col("lon"))
        p = p.join(positive, of, "left").withColumn("_p_lon", turned).drop("_positive")
    p = p.withColumns({f"_p_{a}": F.col(a).cast("double") for a in axes if a != "lon"})
    nearest = {a: _nearest_on_axis(p, e, of, a, steps.get(a, 1.0)) for a in axes}
    for a in axes:
        p = p.join(nearest[a], [*of, f"_p_{a}"], "left")
    cell = F.struct(*values)
    cells = e.groupBy(*of, *[F.col(a).cast("double").alias(f"_e_{a}") for a in axes]).agg(F.min(cell).alias("_cell"))
    found = p.join(cells, [*of, *[f"_e_{a}" for a in axes]], "left")
    return found.select(*points.columns, *[F.col(f"_cell.{c}").alias(c) for c in values])


def _nearest_on_axis(p: DataFrame, e: DataFrame, of: list[str], axis: str, step: float) -> DataFrame:
    """of, _p_axis, _e_axis: for every distinct wanted number the nearest number of the grid's axis."""
    wanted = p.select(*of, F.col(f"_p_{axis}").alias("_x"), F.lit(True).alias("_asked"), F.lit(None).cast("double").alias("_on")).dropna(subset=["_x"])
    known = e.select(*of, F.col(axis).cast("double").alias("_x"), F.lit(False).alias("_asked"), F.col(axis).cast("double").alias("_on"))
    line = wanted.union(known).groupBy(*of, "_x").agg(F.max("_asked").alias("_asked"), F.max("_on").alias("_on"))
    line = fill_known(line, of, "_x", {"on": ["_on"]}, bucket_s=step).where("_asked")
    below, above = F.col("on_before._on"), F.col("on_after._on")
    nearest = F.when(below.isNull() | (above - F.col("_x") <= F.col("_x") - below), above).otherwise(below)
    return line.select(*of, F.col("_x").alias(f"_p_{axis}"), F.coalesce(nearest, below).alias(f"_e_{axis}"))


def join_weather(records: DataFrame, env: DataFrame, overwrite: bool = False, **grid) -> DataFrame:
    """Fills u10 and v10 of ``records`` from the nearest cell, once: known values stay.

    Values that were only guessed for the region are replaced, and all of them with ``overwrite``. Adds ``joined``:
    skipped (kept its own), joined (its ``wind_source`` is cleared), or missing (no cell, or an empty one: no values).
    """
    own = F.col("_own_u").isNotNull() & F.col("_own_v").isNotNull() & (F.coalesce("wind_source", F.lit("")) != GUESSED_WIND)
    kept = own & F.lit(not overwrite)
    asked = records.withColumnsRenamed({"u10": "_own_u", "v10": "_own_v"})
    found = nearest_env(asked, env, **grid)
    new = ~kept & F.col("u10").isNotNull() & F.col("v10").isNotNull()
    return found.withColumns(
        {
            "u10": F.when(kept, F.col("_own_u")).when(new, F.col("u10")), "v10": F.when(kept, F.col("_own_v")).when(new, F.col("v10")),
            "wind_source": F.when(~new, F.col("wind_source")), "joined": F.when(kept, "skipped").when(new, "joined").otherwise("missing"),
        }
    ).drop("_own_u", "_own_v")


def resolve_wind(scenes: DataFrame) -> DataFrame:
    """Wind of each scene: its own speed and direction, else patch metadata, else none."""
    su, sv = wind_to_uv(F.col("wind_speed"), F.col("wind_direction"))
    own = F.col("wind_speed").isNotNull() & F.col("wind_direction").isNotNull()
    meta = F.col("meta_u").isNotNull() & F.col("meta_v").isNotNull()
    u, v = F.when(own, su).when(meta, F.col("meta_u")), F.when(own, sv).when(meta, F.col("meta_v"))
    speed, direction = uv_to_wind(u, v)
    return scenes.withColumns(
        {
            "u10": u, "v10": v, "wind_ms": speed, "wind_from_deg": direction,
            "wind_source": F.when(own, "scene_derived").when(meta, "metadata_json").otherwise("none"),
        }
    )


def spill_with_scene(rings: DataFrame, scenes: DataFrame) -> DataFrame:
    """Each slick with its scene and area-weighted centroid."""
    c = outline_centroid(F.col("outline"))
    size = F.aggregate("outline", F.lit(0), lambda n, r: n + F.size(r["ring"]))
    return rings.join(scenes, "scene_id").withColumn("_c", c).select(
        *scenes.columns, size.alias("n_vertices"), F.col("_c.lon").alias("centroid_lon"), F.col("_c.lat").alias("centroid_lat")
    )


def candidate_filter(boxes: DataFrame, tracks: DataFrame, window_s: int = 12 * 3600, deg: float = 0.5) -> DataFrame:
    """Track points inside a scene's contour box in the release window before detection.

    ``boxes``: scene_id, captured_s, min/max lat/lon.
    """
    b = 6 * 3600
    at = F.col("captured_s")
    rows = F.sequence(cell_y(F.col("min_lat"), deg), cell_y(F.col("max_lat"), deg))
    cols = F.sequence(F.floor((F.col("min_lon") + 180.0) / deg).cast("int"), F.floor((F.col("max_lon") + 180.0) / deg).cast("int"))
    s = (
        boxes.withColumn("cy", F.explode(rows)).withColumn("_x", F.explode(cols))
        .withColumn("cx", F.pmod("_x", F.lit(round(360 / deg)))).drop("_x")
        .withColumn("_tb", F.explode(time_buckets(at - window_s, at, b)))
    )
    t = (
        tracks.withColumn("_tb", time_bucket(F.col("ts_s"), b))
        .withColumn("cy", cell_y(F.col("lat"), deg)).withColumn("cx", cell_x(F.col("lon"), deg))
    )
    return (
        t.join(s, ["_tb", "cy", "cx"])
        .filter(F.col("ts_s").between(at - window_s, at))
        .filter(F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon")))
        .drop("_tb", "cy", "cx")
    )
