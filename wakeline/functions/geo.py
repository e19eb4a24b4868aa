"""Distances, rings and unit conversions as Spark columns (no Python workers)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Earth radii (km), WGS-84 ellipsoid, nautical mile.
R_AIS_KM = 6371.0
R_RESPONSE_KM = 6371.0088
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
NM_M = 1852.0
KM_PER_NM = 1.852

_GEODESIC_ROUNDS = 4


def haversine_km(lat1, lon1, lat2, lon2, radius_km: float = R_AIS_KM) -> Column:
    lat1, lon1, lat2, lon2 = (F.col(c) if isinstance(c, str) else c for c in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius_km * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def with_geodesic(
    df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, metres: str, azimuth: str | None = None
) -> DataFrame:
    """Add the WGS-84 distance in metres (and the forward azimuth in [0, 360)).

    The inverse problem is solved by refining the longitude difference on the
    auxiliary sphere. Each round shrinks the error by the flattening, so four of
    them leave well under a micrometre per degree. Every step is a projection over
    non-null doubles: the chain stays one small code-generated stage.
    """
    f, a = WGS84_F, WGS84_A
    b = a * (1 - f)
    keep = ", ".join(f"`{c}`" for c in df.columns)
    nan = "double('NaN')"
    y1, x1, y2, x2 = (f"coalesce(`{c}`, {nan})" for c in (lat1, lon1, lat2, lon2))
    q = f"""SELECT {keep}, atan({1 - f!r}D * tan(radians({y1}))) AS g_u1, atan({1 - f!r}D * tan(radians({y2}))) AS g_u2,
            radians(pmod({x2} - {x1} + 180D, 360D) - 180D) AS g_l FROM {{df}}"""
    q = f"SELECT {keep}, sin(g_u1) AS g_s1, cos(g_u1) AS g_c1, sin(g_u2) AS g_s2, cos(g_u2) AS g_c2, coalesce(g_l, {nan}) AS g_l, coalesce(g_l, {nan}) AS g_x FROM ({q})"
    tiny = "1e-300D"

    def on_sphere(q: str) -> str:
        q = f"SELECT *, g_c2 * sin(g_x) AS g_e, g_c1 * g_s2 - g_s1 * g_c2 * cos(g_x) AS g_n, g_s1 * g_s2 + g_c1 * g_c2 * cos(g_x) AS g_cs FROM ({q})"
        length = "sqrt(g_e * g_e + g_n * g_n)"
        return f"SELECT *, {length} AS g_ss, atan2({length}, g_cs) AS g_sig, g_c1 * g_e * pow({length} + {tiny}, -1D) AS g_sa FROM ({q})"

    ca = "(1 - g_sa * g_sa)"
    mid = f"(g_cs - 2 * g_s1 * g_s2 * pow({ca} + {tiny}, -1D))"
    k = f"({f / 16!r}D * {ca} * (4 + {f!r}D * (4 - 3 * {ca})))"
    for _ in range(_GEODESIC_ROUNDS):
        q = f"""SELECT {keep}, g_s1, g_c1, g_s2, g_c2, g_l,
                g_l + (1 - {k}) * {f!r}D * g_sa * (g_sig + {k} * g_ss * ({mid} + {k} * g_cs * (2 * {mid} * {mid} - 1))) AS g_x FROM ({on_sphere(q)})"""
    q = f"SELECT *, {ca} * {(a * a - b * b) / (b * b)!r}D AS g_u, {mid} AS g_m FROM ({on_sphere(q)})"
    q = f"""SELECT *, 1 + g_u * {1 / 16384!r}D * (4096 + g_u * (g_u * (320 - 175 * g_u) - 768)) AS g_a,
            g_u * {1 / 1024!r}D * (256 + g_u * (g_u * (74 - 47 * g_u) - 128)) AS g_b FROM ({q})"""
    shift = f"""g_b * g_ss * (g_m + g_b * 0.25D * (g_cs * (2 * g_m * g_m - 1)
            - g_b * {1 / 6!r}D * g_m * (4 * g_ss * g_ss - 3) * (4 * g_m * g_m - 3)))"""
    bearing = f", pmod(degrees(atan2(g_e, g_n)), 360D) AS `{azimuth}`" if azimuth else ""
    q = f"SELECT {keep}, nullif({b!r}D * g_a * (g_sig - {shift}), {nan}) AS `{metres}`{bearing} FROM ({q})"
    return df.sparkSession.sql(q, df=df)


def bbox_half_extent(lat: Column, radius_km: float | Column) -> tuple[Column, Column]:
    """Half height and half width in degrees of the box around a circle."""
    dlat = F.degrees(F.lit(radius_km) / R_AIS_KM)
    dlon = F.degrees(F.lit(radius_km) / (R_AIS_KM * F.greatest(F.lit(0.01), F.cos(F.radians(lat)))))
    return dlat, dlon


def circle_half_extent(lat: Column, radius_km: float | Column) -> tuple[Column, Column]:
    """Half height and half width in degrees of a box that holds the whole circle; every longitude if it holds a pole.

    One percent wider, so that it holds the circle on any of the spheres and the ellipsoid in use.
    """
    angle = F.lit(radius_km) * 1.01 / R_AIS_KM
    reach = F.abs(F.radians(lat)) + angle
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(angle) / F.cos(F.radians(lat)))))
    return F.degrees(angle), F.when(reach >= math.pi / 2, 180.0).otherwise(wide)


def ring_edges(ring: Column) -> Column:
    """Array of structs (lon, lat) -> array of edges; the ring is closed if open."""
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    closed = F.when(first == last, ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    return F.zip_with(
        F.slice(closed, 1, F.size(closed) - 1),
        F.slice(closed, 2, F.size(closed) - 1),
        lambda a, b: F.struct(
            a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")
        ),
    )


def outline_edges(outline: Column) -> Column:
    """Edges of all rings of an outline: array of structs (hole, ring)."""
    whole = F.filter(outline, lambda r: F.size(r["ring"]) >= 3)
    return F.flatten(F.transform(whole, lambda r: ring_edges(r["ring"])))


def point_in_outline(lat: Column, lon: Column, outline: Column) -> Column:
    """Ray casting with the 1e-12 guard on horizontal edges; under 3 vertices is false.

    Crossings of all rings count together, so holes are outside and parts do not touch each other.
    """

    def crosses(e: Column) -> Column:
        straddles = (e["y1"] > lat) != (e["y2"] > lat)
        x = (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"] + F.lit(1e-12)) + e["x1"]
        return straddles & (lon < x)

    hits = F.size(F.filter(outline_edges(outline), lambda e: (e["y1"] != e["y2"]) & crosses(e)))
    return F.coalesce(hits % 2 == 1, F.lit(False))


def outline_distance_m(lat: Column, lon: Column, outline: Column) -> Column:
    """Metres from a point to an outline (0 inside), on the plane tangent at the point."""
    ky = math.pi / 180 * R_AIS_KM * 1000
    kx = F.cos(F.radians(lat)) * ky

    def to_segment(e: Column) -> Column:
        ax, ay = (e["x1"] - lon) * kx, (e["y1"] - lat) * ky
        dx, dy = (e["x2"] - e["x1"]) * kx, (e["y2"] - e["y1"]) * ky
        len2 = dx * dx + dy * dy
        t = F.when(len2 == 0, F.lit(0.0)).otherwise(
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / F.nullif(len2, F.lit(0.0))))
        )
        return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))

    edges = F.flatten(F.transform(outline, lambda r: ring_edges(r["ring"])))
    return F.when(point_in_outline(lat, lon, outline), F.lit(0.0)).otherwise(F.array_min(F.transform(edges, to_segment)))


def ring_moments(ring: Column, x0: Column, y0: Column) -> Column:
    """Struct (a, x, y): twice the signed area and three times its moments, relative to a point."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, e: Column) -> Column:
        ax, ay, bx, by = e["x1"] - x0, e["y1"] - y0, e["x2"] - x0, e["y2"] - y0
        cr = ax * by - bx * ay
        return F.struct((acc["a"] + cr).alias("a"), (acc["x"] + (ax + bx) * cr).alias("x"), (acc["y"] + (ay + by) * cr).alias("y"))

    return F.aggregate(ring_edges(ring), zero, add)


def outline_centroid(outline: Column) -> Column:
    """Area-weighted centroid struct (lon, lat) over all rings; holes weigh against, whatever their direction."""
    x0, y0 = F.get(F.get(outline, F.lit(0))["ring"], F.lit(0))["lon"], F.get(F.get(outline, F.lit(0))["ring"], F.lit(0))["lat"]

    def weighed(r: Column) -> Column:
        m = ring_moments(r["ring"], x0, y0)
        sign = F.signum(m["a"]) * F.when(r["hole"], -1.0).otherwise(1.0)
        return F.struct((m["a"] * sign).alias("a"), (m["x"] * sign).alias("x"), (m["y"] * sign).alias("y"))

    def total(name: str) -> Column:
        return F.aggregate(F.transform(outline, weighed), F.lit(0.0), lambda acc, m: acc + m[name])

    a, x, y = total("a"), total("x"), total("y")
    return F.struct((x0 + F.try_divide(x, 3 * a)).alias("lon"), (y0 + F.try_divide(y, 3 * a)).alias("lat"))


def knots(metres: Column, seconds: Column) -> Column:
    return F.try_divide(metres / NM_M, seconds / 3600.0)


def eta_hours(km: Column) -> Column:
    """Sailing time of a response vessel at 18 knots."""
    return F.round(km / (18 * KM_PER_NM), 2)
