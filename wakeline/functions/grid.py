"""Grid cells: the equi-join key that replaces nested loops over positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakeline.functions.geo import circle_half_extent


def cell_y(lat: Column, deg: float) -> Column:
    return F.floor((lat + 90.0) / deg).cast("int")


def cell_x(lon: Column, deg: float) -> Column:
    return F.pmod(F.floor((lon + 180.0) / deg).cast("int"), F.lit(round(360 / deg)))


def cells_around(lat: Column, lon: Column, radius_km: float | Column, deg: float) -> Column:
    """All cells (cy, cx) the circle can touch; ``deg`` must divide 360.

    The list depends on the radius and the cell size only, never on the data.
    Columns wrap at the date line.
    """
    n = round(360 / deg)
    dlat, dlon = circle_half_extent(lat, radius_km)
    rows = F.sequence(cell_y(lat - dlat, deg), cell_y(lat + dlat, deg))
    x0 = F.floor((lon - dlon + 180.0) / deg).cast("int")
    x1 = F.floor((lon + dlon + 180.0) / deg).cast("int")
    cols = F.transform(
        F.sequence(x0, F.least(x1, x0 + (n - 1))), lambda x: F.pmod(x, F.lit(n))
    )
    return F.flatten(
        F.transform(rows, lambda y: F.transform(cols, lambda x: F.struct(y.alias("cy"), x.alias("cx"))))
    )


def time_buckets(start_s: Column, end_s: Column, width_s: int) -> Column:
    """Buckets a closed time span touches."""
    return F.sequence(F.floor(start_s / width_s).cast("long"), F.floor(end_s / width_s).cast("long"))


def time_bucket(ts_s: Column, width_s: int) -> Column:
    return F.floor(ts_s / width_s).cast("long")
