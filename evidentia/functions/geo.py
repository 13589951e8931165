"""Coordinates: three distances that stay apart, the nearest city centre and grid cells for radius joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

KM_PER_DEGREE = 111.0
EARTH_KM = 6371.0


def parse_coord(v: Column) -> Column:
    """First number of a cell; a trailing S or W makes it negative."""
    n = F.regexp_extract(F.coalesce(v, F.lit("")), r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    return F.when(F.trim(v).rlike(r"(?i)[SW]$"), -F.abs(n)).otherwise(n)


def swapped(lat: Column, lon: Column) -> Column:
    """Only the other order lies in the country's box."""
    box = lambda a, b: a.between(6, 37) & b.between(68, 98)
    return ~box(lat, lon) & box(lon, lat)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def equirect_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.hypot((lat1 - lat2) * KM_PER_DEGREE, (lon1 - lon2) * KM_PER_DEGREE * F.cos(F.radians(lat2)))


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.hypot(lat1 - lat2, lon1 - lon2) * KM_PER_DEGREE


def city_from_coords(lat: Column, lon: Column) -> Column:
    """City whose centre is nearest in units of its radius, within one; the later one on a tie; else empty."""
    turn = swapped(lat, lon)
    la, lo = F.when(turn, lon).otherwise(lat), F.when(turn, lat).otherwise(lon)
    ratios = [
        F.struct((F.hypot((la - a) * KM_PER_DEGREE, (lo - o) * KM_PER_DEGREE * F.cos(F.radians(F.lit(a)))) / r).alias("ratio"), F.lit(-i).alias("order"), F.lit(city).alias("city"))
        for i, (city, a, o, r) in enumerate(fixed.CITY_CENTERS)
    ]
    best = F.array_min(F.array(*ratios))
    return F.when(best["ratio"] <= 1, best["city"]).otherwise("")


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def near_cells(x: Column, size: float) -> Column:
    """The cell of ``x`` and its two neighbours."""
    return F.sequence(cell(x, size) - 1, cell(x, size) + 1)
