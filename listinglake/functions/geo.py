"""Great-circle distance, bounding boxes and grid cells."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column
from pyspark.sql import functions as F

from listinglake.refdata import DEGREE_KM, EARTH_KM


def valid(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres; null where a coordinate is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))


def box(lat: float, lon: float, km: float) -> tuple[float, float, list[tuple[float, float]]]:
    """Least and greatest latitude around a point, and its ranges of longitude: two across the date line, all of them where a pole is near."""
    d_lat = km / DEGREE_KM
    south, north = lat - d_lat, lat + d_lat
    shrunk = cos(radians(min(90.0, max(abs(south), abs(north)))))
    d_lon = km / (DEGREE_KM * shrunk) if shrunk > 1e-6 else 180.0
    west, east = lon - d_lon, lon + d_lon
    if d_lon >= 180:
        return south, north, [(-180.0, 180.0)]
    if west < -180:
        return south, north, [(-180.0, east), (west + 360, 180.0)]
    if east > 180:
        return south, north, [(west, 180.0), (-180.0, east - 360)]
    return south, north, [(west, east)]


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("int")
