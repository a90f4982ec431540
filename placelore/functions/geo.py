"""Distances and coarse regions from coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371
ROAD_FACTOR = 1.2


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2)))
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def region(lat: Column, lon: Column) -> Column:
    """First matching box wins; places without coordinates get the default."""
    # Box limits and names.
    return (F.when(lat.isNull() | lon.isNull(), "Sri Lanka")
            .when(lat >= 8.55, "Northern")
            .when((lon >= 81.30) & (lat >= 6.60), "East Coast")
            .when((lat >= 7.55) & (lat < 8.55) & (lon < 81.30), "Cultural Triangle")
            .when((lat >= 6.55) & (lat < 7.55) & (lon >= 80.35) & (lon < 81.30), "Hill Country")
            .when((lat >= 6.60) & (lon < 80.35), "West Coast")
            .when(lat < 6.60, "South Coast")
            .otherwise("Sri Lanka"))


def road_km(edge_km: Column, straight_km: Column) -> Column:
    """Known road distance, else the straight line stretched by a fixed factor, to one decimal."""
    return F.coalesce(F.round(edge_km, 1), F.round(ROAD_FACTOR * straight_km, 1))
