"""Great-circle distance, key rounding and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in whole metres, halves rounded to even."""
    half_dlat = F.radians(lat2 - lat1) / F.lit(2.0)
    half_dlon = F.radians(lon2 - lon1) / F.lit(2.0)
    chord = F.sin(half_dlat) * F.sin(half_dlat) + (
        F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_dlon) * F.sin(half_dlon))
    angle = F.lit(2.0) * F.atan2(F.sqrt(chord), F.sqrt(F.lit(1.0) - chord))
    return F.bround(F.lit(EARTH_RADIUS_M) * angle).cast("bigint")


def round_key(value: Column, n: int = 3) -> Column:
    """Coordinate rounded half-even, for use as a cache key."""
    return F.bround(value, n)


def in_box(lat: Column, lng: Column, lat_min: float, lat_max: float, lng_min: float, lng_max: float) -> Column:
    """Inclusive box test; a missing coordinate is outside."""
    inside = lat.between(lat_min, lat_max) & lng.between(lng_min, lng_max)
    return F.coalesce(inside, F.lit(False))
