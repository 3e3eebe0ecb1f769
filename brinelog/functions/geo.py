"""Column functions: geodesy, drift physics, plausibility curves. Angles are degrees, distances km unless named otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
EARTH_M = 6_371_000.0


def wrap_lon(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    up, across = F.radians(lat2 - lat1) / 2, F.radians(wrap_lon(lon2 - lon1)) / 2
    a = F.sin(up) * F.sin(up) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(across) * F.sin(across)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def km_per_degree_lon(lat: Column) -> Column:
    return 111.195 * F.cos(F.radians(lat))


def ring_area_sq_km(ring: Column) -> Column:
    """Spherical area of a ring of [lon, lat] points, open or closed; fewer than three points have none."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, nxt, lambda p, q: F.radians(wrap_lon(q[0] - p[0])) * (2 + F.sin(F.radians(p[1])) + F.sin(F.radians(q[1]))))
    total = F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + e)
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(total) * EARTH_KM * EARTH_KM / 2)


def drift_velocity(wind: Column, wind_from: Column, current: Column, current_to: Column, windage: Column | float, deflection: Column | float, lat: Column) -> tuple[Column, Column]:
    """East and north velocity, m/s: the current plus windage times the wind, turned right in the north and left in the south."""
    east, north = -wind * F.sin(F.radians(wind_from)), -wind * F.cos(F.radians(wind_from))
    turn = F.radians(F.when(lat >= 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * deflection)
    return (
        current * F.sin(F.radians(current_to)) + windage * (east * F.cos(turn) - north * F.sin(turn)),
        current * F.cos(F.radians(current_to)) + windage * (east * F.sin(turn) + north * F.cos(turn)),
    )


def evaporated_fraction(hours: Column, wind: Column, sea_temp: Column | float = 25.0) -> Column:
    grown = 0.080 * F.log1p(hours) * (1 + 0.010 * (F.lit(sea_temp) - 15.0)) * (1 + 0.030 * F.greatest(F.lit(0.0), wind - 5.0))
    return F.when(hours <= 0, 0.0).otherwise(F.least(F.lit(0.95), F.greatest(F.lit(0.0), grown)))


def weathering_warning(fraction: Column) -> Column:
    return F.when(fraction > 0.50, F.format_string("%.0f%% evaporated: mass balance unreliable", fraction * 100)).when(fraction > 0.30, F.format_string("%.0f%% evaporated: treat volume with care", fraction * 100)).otherwise(F.lit(""))


def wind_plausibility(wind: Column) -> Column:
    """0.5 without wind data; rising to 3 m/s, full to 12, gone at 20."""
    return F.when(wind.isNull(), 0.5).when(wind <= 0, 0.0).when(wind < 3, (wind / 3) * (wind / 3)).when(wind <= 12, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (wind - 12) / 8))


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def verdict(posterior: Column) -> Column:
    return F.when(posterior >= 0.60, "strong").when(posterior >= 0.35, "probable").when(posterior >= 0.15, "weak").otherwise("insufficient")


def to_mps(value: Column, unit: Column) -> Column:
    return F.when(unit == "km/h", value / 3.6).when(unit == "kn", value * 0.514444).when(unit == "mph", value * 0.44704).otherwise(value)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
