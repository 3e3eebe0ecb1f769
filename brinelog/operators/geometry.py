"""Regions as vertex rings: pixel measures, holes, georeferencing, the gate that stops what has no coordinates.

A ring is an array of [x, y] points, open or closed; holes are an array of rings. Everything is column work on one row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import ring_area_sq_km, wrap_lon

# fixed values: thickness of oil films by appearance, micrometres
THICKNESS = {"sheen": (0.04, 0.30), "rainbow": (0.30, 5.00), "metallic": (5.00, 50.0), "discontinuous_true_colour": (50.0, 200.0), "continuous_true_colour": (200.0, 1000.0)}
GATED = "no coordinates: drift and attribution are withheld"


def _edges(ring: Column, of) -> Column:
    """The sum of of(p, q) over a ring's edges, the closing one included."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, after, of), F.lit(0.0), lambda total, x: total + x)


def _cross(p: Column, q: Column) -> Column:
    return p[0] * q[1] - q[0] * p[1]


def ring_area(ring: Column) -> Column:
    return F.abs(_edges(ring, _cross)) / 2


def perimeter(ring: Column) -> Column:
    return _edges(ring, lambda p, q: F.sqrt(F.pow(q[0] - p[0], 2) + F.pow(q[1] - p[1], 2)))


def centroid(ring: Column, axis: int) -> Column:
    """The centre of the ring's area along an axis, cut to whole pixels; of its points where it has no area."""
    signed = _edges(ring, _cross) / 2
    moment = _edges(ring, lambda p, q: (p[axis] + q[axis]) * _cross(p, q)) / 6
    mean = F.try_divide(F.aggregate(ring, F.lit(0.0), lambda total, p: total + p[axis]), F.size(ring))
    return F.when(signed != 0, F.try_divide(moment, signed)).otherwise(mean).cast("long")


def closed(ring: Column) -> Column:
    """The ring with its first point at the end as well; an empty ring stays empty."""
    return F.when((F.size(ring) > 0) & (F.get(ring, 0) != F.element_at(ring, -1)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def measured(regions: DataFrame, least: float = 100.0) -> DataFrame:
    """regions (ring, holes, ...) with holes of at least `least` pixels only, area (net), perimeter, cx, cy and shape_complexity;
    regions below `least` net pixels go. shape_complexity is the isoperimetric ratio: 1 for a circle, more for ragged or long shapes."""
    outer = regions.withColumn("holes", F.filter("holes", lambda h: ring_area(h) >= least)).withColumn("outer", ring_area(F.col("ring"))).withColumn("perimeter", perimeter(F.col("ring")))
    net = F.col("outer") - F.aggregate(F.transform("holes", ring_area), F.lit(0.0), lambda total, a: total + a)
    ratio = F.when(F.col("outer") > 0, F.pow("perimeter", 2) / (4 * math.pi * F.col("outer"))).otherwise(0.0)
    own = {"area": net, "cx": centroid(F.col("ring"), 0), "cy": centroid(F.col("ring"), 1), "shape_complexity": ratio}
    return outer.withColumns(own).where(F.col("area") >= least).drop("outer")


def georeferenced(regions: DataFrame, width: Column, height: Column, bbox: Column) -> DataFrame:
    """measured regions in degrees by bbox (min_lon, min_lat, max_lon, max_lat): closed rings, centroid and net area in square km.

    Without a bbox rings stay in shares of the picture and centroid and area are null: nothing may be built on invented places."""
    lon = lambda x: wrap_lon(bbox["min_lon"] + x / width * (bbox["max_lon"] - bbox["min_lon"]))
    lat = lambda y: bbox["max_lat"] - y / height * (bbox["max_lat"] - bbox["min_lat"])
    place = lambda p: F.when(bbox.isNotNull(), F.array(lon(p[0]), lat(p[1]))).otherwise(F.array(F.round(p[0] / width, 6), F.round(p[1] / height, 6)))
    moved = lambda ring: closed(F.transform(ring, place))
    out = regions.withColumn("ring", moved(F.col("ring"))).withColumn("holes", F.transform("holes", moved))
    inner = F.aggregate(F.transform("holes", ring_area_sq_km), F.lit(0.0), lambda total, a: total + a)
    area = F.when(bbox.isNotNull(), F.greatest(F.lit(0.0), ring_area_sq_km(F.col("ring")) - inner))
    return out.withColumns({"centroid_lon": F.when(bbox.isNotNull(), lon(F.col("cx"))), "centroid_lat": F.when(bbox.isNotNull(), lat(F.col("cy"))), "area_sq_km": area, "is_georeferenced": bbox.isNotNull()})


def volume(area: Column, code: Column) -> Column:
    """appearance, least and most cubic metres; an unknown code is taken as rainbow, a missing area has no volume."""
    known = F.when(code.isin(*THICKNESS), code).otherwise("rainbow")
    band = F.create_map(*[x for k, (low, high) in THICKNESS.items() for x in (F.lit(k), F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")))])
    has = area.isNotNull() & (area > 0)
    part = lambda end: F.round(F.when(has, area * band[known][end]).otherwise(0.0), 3)
    return F.struct(F.when(has, known).otherwise(code).alias("appearance"), part("low").alias("m3_min"), part("high").alias("m3_max"))


def gate(regions: DataFrame, run: str = "run_id") -> DataFrame:
    """run, stage, reason: runs with a region that has no place stop before the drift."""
    held = F.bool_or(F.col("centroid_lat").isNull()).alias("held")
    return regions.groupBy(run).agg(held, F.count("*").alias("regions")).select(run, "regions", F.when(F.col("held"), "georeference_gated").otherwise("drift").alias("stage"), F.when(F.col("held"), GATED).otherwise("").alias("reason"))
