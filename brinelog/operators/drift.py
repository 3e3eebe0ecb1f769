"""Backward and forward drift: deterministic folds, each step's field and where it is from, and statistics over particles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, drift_velocity, haversine_km, wrap_lon
from .fields import nearest_hour
from .order_statistics import percentiles

FIELD = ("wind", "wind_from", "current", "current_to")


def trajectory(starts: DataFrame, hours: float = 24.0, step_hours: float = 1.0, direction: int = -1, windage: float = 0.03) -> DataFrame:
    """The columns of starts (lat, lon, wind, wind_from, current, current_to) and end_lat, end_lon after Euler steps in a constant field."""
    steps, dt = int(hours / step_hours), step_hours * 3600
    east, north = drift_velocity(F.col("wind"), F.col("wind_from"), F.col("current"), F.col("current_to"), windage, 0.0, F.col("lat"))
    turn = 180 / math.pi

    def step(at: Column, _: Column) -> Column:
        return F.struct((at["lat"] + direction * (F.col("vn") * dt) / EARTH_M * turn).alias("lat"), (at["lon"] + direction * (F.col("ve") * dt) / (EARTH_M * F.cos(F.radians(at["lat"]))) * turn).alias("lon"))

    moved = starts.withColumn("ve", east).withColumn("vn", north)
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.col("lat"), F.col("lon")), step) if steps else F.struct("lat", "lon")
    return moved.withColumn("end", end).select(*starts.columns, F.col("end.lat").alias("end_lat"), F.col("end.lon").alias("end_lon"))


def path(starts: DataFrame, hours: float = 24.0, step_hours: float = 1.0, windage: float = 0.03) -> DataFrame:
    """The columns of starts, the hindcast's places (lat, lon) from the oldest to the start, and how far off its end may be:
    2 km and half a kilometre for each hour."""
    steps, dt = int(hours / step_hours), step_hours * 3600
    east, north = drift_velocity(F.col("wind"), F.col("wind_from"), F.col("current"), F.col("current_to"), windage, 0.0, F.col("lat"))
    turn = 180 / math.pi

    def step(places: Column, _: Column) -> Column:
        at = F.element_at(places, -1)
        new = F.struct((at["lat"] - F.col("vn") * dt / EARTH_M * turn).alias("lat"), (at["lon"] - F.col("ve") * dt / (EARTH_M * F.cos(F.radians(at["lat"]))) * turn).alias("lon"))
        return F.concat(places, F.array(new))

    moved = starts.withColumn("ve", east).withColumn("vn", north)
    first = F.array(F.struct(F.col("lat"), F.col("lon")))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step) if steps else first
    return moved.withColumn("path", F.reverse(walked)).withColumn("uncertainty_km", F.lit(2.0 + 0.5 * hours)).drop("ve", "vn")


def step_sources(cases: DataFrame, hourly: DataFrame, dt: float = 3600.0) -> DataFrame:
    """One row a step of each case, backward from t: case_id, k, at, the field, the hour it is from, its age in seconds (how far that
    hour lies from the step), and source: `hour`, `filled` (an hour that lacked something the case's own field gave), or `held` where no hour
    is near enough, so that the case's own field stands.

    Fields (hour, wind, wind_from, current, current_to) are looked up once for each distinct moment, not for each case."""
    n = F.greatest(F.lit(1), F.rint("hours")).cast("int")
    each = cases.select("case_id", *FIELD, "t", F.explode(F.sequence(F.lit(0), n - 1)).alias("k")).withColumn("at", F.col("t") - F.col("k") * dt)
    moments = each.select(F.col("at").alias("probe_id"), F.col("at").alias("t")).distinct()
    near = nearest_hour(moments, hourly).select(F.col("probe_id").alias("at"), "hour", *[F.col(f).alias(f"near_{f}") for f in FIELD])
    lacking = F.greatest(*[F.col(f"near_{f}").isNull() for f in FIELD])
    source = F.when(F.col("hour").isNull(), "held").when(lacking, "filled").otherwise("hour")
    fields = [F.coalesce(f"near_{f}", f).cast("double").alias(f) for f in FIELD]
    return each.join(near, "at", "left").select("case_id", "k", "at", *fields, "hour", F.abs(F.col("at") - F.col("hour") * 3600).alias("age_s"), source.alias("source"))


def step_fields(cases: DataFrame, hourly: DataFrame) -> DataFrame:
    """The cases with steps (an array with each hour's field, backward from t; null where no hour is near enough) and
    degraded_steps, how many are null. Single nulls of an hour are filled from the case's own field."""
    held = F.col("source") == "held"
    field = F.when(~held, F.struct(*FIELD)).alias("field")
    steps = step_sources(cases, hourly).groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("k", field))).alias("s"), F.count_if(held).alias("degraded_steps"))
    return cases.join(steps.select("case_id", F.transform("s", lambda x: x.field).alias("steps"), "degraded_steps"), "case_id")


def centre(particles: DataFrame, by: str) -> DataFrame:
    """by, mean_lat, mean_lon (circular), mean_t, n."""
    lam = F.radians("lon")
    lon = wrap_lon(F.degrees(F.atan2(F.avg(F.sin(lam)), F.avg(F.cos(lam)))))
    return particles.groupBy(by).agg(F.avg("lat").alias("mean_lat"), lon.alias("mean_lon"), F.avg("t").alias("mean_t"), F.count("*").alias("n"))


def distances(particles: DataFrame, by: str) -> DataFrame:
    c = centre(particles, by)
    return particles.join(c, by).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("mean_lat"), F.col("mean_lon")))


def radii(particles: DataFrame, by: str) -> DataFrame:
    """by, radius_50_km, radius_90_km: exact interpolated percentiles of clouds of any size."""
    p = percentiles(distances(particles, by), [by], "km", [0.5, 0.9])
    return p.select(by, F.col("percentiles")[0].alias("radius_50_km"), F.col("percentiles")[1].alias("radius_90_km"))


def nearest_share(particles: DataFrame, by: str, share: float) -> DataFrame:
    """The nearest particles to each centre, at least three."""
    w = Window.partitionBy(by).orderBy("km", "particle_id")
    d = distances(particles, by).withColumn("rn", F.row_number().over(w))
    return d.where(F.col("rn") <= F.greatest(F.lit(3), F.ceil(F.col("n") * share)))


def hulls(particles: DataFrame, by: str, slices: int = 64) -> DataFrame:
    """by, ring: closed convex hull of each group's points, anticlockwise from the westmost.

    A group is cut into slices by a hash of the point (so repeated points meet), each slice is reduced to its own hull, and
    the hull of those few points is the group's: no task holds a group's points."""

    def corners(pdf: pd.DataFrame) -> list:
        points = sorted(set(zip(pdf["lon"].tolist(), pdf["lat"].tolist(), strict=True)))

        def chain(of: list) -> list:
            out: list = []
            for p in of:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                    out.pop()
                out.append(p)
            return out

        return points if len(points) < 3 else chain(points)[:-1] + chain(points[::-1])[:-1]

    def slice_hull(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf[by].iloc[0], *p) for p in corners(pdf)], columns=[by, "lon", "lat"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = corners(pdf)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "ring": [[list(p) for p in [*ring, ring[0]]]]})

    cut = particles.select(by, "lon", "lat").withColumn("slice", F.pmod(F.xxhash64("lon", "lat"), F.lit(slices)))
    few = cut.groupBy(by, "slice").applyInPandas(slice_hull, f"{by} long, lon double, lat double")
    return few.groupBy(by).applyInPandas(whole, f"{by} long, ring array<array<double>>")
