"""Tracks: segments, interpolation, closest approach, gaps, speed drops, loitering, integrity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, wrap_lon
from ..session import spread
from ..sources.written import saved
from .folds import first_dwells, stays_near

MAX_GAP = 3600.0
DEALT = 1 << 12
SPOTS = ["m_t", "m_cy", "m_cx"]  # a time and a cell


def segments(track: DataFrame) -> DataFrame:
    """Each position with the one before it (p_*); a track's first position has none."""
    before = Window.partitionBy("mmsi").orderBy("t", "ordinal")
    lag = {f"p_{c}": F.lag(c).over(before) for c in ("t", "lat", "lon", "speed", "ordinal")}
    return track.withColumns(lag).withColumn("first_segment", F.lag("t", 2).over(before).isNull()).where("p_t IS NOT NULL").withColumn("dt", F.col("t") - F.col("p_t"))


def at(moment, part: str):
    """Linear interpolation along a segment; longitudes over the shorter arc."""
    share = F.when(F.col("dt") <= 0, 0.0).otherwise((moment - F.col("p_t")) / F.col("dt"))
    step = wrap_lon(F.col("lon") - F.col("p_lon")) if part == "lon" else F.col("lat") - F.col("p_lat")
    place = F.col(f"p_{part}") + share * step
    return wrap_lon(place) if part == "lon" else place


def paired(places: DataFrame, moments: DataFrame, keys: list[str]) -> DataFrame:
    """Places of vessels with the moments of the same keys, which may be few: the places of a key are dealt out, DEALT or so at a
    time, and its moments go to each deal, so that no task has a key to itself. Few bytes make many pairs here, so tasks aren't cut by bytes."""
    deals = places.groupBy(*keys).agg(F.ceil(F.count("*") / DEALT).alias("deals"))
    dealt = places.join(deals, keys).withColumn("deal", F.pmod(F.xxhash64("mmsi"), F.col("deals"))).drop("deals")
    copies = moments.join(deals, keys).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1))).drop("deals")
    return spread(dealt, *keys, "deal").join(spread(copies, *keys, "deal"), [*keys, "deal"]).drop("deal")


def interpolate(track: DataFrame, moments: DataFrame, max_gap: float = MAX_GAP, digits: int | None = None) -> DataFrame:
    """Every vessel's position (rounded to `digits`, if given) at every moment (`t`, any other columns) that its track brackets within max_gap.

    The first segment that brackets a moment counts, so a moment on a ping belongs to the segment that ends there, and
    to none if that one is too long. Segments and distinct moments meet by hour, never as a cross product; rows of one moment
    share each vessel's place, which is rounded once for all of them. A vessel with a single position is taken to be there within max_gap."""
    hour = lambda t: F.floor(t / max_gap)
    moments = moments.withColumnRenamed("t", "moment")
    short = segments(track).where(F.col("dt") <= max_gap).withColumn("bucket", F.explode(F.sequence(hour(F.col("p_t")), hour(F.col("t")))))
    inside = ((F.col("p_t") < F.col("moment")) | (F.col("first_segment") & (F.col("p_t") == F.col("moment")))) & (F.col("moment") <= F.col("t"))
    own = {c: f"m_{c}" for c in moments.columns if c != "moment"}
    moments = saved(moments.withColumnsRenamed(own), "moments")
    times = saved(moments.select("moment").distinct().withColumn("bucket", hour(F.col("moment"))), "times")
    keep = ["mmsi", "moment"]
    met = short.join(times, "bucket").where(inside).select(*keep, at(F.col("moment"), "lat").alias("lat"), at(F.col("moment"), "lon").alias("lon"))
    single = track.groupBy("mmsi").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("t", "lat", "lon")]).where("n = 1")
    single = single.withColumn("bucket", F.explode(F.sequence(hour(F.col("t") - max_gap), hour(F.col("t") + max_gap))))
    lone = single.join(times, "bucket").where(F.abs(F.col("moment") - F.col("t")) <= max_gap).select(*keep, "lat", "lon")
    places = met.unionByName(lone)
    if digits is not None:
        places = places.withColumns({c: F.round(c, digits) for c in ("lat", "lon")})
    return paired(saved(places, "places"), moments, ["moment"]).select(*keep, *own.values(), "lat", "lon")


def near_moments(segs: DataFrame, track: DataFrame, moments: DataFrame, reach_km: float, max_gap: float = MAX_GAP) -> DataFrame:
    """mmsi, km and the columns of moments (t, lat, lon, any others): the moments within `reach_km` of a vessel's interpolated place."""
    return met_moments(segs, track, moments, reach_km, max_gap).where(F.col("km") <= reach_km)


def met_moments(segs: DataFrame, track: DataFrame, moments: DataFrame, reach_km: float, max_gap: float = MAX_GAP) -> DataFrame:
    """As `near_moments`, with some that lie farther away: a filter would have Spark compute every distance twice."""
    places, own = placed_near(segs, track, moments, reach_km, max_gap)
    near = paired(places, own, SPOTS).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("m_lat"), F.col("m_lon")))
    return near.select("mmsi", "km", *[F.col(f"m_{c}").alias(c) for c in moments.columns])


def placed_near(segs: DataFrame, track: DataFrame, moments: DataFrame, reach_km: float, max_gap: float = MAX_GAP) -> tuple[DataFrame, DataFrame]:
    """Written tables that meet by `SPOTS`: mmsi, lat, lon of vessels, and the moments (all columns as m_*); what lies within `reach_km`
    meets, and some that doesn't.

    As `interpolate`, but segments and moments meet by hour and cell, so that what is far apart never meets: cells come in
    sizes of 360 degrees over powers of two, a segment lies in the few cells of the size that its box (widened by the
    reach) calls for, and a moment in one cell of each size; segments outside an hour's first and last moment lie in none. Moments of one time in one smallest cell meet a vessel together;
    it is placed once for all of them."""
    degrees = reach_km / 111.0
    finest = max(0, int(math.floor(math.log2(360.0 / degrees))))
    size = F.lit(360.0) / F.pow(F.lit(2.0), F.col("level"))
    cell = lambda x: F.floor((x + 180.0) / size)
    around = lambda x: F.pmod(x, F.pow(F.lit(2.0), F.col("level")).cast("long"))
    hour = lambda t: F.floor(t / max_gap)
    keys = ["bucket", "level", "cy", "cx"]

    others = {c: f"m_{c}" for c in moments.columns}
    own = moments.withColumnsRenamed(others).withColumn("level", F.lit(finest))
    own = saved(own.withColumn("m_cy", cell(F.col("m_lat"))).withColumn("m_cx", around(cell(F.col("m_lon")))).drop("level"), "moments")
    hours = saved(own.groupBy(hour(F.col("m_t")).alias("bucket")).agg(F.min("m_t").alias("m_first"), F.max("m_t").alias("m_last")), "hours")

    def dealt(rows: DataFrame, lat0, lat1, lon0, lon1, since, until) -> DataFrame:
        rows = rows.withColumn("bucket", F.explode(F.sequence(hour(since), hour(until)))).join(hours, "bucket")
        rows = rows.where((F.col("m_first") <= until) & (F.col("m_last") >= since)).drop("m_first", "m_last")
        wide = degrees / F.greatest(F.lit(0.02), F.cos(F.radians(F.greatest(F.abs(lat0), F.abs(lat1)) + degrees)))
        extent = F.greatest(F.greatest(lat0, lat1) - F.least(lat0, lat1) + 2 * degrees, F.greatest(lon0, lon1) - F.least(lon0, lon1) + 2 * wide)
        rows = rows.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(finest), F.floor(F.log2(360.0 / extent)).cast("int"))))
        cells = lambda a, b, by: F.sequence(cell(F.least(a, b) - by), cell(F.greatest(a, b) + by))
        rows = rows.withColumn("cy", F.explode(cells(lat0, lat1, degrees)))
        return rows.withColumn("cx", F.explode(F.array_distinct(F.transform(cells(lon0, lon1, wide), around))))

    lat, lon, p_lat, p_lon = (F.col(c) for c in ("lat", "lon", "p_lat", "p_lon"))
    short = segs.where(F.col("dt") <= max_gap).withColumn("u_lon", p_lon + wrap_lon(lon - p_lon))
    short = dealt(short, p_lat, lat, p_lon, F.col("u_lon"), F.col("p_t"), F.col("t"))
    times = own.select(*SPOTS).distinct().withColumn("bucket", hour(F.col("m_t"))).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(finest))))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), finest - F.col("level")))
    times = saved(times.withColumn("cy", up("m_cy")).withColumn("cx", up("m_cx")), "times")
    inside = ((F.col("p_t") < F.col("m_t")) | (F.col("first_segment") & (F.col("p_t") == F.col("m_t")))) & (F.col("m_t") <= F.col("t"))
    met = short.join(times, keys).where(inside).select("mmsi", *SPOTS, at(F.col("m_t"), "lat").alias("lat"), at(F.col("m_t"), "lon").alias("lon"))
    single = track.groupBy("mmsi").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("t", "lat", "lon")]).where("n = 1")
    lone = dealt(single, lat, lat, lon, lon, F.col("t") - max_gap, F.col("t") + max_gap).join(times, keys).where(F.abs(F.col("m_t") - F.col("t")) <= max_gap).select("mmsi", *SPOTS, "lat", "lon")
    return saved(met.unionByName(lone), "places"), own


def closest_approach(track: DataFrame, lat: float, lon: float, t: float, window: float = 48 * 3600.0, max_gap: float = MAX_GAP) -> DataFrame:
    """mmsi, cpa_km, cpa_t over the positions in the window and eleven points inside each segment; the first of equals."""
    near = lambda c: F.abs(F.col(c) - t) <= window
    own = track.where(near("t")).select("mmsi", F.col("t").alias("moment"), "lat", "lon", F.lit(0).alias("k"))
    inner = segments(track).where((F.col("dt") > 0) & (F.col("dt") <= max_gap)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(11))))
    inner = inner.withColumn("moment", F.col("p_t") + F.col("dt") * F.col("k") / 12).where(near("moment"))
    inner = inner.select("mmsi", "moment", at(F.col("moment"), "lat").alias("lat"), at(F.col("moment"), "lon").alias("lon"), "k")
    each = own.unionByName(inner).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)))
    return each.groupBy("mmsi").agg(F.min("km").alias("cpa_km"), F.min_by("moment", F.struct("km", "moment")).alias("cpa_t"))


def longest_gap(track: DataFrame, segs: DataFrame | None = None) -> DataFrame:
    """mmsi, gap_s and the gap's ends; the earliest of equal gaps. segs: the track's segments, where they are at hand."""
    ends = F.struct("p_t", "t", "p_lat", "p_lon", "lat", "lon")
    return (segs or segments(track)).groupBy("mmsi").agg(F.max_by(ends, F.struct("dt", (-F.col("t")).alias("early"), (-F.col("ordinal")).alias("o"))).alias("e"), F.max("dt").alias("gap_s")).select("mmsi", "gap_s", "e.*")


def gap_classes(track: DataFrame, lat: float, lon: float, segs: DataFrame | None = None) -> DataFrame:
    """mmsi, code, severity, ratio of the longest gap above 30 minutes; dark if its midpoint lies within 25 km."""
    return classed_gaps(longest_gap(track, segs), F.lit(lat), F.lit(lon)).select("mmsi", "code", "severity", "ratio")


def classed_gaps(gaps: DataFrame, lat, lon) -> DataFrame:
    """Longest gaps above 30 minutes with code, severity and ratio, seen from a place (columns)."""
    g = gaps.where("gap_s > 1800").withColumn("minutes", F.col("gap_s") / 60)
    km = haversine_km((F.col("p_lat") + F.col("lat")) / 2, (F.col("p_lon") + F.col("lon")) / 2, lat, lon)
    code = F.when((F.col("minutes") > 45) & (km <= 25), "dark_vessel_gap").when(F.col("minutes") > 45, "ais_gap_long").otherwise("ais_gap_short")
    base = F.when(F.col("code") == "dark_vessel_gap", 2.10).when(F.col("code") == "ais_gap_long", 1.60).otherwise(1.15)
    severity = F.least(F.lit(1.0), F.col("minutes") / 180)
    return g.withColumn("code", code).withColumn("severity", severity).withColumn("ratio", 1 + (base - 1) * F.greatest(F.col("severity"), F.lit(0.35)))


def speed_drops(track: DataFrame, segs: DataFrame | None = None) -> DataFrame:
    """mmsi, code, severity, ratio: one for each pair at most ten minutes apart that loses over 5 knots."""
    drop = F.col("p_speed") - F.col("speed")
    s = (segs or segments(track)).where((F.col("dt") > 0) & (F.col("dt") <= 600) & (drop > 5))
    return s.select("mmsi", F.lit("speed_drop").alias("code"), F.least(F.lit(1.0), drop / 15).alias("severity")).withColumn("ratio", 1 + 0.35 * F.col("severity"))


def loitering(track: DataFrame, km: float = 2.0, least: float = 3600.0) -> DataFrame:
    """mmsi, code, severity, ratio of the first dwell of over an hour within 2 km of a moving anchor; tracks of three or more."""
    severity = F.least(F.lit(1.0), F.col("dwell") / 21600)
    return first_dwells(track, km, least).select("mmsi", F.lit("loitering").alias("code"), severity.alias("severity"), (1 + 0.45 * severity).alias("ratio"))


def anomalies(track: DataFrame, lat: float, lon: float, segs: DataFrame | None = None) -> DataFrame:
    return speed_drops(track, segs).unionByName(gap_classes(track, lat, lon, segs)).unionByName(loitering(track))


def behavioural_factor(found: DataFrame) -> DataFrame:
    """mmsi, factor, n_anomalies: the product over every anomaly."""
    return found.groupBy("mmsi").agg(F.product("ratio").alias("factor"), F.count("*").alias("n_anomalies"))


def integrity_flags(track: DataFrame) -> DataFrame:
    """mmsi, code, severity: the worst of each kind."""
    s = segments(track).withColumn("km", haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")))
    moving = F.col("dt") > 0
    knots = F.when(moving, F.col("km") / (F.col("dt") / 3600) / 1.852)
    flag = lambda when, code, severity: F.when(when, F.struct(F.lit(code).alias("code"), severity.alias("severity")))
    found = F.array(
        flag(~moving & (F.col("km") > 0.5), "duplicate_timestamps", F.lit(0.7)),
        flag(moving & (knots > 40), "impossible_speed", F.least(F.lit(1.0), knots / 100)),
        flag(moving & (F.col("km") > 50) & (F.col("dt") < 300), "position_teleport", F.lit(1.0)),
        flag(moving & (F.col("km") < 0.02) & (F.col("dt") > 600) & (F.col("p_speed") > 5), "frozen_position_underway", F.lit(0.8)),
    )
    each = s.select("mmsi", F.inline(F.filter(found, lambda f: f.isNotNull())))
    coarse = grid_residual(track).where("n >= 20 AND residual < 0.002").select("mmsi", F.lit("coarse_quantisation").alias("code"), F.lit(0.4).alias("severity"))
    return each.unionByName(coarse).groupBy("mmsi", "code").agg(F.max("severity").alias("severity"))


def grid_residual(track: DataFrame) -> DataFrame:
    """mmsi, n, residual: how far coordinates lie from a grid of 1e-4 degrees, on average."""
    off = F.inline(F.array(F.struct(F.col("lat").alias("c")), F.struct(F.col("lon").alias("c"))))
    each = track.select("mmsi", off)
    return each.groupBy("mmsi").agg((F.count("*") / 2).cast("long").alias("n"), F.avg(F.abs(F.col("c") * 1e4 - F.rint(F.col("c") * 1e4))).alias("residual"))


def implied_speed(track: DataFrame) -> DataFrame:
    """mmsi, max_knots over the pairs that move in time."""
    s = segments(track).where("dt > 0")
    return s.groupBy("mmsi").agg(F.max(haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")) / (F.col("dt") / 3600) / 1.852).alias("max_knots"))


def integrity(track: DataFrame) -> DataFrame:
    """mmsi, plausible, n_flags, max_knots of every vessel."""
    flags = integrity_flags(track).groupBy("mmsi").agg(F.bool_or(F.col("severity") >= 0.7).alias("bad"), F.count("*").alias("n_flags"))
    return track.select("mmsi").distinct().join(flags, "mmsi", "left").join(implied_speed(track), "mmsi", "left").select("mmsi", (~F.coalesce("bad", F.lit(False))).alias("plausible"), F.coalesce("n_flags", F.lit(0)).cast("long").alias("n_flags"), "max_knots")


def legacy_loitering(track: DataFrame, km: float = 2.0, least: float = 3600.0) -> DataFrame:
    """mmsi of tracks with some position that all following ones stay within 2 km of for over an hour."""
    return stays_near(track, km, least)
