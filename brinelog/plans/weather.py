"""Drift and fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import drift as D
from ..operators import fields
from ..sources.written import saved
from ..sources.adapters import hourly_fields, particles, table
from .sql import HOURS, PARTICLES, hav, wrap
from .tracks import r6

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


STARTS = f"{PARTICLES}, starts AS (SELECT *, 4.0::DOUBLE + particle_id % 9 AS wind, (particle_id * 37 % 360)::DOUBLE AS wind_from, 0.1::DOUBLE * (particle_id % 5) AS current, (particle_id * 53 % 360)::DOUBLE AS current_to FROM particles)"


def starts(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("particle_id")
    return particles(spark, sf).select("*", (4.0 + i % 9).alias("wind"), (i * 37 % 360).cast("double").alias("wind_from"), (0.1 * (i % 5)).alias("current"), (i * 53 % 360).cast("double").alias("current_to"))


def _velocity(deflection: str) -> str:
    e, n, t = "(-wind * sin(radians(wind_from)))", "(-wind * cos(radians(wind_from)))", f"radians(CASE WHEN lat >= 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * {deflection})"
    return f"current * sin(radians(current_to)) + 0.03::DOUBLE * ({e} * cos({t}) - {n} * sin({t})) AS ve, current * cos(radians(current_to)) + 0.03::DOUBLE * ({e} * sin({t}) + {n} * cos({t})) AS vn"


@query(f"WITH {STARTS}, v AS (SELECT particle_id, {_velocity('15.0::DOUBLE')} FROM starts) SELECT particle_id, round(ve, 6) AS ve, round(vn, 6) AS vn FROM v")
def drift_velocity(spark: SparkSession, sf: str) -> DataFrame:
    ve, vn = geo.drift_velocity(F.col("wind"), F.col("wind_from"), F.col("current"), F.col("current_to"), 0.03, 15.0, F.col("lat"))
    return starts(spark, sf).select("particle_id", F.round(ve, 6).alias("ve"), F.round(vn, 6).alias("vn"))


def _walk(sign: str) -> str:
    return f"""WITH RECURSIVE {STARTS}, v AS (SELECT particle_id, lat, lon, {_velocity('0.0::DOUBLE')} FROM starts),
walk AS (SELECT 0 AS k, * FROM v UNION ALL SELECT k + 1, particle_id, lat {sign} vn * 3600 / 6371000.0::DOUBLE * 180 / pi(), lon {sign} ve * 3600 / (6371000.0::DOUBLE * cos(radians(lat))) * 180 / pi(), ve, vn FROM walk WHERE k < 24)
SELECT particle_id, round(lat, 6) AS end_lat, round(lon, 6) AS end_lon FROM walk WHERE k = 24"""


@query(_walk("-"))
def lagrangian_hindcast(spark: SparkSession, sf: str) -> DataFrame:
    return D.trajectory(starts(spark, sf)).select("particle_id", *r6("end_lat", "end_lon"))


@query(_walk("+"))
def forecast(spark: SparkSession, sf: str) -> DataFrame:
    return D.trajectory(starts(spark, sf), direction=1).select("particle_id", *r6("end_lat", "end_lon"))


_EVAPORATED = "least(0.95::DOUBLE, greatest(0.0::DOUBLE, 0.080::DOUBLE * ln(1 + l_quantity) * (1 + 0.010::DOUBLE * (25.0::DOUBLE - 15.0::DOUBLE)) * (1 + 0.030::DOUBLE * greatest(0.0::DOUBLE, l_discount * 200 - 5))))"


@query(f"SELECT l_orderkey, l_linenumber, round({_EVAPORATED}, 6) AS fraction, CASE WHEN {_EVAPORATED} > 0.5 THEN 2 WHEN {_EVAPORATED} > 0.3 THEN 1 ELSE 0 END AS level FROM lineitem")
def evaporation(spark: SparkSession, sf: str) -> DataFrame:
    x = geo.evaporated_fraction(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 200)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 6).alias("fraction"), F.when(x > 0.5, 2).when(x > 0.3, 1).otherwise(0).alias("level"))


CLOUDS = f"{PARTICLES}, clouds AS (SELECT particle_id % 7 AS cloud, particle_id, lat, {wrap('lon + 108')} AS lon, t FROM particles)"
CENTRES = f"""{CLOUDS}, centres AS (SELECT cloud, avg(lat) AS mean_lat, {wrap("degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon)))))")} AS mean_lon, avg(t) AS mean_t, count(*) AS n FROM clouds GROUP BY 1)"""
FAR = f"{CENTRES}, far AS (SELECT c.*, n, {hav('lat', 'lon', 'mean_lat', 'mean_lon')} AS km FROM clouds c JOIN centres m ON c.cloud = m.cloud)"


def clouds(spark: SparkSession, sf: str) -> DataFrame:
    return particles(spark, sf).select((F.col("particle_id") % 7).alias("cloud"), "particle_id", "lat", geo.wrap_lon(F.col("lon") + 108).alias("lon"), "t")


@query(f"WITH {CENTRES} SELECT cloud, round(mean_lat, 6) AS mean_lat, round(mean_lon, 6) AS mean_lon, round(mean_t, 3) AS mean_t, n FROM centres")
def origin_circular_mean(spark: SparkSession, sf: str) -> DataFrame:
    return D.centre(clouds(spark, sf), "cloud").select("cloud", *r6("mean_lat", "mean_lon"), F.round("mean_t", 3).alias("mean_t"), "n")


@query(f"WITH {FAR} SELECT cloud, round(quantile_cont(km, 0.5), 5) AS radius_50_km, round(quantile_cont(km, 0.9), 5) AS radius_90_km FROM far GROUP BY 1")
def radius_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return D.radii(clouds(spark, sf), "cloud").select("cloud", F.round("radius_50_km", 5).alias("radius_50_km"), F.round("radius_90_km", 5).alias("radius_90_km"))


@query(f"WITH {FAR}, o AS (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY km, particle_id) AS rn FROM far) SELECT cloud, particle_id FROM o WHERE rn <= greatest(3, ceil(n * 0.5::DOUBLE))")
def nearest_half_particles(spark: SparkSession, sf: str) -> DataFrame:
    return D.nearest_share(clouds(spark, sf), "cloud", 0.5).select("cloud", "particle_id")


STEPS = f"""{STARTS}, {HOURS}, series AS (SELECT w.hour, CASE WHEN w.hour % 5 <> 0 THEN wind END AS wind, wind_from, current, current_to FROM wind w LEFT JOIN curr c ON w.hour = c.hour WHERE w.hour % 97 < 60),
each AS (SELECT particle_id AS case_id, s.*, k, s.t - k * 3600.0::DOUBLE AS at FROM starts s, range(4 + particle_id % 3) AS r(k)),
met AS (SELECT e.case_id, e.k, h.*, row_number() OVER (PARTITION BY e.case_id, e.k ORDER BY abs(e.at - h.hour * 3600), h.hour) AS pick FROM each e JOIN series h ON h.hour BETWEEN floor(e.at / 3600) - 24 AND floor(e.at / 3600) + 25)"""


@query(f"""WITH {STEPS} SELECT e.case_id, e.k::INT AS k, round(e.at, 3) AS at, round(coalesce(m.wind, e.wind), 5) AS wind, round(coalesce(m.wind_from, e.wind_from), 5) AS wind_from, round(coalesce(m.current, e.current), 5) AS current, round(coalesce(m.current_to, e.current_to), 5) AS current_to,
round(abs(e.at - m.hour * 3600), 3) AS age_s, CASE WHEN m.hour IS NULL THEN 'held' WHEN m.wind IS NULL OR m.wind_from IS NULL OR m.current IS NULL OR m.current_to IS NULL THEN 'filled' ELSE 'hour' END AS source FROM each e LEFT JOIN met m ON e.case_id = m.case_id AND e.k = m.k AND pick = 1""")
def step_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Each step's field with where it is from; some hours lack the wind, some days are missing."""
    cases = starts(spark, sf).select(F.col("particle_id").alias("case_id"), "lat", "lon", "t", "wind", "wind_from", "current", "current_to", (4 + F.col("particle_id") % 3).cast("double").alias("hours"))
    hourly = fields.joined_fields(*hourly_fields(spark, sf)).withColumn("wind", F.when(F.col("hour") % 5 != 0, F.col("wind"))).where("hour % 97 < 60")
    steps = D.step_sources(cases, hourly)
    return steps.select("case_id", "k", F.round("at", 3).alias("at"), *[F.round(c, 5).alias(c) for c in ("wind", "wind_from", "current", "current_to")], F.round("age_s", 3).alias("age_s"), "source")


HULL = f"""WITH {PARTICLES}, cl AS (SELECT particle_id % 7 AS cloud, * FROM particles),
ce AS (SELECT cloud, avg(lat) AS mean_lat, {wrap("degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon)))))")} AS mean_lon, count(*) AS n FROM cl GROUP BY 1),
nr AS (SELECT c.*, n, row_number() OVER (PARTITION BY c.cloud ORDER BY {hav('lat', 'lon', 'mean_lat', 'mean_lon')}, particle_id) AS rn FROM cl c JOIN ce USING (cloud)),
pts AS (SELECT cloud, lon, lat FROM nr WHERE rn <= greatest(3, ceil(n * 0.9::DOUBLE))),
side AS (SELECT a.cloud, a.lon, a.lat, min((b.lon - a.lon) * (c.lat - a.lat) - (b.lat - a.lat) * (c.lon - a.lon)) AS least FROM pts a JOIN pts b ON a.cloud = b.cloud AND (a.lon <> b.lon OR a.lat <> b.lat) JOIN pts c ON a.cloud = c.cloud GROUP BY a.cloud, a.lon, a.lat, b.lon, b.lat),
corner AS (SELECT DISTINCT cloud, lon, lat FROM side WHERE least >= 0),
mid AS (SELECT cloud, avg(lon) AS m_lon, avg(lat) AS m_lat, min_by(lon, lon) AS w_lon, min_by(lat, lon) AS w_lat, count(*) AS n FROM corner GROUP BY 1),
turn AS (SELECT c.cloud, lon, lat, n, ((atan2(lat - m_lat, lon - m_lon) - atan2(w_lat - m_lat, w_lon - m_lon)) % (2 * pi()) + 2 * pi() + 1e-9) % (2 * pi()) AS angle FROM corner c JOIN mid USING (cloud)),
ring AS (SELECT cloud, row_number() OVER (PARTITION BY cloud ORDER BY angle) - 1 AS k, lon, lat, n FROM turn)
SELECT cloud, k::INT AS k, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ring UNION ALL SELECT cloud, n::INT, round(lon, 6), round(lat, 6) FROM ring WHERE k = 0"""


@query(HULL)
def convex_hull(spark: SparkSession, sf: str) -> DataFrame:
    rings = D.hulls(D.nearest_share(particles(spark, sf).withColumn("cloud", F.col("particle_id") % 7), "cloud", 0.9), "cloud")
    return rings.select("cloud", F.posexplode("ring").alias("k", "p")).select("cloud", "k", F.round(F.col("p")[0], 6).alias("lon"), F.round(F.col("p")[1], 6).alias("lat"))


@query(f"WITH {HOURS} SELECT w.hour, round(wind, 5) AS wind, wind_from, round(current, 5) AS current, current_to FROM wind w LEFT JOIN curr c ON w.hour = c.hour")
def wind_current_left_join(spark: SparkSession, sf: str) -> DataFrame:
    return fields.joined_fields(*hourly_fields(spark, sf)).select("hour", F.round("wind", 5).alias("wind"), "wind_from", F.round("current", 5).alias("current"), "current_to")


@query(f"""WITH {HOURS}, probes AS (SELECT event_id AS probe_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'error'),
near AS (SELECT probe_id, wind, w.hour, row_number() OVER (PARTITION BY probe_id ORDER BY abs(t - w.hour * 3600), w.hour) AS pick FROM probes p JOIN wind w ON w.hour BETWEEN floor(t / 3600) - 24 AND floor(t / 3600) + 25)
SELECT p.probe_id, n.hour, round(wind, 5) AS wind FROM probes p LEFT JOIN near n ON p.probe_id = n.probe_id AND pick = 1""")
def nearest_hour_join(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'error'").select(F.col("event_id").alias("probe_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"))
    return fields.nearest_hour(e, hourly_fields(spark, sf)[0]).select("probe_id", "hour", F.round("wind", 5).alias("wind"))


@query("SELECT event_id, event_type AS unit_of, round(CASE event_type WHEN 'view' THEN value / 3.6::DOUBLE WHEN 'click' THEN value * 0.514444::DOUBLE WHEN 'error' THEN value * 0.44704::DOUBLE ELSE value END, 6) AS mps FROM events")
def unit_convert(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.when(F.col("event_type") == "view", "km/h").when(F.col("event_type") == "click", "kn").when(F.col("event_type") == "error", "mph").otherwise("m/s")
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("unit_of"), F.round(geo.to_mps(F.col("value"), unit), 6).alias("mps"))


QUERIES, ORACLE_SQL = Q, SQL
