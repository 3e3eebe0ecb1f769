"""Attribution: from hypotheses and tracks to ranked suspects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution as A
from ..operators import geometry as G
from ..operators import tracks as T
from ..sources.adapters import T0, outlines, particles, positions
from .regions import PLACED
from .sql import AIS, PARTICLES, PI, SEG, hav
from .tracks import DROPS, FLAGS, INTERP, LEGACY_LOITER, LOITER, _factor, _gaps, r6

RADIUS = 60.0
O_LAT, O_LON, O_T = 19.0, 72.0, T0 + 6 * 3600
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


SIGMA = "30.0::DOUBLE"
CAPTURE = f"""{PARTICLES}, {INTERP},
near AS (SELECT mmsi, {hav('lat', 'lon', 'at_lat', 'at_lon')} AS km FROM met),
capture AS (SELECT mmsi, sum(exp(-0.5::DOUBLE * (km / {SIGMA}) ** 2)) AS weight, count(*) AS captured FROM near WHERE km <= 3 * {SIGMA} GROUP BY 1)"""
ORIGIN = f"""o0 AS (SELECT avg(lat) AS o_lat, avg(lon) AS o_lon, count(*) AS n FROM particles),
origin AS (SELECT any_value(o_lat) AS o_lat, any_value(o_lon) AS o_lon, any_value(n) AS n, sqrt(avg({hav('lat', 'lon', 'o_lat', 'o_lon')} ** 2)) AS spread FROM particles, o0)"""
RANKED = f"""{CAPTURE}, {ORIGIN},
mass AS (SELECT v.mmsi, coalesce(captured, 0) AS captured, coalesce(weight, 0) / n AS likelihood, coalesce(factor, 1) AS factor, 0.75::DOUBLE * (coalesce(weight, 0) / n) * coalesce(factor, 1) AS mass,
  0.25::DOUBLE * least(1.0::DOUBLE, 2 * {PI} * {SIGMA} * {SIGMA} / ({PI} * greatest(spread, {SIGMA}) ** 2)) AS u
  FROM (SELECT DISTINCT mmsi FROM ais) v LEFT JOIN capture c ON v.mmsi = c.mmsi LEFT JOIN factors f ON v.mmsi = f.mmsi, origin),
post AS (SELECT *, mass / (sum(mass) OVER () + u) AS posterior, u / (sum(mass) OVER () + u) AS unknown FROM mass),
ranked AS (SELECT *, row_number() OVER (ORDER BY posterior DESC, mmsi::VARCHAR) AS rank,
  CASE WHEN posterior >= 0.6 THEN 'strong' WHEN posterior >= 0.35 THEN 'probable' WHEN posterior >= 0.15 THEN 'weak' ELSE 'insufficient' END AS verdict FROM post)"""
HEAD = f"WITH RECURSIVE {AIS}, {_factor(_gaps('19.0::DOUBLE', '72.0::DOUBLE'))}, {RANKED}"
HEADLESS = f"WITH {AIS}, {SEG}"


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return A.attribute(positions(spark, sf), particles(spark, sf), RADIUS, lat=O_LAT, lon=O_LON)


@query(f"{HEADLESS}, {CAPTURE} SELECT mmsi, captured, round(weight, 5) AS weight FROM capture")
def soft_capture(spark: SparkSession, sf: str) -> DataFrame:
    return A.soft_capture(positions(spark, sf), particles(spark, sf), RADIUS).select("mmsi", "captured", F.round("weight", 5).alias("weight"))


@query(f"WITH {PARTICLES}, {ORIGIN} SELECT round(o_lat, 6) AS o_lat, round(o_lon, 6) AS o_lon, n, round(spread, 6) AS spread_km FROM origin")
def ensemble_spread(spark: SparkSession, sf: str) -> DataFrame:
    return A.origin(particles(spark, sf)).select(*r6("o_lat", "o_lon"), "n", *r6("spread_km"))


@query(f"{HEAD} SELECT mmsi, captured, round(likelihood, 6) AS likelihood, round(posterior, 6) AS posterior, round(unknown, 6) AS unknown, rank, verdict FROM ranked")
def posterior_rank_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(spark, sf).select("mmsi", "captured", *r6("likelihood", "posterior", "unknown"), "rank", "verdict")


@query(f"{HEAD} SELECT max_by(mmsi, posterior) AS best, round(max(posterior), 6) AS posterior, round(max(unknown), 6) AS unknown, CASE WHEN max(unknown) >= max(posterior) THEN 'insufficient_evidence' ELSE max_by(verdict, posterior) END AS conclusion FROM ranked")
def case_conclusion(spark: SparkSession, sf: str) -> DataFrame:
    return A.conclusion(ranked(spark, sf)).select("best", *r6("posterior", "unknown"), "conclusion")


MINIMA = f"""old0 AS (SELECT mmsi, t, ordinal, {hav('lat', 'lon', '19.0::DOUBLE', '72.0::DOUBLE')} AS km, abs(t - (1704067200 + 21600)) / 3600 AS h FROM ais),
minima AS (SELECT mmsi, min(km) AS min_km, min_by(t, km) AS min_km_t, min(h) AS min_hours, min_by(t, h) AS closest_t FROM old0 GROUP BY 1)"""


@query(f"{HEADLESS}, {MINIMA} SELECT mmsi, round(min_km, 5) AS min_km, round(min_hours, 5) AS min_hours, round(closest_t, 3) AS closest_t FROM minima")
def legacy_min_dist_argmin(spark: SparkSession, sf: str) -> DataFrame:
    return A.legacy_minima(positions(spark, sf), O_LAT, O_LON, O_T).select("mmsi", F.round("min_km", 5).alias("min_km"), F.round("min_hours", 5).alias("min_hours"), F.round("closest_t", 3).alias("closest_t"))


OLD = f"""{MINIMA}, {LEGACY_LOITER},
codes AS (SELECT s.mmsi, max((dt > 1800)::INT) + max((dt <= 600 AND abs(speed - p_speed) > 5)::INT) + max((l.mmsi IS NOT NULL)::INT) AS n FROM seg s LEFT JOIN old_loiter l ON s.mmsi = l.mmsi GROUP BY 1),
old AS (SELECT m.mmsi, exp(-min_km / 10) AS proximity, exp(-min_hours / 6) AS temporal, least(1.0::DOUBLE, 0.33::DOUBLE * coalesce(n, 0)) AS behavioural FROM minima m LEFT JOIN codes c ON m.mmsi = c.mmsi WHERE min_km <= 50),
older AS (SELECT *, 0.40::DOUBLE * proximity + 0.35::DOUBLE * temporal + 0.25::DOUBLE * behavioural AS composite FROM old)"""


@query(f"{HEADLESS}, {OLD} SELECT mmsi, round(proximity, 6) AS proximity, round(temporal, 6) AS temporal, round(behavioural, 6) AS behavioural, round(composite, 6) AS composite, row_number() OVER (ORDER BY composite DESC, mmsi::VARCHAR) AS rank FROM older")
def legacy_composite_rank(spark: SparkSession, sf: str) -> DataFrame:
    return A.legacy_score(positions(spark, sf), O_LAT, O_LON, O_T).select("mmsi", *r6("proximity", "temporal", "behavioural", "composite"), "rank")


SUSPECTS = f"""{HEAD}, {OLD}, {FLAGS}, bad AS (SELECT mmsi, count(*) AS n_flags, bool_or(severity >= 0.7) AS bad FROM best GROUP BY 1),
suspects AS (SELECT r.mmsi, rank, posterior, verdict, coalesce(composite, 0) AS composite, NOT coalesce(bad, false) AS plausible, coalesce(n_flags, 0) AS n_flags FROM ranked r LEFT JOIN older o ON r.mmsi = o.mmsi LEFT JOIN bad b ON r.mmsi = b.mmsi)"""


def suspects(spark: SparkSession, sf: str) -> DataFrame:
    track = positions(spark, sf)
    return A.suspects(ranked(spark, sf), A.legacy_score(track, O_LAT, O_LON, O_T), T.integrity(track))


@query(f"{SUSPECTS} SELECT mmsi, rank, round(posterior, 6) AS posterior, verdict, round(composite, 6) AS composite, plausible, n_flags FROM suspects")
def suspects_joined(spark: SparkSession, sf: str) -> DataFrame:
    return suspects(spark, sf).select("mmsi", "rank", *r6("posterior"), "verdict", *r6("composite"), "plausible", "n_flags")


@query(f"{SUSPECTS} SELECT max_by(mmsi, posterior) AS by_posterior, max_by(mmsi, composite) AS by_score, max_by(mmsi, posterior) <> max_by(mmsi, composite) AS disagree FROM suspects")
def methods_disagree(spark: SparkSession, sf: str) -> DataFrame:
    top = suspects(spark, sf).agg(F.max_by("mmsi", "posterior").alias("by_posterior"), F.max_by("mmsi", "composite").alias("by_score"))
    return top.withColumn("disagree", F.col("by_posterior") != F.col("by_score"))


@query(f"{HEAD} SELECT mmsi, rank, round(posterior, 6) AS posterior FROM ranked WHERE rank <= 3")
def top_suspects(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(spark, sf).where("rank <= 3").select("mmsi", "rank", *r6("posterior"))


DRIFTS = f"""clouds AS (SELECT *, particle_id % 4 AS drift_id FROM particles),
org0 AS (SELECT drift_id, avg(lat) AS o_lat, avg(lon) AS o_lon, avg(t) AS o_t, count(*) AS n FROM clouds GROUP BY 1),
org AS (SELECT o.*, s.spread FROM org0 o JOIN (SELECT c.drift_id, sqrt(avg({hav('lat', 'lon', 'o_lat', 'o_lon')} ** 2)) AS spread FROM clouds c JOIN org0 USING (drift_id) GROUP BY 1) s USING (drift_id)),
near AS (SELECT particle_id % 4 AS drift_id, mmsi, {hav('lat', 'lon', 'at_lat', 'at_lon')} AS km FROM met),
caught AS (SELECT drift_id, mmsi, sum(exp(-0.5::DOUBLE * (km / {SIGMA}) ** 2)) AS weight, count(*) AS captured FROM near WHERE km <= 3 * {SIGMA} GROUP BY 1, 2),
fixed0 AS (SELECT mmsi, 1 + 0.35::DOUBLE * severity AS ratio FROM drops UNION ALL SELECT mmsi, 1 + 0.45::DOUBLE * severity FROM loiter), fixed AS (SELECT mmsi, product(ratio) AS f FROM fixed0 GROUP BY 1),
long AS (SELECT mmsi, max(dt) AS gap_s, max_by((p_lat + lat) / 2, dt) AS g_lat, max_by((p_lon + lon) / 2, dt) AS g_lon FROM seg GROUP BY 1),
gp AS (SELECT drift_id, mmsi, gap_s, {hav('g_lat', 'g_lon', 'o_lat', 'o_lon')} AS km, least(1.0::DOUBLE, gap_s / 10800) AS sev FROM long, org WHERE gap_s > 1800),
gr AS (SELECT drift_id, mmsi, 1 + CASE WHEN gap_s > 2700 AND km <= 25 THEN 1.1::DOUBLE WHEN gap_s > 2700 THEN 0.6::DOUBLE ELSE 0.15::DOUBLE END * greatest(sev, 0.35::DOUBLE) AS g FROM gp),
pr AS (SELECT DISTINCT drift_id, n, mmsi FROM ais, org WHERE abs(t - o_t) <= 172800),
hyp AS (SELECT pr.drift_id, pr.mmsi, coalesce(captured, 0) AS captured, coalesce(weight, 0) / n AS likelihood, coalesce(f, 1) * coalesce(g, 1) AS factor FROM pr LEFT JOIN caught c ON pr.drift_id = c.drift_id AND pr.mmsi = c.mmsi LEFT JOIN gr ON pr.drift_id = gr.drift_id AND pr.mmsi = gr.mmsi LEFT JOIN fixed x ON pr.mmsi = x.mmsi
  UNION ALL SELECT drift_id, NULL, NULL, least(1.0::DOUBLE, 2 * {SIGMA} * {SIGMA} / greatest(spread, {SIGMA}) ** 2), 1.0::DOUBLE FROM org),
ms AS (SELECT *, CASE WHEN mmsi IS NULL THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END * likelihood * factor AS mass FROM hyp),
ps AS (SELECT *, mass / sum(mass) OVER (PARTITION BY drift_id) AS posterior FROM ms),
rk AS (SELECT *, row_number() OVER (PARTITION BY drift_id ORDER BY posterior DESC, mmsi IS NOT NULL, mmsi::VARCHAR)::INT AS rank, CASE WHEN posterior >= 0.6 THEN 'strong' WHEN posterior >= 0.35 THEN 'probable' WHEN posterior >= 0.15 THEN 'weak' ELSE 'insufficient' END AS verdict FROM ps)"""
BY_CASE = f"WITH RECURSIVE {AIS}, {SEG}, {DROPS}, {LOITER}, {PARTICLES}, {INTERP}, {DRIFTS}"


def by_case(spark: SparkSession, sf: str) -> DataFrame:
    return A.attribute_cases(positions(spark, sf), particles(spark, sf).withColumn("drift_id", F.col("particle_id") % 4), RADIUS)


@query(f"{BY_CASE} SELECT drift_id, mmsi, captured, round(likelihood, 6) AS likelihood, round(factor, 4) AS factor, round(posterior, 6) AS posterior, rank, verdict FROM rk")
def attribution_by_case(spark: SparkSession, sf: str) -> DataFrame:
    return by_case(spark, sf).select("drift_id", "mmsi", "captured", *r6("likelihood"), F.round("factor", 4).alias("factor"), *r6("posterior"), "rank", "verdict")


@query(f"{BY_CASE} SELECT drift_id, min_by(coalesce(mmsi, -1), rank) AS best, round(max(posterior), 6) AS posterior, round(max(posterior) FILTER (mmsi IS NULL), 6) AS unknown, CASE WHEN min_by(coalesce(mmsi, -1), rank) = -1 THEN 'insufficient_evidence' ELSE min_by(verdict, rank) END AS conclusion FROM rk GROUP BY 1")
def conclusions_by_case(spark: SparkSession, sf: str) -> DataFrame:
    return A.case_conclusions(by_case(spark, sf)).select("drift_id", F.coalesce("best", F.lit(-1)).alias("best"), *r6("posterior", "unknown"), "conclusion")


@query(f"{HEADLESS}, {LEGACY_LOITER}, k AS (SELECT s.mmsi, max((dt > 1800)::INT) AS gap, max((dt <= 600 AND abs(speed - p_speed) > 5)::INT) AS change, max((l.mmsi IS NOT NULL)::INT) AS stays FROM seg s LEFT JOIN old_loiter l ON s.mmsi = l.mmsi GROUP BY 1) SELECT mmsi, concat_ws(' ', CASE WHEN gap = 1 THEN 'ais_gap' END, CASE WHEN stays = 1 THEN 'loitering' END, CASE WHEN change = 1 THEN 'speed_change' END) AS codes FROM k")
def legacy_codes(spark: SparkSession, sf: str) -> DataFrame:
    return A.legacy_codes(positions(spark, sf)).select("mmsi", F.array_join("codes", " ").alias("codes"))


@query(f"{BY_CASE}, {PLACED}, {FLAGS}, bad AS (SELECT mmsi, count(*) AS n_flags, bool_or(severity >= 0.7) AS bad FROM best GROUP BY 1) SELECT drift_id, rk.mmsi, rank, round(posterior, 6) AS posterior, NOT coalesce(bad, false) AS plausible, coalesce(n_flags, 0) AS n_flags FROM rk LEFT JOIN bad ON rk.mmsi = bad.mmsi WHERE drift_id + 21 IN (SELECT region_id FROM placed WHERE centroid_lat IS NOT NULL)")
def cases_from_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions 21 to 24 are the cases'; some are too small, some have no place: their drifts go no further."""
    p = particles(spark, sf).withColumn("drift_id", F.col("particle_id") % 4).withColumn("region_id", F.col("drift_id") + 21)
    times = p.select("drift_id", "region_id").distinct()
    own = outlines(spark, sf).join(times.select("region_id"), "region_id", "left_semi")  # each region is measured by itself, so only those that have drifts
    regions = G.georeferenced(G.measured(own), F.lit(1200), F.lit(900), F.col("bbox"))
    found = A.run_cases(regions, p, positions(spark, sf), times, RADIUS)
    return found.select("drift_id", "mmsi", "rank", *r6("posterior"), "plausible", "n_flags")


QUERIES, ORACLE_SQL = Q, SQL
