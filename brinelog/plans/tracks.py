"""Positions, geodesy and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import tracks as T
from ..sources.adapters import T0, particles, positions, table
from ..sources.ais_csv import absent, clip, last_known
from .sql import AIS, PARTICLES, SEG, hav, wrap

LAT, LON = 19.0, 72.0
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query(f"WITH {AIS} SELECT mmsi, ordinal, round(t, 3) AS t, greatest(-18.9::DOUBLE, least(18.9::DOUBLE, lat)) AS lat, round(lon, 6) AS lon, CASE WHEN ordinal % 3 = 0 THEN '' ELSE (ordinal % 3)::VARCHAR END AS status FROM ais WHERE speed IS NOT NULL")
def ais_clean_clip(spark: SparkSession, sf: str) -> DataFrame:
    p = positions(spark, sf).dropna(subset=["mmsi", "t", "lat", "lon", "speed"])
    status = (F.col("ordinal") % 3).cast("string")
    return p.select("mmsi", "ordinal", F.round("t", 3).alias("t"), clip(F.col("lat"), 18.9).alias("lat"), F.round("lon", 6).alias("lon"), F.when(status == "0", "").otherwise(status).alias("status"))


@query(f"WITH {AIS} SELECT mmsi, ordinal, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ais WHERE t BETWEEN 1704067200 + 3 * 3600 AND 1704067200 + 9 * 3600")
def ais_window_filter(spark: SparkSession, sf: str) -> DataFrame:
    return positions(spark, sf).where(F.col("t").between(T0 + 3 * 3600, T0 + 9 * 3600)).select("mmsi", "ordinal", *r6("lat", "lon"))


@query("SELECT c_custkey AS mmsi, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def vessel_insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "customer").select(F.col("c_custkey").alias("mmsi"), F.col("c_name").alias("name"))
    return absent(new, table(spark, sf, "events").select(F.col("user_id").alias("mmsi")), "mmsi")


@query("SELECT user_id AS mmsi, max_by(value, event_id) FILTER (WHERE event_type <> 'view') AS value, max_by(event_type, event_id) FILTER (WHERE event_type <> 'click') AS kind FROM events GROUP BY 1")
def vessel_last_nonnull(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("mmsi"), "event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"))
    return last_known(e, "mmsi", "event_id", ["value", "kind"])


@query(f"WITH {AIS} SELECT mmsi, ordinal, round(t, 3) AS t, round(speed, 6) AS speed FROM ais WHERE mmsi = 3 AND t >= 1704067200 + 3600")
def track_of_vessel(spark: SparkSession, sf: str) -> DataFrame:
    return positions(spark, sf).where((F.col("mmsi") == 3) & (F.col("t") >= T0 + 3600)).select("mmsi", "ordinal", F.round("t", 3).alias("t"), *r6("speed"))


@query(f"WITH {AIS} SELECT mmsi, count(*) AS n, count(DISTINCT floor(t / 3600)) AS hours, round(avg(speed), 10) AS mean_speed FROM ais GROUP BY 1")
def vessel_summary(spark: SparkSession, sf: str) -> DataFrame:
    return positions(spark, sf).groupBy("mmsi").agg(F.count("*").alias("n"), F.countDistinct(F.floor(F.col("t") / 3600)).alias("hours"), F.round(F.avg("speed"), 10).alias("mean_speed"))


@query(f"WITH {AIS} SELECT ordinal, round({hav('lat', 'lon', '19.0::DOUBLE', '72.0::DOUBLE')}, 6) AS km FROM ais")
def haversine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return positions(spark, sf).select("ordinal", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(LAT), F.lit(LON)), 6).alias("km"))


@query(f"SELECT o_orderkey, round({wrap('o_totalprice - 150000')}, 6) AS lon, round(111.195::DOUBLE * cos(radians(o_totalprice % 90)), 6) AS km_per_degree FROM orders")
def wrap_lon(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.round(geo.wrap_lon(F.col("o_totalprice") - 150000), 6).alias("lon"), F.round(geo.km_per_degree_lon(F.col("o_totalprice") % 90), 6).alias("km_per_degree"))


_RING = [("lon", "lat"), ("lon + d", "lat"), ("lon + d", "lat + d"), ("lon", "lat + d")]
_EDGES = " + ".join(f"radians({wrap(f'({b[0]}) - ({a[0]})')}) * (2 + sin(radians({a[1]})) + sin(radians({b[1]})))" for a, b in zip(_RING, _RING[1:] + _RING[:1], strict=True))


@query(f"WITH {PARTICLES}, d AS (SELECT *, 0.1::DOUBLE + particle_id % 7 * 0.1::DOUBLE AS d FROM particles) SELECT particle_id, round(abs({_EDGES}) * 6371.0::DOUBLE * 6371.0::DOUBLE / 2, 5) AS area FROM d")
def ring_area_spherical(spark: SparkSession, sf: str) -> DataFrame:
    p = particles(spark, sf).withColumn("d", 0.1 + F.col("particle_id") % 7 * 0.1)
    lon, lat, d = F.col("lon"), F.col("lat"), F.col("d")
    ring = F.array(F.array(lon, lat), F.array(lon + d, lat), F.array(lon + d, lat + d), F.array(lon, lat + d))
    return p.withColumn("ring", ring).select("particle_id", F.round(geo.ring_area_sq_km(F.col("ring")), 5).alias("area"))


BANDS = "('sheen', 0.04, 0.30), ('rainbow', 0.30, 5.0), ('metallic', 5.0, 50.0), ('discontinuous', 50.0, 200.0), ('continuous', 200.0, 1000.0)"
CODES = "'sheen', 'rainbow', 'metallic', 'discontinuous', 'continuous'"


@query(f"WITH b AS (SELECT * FROM (VALUES {BANDS}) t(code, low, high)), r AS (SELECT p_partkey, p_retailprice / 100 AS area, list_value({CODES})[1 + p_partkey % 5] AS code FROM part) SELECT p_partkey, r.code, round(area * low::DOUBLE, 6) AS m3_min, round(area * high::DOUBLE, 6) AS m3_max FROM r JOIN b ON r.code = b.code")
def volume_band(spark: SparkSession, sf: str) -> DataFrame:
    bands = spark.sql(f"SELECT code, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM VALUES {BANDS} AS t(code, low, high)")
    r = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 100).alias("area"), F.expr(f"array({CODES})[CAST(p_partkey % 5 AS INT)]").alias("code"))
    return r.join(F.broadcast(bands), "code").select("p_partkey", "code", F.round(F.col("area") * F.col("low"), 6).alias("m3_min"), F.round(F.col("area") * F.col("high"), 6).alias("m3_max"))


@query(f"WITH {AIS}, {SEG} SELECT mmsi, ordinal, round(dt, 3) AS dt, round(speed - p_speed, 6) AS change FROM seg")
def segments_lag(spark: SparkSession, sf: str) -> DataFrame:
    return T.segments(positions(spark, sf)).select("mmsi", "ordinal", F.round("dt", 3).alias("dt"), F.round(F.col("speed") - F.col("p_speed"), 6).alias("change"))


INTERP = f"""hits AS (SELECT particle_id, p.t AS moment, p.lat AS at_lat, p.lon AS at_lon, s.*, row_number() OVER (PARTITION BY particle_id, mmsi ORDER BY s.t, s.ordinal) AS pick
  FROM particles p JOIN (SELECT mmsi, t, ordinal, lat, lon, p_t, p_lat, p_lon, dt FROM seg) s(mmsi, t, ordinal, lat, lon, p_t, p_lat, p_lon, dt) ON s.p_t <= p.t AND p.t <= s.t),
met AS (SELECT particle_id, mmsi, at_lat, at_lon, p_lat + (moment - p_t) / dt * (lat - p_lat) AS lat, {wrap(f"p_lon + (moment - p_t) / dt * {wrap('lon - p_lon')}")} AS lon FROM hits WHERE pick = 1 AND dt <= 3600)"""


@query(f"WITH {AIS}, {SEG}, {PARTICLES}, {INTERP} SELECT mmsi, particle_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM met")
def interp_at_particle_time(spark: SparkSession, sf: str) -> DataFrame:
    return T.interpolate(positions(spark, sf), particles(spark, sf).select("t", "particle_id"), digits=6).select("mmsi", F.col("m_particle_id").alias("particle_id"), "lat", "lon")


@query(f"""WITH {AIS}, {SEG}, pts AS (SELECT mmsi, lat, lon FROM ais UNION ALL SELECT mmsi, p_lat + k / 12.0::DOUBLE * (lat - p_lat), {wrap(f"p_lon + k / 12.0::DOUBLE * {wrap('lon - p_lon')}")} FROM seg, range(1, 12) r(k) WHERE dt > 0 AND dt <= 3600)
SELECT mmsi, round(min({hav('lat', 'lon', '19.0::DOUBLE', '72.0::DOUBLE')}), 5) AS cpa_km FROM pts GROUP BY 1""")
def cpa_subsampled(spark: SparkSession, sf: str) -> DataFrame:
    return T.closest_approach(positions(spark, sf), LAT, LON, T0 + 6 * 3600).select("mmsi", F.round("cpa_km", 5).alias("cpa_km"))


@query(f"WITH {AIS}, {SEG} SELECT mmsi, round(max(dt), 3) AS gap_s, round(max_by(lat, dt), 6) AS lat FROM seg GROUP BY 1")
def longest_gap(spark: SparkSession, sf: str) -> DataFrame:
    return T.longest_gap(positions(spark, sf)).select("mmsi", F.round("gap_s", 3).alias("gap_s"), *r6("lat"))


DROPS = "drops AS (SELECT mmsi, least(1.0::DOUBLE, (p_speed - speed) / 15) AS severity FROM seg WHERE dt > 0 AND dt <= 600 AND p_speed - speed > 5)"


@query(f"WITH {AIS}, {SEG}, {DROPS} SELECT mmsi, count(*) AS n, round(max(severity), 6) AS worst, round(sum(severity), 5) AS total FROM drops GROUP BY 1")
def speed_drops(spark: SparkSession, sf: str) -> DataFrame:
    return T.speed_drops(positions(spark, sf)).groupBy("mmsi").agg(F.count("*").alias("n"), F.round(F.max("severity"), 6).alias("worst"), F.round(F.sum("severity"), 5).alias("total"))


def _gaps(lat: str, lon: str) -> str:
    km = hav("(p_lat + lat) / 2", "(p_lon + lon) / 2", lat, lon)
    return f"""gap0 AS (SELECT mmsi, max(dt) AS gap_s, max_by({km}, dt) AS km FROM seg GROUP BY 1),
gaps AS (SELECT mmsi, CASE WHEN gap_s > 2700 AND km <= 25 THEN 'dark_vessel_gap' WHEN gap_s > 2700 THEN 'ais_gap_long' ELSE 'ais_gap_short' END AS code, least(1.0::DOUBLE, gap_s / 60 / 180) AS severity FROM gap0 WHERE gap_s > 1800)"""


GAPS = _gaps("19.0::DOUBLE", "72.0::DOUBLE")
RATIO = "1 + (CASE code WHEN 'dark_vessel_gap' THEN 1.10::DOUBLE WHEN 'ais_gap_long' THEN 0.60::DOUBLE ELSE 0.15::DOUBLE END) * greatest(severity, 0.35::DOUBLE)"


@query(f"WITH {AIS}, {SEG}, {GAPS} SELECT mmsi, code, round(severity, 6) AS severity, round({RATIO}, 6) AS ratio FROM gaps")
def gap_classes(spark: SparkSession, sf: str) -> DataFrame:
    return T.gap_classes(positions(spark, sf), LAT, LON).select("mmsi", "code", *r6("severity", "ratio"))


LOITER = f"""walk AS (
  SELECT mmsi, rn, t, t AS a_t, lat AS a_lat, lon AS a_lon, NULL::DOUBLE AS dwell FROM seg0 WHERE rn = 1
  UNION ALL
  SELECT s.mmsi, s.rn, s.t, CASE WHEN far THEN s.t ELSE a_t END, CASE WHEN far THEN s.lat ELSE a_lat END, CASE WHEN far THEN s.lon ELSE a_lon END, CASE WHEN NOT far AND s.t - a_t > 3600 THEN s.t - a_t END
  FROM (SELECT w.*, n.t AS n_t, {hav('a_lat', 'a_lon', 'n.lat', 'n.lon')} > 2 AS far, n.lat AS n_lat, n.lon AS n_lon FROM walk w JOIN seg0 n ON n.mmsi = w.mmsi AND n.rn = w.rn + 1 WHERE w.dwell IS NULL) x
  JOIN seg0 s ON s.mmsi = x.mmsi AND s.rn = x.rn + 1),
loiter AS (SELECT mmsi, least(1.0::DOUBLE, dwell / 21600) AS severity FROM walk WHERE dwell IS NOT NULL AND mmsi IN (SELECT mmsi FROM ais GROUP BY 1 HAVING count(*) >= 3))"""


@query(f"WITH RECURSIVE {AIS}, {SEG}, {LOITER} SELECT mmsi, round(severity, 6) AS severity, round(1 + 0.45::DOUBLE * severity, 6) AS ratio FROM loiter")
def loiter_anchor(spark: SparkSession, sf: str) -> DataFrame:
    return T.loitering(positions(spark, sf)).select("mmsi", *r6("severity", "ratio"))


LEGACY_LOITER = f"""pairs AS (SELECT a.mmsi, a.rn AS i, b.rn AS j, b.t - a.t AS dwell, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} > 2 AS far FROM seg0 a JOIN seg0 b ON a.mmsi = b.mmsi AND b.rn > a.rn),
exits AS (SELECT mmsi, i, min(j) FILTER (WHERE far) AS out FROM pairs GROUP BY 1, 2),
old_loiter AS (SELECT DISTINCT p.mmsi FROM pairs p JOIN exits e ON p.mmsi = e.mmsi AND p.i = e.i WHERE (e.out IS NULL OR p.j < e.out) AND p.dwell > 3600)"""


@query(f"WITH {AIS}, {SEG}, {LEGACY_LOITER} SELECT mmsi, true AS loiters FROM old_loiter")
def loiter_legacy(spark: SparkSession, sf: str) -> DataFrame:
    return T.legacy_loitering(positions(spark, sf))


def _factor(gaps: str) -> str:
    return f"""{SEG}, {DROPS}, {gaps}, {LOITER},
found AS (SELECT mmsi, 1 + 0.35::DOUBLE * severity AS ratio FROM drops UNION ALL SELECT mmsi, {RATIO} FROM gaps UNION ALL SELECT mmsi, 1 + 0.45::DOUBLE * severity FROM loiter),
factors AS (SELECT mmsi, product(ratio) AS factor, count(*) AS n_anomalies FROM found GROUP BY 1)"""


@query(f"WITH RECURSIVE {AIS}, {_factor(GAPS)} SELECT mmsi, round(factor, 4) AS factor, n_anomalies FROM factors")
def anomaly_lr_product(spark: SparkSession, sf: str) -> DataFrame:
    return T.behavioural_factor(T.anomalies(positions(spark, sf), LAT, LON)).select("mmsi", F.round("factor", 4).alias("factor"), "n_anomalies")


KM = f"legs AS (SELECT *, {hav('p_lat', 'p_lon', 'lat', 'lon')} AS km FROM seg)"


@query(f"WITH {AIS}, {SEG}, {KM} SELECT mmsi, round(max(km / (dt / 3600) / 1.852::DOUBLE), 2) AS max_knots FROM legs WHERE dt > 0 GROUP BY 1")
def implied_speed(spark: SparkSession, sf: str) -> DataFrame:
    return T.implied_speed(positions(spark, sf)).select("mmsi", F.round("max_knots", 2).alias("max_knots"))


FLAGS = f"""{KM}, kn AS (SELECT *, km / (dt / 3600) / 1.852::DOUBLE AS knots FROM legs WHERE dt > 0),
grid AS (SELECT mmsi, count(*) AS n, (avg(abs(lat * 1e4 - round_even(lat * 1e4, 0))) + avg(abs(lon * 1e4 - round_even(lon * 1e4, 0)))) / 2 AS residual FROM ais GROUP BY 1),
flags AS (SELECT mmsi, 'duplicate_timestamps' AS code, 0.7::DOUBLE AS severity FROM legs WHERE dt <= 0 AND km > 0.5
  UNION ALL SELECT mmsi, 'impossible_speed', least(1.0::DOUBLE, knots / 100) FROM kn WHERE knots > 40
  UNION ALL SELECT mmsi, 'position_teleport', 1.0 FROM kn WHERE km > 50 AND dt < 300
  UNION ALL SELECT mmsi, 'frozen_position_underway', 0.8 FROM kn WHERE km < 0.02 AND dt > 600 AND p_speed > 5
  UNION ALL SELECT mmsi, 'coarse_quantisation', 0.4 FROM grid WHERE n >= 20 AND residual < 0.002),
best AS (SELECT mmsi, code, max(severity) AS severity FROM flags GROUP BY 1, 2)"""


@query(f"WITH {AIS}, {SEG}, {FLAGS} SELECT mmsi, code, round(severity, 6) AS severity FROM best")
def integrity_flags_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return T.integrity_flags(positions(spark, sf)).select("mmsi", "code", *r6("severity"))


@query(f"WITH {AIS}, {SEG}, {FLAGS} SELECT mmsi, n, round(residual, 5) AS residual FROM grid")
def grid_residual(spark: SparkSession, sf: str) -> DataFrame:
    return T.grid_residual(positions(spark, sf)).select("mmsi", "n", F.round("residual", 5).alias("residual"))


QUERIES, ORACLE_SQL = Q, SQL
