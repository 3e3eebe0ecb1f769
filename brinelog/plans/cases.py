"""Cases: evidence seals, fields with fallback, position files, joins of regions, drifts and suspects, what a reader sees."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import drift as D
from ..operators import evidence as E
from ..operators import fields as M
from ..operators import joins as J
from ..operators import text as X
from ..operators import tracks as T
from ..session import spread
from ..sources import ais_csv as C
from ..sources import rasters as R
from ..sources.adapters import T0, hourly_fields, positions, runs, table
from ..sources.written import saved, shared_folder
from .sql import AIS, HOURS, SEG
from .tracks import FLAGS, r6
from .weather import STARTS, _velocity, starts

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# ---- evidence

_CONTENT = """'{"input_sha256":"' || sha256(o_orderpriority) || '","model_sha256":"' || sha256(o_orderstatus) || '","run":"' || o_orderkey || '","total":"' || round(o_totalprice)::BIGINT || '"}'"""
_FULL = """'{"content_sha256":"' || c || '","created_at":"' || o_orderdate::DATE || '","input_sha256":"' || sha256(o_orderpriority) || '","model_sha256":"' || sha256(o_orderstatus) || '","run":"' || o_orderkey || '","total":"' || round(o_totalprice)::BIGINT || '"}'"""
SEALED = f"c0 AS (SELECT *, sha256({_CONTENT}) AS c FROM orders), sealed AS (SELECT *, sha256({_FULL}) AS m FROM c0)"


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    pairs = {"created_at": F.date_format("o_orderdate", "yyyy-MM-dd"), "input_sha256": F.sha2("o_orderpriority", 256), "model_sha256": F.sha2("o_orderstatus", 256), "run": F.col("o_orderkey").cast("string"), "total": F.round("o_totalprice").cast("long").cast("string")}
    return E.sealed(o.select(F.col("o_orderkey").alias("run_id"), "o_orderpriority", F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]).alias("fields")))


@query(f"WITH {SEALED} SELECT o_orderkey AS run_id, c AS content_sha256, m AS manifest_sha256 FROM sealed")
def manifest_build(spark: SparkSession, sf: str) -> DataFrame:
    return manifests(spark, sf).select("run_id", "content_sha256", "manifest_sha256")


_ALTERED = "CASE WHEN o_orderkey % 5 = 1 THEN '0' ELSE round(o_totalprice)::BIGINT::VARCHAR END"
_REDATED = "CASE WHEN o_orderkey % 7 = 2 THEN '1066-10-14' ELSE o_orderdate::DATE::VARCHAR END"


@query(f"""WITH {SEALED}, now AS (SELECT *, sha256({_CONTENT.replace("round(o_totalprice)::BIGINT", _ALTERED)}) AS c_now, sha256({_FULL.replace("round(o_totalprice)::BIGINT", _ALTERED).replace("o_orderdate::DATE", _REDATED)}) AS m_now,
CASE WHEN o_orderkey % 11 = 3 THEN 'another file' ELSE sha256(o_orderpriority) END AS input_now FROM sealed),
r AS (SELECT o_orderkey AS run_id, concat_ws(',', CASE WHEN m_now <> m THEN 'manifest_sha256' END, CASE WHEN c_now <> c THEN 'content_sha256' END, CASE WHEN input_now <> sha256(o_orderpriority) THEN 'input' END) AS reasons FROM now)
SELECT run_id, reasons = '' AS valid, reasons FROM r""")
def manifest_verify(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("run_id")
    put = lambda name, value: F.map_concat(F.map_filter("fields", lambda n, _: n != name), F.create_map(F.lit(name), F.lit(value)))
    changed = manifests(spark, sf).withColumn("fields", F.when(k % 5 == 1, put("total", "0")).otherwise(F.col("fields")))
    changed = changed.withColumn("fields", F.when(k % 7 == 2, put("created_at", "1066-10-14")).otherwise(F.col("fields")))
    now = F.when(k % 11 == 3, F.lit("another file")).otherwise(F.sha2("o_orderpriority", 256))
    return E.verified(changed.withColumn("input_now", now).withColumn("model_now", F.lit(None).cast("string")), "run_id")


# A folder for each of 40 customers' groups; the files' places within it: top level, or one or two folders down.
_FILES = "f AS (SELECT c_custkey % 40 AS folder, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'd' || c_custkey % 2 || '/' ELSE 'd1/e/' END || c_name || '.bin' AS path, sha256(c_mktsegment) AS sha, c_custkey % 3 AS depth, c_custkey % 2 AS d, c_name FROM customer)"


@query(f"WITH {_FILES} SELECT folder, sha256(string_agg(path || sha, '' ORDER BY CASE depth WHEN 0 THEN 0 WHEN 1 THEN 1 + 2 * d ELSE 4 END, c_name)) AS sha256 FROM f GROUP BY 1")
def folder_digest(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    at = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("d"), (k % 2).cast("string"), F.lit("/"))).otherwise("d1/e/")
    files = table(spark, sf, "customer").select((k % 40).alias("folder"), F.concat(at, "c_name", F.lit(".bin")).alias("path"), F.sha2("c_mktsegment", 256).alias("sha256"))
    return E.folder_digests(files, "folder")


# ---- fields

FALLBACK = f"""{HOURS}, probes AS (SELECT event_id AS probe_id, epoch_us(ts) / 1e6 + (event_id % 3) * 2000000 AS t FROM events WHERE event_type = 'error'),
ser AS (SELECT w.hour, CASE WHEN w.hour % 5 <> 0 THEN wind END AS wind, CASE WHEN w.hour % 5 <> 0 THEN wind_from END AS wind_from, current, current_to FROM wind w LEFT JOIN curr c ON w.hour = c.hour),
near AS (SELECT p.probe_id, s.*, row_number() OVER (PARTITION BY p.probe_id ORDER BY abs(t - s.hour * 3600), s.hour) AS pick FROM probes p JOIN ser s ON s.hour BETWEEN floor(t / 3600) - 24 AND floor(t / 3600) + 25),
pt AS (SELECT probe_id, 7.0::DOUBLE AS wind, 90.0::DOUBLE AS wind_from, NULL::DOUBLE AS current, NULL::DOUBLE AS current_to FROM probes WHERE probe_id % 2 = 0)"""


@query(f"""WITH {FALLBACK} SELECT p.probe_id, round(coalesce(n.wind, pt.wind, 5), 5) AS wind, round(coalesce(n.wind_from, pt.wind_from, 180), 5) AS wind_from, round(coalesce(n.current, pt.current, 0.3), 5) AS current, round(coalesce(n.current_to, pt.current_to, 90), 5) AS current_to,
CASE WHEN n.hour IS NOT NULL THEN 'series' WHEN pt.wind IS NOT NULL THEN 'point' ELSE 'default' END AS source, concat_ws(',', CASE WHEN n.wind IS NULL THEN 'wind' END, CASE WHEN n.wind_from IS NULL THEN 'wind_from' END, CASE WHEN n.current IS NULL THEN 'current' END, CASE WHEN n.current_to IS NULL THEN 'current_to' END) AS filled
FROM probes p LEFT JOIN near n ON p.probe_id = n.probe_id AND pick = 1 LEFT JOIN pt ON p.probe_id = pt.probe_id""")
def fields_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'error'")
    probes = e.select(F.col("event_id").alias("probe_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) + (F.col("event_id") % 3) * 2000000).alias("t"))
    known = F.col("hour") % 5 != 0
    series = M.joined_fields(*hourly_fields(spark, sf)).withColumns({c: F.when(known, F.col(c)) for c in ("wind", "wind_from")})
    none = F.lit(None).cast("double")
    point = probes.where("probe_id % 2 = 0").select("probe_id", F.lit(7.0).alias("wind"), F.lit(90.0).alias("wind_from"), none.alias("current"), none.alias("current_to"))
    return M.sampled(probes, series, point).select("probe_id", *[F.round(c, 5).alias(c) for c in M.DEFAULTS], "source", "filled")


@query("SELECT event_id, printf('metocean:%.2f:%.2f:', value, -value / 3) || strftime(ts, '%Y%m%d_%H') AS key FROM events")
def field_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", M.cache_key(F.col("value"), -F.col("value") / 3, F.col("ts").cast("timestamp")).alias("key"))


_ASKED = "req AS (SELECT event_id AS id, (event_id % 3)::VARCHAR AS service, user_id % 97 || '@' || event_id % 3 AS key, epoch_us(ts) / 2e7 AS t, event_type <> 'error' AS ok, value FROM events)"


@query(f"""WITH RECURSIVE {_ASKED}, f AS (SELECT key, min(t) AS t FROM req GROUP BY key UNION ALL SELECT r.key, min(r.t) FROM f JOIN req r ON r.key = f.key AND r.t >= f.t + 21600 GROUP BY r.key),
asked AS (SELECT r.* FROM req r JOIN f ON r.key = f.key AND r.t = f.t QUALIFY row_number() OVER (PARTITION BY r.key, r.t ORDER BY id) = 1),
o AS (SELECT service, min(t) AS t FROM asked WHERE NOT ok GROUP BY 1 UNION ALL SELECT a.service, min(a.t) FROM o JOIN asked a ON a.service = o.service AND NOT a.ok AND a.t >= o.t + 300 GROUP BY 1),
fills AS (SELECT a.*, EXISTS (SELECT 1 FROM o WHERE o.service = a.service AND a.t > o.t AND a.t < o.t + 300) AS broken FROM asked a)
SELECT r.id AS request_id, round(r.t, 3) AS t, CASE WHEN a.broken THEN 'open' ELSE 'closed' END AS state, r.id <> a.id AS hit, CASE WHEN a.ok AND NOT a.broken THEN 'fetched' ELSE 'default' END AS source, CASE WHEN a.ok AND NOT a.broken THEN a.value END AS value, round(r.t - a.t, 3) AS age_s
FROM req r JOIN fills a ON a.key = r.key AND a.t <= r.t QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY a.t DESC) = 1""")
def field_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for fields in order of time through a store of six hours and a breaker of five minutes; errors are failures."""
    k, service = F.col("event_id"), (F.col("event_id") % 3).cast("string")
    asked = table(spark, sf, "events").select(k.alias("request_id"), service.alias("service"), F.concat((F.col("user_id") % 97).cast("string"), F.lit("@"), service).alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(2e7)).alias("t"), (F.col("event_type") != "error").alias("ok"), "value")
    return M.served(saved(asked, "requests")).select("request_id", F.round("t", 3).alias("t"), "state", "hit", "source", "value", F.round("age_s", 3).alias("age_s"))


@query("""WITH s AS (SELECT user_id AS key, epoch_us(ts) / 1e6 AS fetched_at FROM events WHERE event_id % 3 = 0), n AS (SELECT key, max(fetched_at) AS fetched_at FROM s GROUP BY 1), w AS (SELECT user_id AS key, epoch_us(ts) / 1e6 AS t FROM events WHERE event_id % 3 = 1)
SELECT w.key, round(min(t), 3) AS t FROM w LEFT JOIN n USING (key) WHERE fetched_at IS NULL OR t >= fetched_at + 21600 GROUP BY 1""")
def fields_to_ask(spark: SparkSession, sf: str) -> DataFrame:
    """Which keys have to be asked again: their newest value in the store is too old at some moment that wants it."""
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("at"), "value")
    store = e.where("event_id % 3 = 0").select("key", F.col("at").alias("fetched_at"), "value")
    return M.to_ask(e.where("event_id % 3 = 1").select("key", F.col("at").alias("t")), store).select("key", F.round("t", 3).alias("t"))


# ---- position files

_CSV = """raw AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE (user_id + 360000000) || CASE WHEN event_id % 4 = 0 THEN '99' ELSE '' END END AS mmsi,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS ts, round(value, 2) * 20 - 90 AS lat, round(value, 2) * 40 - 200 AS lon, value, event_type FROM events),
clean AS (SELECT event_id, substr(mmsi, 1, 9) AS mmsi, date_trunc('second', ts) AS timestamp, greatest(-90, least(90, lat)) AS lat, greatest(-180, least(180, lon)) AS lon, CASE WHEN event_id % 3 = 0 THEN '' ELSE (event_id % 3)::VARCHAR END AS status,
  CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS name FROM raw WHERE mmsi IS NOT NULL AND ts IS NOT NULL)"""


def position_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a position-report file has them, with headers in any case."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    mmsi = F.when(k % 17 != 0, F.concat((F.col("user_id") + 360000000).cast("string"), F.when(k % 4 == 0, "99").otherwise("")))
    time = F.when(k % 13 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    v = F.round("value", 2)
    return e.select(mmsi.alias("MMSI"), time.alias("BaseDateTime"), (v * 20 - 90).alias("LAT"), (v * 40 - 200).alias("Lon"), k.alias("Heading"), (k % 3).alias("Status"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("VesselName"))


def position_csv(spark: SparkSession, sf: str) -> str:
    """Where the events were written as a position-report file."""
    path = f"{shared_folder(spark)}/positions-{uuid.uuid4().hex}"
    position_columns(spark, sf).write.option("header", True).csv(path)
    return path


def position_file(spark: SparkSession, sf: str) -> DataFrame:
    """That file, scanned and cleaned."""
    return C.clean(C.read_csv(spark, position_csv(spark, sf)))


@query(f"WITH {_CSV} SELECT event_id, mmsi, epoch(timestamp)::BIGINT AS t, round(lat, 5) AS lat, round(lon, 5) AS lon, status, coalesce(name, '') AS name FROM clean")
def position_file_scan(spark: SparkSession, sf: str) -> DataFrame:
    return position_file(spark, sf).select(F.col("heading").cast("long").alias("event_id"), "mmsi", F.unix_seconds("timestamp").alias("t"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "status", "name")


@query(f"WITH {_CSV} SELECT mmsi, count(*) AS reports, max_by(name, event_id) FILTER (name IS NOT NULL) AS name FROM clean WHERE event_id % 10 <> 9 GROUP BY 1 UNION ALL SELECT 'replaced', count(*), NULL FROM clean WHERE event_id % 10 < 5")
def position_store(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends to a table of positions, then one of its partitions anew."""
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    p = position_file(spark, sf).select(F.col("heading").cast("long").alias("event_id"), "mmsi", F.when(F.col("name") != "", F.col("name")).alias("name")).withColumn("part", F.col("event_id") % 10)
    C.append(p.where("part < 5"), path, "part")
    C.append(p.where("part BETWEEN 5 AND 8"), path, "part")
    C.replace_partitions(p.where("part < 5").withColumn("name", F.col("name")), path, "part")
    kept = spark.read.schema(p.schema).parquet(path)
    each = C.last_known(kept, "mmsi", "event_id", ["name"]).join(kept.groupBy("mmsi").agg(F.count("*").alias("reports")), "mmsi")
    return each.select("mmsi", "reports", "name").unionByName(kept.where("part < 5").agg(F.lit("replaced").alias("mmsi"), F.count("*").alias("reports"), F.lit(None).cast("string").alias("name")))


@query(f"WITH {_CSV}, known AS (SELECT DISTINCT mmsi FROM clean WHERE event_id % 10 = 0) SELECT (SELECT count(DISTINCT mmsi) FROM clean WHERE mmsi NOT IN (SELECT mmsi FROM known)) AS vessels_created, (SELECT count(*) FROM clean) AS records_created, (SELECT count(*) FROM raw WHERE mmsi IS NULL OR ts IS NULL) AS errors")
def ingest_counters(spark: SparkSession, sf: str) -> DataFrame:
    path, folder = position_csv(spark, sf), f"{shared_folder(spark)}/loaded-{uuid.uuid4().hex}"
    known = table(spark, sf, "events").where("event_id % 10 = 0 AND event_id % 17 <> 0 AND event_id % 13 <> 0").select((F.col("user_id") + 360000000).cast("string").alias("mmsi"))
    return C.load(C.read_csv(spark, path), folder, known)


_LAYOUTS = f"""{_CSV}, mixed AS (SELECT * FROM clean WHERE event_id % 4 < 3)"""


@query(f"WITH {_LAYOUTS} SELECT event_id, mmsi, epoch(timestamp)::BIGINT AS t, round(lat, 5) AS lat, round(lon, 5) AS lon, CASE WHEN event_id % 4 = 2 THEN '' ELSE status END AS status, coalesce(name, '') AS name FROM mixed")
def position_files_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """One folder, four layouts: as usual; another order, case and a column more; without an optional one; without a required one."""
    raw, k, path = position_columns(spark, sf), F.col("Heading") % 4, f"{shared_folder(spark)}/mixed-{uuid.uuid4().hex}"
    other = raw.where(k == 1).select(*[F.col(c).alias(c.lower()) for c in ("VesselName", "Lon", "LAT", "Status", "Heading", "BaseDateTime", "MMSI")], F.lit("x, y").alias("note"))
    for layout in (raw.where(k == 0), other, raw.where(k == 2).drop("Status"), raw.where(k == 3).drop("LAT")):
        layout.write.mode("append").option("header", True).csv(path)
    rows = C.clean(C.read_csv(spark, path))
    return rows.select(F.col("heading").cast("long").alias("event_id"), "mmsi", F.unix_seconds("timestamp").alias("t"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "status", "name")


@query(f"WITH {AIS} SELECT ordinal, a.mmsi, c_name AS name, c_mktsegment AS vessel_type FROM ais a LEFT JOIN customer ON a.mmsi = c_custkey")
def record_vessel_join(spark: SparkSession, sf: str) -> DataFrame:
    vessels = table(spark, sf, "customer").select(F.col("c_custkey").alias("mmsi"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("vessel_type"))
    return J.with_vessels(positions(spark, sf), vessels).select("ordinal", "mmsi", "name", "vessel_type")


# ---- regions, drifts, suspects

@query("SELECT p_partkey AS region_id, o_orderkey AS drift_id, o_orderstatus AS status FROM part LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) o ON p_partkey = o_custkey AND rn = 1")
def region_last_drift(spark: SparkSession, sf: str) -> DataFrame:
    regions = table(spark, sf, "part").select(F.col("p_partkey").alias("region_id"))
    drifts = table(spark, sf, "orders").select(F.col("o_custkey").alias("region_id"), F.col("o_orderkey").alias("drift_id"), F.col("o_orderstatus").alias("status"))
    return J.last_drift(regions, drifts)


@query(f"WITH {AIS}, o AS (SELECT min(t) AS low, max(t) AS high FROM (SELECT 1704067200 + 3600.0::DOUBLE * (20 + 4 * (o_orderkey % 3)) AS t FROM orders)) SELECT a.mmsi, ordinal, round(a.t, 3) AS t FROM ais a, o WHERE a.mmsi IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND a.t BETWEEN low - 43200 AND high + 43200")
def suspect_tracks(spark: SparkSession, sf: str) -> DataFrame:
    suspects = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("mmsi"))
    origins = table(spark, sf, "orders").select((T0 + 3600.0 * (20 + 4 * (F.col("o_orderkey") % 3))).alias("t"))
    return J.suspect_tracks(positions(spark, sf), suspects, origins).select("mmsi", "ordinal", F.round("t", 3).alias("t"))


@query("SELECT o_orderkey AS run_id, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def runs_page(spark: SparkSession, sf: str) -> DataFrame:
    return J.page(runs(spark, sf).orderBy(F.desc("created"), "run_id"), 3, 50).select("run_id", "status")


@query("SELECT l_orderkey AS drift_id, l_linenumber AS rank, l_suppkey AS mmsi, round(l_discount, 6) AS posterior FROM lineitem WHERE l_linenumber <= 3 UNION ALL SELECT l_orderkey, NULL, NULL, round(1 - sum(l_discount), 6) FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1")
def suspects_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Suspects and what is left for an unknown source, written by run and read back."""
    s = table(spark, sf, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("drift_id"), F.col("l_linenumber").alias("rank"), F.col("l_suppkey").alias("mmsi"), F.col("l_discount").cast("double").alias("posterior"))
    every = s.unionByName(s.groupBy("drift_id").agg((1 - F.sum("posterior")).alias("posterior")), allowMissingColumns=True)
    path = f"{shared_folder(spark)}/suspects-{uuid.uuid4().hex}"
    C.append(every.withColumn("run_part", F.pmod("drift_id", F.lit(8))), path, "run_part")
    return spark.read.schema(every.schema).parquet(path).select("drift_id", "rank", "mmsi", *r6("posterior"))


@query("SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'running' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 5 = 0 THEN 2 ELSE 3 END AS version FROM orders")
def run_states(spark: SparkSession, sf: str) -> DataFrame:
    """Runs and their changes of state, each appended; the last one of a run is what holds."""
    o, k = runs(spark, sf).select("run_id"), F.col("run_id")
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    for version, status, which in ((1, "running", F.lit(True)), (2, "failed", (k % 3 != 0) & (k % 5 == 0)), (3, "completed", (k % 3 != 0) & (k % 5 != 0))):
        C.append(o.where(which).select("run_id", F.lit(status).alias("status"), F.lit(version).alias("version")), path)
    kept = spark.read.schema("run_id long, status string, version int").parquet(path)
    return kept.groupBy("run_id").agg(F.max_by("status", "version").alias("status"), F.max("version").alias("version"))


@query("SELECT 'scene-' || p_partkey AS scene, p_partkey % 3 <> 0 AS has_slick, CASE WHEN p_partkey % 3 <> 0 THEN 'truth/' || p_partkey || '.tif' END AS truth FROM part WHERE p_partkey % 4 <> 0")
def suite_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A suite's manifest written as JSON and read back; its scenes with what they should show."""
    k = F.col("p_partkey")
    scenes = table(spark, sf, "part").select((k % 8).alias("part"), F.struct(F.format_string("scene-%d", k).alias("scene"), (k % 3 != 0).alias("has_slick"), F.when(k % 3 != 0, F.format_string("truth/%d.tif", k)).alias("truth"), (k % 4 == 0).alias("withdrawn")).alias("s"))
    path = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    scenes.groupBy("part").agg(F.collect_list("s").alias("scenes")).write.json(path)
    return R.read_manifest(spark, path)


# ---- what a reader sees

@query(f"WITH {AIS}, {SEG}, {FLAGS} SELECT mmsi, string_agg(code, ' ' ORDER BY severity DESC, code) AS flags, coalesce(string_agg(code, ' ' ORDER BY severity DESC, code) FILTER (severity >= 0.5), '') AS material FROM best GROUP BY 1")
def flags_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    every = T.integrity_flags(positions(spark, sf)).groupBy("mmsi").agg(F.collect_list(F.struct("code", "severity")).alias("f"))
    return every.select("mmsi", F.array_join(X.material(F.col("f"), 0.0), " ").alias("flags"), F.array_join(X.material(F.col("f")), " ").alias("material"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '—' ELSE printf('%.2f km', p_retailprice / 7) END AS km, CASE WHEN p_partkey % 3 = 0 THEN '—' ELSE printf('%.1f%%', p_size / 50.0 * 100) END AS share FROM part""")
def missing_numbers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", X.shown(F.when(k % 4 != 0, F.col("p_retailprice") / 7), 2, " km").alias("km"), X.percent(F.when(k % 3 != 0, F.col("p_size") / 50.0), 1).alias("share"))


@query("""WITH h AS (SELECT o_orderkey AS case_id, o_custkey AS mmsi, c_name AS name, (o_orderkey % 100) / 100.0::DOUBLE AS posterior, (o_orderkey * 7 % 100) / 100.0::DOUBLE AS unknown FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0)
SELECT case_id, CASE WHEN unknown >= posterior THEN printf('No reporting vessel stands out: %.0f%% goes to a source that sent no reports.', unknown * 100)
ELSE printf('Released most likely by %s, MMSI %s (%s evidence): %.0f%%, against %.0f%% for a source that sent no reports.', coalesce(name, 'a vessel without a name'), mmsi::VARCHAR, CASE WHEN posterior >= 0.6 THEN 'strong' WHEN posterior >= 0.35 THEN 'probable' WHEN posterior >= 0.15 THEN 'weak' ELSE 'insufficient' END, posterior * 100, unknown * 100) END AS headline FROM h""")
def case_headline(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    o, k = table(spark, sf, "orders").join(names, "o_custkey", "left"), F.col("o_orderkey")
    posterior, unknown = (k % 100) / 100.0, (k * 7 % 100) / 100.0
    return o.select(k.alias("case_id"), X.headline(F.col("name"), F.col("o_custkey"), posterior, unknown, geo.verdict(posterior)).alias("headline"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN printf('Never within 5 km of any of the %d release hypotheses.', 500) ELSE printf('Within 5 km of the release in %d of %d hypotheses (%.1f%%).', event_id % 5 * 20, 500, event_id % 5 * 4.0) END
|| CASE WHEN event_id % 3 = 0 THEN '' ELSE printf(' Closest approach %.2f km at ', value) || strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+00:00') || '.' END || CASE WHEN event_type = 'error' THEN ' No anomalies on this track.' ELSE printf(' Behaviour raises the odds by %.2f: loitering, ', 1 + value) || event_type || '.' END AS told FROM events""")
def narratives(spark: SparkSession, sf: str) -> DataFrame:
    e, k = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.col("event_id")
    codes = F.when(F.col("event_type") == "error", F.array().cast("array<string>")).otherwise(F.array(F.lit("loitering"), "event_type"))
    return e.select("event_id", X.narrative(k % 5 * 20, F.lit(500), 5.0, F.when(k % 3 != 0, F.col("value")), F.col("ts"), 1 + F.col("value"), codes).alias("told"))


@query("SELECT event_id, strftime(date_trunc('second', ts) - INTERVAL 12 HOUR, '%Y-%m-%dT%H:%M:%S+00:00') AS since, strftime(date_trunc('second', ts) + INTERVAL 48 HOUR, '%Y-%m-%dT%H:%M:%S+00:00') AS until FROM events")
def time_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", X.iso(F.expr("ts - make_dt_interval(0, 12, 0, 0)")).alias("since"), X.iso(F.expr("ts + make_dt_interval(0, 48, 0, 0)")).alias("until"))


_EVAP = "least(0.95::DOUBLE, 0.080::DOUBLE * ln(1 + l_quantity) * (1 + 0.010::DOUBLE * (25.0::DOUBLE - 15.0::DOUBLE)) * (1 + 0.030::DOUBLE * greatest(0.0::DOUBLE, l_discount * 200 - 5)))"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN {_EVAP} > 0.5 THEN printf('%.0f%% evaporated: mass balance unreliable', {_EVAP} * 100) WHEN {_EVAP} > 0.3 THEN printf('%.0f%% evaporated: treat volume with care', {_EVAP} * 100) ELSE '' END AS warning FROM lineitem")
def weathering_warnings(spark: SparkSession, sf: str) -> DataFrame:
    x = geo.evaporated_fraction(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 200)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", geo.weathering_warning(x).alias("warning"))


@query(f"""WITH RECURSIVE {STARTS}, v AS (SELECT particle_id, lat, lon, {_velocity('0.0::DOUBLE')} FROM starts),
walk AS (SELECT 0 AS k, * FROM v UNION ALL SELECT k + 1, particle_id, lat - vn * 3600 / 6371000.0::DOUBLE * 180 / pi(), lon - ve * 3600 / (6371000.0::DOUBLE * cos(radians(lat))) * 180 / pi(), ve, vn FROM walk WHERE k < 24)
SELECT particle_id, 24 - k AS step, round(lat, 6) AS lat, round(lon, 6) AS lon, 14.0::DOUBLE AS uncertainty_km FROM walk WHERE k IN (0, 11, 24)""")
def hindcast_path(spark: SparkSession, sf: str) -> DataFrame:
    return D.path(starts(spark, sf), 24.0).select("particle_id", F.posexplode("path").alias("step", "p"), "uncertainty_km").where("step IN (0, 13, 24)").select("particle_id", F.col("step").cast("long").alias("step"), F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"), "uncertainty_km")


# ---- raster files and sidecars

def tiffs(spark: SparkSession, sf: str) -> DataFrame:
    """path, content: each part as the TIFF file of a small two-band picture; some without a place, some cut short."""

    def run(frames):
        for pdf in frames:
            rows = []
            for k in pdf["p_partkey"].tolist():
                w, h, wide = 3 + k % 4, 2 + k % 3, k % 2 == 1
                pixels = ((np.arange(w * h * 2) * 7 + k) % 250).astype("<u2" if wide else "u1").tobytes()
                tags = [(256, 3, 1, w), (257, 3, 1, h), (258, 3, 2, 16 * 65537 if wide else 8 * 65537), (259, 3, 1, 1), (273, 4, 1, 300), (277, 3, 1, 2), (279, 4, 1, len(pixels))]
                tags += [(33550, 12, 3, 200), (33922, 12, 6, 230)] if k % 5 else []
                head = b"II" + struct.pack("<HIH", 42, 8, len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
                place = struct.pack("<3d", 0.01, 0.02, 0) + b"\0" * 6 + struct.pack("<6d", 0, 0, 0, -170 + k % 300, 80 - k % 100, 0)
                whole = head.ljust(200, b"\0") + place.ljust(100, b"\0") + pixels
                rows.append((f"scene/{k}.tif", whole[:50] if k % 11 == 0 else whole))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return spread(table(spark, sf, "part").select("p_partkey"), "p_partkey").mapInPandas(run, "path string, content binary")


_TIFF = "t AS (SELECT p_partkey AS k, 3 + p_partkey % 4 AS w, 2 + p_partkey % 3 AS h, -170.0::DOUBLE + p_partkey % 300 AS lon, 80.0::DOUBLE - p_partkey % 100 AS lat, p_partkey % 5 <> 0 AS placed FROM part WHERE p_partkey % 11 <> 0)"


@query(f"WITH {_TIFF} SELECT 'scene/' || k || '.tif' AS path, w::INT AS width, h::INT AS height, 2 AS bands, CASE WHEN k % 2 = 1 THEN 'uint16' ELSE 'uint8' END AS kind, CASE WHEN placed THEN lon END AS min_lon, round(CASE WHEN placed THEN lat - h * 0.02::DOUBLE END, 6) AS min_lat, round(CASE WHEN placed THEN lon + w * 0.01::DOUBLE END, 6) AS max_lon, CASE WHEN placed THEN lat END AS max_lat, true AS readable FROM t UNION ALL SELECT 'scene/' || p_partkey || '.tif', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false FROM part WHERE p_partkey % 11 = 0")
def raster_scan(spark: SparkSession, sf: str) -> DataFrame:
    return R.read_tiff(tiffs(spark, sf)).select("path", "width", "height", "bands", "kind", "min_lon", *r6("min_lat", "max_lon"), "max_lat", F.col("error").isNull().alias("readable"))


@query(f"WITH {_TIFF}, p AS (SELECT k, w, unnest(range(w * h * 2)) AS i FROM t) SELECT 'scene/' || k || '.tif' AS path, (i % 2)::INT AS band, count(*) AS n, sum(((i * 7 + k) % 250) * (1 + i // 2))::DOUBLE AS mark FROM p GROUP BY 1, 2")
def raster_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """A pixel's weight is its place in its file, from 1; sums along rows meet the width, not each pixel. Whole numbers, so exact."""
    files = tiffs(spark, sf)
    width = R.read_tiff(files).select("path", "width").hint("merge")  # by its bytes it would be broadcast, however many files
    sums = R.tiff_pixels(files).groupBy("path", "band").agg(F.count("*").alias("n"), F.sum(F.col("value") * (1 + F.col("x"))).alias("across"), F.sum(F.col("value") * F.col("y")).alias("down"))
    return sums.join(width, "path").select("path", "band", "n", (F.col("across") + F.col("down") * F.col("width")).alias("mark"))


_MODELS = "m AS (SELECT c_custkey AS k, 'models/g' || c_custkey % 7 || '/p' || c_custkey % 5 || '/net' || c_custkey AS checkpoint FROM customer)"


@query(f"""WITH {_MODELS} SELECT checkpoint, CASE WHEN k % 4 = 0 THEN 'own ' || k WHEN k % 5 = 1 THEN 'parent' WHEN k % 7 = 2 THEN 'top' ELSE 'net' || k END AS name, CASE WHEN k % 4 = 0 THEN '2.0' ELSE '1.0.0' END AS version, 'custom_unet' AS architecture, CASE WHEN k % 4 <> 0 AND k % 5 = 1 THEN 128 ELSE 256 END AS input_size, 224 AS stride, 'scale_0_1' AS normalization, 0.5::DOUBLE AS threshold,
CASE WHEN k % 4 = 0 THEN checkpoint || '/model_info.json' WHEN k % 5 = 1 THEN 'models/g' || k % 7 || '/p1/model_info.json' WHEN k % 7 = 2 THEN 'models/g2/model_info.json' END AS sidecar FROM m""")
def model_sidecars(spark: SparkSession, sf: str) -> DataFrame:
    """Sidecars written as JSON and read back; the nearest of three folders counts."""
    k = F.col("c_custkey")
    at = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i.cast("string") for i in x])
    models = table(spark, sf, "customer").select(k, at("models/g", k % 7, "/p", k % 5, "/net", k).alias("checkpoint"))
    own = models.where("c_custkey % 4 = 0").select(at(F.col("checkpoint"), "/model_info.json").alias("path"), at("own ", k).alias("name"), F.lit("2.0").alias("version"))
    parent = models.where("c_custkey % 5 = 1").select(at("models/g", k % 7, "/p1/model_info.json").alias("path"), F.lit("parent").alias("name"), F.lit(128).alias("input_size")).distinct()
    top = models.where("c_custkey % 7 = 2").select(F.lit("models/g2/model_info.json").alias("path"), F.lit("top").alias("name")).distinct()
    folder = f"{shared_folder(spark)}/sidecars-{uuid.uuid4().hex}"
    own.unionByName(parent, allowMissingColumns=True).unionByName(top, allowMissingColumns=True).write.json(folder)
    read = spark.read.schema("path string, name string, version string, input_size int").json(folder)
    return R.with_sidecars(models.select("checkpoint"), read)


QUERIES, ORACLE_SQL = Q, SQL
