"""Evidence, runs and dossiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import evidence as E
from ..sources.adapters import particles, runs, table
from .sql import PARTICLES
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


@query("SELECT doc_id, sha256(text) AS sha256, substr(sha256(source), 1, 16) AS owner FROM documents")
def sha256_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", E.digest(F.col("text")).alias("sha256"), E.fingerprint(F.col("source")).alias("owner"))


@query("SELECT event_id, sha256('{\"k\":\"' || (props->>'k') || '\"}') AS digest FROM events")
def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    told = D.canonical(table(spark, sf, "events").select("event_id", "props"), "props")
    return told.select("event_id", E.digest(F.col("canonical")).alias("digest"))


def nested(spark: SparkSession, sf: str) -> DataFrame:
    """run_id, text: an order as a document with objects in arrays in objects, booleans, nulls and long numbers; some can't be read."""
    o, k, total = table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    text = F.format_string('{"z": [%d, {"status": "%s", "none": null, "deep": [[], {"share": %.15e}]}], "paid": %s, "a b": {"\\u00e9\\n": %.3f, "small": -%.9e}, "e": {}, "n": %d0000000000}', k, "o_orderstatus", total / 7, (k % 3 == 0).cast("string"), total * 1000, total / F.lit(1e12), k)
    return o.select(k.alias("run_id"), F.when(k % 13 == 0, F.substring(text, 1, 40)).otherwise(text).alias("text"))


_G = lambda x: f"""'"' || printf('%.12g', {x}) || '"'"""
_DOC = f"""d AS (SELECT o_orderkey AS k, o_orderstatus AS status, (o_orderkey % 3 = 0)::VARCHAR AS paid, printf('%.15e', o_totalprice::DOUBLE / 7)::DOUBLE AS share, printf('%.3f', o_totalprice::DOUBLE * 1000)::DOUBLE AS big, -printf('%.9e', o_totalprice::DOUBLE / 1e12)::DOUBLE AS small FROM orders)"""


@query(f"""WITH {_DOC} SELECT k AS run_id, CASE WHEN k % 13 <> 0 THEN '{{"a b":{{"small":' || {_G('small')} || ',"é\\n":' || {_G('big')} || '}},"e":{{}},"n":' || {_G('k * 10000000000.0::DOUBLE')} || ',"paid":' || paid || ',"z":[' || {_G('k::DOUBLE')} || ',{{"deep":[[],{{"share":' || {_G('share')} || '}}],"none":null,"status":"' || status || '"}}]}}' END AS canonical FROM d""")
def canonical_nested(spark: SparkSession, sf: str) -> DataFrame:
    return D.canonical(nested(spark, sf), "text").select("run_id", "canonical")


@query(f"""WITH {_DOC} SELECT k AS run_id, unnest(['$.a b.small', '$.a b.é' || chr(10), '$.e', '$.n', '$.paid', '$.z[0]', '$.z[1].deep[0]', '$.z[1].deep[1].share', '$.z[1].none', '$.z[1].status']) AS path, unnest(['number', 'number', 'object', 'number', 'boolean', 'number', 'array', 'number', 'null', 'string']) AS kind,
unnest([{_G('small')}, {_G('big')}, '{{}}', {_G('k * 10000000000.0::DOUBLE')}, paid, {_G('k::DOUBLE')}, '[]', {_G('share')}, 'null', '"' || status || '"']) AS value FROM d WHERE k % 13 <> 0""")
def documents_flattened(spark: SparkSession, sf: str) -> DataFrame:
    return D.flattened(nested(spark, sf), "run_id", "text")


@query("""SELECT o_orderkey AS run_id, o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AS valid,
concat_ws('; ', CASE WHEN o_orderkey % 4 = 0 THEN 'seal missing' END, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 4 <> 0 THEN 'content changed' END, CASE WHEN o_orderkey % 3 = 0 THEN 'scene changed' END) AS reasons FROM orders""")
def manifest_verify_reasons(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k, content, manifest = F.col("o_orderkey"), F.to_json(F.struct("o_orderkey", "o_totalprice")), F.to_json(F.struct("o_orderkey", "o_orderstatus"))
    sealed = F.when(k % 4 == 0, F.lit(None)).when(k % 5 == 0, E.digest(F.lit("other"))).otherwise(E.digest(content))
    m = o.select(k.alias("run_id"), content.alias("content"), sealed.alias("content_sha256"), manifest.alias("manifest"), E.digest(manifest).alias("manifest_sha256"), F.sha2(k.cast("string"), 256).alias("scene_sha256"), F.sha2(F.when(k % 3 == 0, F.lit("x")).otherwise(k.cast("string")), 256).alias("sealed_scene_sha256"))
    return E.verify(m)


@query(f"WITH {PARTICLES} SELECT particle_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM particles WHERE particle_id % greatest(1, (SELECT count(*) FROM particles) // 200) = 0")
def particle_stride(spark: SparkSession, sf: str) -> DataFrame:
    p = particles(spark, sf)
    stride = F.broadcast(p.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 200)).alias("stride")))
    return p.crossJoin(stride).where(F.col("particle_id") % F.col("stride") == 0).select("particle_id", *r6("lat", "lon"))


@query("SELECT l_orderkey AS run_id, sum(l_quantity)::DOUBLE AS total, count(*) AS stages FROM lineitem GROUP BY 1")
def stage_duration_sum(spark: SparkSession, sf: str) -> DataFrame:
    durations = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("double")).alias("durations"))
    total = F.aggregate("durations", F.lit(0.0), lambda acc, x: acc + x)
    return durations.select(F.col("l_orderkey").alias("run_id"), total.alias("total"), F.size("durations").cast("long").alias("stages"))


@query("SELECT o_orderkey AS run_id, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recent_runs_limit(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).orderBy(F.desc("created"), "run_id").limit(20).select("run_id", "status")


@query("SELECT o_orderkey AS run_id, o_custkey AS submitted_by FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def runs_of_submitters(spark: SparkSession, sf: str) -> DataFrame:
    broke = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("submitted_by"))
    return runs(spark, sf).join(broke, "submitted_by", "left_semi").select("run_id", "submitted_by")


@query("SELECT o_orderstatus AS status, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1")
def runs_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("SELECT o_orderkey AS run_id, coalesce(max(p.p_retailprice * l_quantity), 0)::DOUBLE AS largest, count(l_orderkey) AS regions FROM orders o LEFT JOIN lineitem l ON o_orderkey = l_orderkey AND l_quantity > 30 LEFT JOIN part p ON l_partkey = p_partkey GROUP BY 1")
def region_of_runs(spark: SparkSession, sf: str) -> DataFrame:
    regions = table(spark, sf, "lineitem").where("l_quantity > 30").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    each = regions.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.max(F.col("p_retailprice") * F.col("l_quantity")).alias("largest"), F.count("*").alias("regions"))
    return runs(spark, sf).join(each, "run_id", "left").select("run_id", F.coalesce("largest", F.lit(0.0)).cast("double").alias("largest"), F.coalesce("regions", F.lit(0)).cast("long").alias("regions"))


@query("""WITH r AS (SELECT l_orderkey, to_json(list({'by': -l_quantity::DOUBLE, 'region_id': l_linenumber, 'area': l_quantity::DOUBLE} ORDER BY l_quantity DESC, l_linenumber))::VARCHAR AS regions FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey, to_json(list({'rank': l_linenumber, 'mmsi': l_suppkey, 'posterior': l_discount::DOUBLE} ORDER BY l_linenumber, l_suppkey, l_discount))::VARCHAR AS suspects FROM lineitem WHERE l_discount > 0 GROUP BY 1)
SELECT o_orderkey AS run_id, o_orderstatus AS status, regions, suspects, suspects IS NULL AS stale FROM orders LEFT JOIN r ON o_orderkey = r.l_orderkey LEFT JOIN s ON o_orderkey = s.l_orderkey""")
def dossier_nested(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("region_id"), F.col("l_quantity").cast("double").alias("area"), F.col("l_suppkey").alias("mmsi"), F.col("l_discount").cast("double").alias("posterior"))
    suspects = items.select("run_id", F.col("region_id").alias("rank"), "mmsi", "posterior").where("posterior > 0")
    return E.dossier(runs(spark, sf), items, suspects).select("run_id", "status", F.to_json("regions").alias("regions"), F.to_json("suspects").alias("suspects"), "stale")


QUERIES, ORACLE_SQL = Q, SQL
