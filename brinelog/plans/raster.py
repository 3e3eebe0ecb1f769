"""Scenes, screening and robustness."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import raster as R
from ..operators import robustness as B
from ..sources.adapters import pixels, scenarios, table
from .sql import PARAMETERS, PIXELS, SCENARIOS
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


def _hann(i: str) -> str:
    return f"greatest(1e-3::DOUBLE, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * ({i} + 1) / 9))"


TILES = f"""{PIXELS}, tiles AS (SELECT scene // 4 AS big, scene % 4 // 2 * 6 AS tile_y, scene % 2 * 6 AS tile_x, y, x, p FROM px)"""


@query(f"WITH {TILES}, w AS (SELECT *, greatest(1e-3::DOUBLE, {_hann('y')} * {_hann('x')}) AS w FROM tiles) SELECT big AS scene, (tile_y + y)::INT AS y, (tile_x + x)::INT AS x, round(sum(p * w) / greatest(sum(w), 1e-6::DOUBLE), 6) AS p FROM w GROUP BY 1, 2, 3")
def tile_blend(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("scene")
    tiles = pixels(spark, sf).select(F.floor(s / 4).alias("scene"), (F.floor(s % 4 / 2) * 6).alias("tile_y"), (s % 2 * 6).alias("tile_x"), "y", "x", "p")
    return R.blend(tiles, 8).select("scene", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *r6("p"))


VIEWS = f"{PIXELS}, views AS (SELECT scene // 5 AS big, y, x, p FROM px)"


def views(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).select(F.floor(F.col("scene") / 5).alias("scene"), "y", "x", "p")


@query(f"WITH {VIEWS} SELECT big AS scene, y, x, round(avg(p), 6) AS p, round(stddev_pop(p), 6) AS p_std FROM views GROUP BY 1, 2, 3")
def tta_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    return R.combine(views(spark, sf)).select("scene", "y", "x", *r6("p", "p_std"))


@query(f"WITH {VIEWS} SELECT big AS scene, y, x, round(max(p), 6) AS p FROM views GROUP BY 1, 2, 3")
def ensemble_max(spark: SparkSession, sf: str) -> DataFrame:
    return R.combine(views(spark, sf), "max").select("scene", "y", "x", *r6("p"))


MASK = f"{PIXELS}, mask AS (SELECT scene, y, x FROM px WHERE p > 0.55)"


def mask(spark: SparkSession, sf: str, least: float = 0.55) -> DataFrame:
    return pixels(spark, sf).where(F.col("p") > least).select("scene", "y", "x")


@query(f"WITH {MASK} SELECT scene, count(*) AS area FROM mask GROUP BY 1")
def mask_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return mask(spark, sf).groupBy("scene").agg(F.count("*").alias("area"))


MOVES = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (2, 0), (-2, 0), (0, 2), (0, -2), (1, 1), (1, -1), (-1, 1), (-1, -1)) mv(dy, dx)"
DILATED = f"{MASK}, big AS (SELECT DISTINCT scene, y + dy AS y, x + dx AS x FROM mask, {MOVES})"


@query(f"WITH {DILATED} SELECT scene, y, x FROM big EXCEPT SELECT scene, y, x FROM mask")
def mask_ring(spark: SparkSession, sf: str) -> DataFrame:
    m = mask(spark, sf)
    return R.dilate(m, 2).exceptAll(m)


@query(f"WITH {PIXELS}, a AS (SELECT scene // 2 AS s, y, x FROM px WHERE p > 0.55 AND scene % 2 = 0), b AS (SELECT scene // 2 AS s, y, x FROM px WHERE p > 0.55 AND scene % 2 = 1), u AS (SELECT * FROM a UNION SELECT * FROM b), i AS (SELECT * FROM a INTERSECT SELECT * FROM b) SELECT s AS scene, count(*) AS n_union, (SELECT count(*) FROM i WHERE i.s = u.s) AS n_both FROM u GROUP BY 1")
def mask_set_ops(spark: SparkSession, sf: str) -> DataFrame:
    m = mask(spark, sf).select(F.floor(F.col("scene") / 2).alias("s"), "y", "x", (F.col("scene") % 2).alias("side"))
    a, b = m.where("side = 0").drop("side"), m.where("side = 1").drop("side")
    both = a.intersect(b).groupBy("s").agg(F.count("*").alias("n_both"))
    return a.union(b).distinct().groupBy("s").agg(F.count("*").alias("n_union")).join(both, "s", "left").select(F.col("s").alias("scene"), "n_union", F.coalesce("n_both", F.lit(0)).cast("long").alias("n_both"))


@query(f"""WITH {PIXELS}, s AS (SELECT a.scene, sum((a.p > 0.5 AND b.p > 0.55)::INT) AS i, sum((a.p > 0.5)::INT) AS na, sum((b.p > 0.55)::INT) AS nb FROM px a JOIN px b ON a.scene + 1 = b.scene AND a.y = b.y AND a.x = b.x GROUP BY 1)
SELECT scene, round(2 * i / nullif(na + nb, 0), 6) AS dice, round(i / nullif(na + nb - i, 0), 6) AS iou, round(i / nullif(na, 0), 6) AS precision, round(i / nullif(nb, 0), 6) AS recall FROM s""")
def dice_iou(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf)
    return R.dice(p.select("scene", "y", "x", (F.col("p") > 0.5).alias("m")), p.select((F.col("scene") - 1).alias("scene"), "y", "x", (F.col("p") > 0.55).alias("m"))).select("scene", *r6("dice", "iou", "precision", "recall"))


_AT = "CASE WHEN {0} < 0 THEN -1 - ({0}) WHEN {0} > 7 THEN 15 - ({0}) ELSE {0} END"


@query(f"""WITH {PIXELS}, want AS (SELECT scene, y, x, {_AT.format('y + dy')} AS ny, {_AT.format('x + dx')} AS nx FROM px, range(-1, 2) dy(dy), range(-1, 2) dx(dx)),
c AS (SELECT a.scene, a.y, a.x, avg(b.p) AS m, sqrt(greatest(0.0::DOUBLE, avg(b.p * b.p) - avg(b.p) * avg(b.p))) AS d FROM want a JOIN px b ON a.scene = b.scene AND b.y = ny AND b.x = nx GROUP BY 1, 2, 3)
SELECT scene, round(median(d / m), 5) AS median_cv, count(*) AS n FROM c GROUP BY 1""")
def local_cv(spark: SparkSession, sf: str) -> DataFrame:
    return R.local_cv(pixels(spark, sf).select("scene", "y", "x", "p"), 1).groupBy("scene").agg(F.round(F.median("cv"), 5).alias("median_cv"), F.count("*").alias("n"))


@query(f"WITH {PIXELS}, b AS (SELECT scene, y // 4 AS py, x // 4 AS px, var_pop(p) AS v FROM px GROUP BY 1, 2, 3) SELECT scene, avg((v < 0.014)::INT) AS flat_ratio FROM b GROUP BY 1")
def patch_flat_ratio(spark: SparkSession, sf: str) -> DataFrame:
    b = pixels(spark, sf).groupBy("scene", F.floor(F.col("y") / 4), F.floor(F.col("x") / 4)).agg(F.var_pop("p").alias("v"))
    return b.groupBy("scene").agg(F.avg((F.col("v") < 0.014).cast("int")).alias("flat_ratio"))


@query(f"WITH {PIXELS} SELECT a.scene, round(corr(a.p, b.p), 5) AS corr, round(avg(a.p) - avg(b.p), 6) AS diff FROM px a JOIN px b ON a.scene + 1 = b.scene AND a.y = b.y AND a.x = b.x GROUP BY 1")
def channel_corr(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf)
    both = p.select("scene", "y", "x", "p").join(p.select((F.col("scene") - 1).alias("scene"), "y", "x", F.col("p").alias("q")), ["scene", "y", "x"])
    return both.groupBy("scene").agg(F.round(F.corr("p", "q"), 5).alias("corr"), F.round(F.avg("p") - F.avg("q"), 6).alias("diff"))


STATS = f"""{DILATED}, zoned AS (SELECT px.*, CASE WHEN m.y IS NOT NULL THEN 'inside' WHEN g.y IS NOT NULL THEN 'ring' ELSE 'outside' END AS zone FROM px LEFT JOIN mask m USING (scene, y, x) LEFT JOIN big g USING (scene, y, x)),
stats AS (SELECT scene, count(*) FILTER (WHERE zone = 'inside') AS n_in, count(*) FILTER (WHERE zone = 'ring') AS n_ring, avg(p) FILTER (WHERE zone = 'inside') AS in_mean, avg(p) FILTER (WHERE zone = 'ring') AS ring_mean,
  stddev_pop(p) FILTER (WHERE zone = 'inside') AS in_std, stddev_pop(p) FILTER (WHERE zone = 'ring') AS ring_std, quantile_cont(p, 0.9) FILTER (WHERE zone = 'inside') AS in_p90 FROM zoned GROUP BY 1)"""


def stats(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf).select("scene", "y", "x", "p")
    return R.region_statistics(R.zones(p, mask(spark, sf), 2))


@query(f"WITH {STATS} SELECT scene, n_in, n_ring, round(in_mean, 6) AS in_mean, round(ring_mean, 6) AS ring_mean, round(in_std, 6) AS in_std, round(ring_std, 6) AS ring_std, round(in_p90, 6) AS in_p90 FROM stats")
def damping_contrast(spark: SparkSession, sf: str) -> DataFrame:
    return stats(spark, sf).select("scene", "n_in", "n_ring", *r6("in_mean", "ring_mean", "in_std", "ring_std", "in_p90"))


_C = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, {}))"
_WIND = "CASE WHEN wind <= 0 THEN 0.0::DOUBLE WHEN wind < 3 THEN (wind / 3) * (wind / 3) WHEN wind <= 12 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - (wind - 12) / 8) END"
LOGIT = f"""{STATS},
feat AS (SELECT scene, CASE WHEN n_ring < greatest(32.0::DOUBLE, 0.05::DOUBLE * n_in) THEN 0.5::DOUBLE ELSE {_C.format('(ring_mean - in_mean) / ring_mean / 0.5::DOUBLE')} END AS damping,
  {_C.format('(1 - (in_std / in_mean) / (ring_std / ring_mean)) / 0.6::DOUBLE')} AS homogeneity, {_C.format('in_mean')} AS model, (scene % 22)::DOUBLE AS wind, (scene % 11) / 10.0::DOUBLE AS shape, (scene % 8) / 7.0::DOUBLE AS edge FROM stats WHERE n_in > 1 AND n_ring > 1),
sw AS (SELECT scene, {_WIND} AS w, 1.8::DOUBLE * (damping - 0.5) * 2 AS d, 1.6::DOUBLE * (edge - 0.5) * 2 AS e, 3.0::DOUBLE * (homogeneity - 0.5) * 2 AS h, 1.4::DOUBLE * (shape - 0.5) * 2 AS s, 1.4::DOUBLE * (model - 0.5) * 2 AS m FROM feat),
lo AS (SELECT scene, -1.2::DOUBLE + CASE WHEN d > 0 THEN d * w ELSE d END + CASE WHEN e > 0 THEN e * w ELSE e END + CASE WHEN h > 0 THEN h * w ELSE h END + s + m + 3.0::DOUBLE * (w - 1) * 2 AS logit FROM sw),
pr AS (SELECT scene, logit, least(0.99::DOUBLE, greatest(0.01::DOUBLE, 1 / (1 + exp(-logit)))) AS p FROM lo)"""


@query(f"WITH {LOGIT} SELECT scene, round(logit, 5) AS logit, round(p, 6) AS oil_probability, CASE WHEN p < 0.35 THEN 'probable_lookalike' WHEN p > 0.65 THEN 'probable_oil' ELSE 'ambiguous' END AS screen FROM pr")
def lookalike_logit(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("scene")
    f = R.screen_features(stats(spark, sf).where("n_in > 1 AND n_ring > 1")).withColumns({"wind": (s % 22).cast("double"), "shape": (s % 11) / 10.0, "edge": (s % 8) / 7.0})
    return R.lookalike(f).select("scene", F.round("logit", 5).alias("logit"), *r6("oil_probability"), "screen")


@query(f"SELECT event_id, round({_WIND}, 6) AS plausibility FROM (SELECT event_id, value / 5 - 1 AS wind FROM events)")
def wind_plausibility(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(geo.wind_plausibility(F.col("value") / 5 - 1), 6).alias("plausibility"))


@query(f"WITH {MASK}, a AS (SELECT scene, count(*) AS area FROM mask GROUP BY 1) SELECT scene, area FROM a WHERE area >= 10 ORDER BY area DESC, scene LIMIT 20")
def region_area_sort(spark: SparkSession, sf: str) -> DataFrame:
    return mask(spark, sf).groupBy("scene").agg(F.count("*").alias("area")).where("area >= 10").orderBy(F.desc("area"), "scene").limit(20)


@query(f"WITH {SCENARIOS}, s AS (SELECT scenario % 10 AS run_id, * FROM scn) SELECT run_id, round(avg((winner = 1)::INT), 6) AS stability, round(min(posterior), 6) AS least, round(median(posterior), 6) AS median, round(max(posterior), 6) AS most, CASE WHEN avg((winner = 1)::INT) >= 0.75 THEN 'robust' WHEN avg((winner = 1)::INT) >= 0.45 THEN 'conditional' ELSE 'fragile' END AS band FROM s GROUP BY 1")
def stability_bands(spark: SparkSession, sf: str) -> DataFrame:
    s = scenarios(spark, sf).withColumn("run_id", F.col("scenario") % 10)
    return B.stability(s, F.lit(1), "run_id").select("run_id", *r6("stability", "least", "median", "most"), "band")


@query(f"WITH {SCENARIOS} " + " UNION ALL ".join(f"SELECT '{p}' AS parameter, round(abs(avg({p}) FILTER (WHERE winner = 1) - avg({p}) FILTER (WHERE winner <> 1)), 6) AS influence FROM scn" for p in PARAMETERS))
def scenario_influence(spark: SparkSession, sf: str) -> DataFrame:
    return B.influence(scenarios(spark, sf), F.lit(1), dict.fromkeys(PARAMETERS, 1.0)).select("parameter", *r6("influence"))


@query(f"""WITH {SCENARIOS}, m AS (SELECT scenario, winner, wind_scale AS value, abs(wind_scale - 0.5) AS away FROM scn WHERE winner <> 1 AND abs(wind_scale - 0.5) > 0.02),
o AS (SELECT *, row_number() OVER (PARTITION BY round_even(value, 2) ORDER BY away, scenario) AS rn FROM m) SELECT scenario, winner, round(value, 6) AS value FROM o WHERE rn = 1 ORDER BY away, scenario LIMIT 3""")
def breaking_points_top3(spark: SparkSession, sf: str) -> DataFrame:
    return B.breaking_points(scenarios(spark, sf), F.lit(1), "wind_scale", 0.5, 1.0).select("scenario", "winner", *r6("value"))


AUDIT = f"""{SCENARIOS}, r AS (SELECT scenario % 10 AS run_id, scenario // 10 AS k, CASE WHEN winner = 0 THEN NULL ELSE winner END AS winner, CASE WHEN scenario % 9 = 0 THEN NULL WHEN posterior >= 0.6 THEN 'strong' WHEN posterior >= 0.35 THEN 'probable' ELSE 'weak' END AS verdict, posterior AS p,
  CASE WHEN scenario % 10 % 3 = 0 THEN NULL ELSE 1 END AS base FROM scn),
w AS (SELECT *, CASE WHEN base IS NULL THEN 1 - p WHEN winner IS NOT NULL AND scenario_known THEN p ELSE 0 END AS own FROM (SELECT *, k % 5 <> 0 AS scenario_known FROM r))"""


@query(f"WITH {AUDIT} SELECT run_id, count(*) AS scenarios, count(*) FILTER (verdict IS NULL) AS failed, round(avg((winner IS NOT DISTINCT FROM base)::INT), 6) AS stability, round(coalesce(avg((verdict IN ('strong', 'probable'))::INT), 0), 6) AS verdict_stability, round(coalesce(min(own) FILTER (verdict IS NOT NULL), 0), 6) AS least, round(coalesce(median(own) FILTER (verdict IS NOT NULL), 0), 6) AS median, round(coalesce(max(own) FILTER (verdict IS NOT NULL), 0), 6) AS most FROM w GROUP BY 1")
def robustness_audit(spark: SparkSession, sf: str) -> DataFrame:
    s, p, k = scenarios(spark, sf), F.col("posterior"), F.col("scenario")
    r = s.select((k % 10).alias("run_id"), F.floor(k / 10).alias("scenario"), F.when(F.col("winner") != 0, F.col("winner")).alias("winner"), F.when(k % 9 != 0, F.when(p >= 0.6, "strong").when(p >= 0.35, "probable").otherwise("weak")).alias("verdict"), "posterior")
    known = r.where("winner IS NOT NULL AND scenario % 5 <> 0").select("run_id", "scenario", F.lit(1).alias("mmsi"), "posterior")
    unknown = r.select("run_id", "scenario", F.lit(None).cast("int").alias("mmsi"), (1 - p).alias("posterior"))
    base = F.when(F.col("run_id") % 3 != 0, F.lit(1))
    own = B.baseline_posteriors(r.drop("posterior"), known.unionByName(unknown), base, "run_id")
    return B.audited(own, base, "run_id").select("run_id", "scenarios", "failed", *r6("stability", "verdict_stability", "least", "median", "most"))


QUERIES, ORACLE_SQL = Q, SQL
