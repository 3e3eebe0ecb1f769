"""Regions: geometry, the radar gate, look-alike features, tiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import raster as R
from ..sources.adapters import colours, outlines, scene_sizes, scenes, table
from .raster import _C, _WIND
from .sql import PIXELS, wrap
from .tracks import r6

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# The outline's measures in closed form: an L is two rectangles.
OUTLINES = """o0 AS (SELECT p_partkey AS region_id, p_partkey % 50 AS run_id, p_partkey * 37 % 1000 AS x, p_partkey * 53 % 800 AS y, 5 + p_partkey % 40 AS w, 4 + p_partkey * 7 % 30 AS h,
  p_partkey % 12 AS a, p_partkey // 3 % 14 AS b, p_partkey % 5 <> 0 AS placed, 70.0::DOUBLE + p_partkey % 10 AS lon0, 11.5::DOUBLE + p_partkey % 20 AS lat1 FROM part),
o1 AS (SELECT *, w // 2 AS w2, h // 2 AS h2 FROM o0),
o2 AS (SELECT *, w * h2 AS a1, w2 * (h - h2) AS a2, (a * a >= 100)::INT * a * a + (b * b >= 100)::INT * b * b AS hole FROM o1),
shapes AS (SELECT *, (a1 + a2 - hole)::DOUBLE AS area, 2.0::DOUBLE * (w + h) AS perimeter, trunc((a1 * (x + w / 2) + a2 * (x + w2 / 2)) / (a1 + a2))::BIGINT AS cx, trunc((a1 * (y + h2 / 2) + a2 * (y + h2 + (h - h2) / 2)) / (a1 + a2))::BIGINT AS cy,
  (2.0::DOUBLE * (w + h)) ** 2 / (4 * pi() * (a1 + a2)) AS shape FROM o2 WHERE a1 + a2 - hole >= 100)"""


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return G.measured(outlines(spark, sf))


def placed(spark: SparkSession, sf: str) -> DataFrame:
    return G.georeferenced(regions(spark, sf), F.lit(1200), F.lit(900), F.col("bbox"))


@query(f"WITH {OUTLINES} SELECT region_id, area, round(perimeter, 6) AS perimeter, cx, cy, round(shape, 4) AS shape_complexity, (a * a >= 100)::INT + (b * b >= 100)::INT AS holes FROM shapes")
def region_geometry(spark: SparkSession, sf: str) -> DataFrame:
    return regions(spark, sf).select("region_id", "area", *r6("perimeter"), "cx", "cy", F.round("shape_complexity", 4).alias("shape_complexity"), F.size("holes").alias("holes"))


def _area(points: list[tuple[str, str]]) -> str:
    """Spherical area of a ring of pixel places."""
    p = [(wrap(f"lon0 + ({x}) / 1200.0::DOUBLE * 2"), f"(lat1 - ({y}) / 900.0::DOUBLE * 1.5::DOUBLE)") for x, y in points]
    edges = " + ".join(f"radians({wrap(f'({b[0]}) - ({a[0]})')}) * (2 + sin(radians({a[1]})) + sin(radians({b[1]})))" for a, b in zip(p, p[1:] + p[:1], strict=True))
    return f"(abs({edges}) * 6371.0::DOUBLE * 6371.0::DOUBLE / 2)"


def _square(n: str, at: int) -> str:
    return f"CASE WHEN {n} * {n} >= 100 THEN " + _area([(f"x + {at}", f"y + {at}"), (f"x + {at} + {n}", f"y + {at}"), (f"x + {at} + {n}", f"y + {at} + {n}"), (f"x + {at}", f"y + {at} + {n}")]) + " ELSE 0 END"


PLACED = f"""{OUTLINES}, placed AS (SELECT *, CASE WHEN placed THEN {wrap('lon0 + cx / 1200.0::DOUBLE * 2')} END AS centroid_lon, CASE WHEN placed THEN lat1 - cy / 900.0::DOUBLE * 1.5::DOUBLE END AS centroid_lat,
  CASE WHEN placed THEN greatest(0, {_area([('x', 'y'), ('x + w', 'y'), ('x + w', 'y + h2'), ('x + w2', 'y + h2'), ('x + w2', 'y + h'), ('x', 'y + h')])} - {_square('a', 1)} - {_square('b', 2)}) END AS area_sq_km FROM shapes)"""


@query(f"WITH {PLACED} SELECT region_id, round(centroid_lon, 6) AS centroid_lon, round(centroid_lat, 6) AS centroid_lat, round(area_sq_km, 4) AS area_sq_km, placed AS is_georeferenced, 7 AS points, round(CASE WHEN placed THEN {wrap('lon0 + x / 1200.0::DOUBLE * 2')} ELSE x / 1200.0::DOUBLE END, 5) AS first_x, round(CASE WHEN placed THEN lat1 - y / 900.0::DOUBLE * 1.5::DOUBLE ELSE y / 900.0::DOUBLE END, 5) AS last_y FROM placed")
def region_to_geo(spark: SparkSession, sf: str) -> DataFrame:
    first, last = F.col("ring")[0][0], F.element_at("ring", -1)[1]
    return placed(spark, sf).select("region_id", *r6("centroid_lon", "centroid_lat"), F.round("area_sq_km", 4).alias("area_sq_km"), "is_georeferenced", F.size("ring").alias("points"), F.round(first, 5).alias("first_x"), F.round(last, 5).alias("last_y"))


_CODE = "list_value('sheen', 'rainbow', 'metallic', 'unheard of')[1 + region_id % 4]"
_KNOWN = "CASE code WHEN 'sheen' THEN {0}::DOUBLE WHEN 'metallic' THEN {2}::DOUBLE ELSE {1}::DOUBLE END"


@query(f"WITH {PLACED}, c AS (SELECT region_id, area_sq_km, {_CODE} AS code FROM placed) SELECT region_id, CASE WHEN area_sq_km > 0 AND code NOT IN ('sheen', 'metallic') THEN 'rainbow' ELSE code END AS appearance, round(coalesce(area_sq_km, 0) * {_KNOWN.format(0.04, 0.3, 5.0)}, 3) AS m3_min, round(coalesce(area_sq_km, 0) * {_KNOWN.format(0.3, 5.0, 50.0)}, 3) AS m3_max FROM c")
def region_volume(spark: SparkSession, sf: str) -> DataFrame:
    code = F.expr("array('sheen', 'rainbow', 'metallic', 'unheard of')[CAST(region_id % 4 AS INT)]")
    return placed(spark, sf).select("region_id", G.volume(F.col("area_sq_km"), code).alias("v")).select("region_id", "v.*")


@query(f"WITH {PLACED} SELECT run_id, count(*) AS regions, CASE WHEN bool_or(centroid_lat IS NULL) THEN 'georeference_gated' ELSE 'drift' END AS stage, CASE WHEN bool_or(centroid_lat IS NULL) THEN '{G.GATED}' ELSE '' END AS reason FROM placed GROUP BY 1")
def georeference_gate(spark: SparkSession, sf: str) -> DataFrame:
    return G.gate(placed(spark, sf))


SCENES = f"{PIXELS}, sc AS (SELECT scene // 25 AS scene, (scene % 25 // 5 * 8 + y)::INT AS y, (scene % 5 * 8 + x)::INT AS x, p FROM px)"


def _mirror(at: str, n: str = "40") -> str:
    return f"CASE WHEN {at} < 0 THEN -1 - ({at}) WHEN {at} >= {n} THEN 2 * {n} - 1 - ({at}) ELSE {at} END"


SPECKLE = f"""want AS (SELECT scene, y, x, {_mirror('y + dy')} AS ny, {_mirror('x + dx')} AS nx FROM grey, range(-4, 5) dy(dy), range(-4, 5) dx(dx)),
near AS (SELECT a.scene, a.y, a.x, avg(b.p) AS mean, avg(b.p * b.p) AS square FROM want a JOIN grey b ON b.scene = a.scene AND b.y = ny AND b.x = nx GROUP BY 1, 2, 3),
cvs AS (SELECT scene, CASE WHEN mean > 5.1::DOUBLE THEN sqrt(greatest(0.0::DOUBLE, square - mean * mean)) / greatest(mean, 1e-6::DOUBLE) END AS cv FROM near),
spk0 AS (SELECT scene, median(cv) AS m, avg((cv < 0.05)::INT) AS s, count(cv) AS n, count(*) AS everything FROM cvs GROUP BY 1),
speckle AS (SELECT scene, CASE WHEN n >= 64 THEN m ELSE 0 END AS median_cv, CASE WHEN n >= 64 THEN s ELSE 1 END AS smooth_fraction, CASE WHEN n >= 64 THEN n / everything ELSE 0 END AS valid_fraction FROM spk0)"""


@query(f"WITH {SCENES}, grey AS (SELECT scene, y, x, CASE WHEN scene % 3 = 0 THEN p * 12 WHEN scene % 3 = 1 AND y < 20 THEN 100 ELSE p * 255 END AS p FROM sc), {SPECKLE} SELECT scene, round(median_cv, 5) AS median_cv, round(smooth_fraction, 6) AS smooth_fraction, round(valid_fraction, 6) AS valid_fraction FROM speckle")
def speckle_statistics(spark: SparkSession, sf: str) -> DataFrame:
    s, p = F.col("scene"), F.col("p")
    grey = scenes(spark, sf).withColumn("p", F.when(s % 3 == 0, p * 12).when((s % 3 == 1) & (F.col("y") < 20), F.lit(100.0)).otherwise(p * 255))
    return R.speckle(grey, sizes=scene_sizes(spark, sf)).select("scene", F.round("median_cv", 5).alias("median_cv"), *r6("smooth_fraction", "valid_fraction"))


COLOURS = f"""{SCENES}, c0 AS (SELECT scene, y, x, floor(p * 255) AS grey0, floor(255 * (p * 0.3::DOUBLE + 0.7::DOUBLE * ((x * 7 + y * 13) % 32) / 32)) AS other, 40 + 20 * (x // 20) AS block FROM sc),
colours AS (SELECT scene, y, x, (CASE scene % 4 WHEN 0 THEN grey0 WHEN 1 THEN grey0 WHEN 2 THEN block ELSE 90 END)::DOUBLE AS r, (CASE scene % 4 WHEN 0 THEN grey0 WHEN 1 THEN other WHEN 2 THEN block ELSE 90 END)::DOUBLE AS g, (CASE scene % 4 WHEN 0 THEN grey0 WHEN 1 THEN grey0 WHEN 2 THEN block ELSE 120 END)::DOUBLE AS b FROM c0),
grey AS (SELECT scene, y, x, (r + g + b) / 3 AS p FROM colours)"""
GATE = f"""{COLOURS}, {SPECKLE},
ch AS (SELECT scene, (stddev_pop(r) <= 1)::INT + (stddev_pop(g) <= 1)::INT + (stddev_pop(b) <= 1)::INT AS flat, greatest(abs(avg(r) - avg(g)), abs(avg(g) - avg(b)), abs(avg(r) - avg(b))) AS apart, least(corr(r, g), corr(g, b), corr(r, b)) AS least_corr FROM colours GROUP BY 1),
agree AS (SELECT scene, CASE WHEN flat = 3 THEN CASE WHEN apart > 5 THEN 0 ELSE 1 END WHEN flat > 0 THEN 0 ELSE least_corr END AS min_corr FROM ch),
patches AS (SELECT scene, y // 16 AS py, x // 16 AS px, (var_pop(p) < 0.5)::INT AS flat FROM grey WHERE y // 16 * 16 < 24 AND x // 16 * 16 < 24 GROUP BY 1, 2, 3),
blocks AS (SELECT scene, avg(flat) AS flat_ratio FROM patches GROUP BY 1),
signals AS (SELECT *, min_corr < 0.98 AS apart, min_corr < 0.85 AS strongly, flat_ratio > 0.3 AS flat, flat_ratio > 0.5 AS mostly, median_cv < 0.18 AND smooth_fraction > 0.15 AS bare FROM agree JOIN blocks USING (scene) JOIN speckle USING (scene)),
gated AS (SELECT *, NOT (strongly OR (apart AND flat) OR mostly OR bare) AS valid FROM signals)"""


@query(f"""WITH {GATE} SELECT scene, round(min_corr, 4) AS min_corr, round(flat_ratio, 6) AS flat_ratio, valid, CASE WHEN valid THEN 'passed' ELSE concat_ws('; ', CASE WHEN apart THEN printf('channels disagree (%.3f)', min_corr) END,
  CASE WHEN flat THEN printf('flat blocks (%.1f%%)', flat_ratio * 100) END, CASE WHEN bare THEN printf('no speckle (%.3f, %.0f%% smooth)', median_cv, smooth_fraction * 100) END) END AS reason FROM gated""")
def radar_gate(spark: SparkSession, sf: str) -> DataFrame:
    return R.radar_gate(colours(spark, sf), scene_sizes(spark, sf)).select("scene", F.round("min_corr", 4).alias("min_corr"), *r6("flat_ratio"), "valid", "reason")


_BLOB = "abs(y - 16) + abs(x - 14) <= 5 + scene % 4"
_SHAPE = "CASE WHEN scene % 6 <> 0 THEN 1 + (scene % 5) * 0.9{d} END AS shape_complexity, CASE WHEN scene % 7 <> 0 THEN (scene % 11) * 2.0{d} - 1 END AS wind"
FEATURES = f"""{SCENES}, pic AS (SELECT scene, y, x, CASE WHEN {_BLOB} THEN 0.35::DOUBLE + 0.2::DOUBLE * p ELSE p END AS p, CASE WHEN scene % 5 <> 4 THEN 1 - p END AS prob, {_BLOB} AS is_in FROM sc),
blob AS (SELECT scene, y, x FROM pic WHERE is_in),
away AS (SELECT a.scene, a.y, a.x, min(abs(a.y - b.y) + abs(a.x - b.x)) AS away FROM pic a JOIN blob b USING (scene) GROUP BY 1, 2, 3),
deep AS (SELECT a.scene, a.y, a.x, least(min(abs(a.y - b.y) + abs(a.x - b.x)), a.y + 1, a.x + 1, 40 - a.y, 40 - a.x) AS deep FROM blob a JOIN pic b ON a.scene = b.scene AND NOT b.is_in GROUP BY 1, 2, 3),
slopes AS (SELECT *, sqrt(dx * dx + dy * dy) AS slope FROM (SELECT *, CASE WHEN l IS NULL THEN n - p WHEN n IS NULL THEN p - l ELSE (n - l) / 2 END AS dx, CASE WHEN u IS NULL THEN d - p WHEN d IS NULL THEN p - u ELSE (d - u) / 2 END AS dy
  FROM (SELECT *, lag(p) OVER (PARTITION BY scene, y ORDER BY x) AS l, lead(p) OVER (PARTITION BY scene, y ORDER BY x) AS n, lag(p) OVER (PARTITION BY scene, x ORDER BY y) AS u, lead(p) OVER (PARTITION BY scene, x ORDER BY y) AS d FROM pic))),
pixel AS (SELECT s.*, away, is_in AS own, NOT is_in AND away <= 25 AS ring, away <= 2 AND coalesce(deep, 0) <= 2 AS near_edge FROM slopes s JOIN away USING (scene, y, x) LEFT JOIN deep USING (scene, y, x)),
zone AS (SELECT scene, count(*) FILTER (own) AS n_in, count(*) FILTER (ring) AS n_ring, avg(p) FILTER (own) AS im, avg(p) FILTER (ring) AS rm, stddev_pop(p) FILTER (own) AS isd, stddev_pop(p) FILTER (ring) AS rsd,
  avg(slope) FILTER (near_edge) AS es, avg(slope) AS ss, avg(prob) FILTER (own) AS prob FROM pixel GROUP BY 1),
shp AS (SELECT DISTINCT scene, {_SHAPE.format(d='::DOUBLE')} FROM sc),
feat AS (SELECT scene, n_in, n_ring, wind, {_C.format('(rm - im) / rm / 0.5::DOUBLE')} AS damping, {_C.format('es / (ss + 1e-6::DOUBLE) / 3')} AS edge, {_C.format('(1 - (isd / im) / (rsd / rm)) / 0.6::DOUBLE')} AS homogeneity,
  coalesce({_C.format('(shape_complexity - 1) / 3')}, 0.5) AS shape, coalesce(prob, 0.5) AS model FROM zone JOIN shp USING (scene))"""
FEATURES = FEATURES.replace("coalesce(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (shape_complexity - 1) / 3)), 0.5)", "CASE WHEN shape_complexity IS NULL THEN 0.5 ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (shape_complexity - 1) / 3)) END")
SCORED = f"""{FEATURES}, sw AS (SELECT *, CASE WHEN wind IS NULL THEN 0.5 ELSE {_WIND} END AS w, 1.8::DOUBLE * (damping - 0.5) * 2 AS d, 1.6::DOUBLE * (edge - 0.5) * 2 AS e, 3.0::DOUBLE * (homogeneity - 0.5) * 2 AS h, 1.4::DOUBLE * (shape - 0.5) * 2 AS s, 1.4::DOUBLE * (model - 0.5) * 2 AS m FROM feat),
held AS (SELECT *, CASE WHEN d > 0 THEN d * w ELSE d END AS hd, CASE WHEN e > 0 THEN e * w ELSE e END AS he, CASE WHEN h > 0 THEN h * w ELSE h END AS hh, CASE WHEN wind IS NULL THEN 0 ELSE 3.0::DOUBLE * (w - 1) * 2 END AS hw FROM sw),
lo AS (SELECT *, -1.2::DOUBLE + hd + he + hh + s + m + hw AS logit FROM held),
scored AS (SELECT *, least(0.99::DOUBLE, greatest(0.01::DOUBLE, 1 / (1 + exp(-logit)))) AS op FROM lo),
parts AS (SELECT scene, unnest(['damping', 'edge', 'homogeneity', 'model', 'shape', 'wind']) AS name, unnest([hd, he, hh, m, s, hw]) AS value FROM held)"""


def features(spark: SparkSession, sf: str) -> DataFrame:
    own, p = F.expr(_BLOB), F.col("p")
    sc = scenes(spark, sf)
    pic = sc.select("scene", "y", "x", F.when(own, 0.35 + 0.2 * p).otherwise(p).alias("p"), F.when(F.col("scene") % 5 != 4, 1 - p).alias("prob"))
    shapes = sc.select("scene").distinct().selectExpr("scene", *_SHAPE.format(d="D").split(", CASE")[:1], "CASE" + _SHAPE.format(d="D").split(", CASE")[1])
    return R.region_features(pic, sc.where(own), shapes, sizes=scene_sizes(spark, sf))


def contributions(spark: SparkSession, sf: str) -> DataFrame:
    scored = R.lookalike(features(spark, sf))
    parts = {k: F.col(f"c_{k}") for k in ("damping", "edge", "homogeneity", "shape", "model", "wind")} | {"bias": F.lit(R.BIAS)}
    return scored.withColumn("parts", F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]))


@query(f"WITH {FEATURES} SELECT scene, n_in, n_ring, round(damping, 5) AS damping, round(edge, 5) AS edge, round(homogeneity, 5) AS homogeneity, round(shape, 5) AS shape, round(model, 5) AS model FROM feat")
def region_features(spark: SparkSession, sf: str) -> DataFrame:
    return features(spark, sf).select("scene", "n_in", "n_ring", *[F.round(c, 5).alias(c) for c in ("damping", "edge", "homogeneity", "shape", "model")])


@query(f"WITH {SCORED} SELECT s.scene, round(logit, 4) AS logit, round(logit, 4) AS total, round(op, 5) AS oil_probability, CASE WHEN op < 0.35 THEN 'probable_lookalike' WHEN op > 0.65 THEN 'probable_oil' ELSE 'ambiguous' END AS screen, (SELECT max_by(name, value) FROM parts p WHERE p.scene = s.scene) AS for_oil, (SELECT min_by(name, value) FROM parts p WHERE p.scene = s.scene) AS against FROM scored s")
def lookalike_evidence(spark: SparkSession, sf: str) -> DataFrame:
    total = F.aggregate(F.map_values("parts"), F.lit(0.0), lambda acc, x: acc + x)
    return contributions(spark, sf).select("scene", F.round("logit", 4).alias("logit"), F.round(total, 4).alias("total"), F.round("oil_probability", 5).alias("oil_probability"), "screen", R.strongest(F.col("parts")).alias("s")).select("scene", "logit", "total", "oil_probability", "screen", "s.*")


@query(f"WITH {SCORED}, every AS (SELECT * FROM parts UNION ALL SELECT scene, 'bias', -1.2::DOUBLE FROM held) SELECT scene, string_agg(name, ' ' ORDER BY abs(value) DESC, name) AS ordered FROM every GROUP BY 1")
def contributions_by_size(spark: SparkSession, sf: str) -> DataFrame:
    names = F.transform(R.evidence_order(F.col("parts")), lambda e: e["name"])
    return contributions(spark, sf).select("scene", F.array_join(names, " ").alias("ordered"))


_STATE = "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 20)::BIGINT END"


@query(f"WITH {SCORED}, r AS (SELECT p_partkey AS region_id, {_STATE} AS scene FROM part) SELECT region_id, round(coalesce(op, 0.5), 5) AS oil_probability, CASE WHEN op IS NULL THEN 'ambiguous' WHEN op < 0.35 THEN 'probable_lookalike' WHEN op > 0.65 THEN 'probable_oil' ELSE 'ambiguous' END AS screen FROM r LEFT JOIN scored s ON r.scene = s.scene")
def regions_assessed(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    r = table(spark, sf, "part").select(k.alias("region_id"), F.when(k % 3 != 0, k % 20).cast("long").alias("scene"))
    return R.assessed(r, R.lookalike(features(spark, sf)).select("scene", "oil_probability", "screen")).select("region_id", F.round("oil_probability", 5).alias("oil_probability"), "screen")


@query(f"WITH {SCORED} SELECT scene % 4 AS run_id, count(*) FILTER (op >= 0.35) AS kept, count(*) FILTER (op < 0.35) AS rejected FROM scored GROUP BY 1")
def lookalikes_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return R.rejected(R.lookalike(features(spark, sf)).withColumn("run_id", F.col("scene") % 4), "run_id")


@query(f"""WITH {SCENES}, m AS (SELECT scene, min(p) AS low, max(p) AS high FROM sc GROUP BY 1), f AS (SELECT scene, y, x, floor((p - low) / (high - low) * 255)::INT AS vv, floor((floor(p * 65535)) / 256)::INT AS vh FROM sc JOIN m USING (scene))
SELECT scene, y, x, vv, vh, floor(greatest(0, least(255, (vh + 1e-5::DOUBLE) / (vv + 1e-5::DOUBLE) * 128)))::INT AS ratio FROM f""")
def raster_normalise(spark: SparkSession, sf: str) -> DataFrame:
    sc = scenes(spark, sf).select("scene", "y", "x", F.col("p").alias("vv"), F.floor(F.col("p") * 65535).alias("vh"))
    return R.to_bytes(R.to_bytes(sc, "vv", "float"), "vh", "uint16").select("scene", "y", "x", "vv", "vh", R.ratio_band(F.col("vv"), F.col("vh")).alias("ratio"))


@query(f"WITH {COLOURS} SELECT scene, y, x, round((r / 255 - 0.485::DOUBLE) / 0.229::DOUBLE, 5) AS r, round((g / 255 - 0.456::DOUBLE) / 0.224::DOUBLE, 5) AS g, round((b / 255 - 0.406::DOUBLE) / 0.225::DOUBLE, 5) AS b FROM colours")
def tile_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return R.normalised(colours(spark, sf), "imagenet").select("scene", "y", "x", *[F.round(c, 5).alias(c) for c in "rgb"])


# 40 pixels, tiles of 16 every 12: padded to 48, tiles at 0, 12, 24; 32 + 16 = 48 isn't reached by the stride
TILED = f"""{SCENES}, big AS (SELECT scene, y, x, p FROM sc UNION ALL SELECT scene, 78 - y, x, p FROM sc WHERE 78 - y BETWEEN 40 AND 47 UNION ALL SELECT scene, y, 78 - x, p FROM sc WHERE 78 - x BETWEEN 40 AND 47 UNION ALL SELECT scene, 78 - y, 78 - x, p FROM sc WHERE 78 - y BETWEEN 40 AND 47 AND 78 - x BETWEEN 40 AND 47),
tl AS (SELECT scene, ty.t AS tile_y, tx.t AS tile_x, y - ty.t AS y, x - tx.t AS x, p FROM big JOIN range(0, 33, 12) ty(t) ON y BETWEEN ty.t AND ty.t + 15 JOIN range(0, 33, 12) tx(t) ON x BETWEEN tx.t AND tx.t + 15)"""


@query(f"WITH {TILED} SELECT scene, tile_y, tile_x, count(*) AS n, round(sum(p * (y * 16 + x)), 3) AS mark FROM tl GROUP BY 1, 2, 3")
def tile_split(spark: SparkSession, sf: str) -> DataFrame:
    return R.tiled(scenes(spark, sf), 16, 12, scene_sizes(spark, sf)).groupBy("scene", "tile_y", "tile_x").agg(F.count("*").alias("n"), F.round(F.sum(F.col("p") * (F.col("y") * 16 + F.col("x"))), 3).alias("mark"))


@query(f"WITH {TILED}, v AS (SELECT scene, tile_y, tile_x, view, CASE WHEN view % 2 = 1 THEN 15 - y ELSE y END AS y, CASE WHEN view >= 2 THEN 15 - x ELSE x END AS x, p FROM tl, range(4) vw(view)) SELECT scene, view::INT AS view, count(*) AS n, round(sum(p * (y * 16 + x)), 2) AS mark FROM v GROUP BY 1, 2")
def tile_views(spark: SparkSession, sf: str) -> DataFrame:
    v = R.flipped(R.tiled(scenes(spark, sf), 16, 12, scene_sizes(spark, sf)), 16)
    return v.groupBy("scene", "view").agg(F.count("*").alias("n"), F.round(F.sum(F.col("p") * (F.col("y") * 16 + F.col("x"))), 2).alias("mark"))


@query(f"WITH {SCENES}, want AS (SELECT scene, y, x, {_mirror('y + dy')} AS ny, {_mirror('x + dx')} AS nx FROM sc, range(-1, 2) dy(dy), range(-1, 2) dx(dx)) SELECT a.scene, a.y, a.x, round(median(b.p), 6) AS p FROM want a JOIN sc b ON b.scene = a.scene AND b.y = ny AND b.x = nx GROUP BY 1, 2, 3")
def median_purified(spark: SparkSession, sf: str) -> DataFrame:
    return R.median_filter(scenes(spark, sf), 3, scene_sizes(spark, sf)).select("scene", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *r6("p"))


_ROWS = "vec_id AS scene, label % 3 <> 0 AS has_slick, abs(embedding[1])::DOUBLE AS dice, abs(embedding[2])::DOUBLE AS precision, abs(embedding[3])::DOUBLE AS recall, greatest(0, embedding[4]::DOUBLE - 0.1::DOUBLE) AS found_share"


@query(f"WITH r AS (SELECT {_ROWS} FROM embeddings) SELECT round(avg(dice) FILTER (has_slick), 6) AS dice, round(avg(precision) FILTER (has_slick), 6) AS precision, round(avg(recall) FILTER (has_slick), 6) AS recall, round(coalesce(avg(found_share) FILTER (NOT has_slick), 0), 6) AS clean_found, count(*) FILTER (NOT has_slick AND found_share > 0.001) AS clean_alerts, count(*) FILTER (NOT has_slick) AS n_clean FROM r")
def suite_means(spark: SparkSession, sf: str) -> DataFrame:
    e = lambda k: F.element_at("embedding", k).cast("double")
    rows = table(spark, sf, "embeddings").select((F.col("label") % 3 != 0).alias("has_slick"), F.abs(e(1)).alias("dice"), F.abs(e(2)).alias("precision"), F.abs(e(3)).alias("recall"), F.greatest(F.lit(0.0), e(4) - 0.1).alias("found_share"))
    return R.suite_means(rows).select(*r6("dice", "precision", "recall", "clean_found"), "clean_alerts", "n_clean")


QUERIES, ORACLE_SQL = Q, SQL
