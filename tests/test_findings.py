"""What reviews found, on tables small enough to tell why."""

import numpy as np
from pyspark.sql import functions as F

from brinelog.operators import documents as D
from brinelog.operators import raster as R
from brinelog.operators import robustness
from brinelog.operators import tracks as T
from brinelog.plans import cases
from brinelog.sources.written import saved


def test_of_equal_contributions_the_first_name_counts(spark):
    row = spark.range(1).select(R.strongest(F.create_map(*[F.lit(x) for x in ("shape", 0.0, "homogeneity", 0.0, "damping", -1.0, "wind", -2.0, "edge", -2.0, "bias", 3.0)])).alias("s")).first().s
    assert (row.for_oil, row.against) == ("homogeneity", "edge")


def part_of_a_scene(spark):
    """A scene of 6 x 6 of which only the first two rows and the beginning of the third are there."""
    pixels = {(y, x): float((y * 7 + x * 5) % 11) for y in range(6) for x in range(6) if y < 2 or (y == 2 and x < 3)}
    scene = spark.createDataFrame([(0, y, x, p) for (y, x), p in pixels.items()], "scene long, y int, x int, p double")
    return pixels, scene, spark.createDataFrame([(0, 6, 6)], "scene long, height int, width int")


def test_medians_of_a_scene_that_lacks_pixels(spark):
    pixels, scene, sizes = part_of_a_scene(spark)
    mirror = lambda i: -1 - i if i < 0 else 11 - i if i > 5 else i
    want = {(y, x): float(np.median([pixels[at] for b in (-1, 0, 1) for a in (-1, 0, 1) if (at := (mirror(y + b), mirror(x + a))) in pixels])) for y, x in pixels}
    assert {(r.y, r.x): r.p for r in R.median_filter(scene, 3, sizes).collect()} == want


def test_window_means_of_a_scene_that_lacks_pixels(spark):
    pixels, scene, sizes = part_of_a_scene(spark)
    mirror = lambda i: -1 - i if i < 0 else 11 - i if i > 5 else i
    near = lambda y, x: [pixels[at] for b in (-1, 0, 1) for a in (-1, 0, 1) if (at := (mirror(y + b), mirror(x + a))) in pixels]
    found = {(r.y, r.x): r.p for r in R.window_means(scene, ["p"], 3, sizes).collect()}
    assert found.keys() == pixels.keys() and all(abs(found[at] - np.mean(near(*at))) < 1e-12 for at in pixels)


def test_distances_reach_across_pixels_that_lack(spark):
    pixels, scene, sizes = part_of_a_scene(spark)
    marked = R.filled(scene.withColumn("m", (F.col("y") == 2) & (F.col("x") == 2)), sizes)
    found = {(r.y, r.x): r.away for r in R.distances(marked, "m", "away").where("there").collect()}
    assert found == {(y, x): abs(y - 2) + abs(x - 2) for y, x in pixels}


def test_patches_and_tiles_of_a_scene_that_lacks_pixels(spark):
    _, scene, sizes = part_of_a_scene(spark)
    flat = R.flat_patches(scene.withColumn("p", F.lit(1.0)), 2, sizes=sizes).first()
    assert flat.flat_ratio == 1.0
    tiles = {(r.tile_y, r.tile_x): r["count"] for r in R.tiled(scene, 4, 2, sizes).groupBy("tile_y", "tile_x").count().collect()}
    assert tiles == {(0, 0): 11, (0, 2): 9, (2, 0): 3, (2, 2): 1}


def test_many_vessels_of_one_moment_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(T, "DEALT", 4)
    places = spark.createDataFrame([(m, 0.0, float(m)) for m in range(50)] + [(7, 1.0, 0.5)], "mmsi long, moment double, lat double")
    moments = spark.createDataFrame([(0.0, i) for i in range(3)] + [(1.0, 9), (2.0, 8)], "moment double, m_i int")
    found = sorted((r.mmsi, r.moment, r.m_i) for r in T.paired(places, moments, ["moment"]).collect())
    assert found == sorted([(m, 0.0, i) for m in range(50) for i in range(3)] + [(7, 1.0, 9)])


def test_a_vessel_is_placed_once_for_moments_of_one_time(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(T, "saved", lambda df, label: written.setdefault(label, saved(df, label)))
    track = spark.createDataFrame([(1, i, 600.0 * i, 10.0 + 0.001 * i, 20.0, 5.0) for i in range(7)], "mmsi long, ordinal long, t double, lat double, lon double, speed double")
    cloud = spark.createDataFrame([(i, 900.0, 10.0 + 1e-4 * i, 20.0) for i in range(40)], "particle_id long, t double, lat double, lon double")
    assert T.near_moments(T.segments(track), track, cloud, 50.0).count() == 40
    assert written["places"].count() == 1


def test_joins_by_document_are_no_broadcasts(spark):
    docs = spark.createDataFrame([(1, '{"a": [1, {"b": null}]}'), (2, "x"), (3, '{"c": {}}')], "k long, told string")
    for out in (D.flattened(docs, "k", "told"), D.canonical(docs, "told")):
        assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in str(out.collect() and out._jdf.queryExecution().executedPlan().toString())


def test_scenarios_of_many_runs_are_many_tasks_and_none_sorts_them(spark):
    made = robustness.sampled(spark.range(400).select(F.col("id").alias("run")), "run")
    assert "Window" not in (plan := made._jdf.queryExecution().executedPlan().toString()) and "Sort " not in plan
    shares = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 400 * 32 and max(shares) < 200 * 32


def test_files_are_read_by_many_tasks_and_met_without_a_broadcast(spark, tmp_path):
    spark.range(300).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    shares = [r["count"] for r in cases.tiffs(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 300 and max(shares) < 150
    assert "Broadcast" not in cases.raster_pixels(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_flattening_joins_nothing_and_sends_no_short_number_to_python(spark):
    docs = spark.createDataFrame([(1, '{"a": [null], "b": [], "c": {}, "d": [[], {"x": 0.1}], "e": -0.5e-7}'), (2, "[1, true]"), (3, "[1")], "k long, told string")
    out = D.flattened(docs, "k", "told")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan
    want = [(1, "$.a[0]", "null", "null"), (1, "$.b", "array", "[]"), (1, "$.c", "object", "{}"), (1, "$.d[0]", "array", "[]"), (1, "$.d[1].x", "number", '"0.1"'), (1, "$.e", "number", '"-5e-08"')]
    assert sorted(map(tuple, out.collect())) == [*want, (2, "$[0]", "number", '"1"'), (2, "$[1]", "boolean", "true")]
    more = D.flattened(spark.createDataFrame([("a", "[0.12345678901234567, 7]")], "k string, told string"), "k", "told")
    assert sorted(map(tuple, more.collect())) == [("a", "$[0]", "number", '"0.123456789012"'), ("a", "$[1]", "number", '"7"')]


def test_places_are_rounded_once_and_few_bytes_of_many_pairs_are_many_tasks(spark):
    track = spark.createDataFrame([(m, i, 600.0 * i, 10.0 + m / 3 + i / 7, 20.0 + m / 7, 5.0) for m in range(60) for i in range(4)], "mmsi long, ordinal long, t double, lat double, lon double, speed double")
    moments = spark.createDataFrame([(60.0 * (i % 30), i) for i in range(300)], "t double, k long")
    found = T.interpolate(track, moments, digits=6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan.split("Join")[0]
    pids = {r.p for r in found.select(F.spark_partition_id().alias("p")).distinct().collect()}
    assert len(pids) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = T.interpolate(track, moments)
    assert sorted(map(tuple, found.collect())) == sorted((r.mmsi, r.moment, r.m_k, r.lat, r.lon) for r in plain.withColumns({c: F.round(c, 6) for c in ("lat", "lon")}).collect())
