"""The given tables in the engine's own schemas: positions, particles, hourly fields, pixels, scenarios, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T0 = 1704067200.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frac(x):
    return x - F.floor(x)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mmsi, ordinal, t (epoch seconds), lat, lon, speed: events as position reports, time run sixty times as fast."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    t = F.lit(T0) + (F.unix_micros("ts") / F.lit(1e6) - T0) / 60
    hours = (F.col("t") - T0) / 3600
    mmsi, n = F.col("user_id"), F.col("event_id")
    lat = F.when(mmsi % 5 == 0, F.lit(0.0)).when(mmsi % 7 == 0, ((n * 37) % 400) / 200).otherwise(((mmsi % 11) - 5) * 0.02 * hours)
    lon = F.when(mmsi % 5 == 0, F.lit(0.0)).when(mmsi % 7 == 0, ((n * 53) % 400) / 200).otherwise(((mmsi % 13) - 6) * 0.02 * hours)
    return e.withColumn("t", t).select(
        mmsi.alias("mmsi"), n.alias("ordinal"), "t", (18.5 + (mmsi % 20) * 0.05 + lat).alias("lat"), (71.5 + (mmsi % 17) * 0.05 + lon).alias("lon"),
        (F.col("value") - 30 * F.floor(F.col("value") / 30)).alias("speed"),
    )


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """particle_id, lat, lon, t: one release hypothesis for each vector, evenly spread over a box and a day's half."""
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        i.alias("particle_id"), (18.8 + 0.4 * frac(i * 0.6180339887)).alias("lat"), (71.8 + 0.4 * frac(i * 0.7548776662)).alias("lon"), (T0 + 3600.0 * (i % 12)).alias("t")
    )


def hourly_fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(hour, wind, wind_from) from views, (hour, current, current_to) from clicks."""
    e = table(spark, sf_dir, "events").withColumn("hour", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3600e6)).cast("long"))
    side = lambda kind, speed, angle: e.where(F.col("event_type") == kind).groupBy("hour").agg(F.avg("value").alias(speed), (F.sum(F.col("event_id") % 360) % 360).cast("double").alias(angle))
    return side("view", "wind", "wind_from"), side("click", "current", "current_to")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, y, x, p: each vector as an 8 x 8 tile with values moved into 0..1."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scene"), "label", F.posexplode("embedding").alias("k", "v"))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.col("v").cast("double")))
    return e.select("scene", "label", F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("k") % 8).alias("x"), p.alias("p"))


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scenario, five parameters in 0..1, winner, posterior: each vector as the result of one scenario."""
    v = lambda k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.element_at("embedding", k).cast("double")))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("scenario"), *[v(k + 1).alias(n) for k, n in enumerate(("duration_scale", "windage_mean", "deflection_deg", "wind_scale", "current_scale"))],
        (F.col("label") % 3).alias("winner"), v(7).alias("posterior"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, status, created, submitted_by: orders as pipeline runs."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("created"), F.col("o_custkey").alias("submitted_by"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, y, x, p: 25 tiles of 8 x 8 pixels side by side, as one scene of 40 x 40."""
    i = F.col("scene")
    return pixels(spark, sf_dir).select(F.floor(i / 25).alias("scene"), (F.floor(i % 25 / 5) * 8 + F.col("y")).cast("int").alias("y"), (i % 5 * 8 + F.col("x")).cast("int").alias("x"), "p")


def scene_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, height, width of `scenes`: 40 x 40, whether or not there are vectors for all 25 tiles."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 25).alias("scene")).distinct()
    return e.select("scene", F.lit(40).alias("height"), F.lit(40).alias("width"))


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id, run_id, ring, holes, bbox: each part as an L-shaped outline in a picture of 1200 x 900, every fifth without a place."""
    k = F.col("p_partkey")
    x, y, w, h = k * 37 % 1000, k * 53 % 800, 5 + k % 40, 4 + k * 7 % 30
    p = lambda a, b: F.array(a.cast("double"), b.cast("double"))
    half = lambda n: F.floor(n / 2)
    ring = F.array(p(x, y), p(x + w, y), p(x + w, y + half(h)), p(x + half(w), y + half(h)), p(x + half(w), y + h), p(x, y + h))
    square = lambda n, at: F.array(p(x + at, y + at), p(x + at + n, y + at), p(x + at + n, y + at + n), p(x + at, y + at + n))
    box = F.struct((70.0 + k % 10).alias("min_lon"), (10.0 + k % 20).alias("min_lat"), (72.0 + k % 10).alias("max_lon"), (11.5 + k % 20).alias("max_lat"))
    part = table(spark, sf_dir, "part")
    return part.select(k.alias("region_id"), (k % 50).alias("run_id"), ring.alias("ring"), F.array(square(k % 12, 1), square(F.floor(k / 3) % 14, 2)).alias("holes"), F.when(k % 5 != 0, box).alias("bbox"))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, y, x, r, g, b in 0..255: scenes whose channels agree, disagree, lie in flat blocks, or are one colour, by turns."""
    s, grey = F.col("scene"), F.floor(F.col("p") * 255)
    other = F.floor(255 * (F.col("p") * 0.3 + 0.7 * ((F.col("x") * 7 + F.col("y") * 13) % 32) / 32))
    block = F.lit(40) + 20 * F.floor(F.col("x") / 20)
    kind = lambda a, b, c, d: F.when(s % 4 == 0, a).when(s % 4 == 1, b).when(s % 4 == 2, c).otherwise(d).cast("double")
    return scenes(spark, sf_dir).select("scene", "y", "x", kind(grey, grey, block, F.lit(90)).alias("r"), kind(grey, other, block, F.lit(90)).alias("g"), kind(grey, grey, block, F.lit(120)).alias("b"))
