"""The whole dossier of a case: a run with its attribution, regions with their drifts, suspects with their tracks, as one variant, or told value by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .documents import flattened_variants


def thinned(particles: DataFrame, most: int = 200) -> DataFrame:
    """drift_id and the particles that a map needs: every n-th by ordinal, n being the count over `most`, rounded down, at least 1."""
    counted = particles.join(particles.groupBy("drift_id").agg(F.count("*").alias("n")), "drift_id")
    kept = counted.where(F.col("ordinal") % F.greatest(F.lit(1), F.floor(F.col("n") / most)) == 0)
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "lat", "lon")))  # under twice `most` a drift
    return kept.groupBy("drift_id").agg(F.transform(ordered, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("particles"), F.first("n").alias("n_particles"))


def as_variant(of: Column) -> Column:
    return F.parse_json(F.to_json(of, {"ignoreNullFields": "false"}))


def placed_parts(regions: DataFrame, drifts: DataFrame, particles: DataFrame, suspects: DataFrame, tracks: DataFrame, hours: float, most: int) -> tuple[DataFrame, DataFrame]:
    """The regions with their last drift, and the suspects with their track; a row each, as `dossier` describes them."""
    own = [c for c in drifts.columns if c not in ("region_id", "drift_id")]
    last = drifts.groupBy("region_id").agg(F.max_by(F.struct(*drifts.columns), "drift_id").alias("d"))
    last = last.select("region_id", "d.drift_id", *[F.col(f"d.{c}").alias(f"d_{c}") for c in own])
    spans = regions.select("run_id", "region_id").join(last, "region_id").groupBy("run_id").agg(F.min("d_origin_t").alias("first"), F.max("d_origin_t").alias("last"))
    drift = F.struct(F.col("drift_id"), *[F.col(f"d_{c}").alias(c) for c in own], F.coalesce("n_particles", F.lit(0)).alias("n_particles"), F.coalesce("particles", F.array().cast("array<struct<lat:double,lon:double>>")).alias("particles"))
    met = regions.join(last.join(thinned(particles, most), "drift_id", "left"), "region_id", "left").withColumn("drift", F.when(F.col("drift_id").isNotNull(), drift))

    rest = [c for c in tracks.columns if c != "mmsi"]
    near = suspects.select("run_id", "mmsi").join(spans, "run_id").join(tracks, "mmsi").where(F.col("t").between(F.col("first") - hours * 3600, F.col("last") + hours * 3600))
    track = near.groupBy("run_id", "mmsi").agg(F.array_sort(F.collect_list(F.struct("t", *[c for c in rest if c != "t"]))).alias("track"))
    none = F.array().cast(track.schema["track"].dataType)
    return met.select(*regions.columns, "drift"), suspects.join(track, ["run_id", "mmsi"], "left").select(*suspects.columns, F.coalesce("track", none).alias("track"))


def region_fields(regions: DataFrame) -> list[str]:
    return ["region_id", *[c for c in regions.columns if c not in ("run_id", "region_id")]]


def suspect_fields(suspects: DataFrame) -> list[str]:
    return ["rank", "mmsi", *[c for c in suspects.columns if c not in ("run_id", "rank", "mmsi")]]


def dossier(runs: DataFrame, regions: DataFrame, drifts: DataFrame, particles: DataFrame, suspects: DataFrame, tracks: DataFrame, hours: float = 12.0, most: int = 200) -> DataFrame:
    """run_id, payload (a variant): run, regions (by id, each with its last drift or null), suspects (by rank, each with its track from
    `hours` before the first origin of the run to as long after the last), stale: no suspect is left although the run ranked some.

    runs: run_id, suspects_ranked and more; regions: run_id, region_id and more; drifts: region_id, drift_id, origin_t and more; particles:
    drift_id, ordinal (from 0), lat, lon; suspects: run_id, rank, mmsi and more; tracks: mmsi, t and more. Lists are as long as a run
    has regions or suspects, and a track as long as its stretch of time. Runs without any of them keep their place."""
    met, tracked = placed_parts(regions, drifts, particles, suspects, tracks, hours, most)
    by_run = met.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*region_fields(regions), "drift"))).alias("regions"))
    listed = tracked.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*suspect_fields(suspects), "track"))).alias("suspects"))

    whole = runs.join(by_run.select("run_id", "regions"), "run_id", "left").join(listed, "run_id", "left")
    empty = lambda c, of: F.coalesce(c, F.array().cast(of.schema[c].dataType)).alias(c)
    stale = (F.coalesce("suspects_ranked", F.lit(0)) > 0) & (F.coalesce(F.size("suspects"), F.lit(0)) == 0)
    payload = F.struct(F.struct(*runs.columns).alias("run"), empty("regions", by_run), empty("suspects", listed), stale.alias("stale"))
    return whole.select("run_id", as_variant(payload).alias("payload"))


def told(runs: DataFrame, regions: DataFrame, drifts: DataFrame, particles: DataFrame, suspects: DataFrame, tracks: DataFrame, hours: float = 12.0, most: int = 200) -> DataFrame:
    """run_id, path, kind, value of every scalar and empty container of the payloads of `dossier`, without a payload ever being made: the run, each
    region and each suspect is a document of its own, so no row is longer than one of these, however many a run has."""
    met, tracked = placed_parts(regions, drifts, particles, suspects, tracks, hours, most)

    def placed(rows: DataFrame, fields: list[str], name: str, last: str) -> DataFrame:
        at = F.row_number().over(Window.partitionBy("run_id").orderBy(*fields)) - 1
        own = rows.join(runs.select("run_id").distinct(), "run_id", "left_semi")
        return own.select("run_id", F.concat(F.lit(f"$.{name}["), at.cast("string"), F.lit("]")).alias("place"), as_variant(F.struct(*fields, last)).alias("v"))

    there = lambda rows, name: rows.select("run_id").distinct().withColumn(name, F.lit(True))
    known = runs.join(there(regions, "has_regions"), "run_id", "left").join(there(suspects, "has_suspects"), "run_id", "left")
    stale = (F.coalesce("suspects_ranked", F.lit(0)) > 0) & F.col("has_suspects").isNull()
    heads = known.select("run_id", F.lit("$").alias("place"), as_variant(F.struct(F.struct(*runs.columns).alias("run"), stale.alias("stale"))).alias("v"))
    hollow = [known.where(F.col(f"has_{c}").isNull()).select("run_id", F.lit(f"$.{c}").alias("place"), F.parse_json(F.lit("[]")).alias("v")) for c in ("regions", "suspects")]
    pieces = heads
    for more in (*hollow, placed(met, region_fields(regions), "regions", "drift"), placed(tracked, suspect_fields(suspects), "suspects", "track")):
        pieces = pieces.unionByName(more)
    flat = flattened_variants(pieces.select(F.struct("run_id", "place").alias("of"), "v"), "of", "v")
    return flat.select("of.run_id", F.concat("of.place", F.substring("path", 2, 1 << 30)).alias("path"), "kind", "value")
