"""Attribution of a release to vessels: soft capture, posterior with an unknown source, ranks, verdicts; the older weighted score."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, verdict
from ..session import spread
from ..sources.written import saved
from . import tracks
from .sums import near_sums

DEALT, CHUNK = 1 << 14, 1 << 17

def origin(particles: DataFrame) -> DataFrame:
    """One row: mean place, number, time of the middle particle, and root mean square distance to the mean place."""
    mean = particles.agg(F.avg("lat").alias("o_lat"), F.avg("lon").alias("o_lon"), F.count("*").alias("n"), F.avg("t").alias("o_t"))
    far = particles.crossJoin(F.broadcast(mean)).agg(F.sqrt(F.avg(F.pow(haversine_km(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")), 2))).alias("spread_km"))
    return mean.crossJoin(F.broadcast(far))


def soft_capture(track: DataFrame, particles: DataFrame, radius_km: float, segs: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """mmsi (and by), weight, captured: Gaussian weights of the particles within 1.5 radii of the vessel at their release time.

    Vessels and particles of one time and cell (and by) are dealt out, DEALT vessels and CHUNK particles or so at a time; a task sums up
    what each of its vessels meets (`near_sums`), so pairs are neither written nor made one by one."""
    by, sigma = by or [], radius_km / 2
    places, own = tracks.placed_near(segs or tracks.segments(track), track, particles, 3 * sigma)
    own = own.select(*tracks.SPOTS, *[F.col(f"m_{c}").alias(f"by_{c}") for c in by], F.col("m_lat").alias("p_lat"), F.col("m_lon").alias("p_lon"))
    groups = [*tracks.SPOTS, *[f"by_{c}" for c in by]]
    deals = places.groupBy(*tracks.SPOTS).agg(F.ceil(F.count("*") / DEALT).alias("deals"))
    chunks = own.groupBy(*groups).agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    sizes = saved(chunks.join(deals, tracks.SPOTS), "sizes")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    vessels = places.join(sizes, tracks.SPOTS).select(*groups, F.pmod(F.xxhash64("mmsi"), F.col("deals")).alias("deal"), each("chunks").alias("chunk"), "mmsi", "lat", "lon")
    cloud = own.join(sizes, groups).select(*groups, each("deals").alias("deal"), F.pmod(F.xxhash64("p_lat", "p_lon"), F.col("chunks")).alias("chunk"), "p_lat", "p_lon")

    def run(vessels: pa.Table, cloud: pa.Table) -> pa.Table:
        lat, lon, p_lat, p_lon = (t.column(c).to_numpy() for t, cs in ((vessels, ("lat", "lon")), (cloud, ("p_lat", "p_lon"))) for c in cs)
        weight, captured = near_sums(lat, lon, p_lat, p_lon, sigma, 3 * sigma)
        met = vessels.select([*[f"by_{c}" for c in by], "mmsi"]).rename_columns([*by, "mmsi"])
        return met.append_column("weight", pa.array(weight)).append_column("captured", pa.array(captured)).filter(pa.array(captured > 0))

    kinds = [f"`{c}` {t.simpleString()}" for c, t in (*((c, particles.schema[c].dataType) for c in by), ("mmsi", places.schema["mmsi"].dataType))]
    keys = [*groups, "deal", "chunk"]
    met = spread(vessels, *keys).groupBy(*keys).cogroup(spread(cloud, *keys).groupBy(*keys)).applyInArrow(run, f"{', '.join(kinds)}, weight double, captured long")
    return met.groupBy(*by, "mmsi").agg(F.sum("weight").alias("weight"), F.sum("captured").alias("captured"))


def global_rank(df: DataFrame, score: str, name: str) -> DataFrame:
    """Ranks by falling score (in 0..1), then name as text, without one task that sorts everything: rows are cut into
    score buckets (rows of score 0 into buckets of name), each ranked on its own behind the rows of those before it."""
    text = F.col(name).cast("string")
    cut = df.withColumn("b", F.floor((1 - F.col(score)) * 1000).cast("int")).withColumn("p", F.when(F.col(score) == 0, F.substring(text, 1, 3)).otherwise(""))
    cut = cut.withColumn("b", F.when(F.col(score) == 0, 1001).otherwise(F.col("b")))
    sizes = cut.groupBy("b", "p").agg(F.count("*").alias("size"))
    ahead = sizes.withColumn("ahead", F.coalesce(F.sum("size").over(Window.orderBy("b", "p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    own = F.row_number().over(Window.partitionBy("b", "p").orderBy(F.desc(score), text))
    return cut.join(F.broadcast(ahead), ["b", "p"]).withColumn("rank", (F.col("ahead") + own).cast("long")).drop("b", "p", "ahead")


def attribute(track: DataFrame, particles: DataFrame, radius_km: float = 5.0, prior_unknown: float = 0.25, lat: float | None = None, lon: float | None = None) -> DataFrame:
    """mmsi, captured, likelihood, factor, posterior, unknown, rank, verdict of every vessel."""
    o = origin(particles)
    sigma = radius_km / 2
    if lat is None or lon is None:
        first = o.first()
        lat, lon = first["o_lat"], first["o_lon"]
    segs = saved(tracks.segments(track), "segments")  # speed drops, gaps and the capture all read them
    behaviour = tracks.behavioural_factor(tracks.anomalies(track, lat, lon, segs))
    caught = saved(soft_capture(track, particles, radius_km, segs), "caught")
    vessels = track.select("mmsi").distinct().join(caught, "mmsi", "left").join(behaviour, "mmsi", "left").crossJoin(F.broadcast(o.select("n", "spread_km")))
    wide = F.greatest(F.col("spread_km"), F.lit(sigma))
    unknown_likelihood = F.least(F.lit(1.0), F.lit(2 * math.pi * sigma * sigma) / (math.pi * wide * wide))
    likely = vessels.select("mmsi", F.coalesce("captured", F.lit(0)).alias("captured"), (F.coalesce("weight", F.lit(0.0)) / F.col("n")).alias("likelihood"), F.coalesce("factor", F.lit(1.0)).alias("factor"), (prior_unknown * unknown_likelihood).alias("u"))
    mass = saved(likely.withColumn("mass", (1 - prior_unknown) * F.col("likelihood") * F.col("factor")), "mass")  # the evidence, ranks and posteriors read it
    evidence = mass.agg((F.sum("mass") + F.max("u")).alias("evidence"))
    shared = mass.crossJoin(F.broadcast(evidence))
    posterior = shared.select("mmsi", "captured", "likelihood", "factor", F.when(F.col("evidence") > 0, F.col("mass") / F.col("evidence")).otherwise(0.0).alias("posterior"), F.when(F.col("evidence") > 0, F.col("u") / F.col("evidence")).otherwise(1.0).alias("unknown"))
    return global_rank(posterior, "posterior", "mmsi").withColumn("verdict", verdict(F.col("posterior")))


def origins(particles: DataFrame) -> DataFrame:
    """drift_id, o_lat, o_lon, o_t, n, spread_km of each case's particles."""
    mean = particles.groupBy("drift_id").agg(F.avg("lat").alias("o_lat"), F.avg("lon").alias("o_lon"), F.avg("t").alias("o_t"), F.count("*").alias("n"))
    far = particles.join(mean, "drift_id").groupBy("drift_id").agg(F.sqrt(F.avg(F.pow(haversine_km(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")), 2))).alias("spread_km"))
    return mean.join(far, "drift_id")


def vessels_of_cases(track: DataFrame, cases: DataFrame, hours: float = 48.0) -> DataFrame:
    """drift_id, mmsi: the vessels with a position within `hours` of a case's origin. Days meet, not positions."""
    day, reach = 86_400.0, hours * 3600
    days = track.groupBy("mmsi", F.floor(F.col("t") / day).alias("day")).agg(F.min("t").alias("low"), F.max("t").alias("high"))
    wanted = cases.select("drift_id", "o_t", F.explode(F.sequence(F.floor((F.col("o_t") - reach) / day), F.floor((F.col("o_t") + reach) / day))).alias("day"))
    return days.join(wanted, "day").where((F.col("low") <= F.col("o_t") + reach) & (F.col("high") >= F.col("o_t") - reach)).select("drift_id", "mmsi").distinct()


def attribute_cases(track: DataFrame, particles: DataFrame, radius_km: float = 5.0, prior_unknown: float = 0.25) -> DataFrame:
    """Many cases at once: drift_id, mmsi (null: a source outside the data), captured, likelihood, factor, posterior, rank, verdict.

    particles: drift_id, particle_id, t, lat, lon. Every vessel near a case in time is a hypothesis of it, and so is the
    unknown source, which wins ties; a case's posteriors add up to one. A case without evidence is the unknown source's."""
    sigma = radius_km / 2
    segs, cases = saved(tracks.segments(track), "segments"), saved(origins(particles), "origins")
    pairs = saved(vessels_of_cases(track, cases), "pairs")
    gaps = pairs.join(tracks.longest_gap(track, segs), "mmsi").join(cases.select("drift_id", "o_lat", "o_lon"), "drift_id")
    gap_ratio = tracks.classed_gaps(gaps, F.col("o_lat"), F.col("o_lon")).select("drift_id", "mmsi", F.col("ratio").alias("gap_ratio"))
    own = tracks.behavioural_factor(tracks.speed_drops(track, segs).unionByName(tracks.loitering(track))).select("mmsi", "factor")
    caught = saved(soft_capture(track, particles, radius_km, segs, ["drift_id"]), "caught")
    rows = pairs.join(caught, ["drift_id", "mmsi"], "left").join(gap_ratio, ["drift_id", "mmsi"], "left").join(own, "mmsi", "left").join(cases.select("drift_id", "n"), "drift_id")
    likelihood, one = F.coalesce("weight", F.lit(0.0)) / F.col("n"), F.lit(1.0)
    vessels = rows.select("drift_id", "mmsi", F.coalesce("captured", F.lit(0)).alias("captured"), likelihood.alias("likelihood"), (F.coalesce("factor", one) * F.coalesce("gap_ratio", one)).alias("factor"))
    vessels = vessels.withColumn("mass", (1 - prior_unknown) * F.col("likelihood") * F.col("factor"))
    wide = F.greatest(F.col("spread_km"), F.lit(sigma))
    elsewhere = F.least(F.lit(1.0), F.lit(2 * sigma * sigma) / (wide * wide))
    unknown = cases.select("drift_id", elsewhere.alias("likelihood"), one.alias("factor"), (prior_unknown * elsewhere).alias("mass"))
    every = vessels.unionByName(unknown, allowMissingColumns=True)
    evidence = F.sum("mass").over(Window.partitionBy("drift_id"))
    posterior = F.when(evidence > 0, F.col("mass") / evidence).otherwise(F.col("mmsi").isNull().cast("double"))
    order = Window.partitionBy("drift_id").orderBy(F.desc("posterior"), F.col("mmsi").isNotNull(), F.col("mmsi").cast("string"))
    return every.withColumn("posterior", posterior).withColumn("rank", F.row_number().over(order)).withColumn("verdict", verdict(F.col("posterior"))).drop("mass")


def case_conclusions(hypotheses: DataFrame) -> DataFrame:
    """drift_id, best (null: the unknown source), posterior, unknown, conclusion."""
    first = F.struct("mmsi", "posterior", "verdict")
    s = hypotheses.groupBy("drift_id").agg(F.min_by(first, "rank").alias("top"), F.max(F.when(F.col("mmsi").isNull(), F.col("posterior"))).alias("unknown"))
    return s.select("drift_id", F.col("top.mmsi").alias("best"), F.col("top.posterior").alias("posterior"), "unknown", F.when(F.col("top.mmsi").isNull(), "insufficient_evidence").otherwise(F.col("top.verdict")).alias("conclusion"))


def conclusion(ranked: DataFrame) -> DataFrame:
    """One row: best vessel, its posterior, the unknown source's, and what follows; unknown wins ties."""
    best = ranked.agg(F.max_by("mmsi", F.struct("posterior", -F.col("rank"))).alias("best"), F.max("posterior").alias("posterior"), F.max("unknown").alias("unknown"))
    return best.withColumn("conclusion", F.when(F.col("unknown") >= F.col("posterior"), "insufficient_evidence").otherwise(verdict(F.col("posterior"))))


def legacy_minima(track: DataFrame, lat: float, lon: float, t: float, hours: float = 48.0) -> DataFrame:
    """mmsi, min_km, min_km_t, min_hours, closest_t: nearest position in space and, separately, in time."""
    near = track.where(F.col("t").between(t - hours * 3600, t + hours * 3600))
    each = near.select("mmsi", "t", "ordinal", haversine_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)).alias("km"), (F.abs(F.col("t") - t) / 3600).alias("h"))
    first = lambda c: F.struct(c, "t", "ordinal")
    return each.groupBy("mmsi").agg(F.min("km").alias("min_km"), F.min_by("t", first("km")).alias("min_km_t"), F.min("h").alias("min_hours"), F.min_by("t", first("h")).alias("closest_t"))


def legacy_codes(track: DataFrame) -> DataFrame:
    """mmsi, codes and n_codes of the three older kinds of anomaly."""
    s = tracks.segments(track)
    pairs = s.groupBy("mmsi").agg(F.bool_or(F.col("dt") > 1800).alias("gap"), F.bool_or((F.col("dt") <= 600) & (F.abs(F.col("speed") - F.col("p_speed")) > 5)).alias("change"))
    both = pairs.join(tracks.legacy_loitering(track), "mmsi", "full")
    names = {"gap": "ais_gap", "change": "speed_change", "loiters": "loitering"}
    codes = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(n)) for c, n in names.items()]))
    return both.select("mmsi", F.array_sort(codes).alias("codes"), F.size(codes).alias("n_codes"))


def legacy_score(track: DataFrame, lat: float, lon: float, t: float, radius_km: float = 50.0, weights: tuple[float, float, float] = (0.40, 0.35, 0.25)) -> DataFrame:
    """mmsi, proximity, temporal, behavioural, composite, rank of the vessels within the radius."""
    near = legacy_minima(track, lat, lon, t).where(F.col("min_km") <= radius_km).join(legacy_codes(track), "mmsi", "left")
    parts: list[Column] = [F.exp(-F.col("min_km") / 10), F.exp(-F.col("min_hours") / 6), F.least(F.lit(1.0), 0.33 * F.coalesce("n_codes", F.lit(0)))]
    named = near.select("mmsi", *[p.alias(n) for p, n in zip(parts, ("proximity", "temporal", "behavioural"), strict=True)])
    scored = named.withColumn("composite", weights[0] * F.col("proximity") + weights[1] * F.col("temporal") + weights[2] * F.col("behavioural"))
    return global_rank(scored, "composite", "mmsi")


def suspects(ranked: DataFrame, legacy: DataFrame, integrity: DataFrame) -> DataFrame:
    """The attribution's rows with the older score (0 where missing) and track integrity (plausible where missing)."""
    out = ranked.join(legacy.select("mmsi", "composite"), "mmsi", "left").join(integrity.select("mmsi", "plausible", "n_flags"), "mmsi", "left")
    return out.withColumns({"composite": F.coalesce("composite", F.lit(0.0)), "plausible": F.coalesce("plausible", F.lit(True)), "n_flags": F.coalesce("n_flags", F.lit(0)).cast("long")})


def run_cases(regions: DataFrame, particles: DataFrame, track: DataFrame, times: DataFrame, radius_km: float = 5.0) -> DataFrame:
    """From placed regions to ranked suspects, for all cases at once: the hypotheses of `attribute_cases` for the drifts whose
    region has a place, and what each vessel's track itself is worth (plausible where nothing speaks against it).

    regions: region_id, centroid_lat; particles: drift_id, region_id, particle_id, t, lat, lon; times: drift_id, region_id."""
    open_ = regions.where(F.col("centroid_lat").isNotNull()).select("region_id").distinct()
    allowed = times.join(open_, "region_id", "left_semi").select("drift_id").distinct()
    own = particles.join(allowed, "drift_id", "left_semi")
    hypotheses = attribute_cases(track, own.select("drift_id", "particle_id", "t", "lat", "lon"), radius_km)
    return hypotheses.join(tracks.integrity(track).select("mmsi", "plausible", "n_flags"), "mmsi", "left").withColumns({"plausible": F.coalesce("plausible", F.lit(True)), "n_flags": F.coalesce("n_flags", F.lit(0)).cast("long")})
