"""How far a conclusion depends on its assumptions: scenario tables, stability, influence, breaking points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import spread

RANGES = {
    # fixed values: swept range of each assumption
    "duration_scale": (0.60, 1.60),
    "windage_mean": (0.020, 0.040),
    "deflection_deg": (0.0, 30.0),
    "wind_scale": (0.75, 1.25),
    "current_scale": (0.70, 1.30),
    "capture_scale": (0.50, 2.00),
}


def sampled(runs: DataFrame, by: str, n: int = 32, seed: int = 7, ranges: dict[str, tuple[float, float]] = RANGES) -> DataFrame:
    """by, scenario and the assumptions: a latin hypercube for each run, in which every assumption takes each of its n strata once.

    A stratum's place among a run's scenarios and its offset come from a digest of seed, run, assumption and stratum, so a run's
    scenarios are the same whatever else is sampled, and whichever executor samples them. A run's strata are put in order within its
    row, so nothing is sorted or shuffled but the runs, and a task holds one run's scenarios at a time."""

    def values(name: str, low: float, high: float) -> Column:
        digest = lambda s: F.md5(F.concat_ws("|", F.lit(seed), F.col(by).cast("string"), F.lit(name), s.cast("string")))
        strata = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.struct(digest(s).alias("digest"), s.alias("stratum")))
        offset = lambda e: F.conv(F.substring(e["digest"], 1, 8), 16, 10).cast("double") / float(1 << 32)
        return F.transform(F.sort_array(strata), lambda e: F.lit(low) + (F.lit(high) - F.lit(low)) * (e["stratum"] + offset(e)) / n)

    each = spread(runs.select(by), by).distinct()
    placed = each.select(by, F.posexplode(F.arrays_zip(*[values(k, float(low), float(high)).alias(k) for k, (low, high) in ranges.items()])).alias("scenario", "v"))
    return placed.select(by, F.col("scenario").cast("long").alias("scenario"), *[F.col("v")[k].alias(k) for k in ranges])


def sample_scenarios(spark: SparkSession, n: int = 32, seed: int = 7) -> DataFrame:
    """The hypercube of one run without a name."""
    return sampled(spark.range(1).select(F.lit("").alias("run")), "run", n, seed).drop("run")


def stability(results: DataFrame, baseline, by: str) -> DataFrame:
    """by, stability, band, least, median and most posterior; a null winner counts as held where the baseline is null."""
    held = F.col("winner").eqNullSafe(baseline)
    s = results.groupBy(by).agg(F.avg(held.cast("double")).alias("stability"), F.min("posterior").alias("least"), F.median("posterior").alias("median"), F.max("posterior").alias("most"))
    return s.withColumn("band", F.when(F.col("stability") >= 0.75, "robust").when(F.col("stability") >= 0.45, "conditional").otherwise("fragile"))


def baseline_posteriors(scenarios: DataFrame, posteriors: DataFrame, baseline, by: str) -> DataFrame:
    """by, scenario, winner, verdict and the posterior of the baseline vessel (0 where a scenario doesn't know it), or of the
    unknown source where no baseline was named. posteriors: by, scenario, mmsi (null: unknown), posterior; baseline: a column."""
    own = posteriors.withColumn("base", baseline).where(F.col("mmsi").eqNullSafe(F.col("base"))).select(by, "scenario", F.col("posterior").alias("own"))
    return scenarios.join(own, [by, "scenario"], "left").withColumn("posterior", F.coalesce("own", F.lit(0.0))).drop("own")


def audited(results: DataFrame, baseline, by: str) -> DataFrame:
    """by, scenarios, failed, stability, verdict_stability, least, median, most. A failed scenario (verdict null) names no winner: it
    counts for stability, where a null baseline holds it, and neither for the verdicts nor for the posteriors."""
    ran = F.col("verdict").isNotNull()
    steady = F.when(ran, F.col("verdict").isin("strong", "probable").cast("double"))
    p = F.when(ran, F.col("posterior"))
    return results.groupBy(by).agg(
        F.count("*").alias("scenarios"), F.count_if(~ran).alias("failed"), F.avg(F.col("winner").eqNullSafe(baseline).cast("double")).alias("stability"),
        F.coalesce(F.avg(steady), F.lit(0.0)).alias("verdict_stability"), F.coalesce(F.min(p), F.lit(0.0)).alias("least"), F.coalesce(F.median(p), F.lit(0.0)).alias("median"), F.coalesce(F.max(p), F.lit(0.0)).alias("most"),
    )


def influence(results: DataFrame, baseline, parameters: dict[str, float], by: str | None = None) -> DataFrame:
    """by (where given), parameter, influence: distance of its means in held and flipped scenarios over its span; null where all held
    or all flipped. baseline is a column, so that every run may have its own."""
    keys = [by] if by else []
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).alias("value"), F.lit(float(s)).alias("span")) for p, s in parameters.items()]))
    each = results.select(*keys, F.col("winner").eqNullSafe(baseline).alias("held"), pairs.alias("e")).select(*keys, "held", "e.*")
    mean = lambda held: F.avg(F.when(F.col("held") if held else ~F.col("held"), F.col("value")))
    return each.groupBy(*keys, "parameter", "span").agg((F.abs(mean(True) - mean(False))).alias("d")).select(*keys, "parameter", (F.col("d") / F.col("span")).alias("influence"))


def breaking_points(results: DataFrame, baseline, parameter: str, base: float, span: float, most: int = 3) -> DataFrame:
    """scenario, winner, value: the flipped scenarios nearest to the baseline value that moved it, one for each value to two places."""
    one = breaking_points_of(results.withColumn("run_", F.lit(0)), baseline, {parameter: (base, span)}, "run_", most)
    return one.orderBy("nearness").select("scenario", "winner", "value")


def breaking_points_of(results: DataFrame, baseline, parameters: dict[str, tuple[float, float]], by: str, most: int = 3) -> DataFrame:
    """by, parameter, nearness (from 1), scenario, winner, value: the same for every run and several parameters (base, span) at once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).alias("value"), F.lit(float(b)).alias("base"), F.lit(float(s)).alias("span")) for p, (b, s) in parameters.items()]))
    flipped = results.where(~F.col("winner").eqNullSafe(baseline)).select(by, "scenario", "winner", pairs.alias("e")).select(by, "scenario", "winner", "e.*")
    moved = flipped.withColumn("away", F.abs(F.col("value") - F.col("base"))).where(F.col("away") > 0.02 * F.col("span"))
    near = lambda *keys: F.row_number().over(Window.partitionBy(by, "parameter", *keys).orderBy("away", "scenario"))
    one = moved.withColumn("bucket", F.bround("value", 2)).withColumn("rn", near("bucket")).where("rn = 1")
    return one.withColumn("nearness", near()).where(F.col("nearness") <= most).select(by, "parameter", "nearness", "scenario", "winner", "value")
