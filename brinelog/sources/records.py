"""What the stages of a run write: regions, drifts, suspects and the run's states, each stage once however often it is tried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def insert(rows: DataFrame, path: str, stage: str, attempt: str) -> None:
    """Writes a stage's rows under the name of what they are part of (a batch of runs). The same name again replaces what an earlier
    try left, so a retry neither doubles rows nor keeps half of them; a stage without rows leaves none."""
    target = f"{path}/{stage}/attempt={attempt}"
    rows.write.mode("overwrite").parquet(target)


def inserted(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """A stage's rows of all batches, with `attempt`."""
    return spark.read.option("basePath", f"{path}/{stage}").parquet(f"{path}/{stage}/attempt=*")


def last_states(states: DataFrame) -> DataFrame:
    """run_id, state, since: of each run's states (run_id, state, at) the last, of equal moments the last by name; failures keep
    their reason."""
    return states.groupBy("run_id").agg(F.max(F.struct("at", "state", "reason")).alias("s")).select("run_id", "s.state", F.col("s.at").alias("since"), "s.reason")


def written_case(spark: SparkSession, path: str) -> DataFrame:
    """Each run with its last state and what its stages have written: run_id, state, regions, area, drifts, degraded_steps."""
    regions, drifts = inserted(spark, path, "regions"), inserted(spark, path, "drifts")
    each = regions.groupBy("run_id").agg(F.count("*").alias("regions"), F.sum("area").alias("area"))
    moved = drifts.join(regions.select("region_id", "run_id"), "region_id").groupBy("run_id").agg(F.count("*").alias("drifts"), F.sum("degraded_steps").alias("degraded_steps"))
    out = last_states(inserted(spark, path, "states")).join(each, "run_id", "left").join(moved, "run_id", "left")
    none = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return out.select("run_id", "state", none("regions", "long"), none("area", "double"), none("drifts", "long"), none("degraded_steps", "long"))
