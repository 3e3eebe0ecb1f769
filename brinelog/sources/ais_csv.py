"""Position-report files: scan, cleaning, and loads that only insert what is absent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

REQUIRED = {"mmsi": "mmsi", "basedatetime": "timestamp", "lat": "lat", "lon": "lon"}
OPTIONAL = {"sog": "speed_knots", "cog": "course", "heading": "heading", "vesselname": "name", "vesseltype": "vessel_type", "status": "status", "length": "length_m", "width": "width_m"}


def headers(spark: SparkSession, path: str) -> DataFrame:
    """file, columns (the first line's names, in order) and missing (required names it lacks, whatever the case) of every file at a
    path. One pass over the files as lines, of which only each file's first is kept; files of no bytes aren't listed by Spark."""
    named = F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))").alias("file")
    lines = spark.read.text(path).where("_metadata.file_block_start = 0").select(named, "value", F.monotonically_increasing_id().alias("at"))
    first = lines.groupBy("file").agg(F.min_by("value", "at").alias("line"))
    names = F.transform(F.split("line", ","), lambda c: F.regexp_replace(c, r'^[\uFEFF\s"]+|[\s"]+$', ""))
    lacking = F.array_except(F.array(*[F.lit(c) for c in REQUIRED]), F.transform("columns", F.lower))
    return first.select("file", names.alias("columns")).withColumn("missing", lacking)


def read_csv(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """All columns as text under their own names, matched by each file's own header without regard to case (of names that differ
    in case only the last counts); missing optional ones are null. Files that lack a required column are left out: `headers` names
    them, and what a load counts as errors has them. If no file can be read that is an error.

    Files go by layout, one scan a layout, united by name. What the driver holds is the files' names, as it does for any scan."""
    layouts = (headers(spark, path) if known is None else known).groupBy("columns", "missing").agg(F.collect_list("file").alias("files")).collect()
    readable = [x for x in layouts if not x.missing]
    if not readable:
        raise ValueError(f"required columns missing: {', '.join(sorted({c for x in layouts for c in x.missing}))}")
    frames = []
    for layout in sorted(readable, key=lambda x: x.columns):
        place = {c.lower(): i for i, c in enumerate(layout.columns)}
        kind = ", ".join(f"c{i} string" for i in range(len(layout.columns)))
        raw = spark.read.schema(kind).option("header", True).option("mode", "PERMISSIVE").csv(layout.files)
        frames.append(raw.select(*[(F.col(f"c{place[c]}") if c in place else F.lit(None).cast("string")).alias(n) for c, n in (REQUIRED | OPTIONAL).items()]))
    return reduce(DataFrame.unionByName, frames)


def clean(raw: DataFrame) -> DataFrame:
    """Rows without key columns or with an unreadable time go; positions are clipped; naive times are UTC; a status or type of 0 is empty."""
    falsy = lambda c: F.when(F.col(c).isNull() | F.col(c).isin("0", "0.0"), "").otherwise(F.col(c))
    rows = raw.dropna(subset=list(REQUIRED.values())).withColumn("timestamp", F.try_to_timestamp("timestamp")).dropna(subset=["timestamp"])
    rows = rows.withColumns({"lat": clip(F.col("lat").cast("double"), 90.0), "lon": clip(F.col("lon").cast("double"), 180.0), "mmsi": F.substring("mmsi", 1, 9)})
    rows = rows.withColumns({c: F.col(c).cast("double") for c in ("speed_knots", "course", "heading", "length_m", "width_m")})
    return rows.withColumns({c: falsy(c) for c in ("status", "vessel_type", "name")})


def clip(x: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), x))


def last_known(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last non-null value of each column per key, in the given order."""
    return rows.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def absent(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """The rows of new keys only: what an insert-if-absent load appends."""
    return new.join(existing.select(key), key, "left_anti")


def append(rows: DataFrame, path: str, by: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replaces exactly the partitions that rows has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def load(raw: DataFrame, path: str, existing: DataFrame, unreadable: int = 0) -> DataFrame:
    """Cleans and appends a load, and returns one row: vessels_created, records_created, errors (rows that went, and files that
    couldn't be read). Rows are counted while they are written, so the files are scanned once; new vessels are then told from the
    written numbers alone."""
    seen, kept = Observation(), Observation()
    rows = clean(raw.observe(seen, F.count(F.lit(1)).alias("n"))).observe(kept, F.count(F.lit(1)).alias("n"))
    append(rows, path)
    records, errors = kept.get["n"], seen.get["n"] - kept.get["n"] + unreadable
    fresh = absent(raw.sparkSession.read.schema(rows.schema).parquet(path).select("mmsi").distinct(), existing.select("mmsi").distinct(), "mmsi")
    return fresh.agg(F.count("*").alias("vessels_created"), F.lit(records).alias("records_created"), F.lit(errors).alias("errors"))
