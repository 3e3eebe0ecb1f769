"""Exact interpolated percentiles of groups of any size, by counting instead of sorting.

A first histogram (sixteenths of an octave, by sign) tells which bucket holds each wanted rank; the bucket is then cut into equal bins
between its least and greatest value, again and again, until it holds one value or few enough to gather. All counts are partial
aggregates, so no task holds a group's values, and each pass narrows a bucket about a thousandfold.

Null values don't count; NaN is greater than all others; a group without values has no row. Groups may be null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import saved


def log_bucket(v: Column) -> Column:
    """A whole number that never falls as v grows."""
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(5000.0)) * 16).cast("long") + 20000
    return F.when(F.isnan(v), 1 << 30).when(v == 0, 0).when(v < 0, -size).otherwise(size)


def percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float], gathered: int = 4096, bins: int = 1024) -> DataFrame:
    """by, n and percentiles (an array, one for each share, interpolated as numpy does)."""
    v = saved(rows.select(*by, F.col(value).cast("double").alias("v_")).where("v_ IS NOT NULL"), "values")

    def met(targets: DataFrame) -> DataFrame:
        """Values with the targets whose bucket they lie in."""
        own = targets.select(*[F.col(c).alias(f"t_{c}") for c in by], "rank", "lo", "hi", "before")
        return v.join(own, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in by])).where("v_ BETWEEN lo AND hi")

    def holding(histogram: DataFrame, keys: list[str], bucket: str) -> DataFrame:
        """Of each rank the bucket that holds it, with how many values lie below."""
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(bucket))
        return histogram.withColumn("before", F.col("before") + upto - F.col("n")).where("before <= rank AND rank < before + n").select(*by, "rank", "lo", "hi", "before", "n")

    ends = [F.count("*").alias("n"), F.min("v_").alias("lo"), F.max("v_").alias("hi")]
    first = saved(v.withColumn("bucket", log_bucket(F.col("v_"))).groupBy(*by, "bucket").agg(*ends), "histogram")
    total = F.sum("n").over(Window.partitionBy(*by))
    places = [p * (F.col("total") - 1) for p in shares]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in places])))
    wide = first.withColumn("total", total).withColumn("rank", F.explode(ranks)).withColumn("before", F.lit(0).cast("long"))
    sizes = first.groupBy(*by).agg(F.sum("n").alias("total"))
    targets = saved(holding(wide, [*by, "rank"], "bucket"), "targets")
    while not (open_ := targets.where(f"lo < hi AND n > {gathered}")).isEmpty():
        place = F.least(F.lit(bins - 1), F.floor((F.col("v_") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
        finer = met(open_).withColumn("bucket", place).groupBy(*by, "rank", "before", "bucket").agg(*ends)
        targets = saved(targets.where(f"NOT (lo < hi AND n > {gathered})").unionByName(holding(finer, [*by, "rank"], "bucket")), "targets")
    few = met(targets.where("lo < hi")).groupBy(*by, "rank", "before").agg(F.sort_array(F.collect_list("v_")).alias("all"))  # at most `gathered`
    known = few.select(*by, "rank", F.get("all", (F.col("rank") - F.col("before")).cast("int")).alias("x"))
    known = known.unionByName(targets.where("NOT lo < hi").select(*by, "rank", F.col("lo").alias("x")))
    each = known.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))
    whole = sizes.join(each.select(*[F.col(c).alias(f"t_{c}") for c in by], "at"), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in by]))

    def interpolated(place: Column) -> Column:
        low, high = F.floor(place), F.ceil(place)
        return F.when(low == high, F.col("at")[low]).otherwise((high - place) * F.col("at")[low] + (place - low) * F.col("at")[high])

    return whole.select(*by, F.col("total").alias("n"), F.array(*[interpolated(x) for x in places]).alias("percentiles"))
