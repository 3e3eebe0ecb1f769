"""A store of positions laid out by day and place, whose reads touch only what can matter.

Files lie in a folder for each day and load; within them positions follow a Morton curve over place and then time, so that the least
and greatest latitude, longitude and time of a row group rule most of it out. A load writes its own folders anew: one that
is tried again adds nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86400.0


def morton(lat: Column, lon: Column, bits: int = 10) -> Column:
    """Latitude's and longitude's bits in turn; places off the globe count as its edge."""
    cell = lambda x, low, span: F.least(F.greatest(F.floor((x - low) / span * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("int")
    spread = lambda x, by: [F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1)), 2 * i + by) for i in range(bits)]
    parts = spread(cell(lat, -90.0, 180.0), 1) + spread(cell(lon, -180.0, 360.0), 0)
    return sum(parts[1:], parts[0])


def add_load(rows: DataFrame, path: str, load: str) -> None:
    """Writes positions (t in epoch seconds, lat, lon and more) under a load's name. The same load may be written again, with the
    same rows. Rows with a null t or place lie in a day or cell of their own."""
    laid = rows.withColumns({"cell": F.coalesce(morton(F.col("lat"), F.col("lon")), F.lit(-1)), "day": F.floor(F.col("t") / DAY).cast("int"), "load": F.lit(load)})
    laid = laid.repartitionByRange("day", "cell", "t").sortWithinPartitions("day", "cell", "t")
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "load").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def between(store: DataFrame, since: float, until: float) -> DataFrame:
    """The positions of a stretch of time; days outside it aren't listed, row groups outside it aren't read."""
    days = F.col("day").between(int(since // DAY), int(until // DAY))
    return store.where(days & F.col("t").between(float(since), float(until)))


def within(store: DataFrame, windows: DataFrame) -> DataFrame:
    """The positions in any of the windows (since, until); days are pruned while the query runs, by the windows' own days. Those are
    broadcast: they can't be more than the days of the calendar, however many windows there are."""
    span = F.sequence(F.floor(F.col("since") / DAY).cast("int"), F.floor(F.col("until") / DAY).cast("int"))
    days = windows.where("until >= since").select(F.explode(span).alias("day")).distinct().where("day > -1000000")
    near = store.join(F.broadcast(days), "day", "left_semi")
    w = windows.where("until >= since").select("since", "until", F.explode(span).alias("w_day"))
    return near.join(w, (F.col("day") == F.col("w_day")) & F.col("t").between(F.col("since"), F.col("until")), "left_semi")
