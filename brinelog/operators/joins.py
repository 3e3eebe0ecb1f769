"""Joins of records, regions, drifts and suspects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_vessels(records: DataFrame, vessels: DataFrame, key: str = "mmsi") -> DataFrame:
    """Position records with their vessel's columns; a record of an unknown vessel stays, with nulls. Of several rows for one
    vessel the first by its columns counts. Whether the vessels are broadcast is left to their measured size."""
    rest = [c for c in vessels.columns if c != key]
    one = vessels.groupBy(key).agg(F.min(F.struct(*rest)).alias("v"))
    return records.join(one, key, "left").select(*records.columns, "v.*")


def last_drift(regions: DataFrame, drifts: DataFrame, key: str = "region_id", order: str = "drift_id") -> DataFrame:
    """Every region with the whole row of its last drift, or with nulls."""
    rest = [c for c in drifts.columns if c != key]
    last = drifts.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("d"))
    return regions.join(last, key, "left").select(*regions.columns, "d.*")


def suspect_tracks(track: DataFrame, suspects: DataFrame, origins: DataFrame, hours: float = 12.0) -> DataFrame:
    """The suspects' positions from `hours` before the first origin to as long after the last."""
    ends = origins.agg((F.min("t") - hours * 3600).alias("since"), (F.max("t") + hours * 3600).alias("until")).first()  # one row
    near = track.where(F.col("t").between(F.lit(ends.since), F.lit(ends.until)))  # numbers reach the scan, a join wouldn't
    return near.join(suspects.select("mmsi").distinct(), "mmsi", "left_semi")


def page(ordered: DataFrame, number: int, size: int = 50) -> DataFrame:
    """A page, from 1, of rows that are in order."""
    return ordered.offset((number - 1) * size).limit(size)
