"""Shared helpers: table reading, null-safe byte access to text; written tables come from the sources."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.written import saved, shared_folder  # noqa: F401

WHITESPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(names: list[str], like: str = "own") -> str:
    """A column name that none of the given ones equals, whatever the case."""
    taken = {n.lower() for n in names}
    while like.lower() in taken:
        like += "_"
    return like


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


PART_ROWS, PART_TEXT = 4096, 1 << 14


def part_of(number: Column, text: Column) -> Column:
    """A part of the scan's partition that `number` lies in, of at most PART_ROWS rows and twice as many times PART_TEXT bytes.

    Texts of up to twice PART_TEXT bytes go by PART_ROWS rows, those of up to twice as many bytes by half as many rows, and so
    on; from PART_ROWS times as many each is a part of its own. So a partition of any size, or a file that can't be split, makes
    many small groups."""
    tier = F.least(F.floor(F.log2(F.greatest(F.coalesce(F.octet_length(text), F.lit(0)) / PART_TEXT, F.lit(1.0)))), F.lit(PART_ROWS.bit_length() - 1)).cast("int")
    rows = F.floor(number.bitwiseAND(F.lit((1 << 33) - 1)) / F.pow(F.lit(2.0), F.lit(PART_ROWS.bit_length() - 1) - tier)).cast("long")
    return F.shiftleft(F.shiftright(number, 33), 37).bitwiseOR(F.shiftleft(tier.cast("long"), 33)).bitwiseOR(rows)


def numbered(docs: DataFrame, label: str, text: str = "text", rows_a_bucket: int = 4096) -> DataFrame:
    """docs with `part` (a bounded piece of what one task of their scan read) and `row` (its place there), written bucketed by part.

    Each task writes one file, and whatever is joined or cogrouped by part later moves to the texts: they are not
    shuffled again. `part` and `row` tell rows apart that repeat each other or an id; no column of docs may have these names."""
    spark, number = docs.sparkSession, F.monotonically_increasing_id()
    placed = docs.withColumn("row", number).withColumn("part", part_of(F.col("row"), F.col(text).cast("string")))
    rows = placed.withColumn("row", F.col("row").bitwiseAND(F.lit((1 << 33) - 1)).cast("int"))
    name, buckets = f"{label}_{uuid.uuid4().hex}", min(100_000, max(128, docs.count() // rows_a_bucket))
    rows.write.bucketBy(buckets, "part").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def rows_at(rows: DataFrame, places: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of bucketed documents whose (part, row) is among the places, or is not; only the places move."""

    def run(own: pa.Table, places: pa.Table) -> pa.Table:
        there = pc.is_in(own.column("row"), places.column("row").combine_chunks())
        return own.filter(there if inside else pc.invert(there))

    return rows.groupBy("part").cogroup(places.select("part", "row").groupBy("part")).applyInArrow(run, rows.schema)
