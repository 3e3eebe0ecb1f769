"""Raster files and model sidecars as tables.

`read_tiff` and `tiff_pixels` take rows of (path, content), as Spark's binaryFile source gives them, so they read from wherever Spark reads
files of up to 2 GB; `scenes` reads files of any size by strips. What can't be read gives a reason in `error` and no pixels. A
picture's place comes from its tie point and pixel scale, where both are there and lie on the globe."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codecs import BAD, Read, layout_of
from .scenes import HEAD, PIXELS, batches_of, blocks_of, head_row, pixel_batch, scenes

def reader_of(content: bytes | None) -> Read:
    data = bytes(content) if content is not None else b""

    def read(offset: int, size: int) -> bytes:
        return data[offset : offset + size]

    return read


def read_tiff(files: DataFrame) -> DataFrame:
    """One row a file: HEAD, from the headers alone. error is null where the file can be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [head_row(path, reader_of(c), len(c) if c is not None else 0) for path, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HEAD.split(", ")])

    return files.select("path", "content").mapInPandas(run, HEAD)


def tiff_pixels(files: DataFrame) -> DataFrame:
    """path, band, y, x, value of every pixel of the files that can be read; many small files make one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[dict]:
            for batch in batches:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                    read, length = reader_of(content.as_py()), len(content.as_py() or b"")
                    try:
                        layout = layout_of(read, length)
                    except BAD:
                        continue
                    yield from blocks_of(path, layout, read, length)

        yield from batches_of(blocks())

    return files.select("path", "content").mapInArrow(run, PIXELS)


def image_pixels(images: DataFrame) -> DataFrame:
    """path, band, y, x, value from Spark's own `image` source (PNG, JPEG and others; its bands are blue, green, red and alpha, ours
    begin with red); pictures that it couldn't read have no pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[dict]:
            for batch in batches:
                for r in batch.to_pylist():
                    pixels = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["bands"])
                    if r["bands"] >= 3:
                        pixels = pixels[:, :, [2, 1, 0, *range(3, r["bands"])]]
                    yield pixel_batch(r["path"], 0, 0, 0, pixels)

        yield from batches_of(blocks())

    rows = images.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("bands"), "image.data")
    return rows.where("height > 0 AND width > 0 AND bands > 0").mapInArrow(run, PIXELS)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """scene, has_slick, truth of each scene of the manifests at a path (JSON with a list `scenes`) that isn't withdrawn; a scene
    without a truth has none to be found."""
    kind = "scenes array<struct<scene:string,has_slick:boolean,truth:string,withdrawn:boolean>>"
    listed = spark.read.schema(kind).json(path).select(F.inline("scenes"))
    return listed.where(~F.coalesce("withdrawn", F.lit(False))).select("scene", F.coalesce("has_slick", F.col("truth").isNotNull()).alias("has_slick"), "truth")


def truth_masks(spark: SparkSession, manifest: DataFrame, folder: str, threshold: float = 127.0) -> DataFrame:
    """scene, y, x, m of the manifest's scenes that have a truth: the first band of its picture, above the threshold. Truths are paths
    below the folder; one that is missing or can't be read gives no pixels."""
    wanted = manifest.where("truth IS NOT NULL").select("scene", F.concat(F.lit("/"), F.regexp_replace("truth", "^[./]+", "")).alias("truth"))
    pixels = scenes(spark, folder).where("band = 0 AND value IS NOT NULL")
    inside = F.regexp_replace("path", "^.*?(?=" + re.escape(folder.rstrip("/").rsplit("/", 1)[-1]) + "/)", "")
    below = F.substring(inside, F.lit(len(folder.rstrip("/").rsplit("/", 1)[-1]) + 1), F.length(inside))
    return pixels.withColumn("truth", below).join(wanted, "truth").select("scene", "y", "x", (F.col("value") > threshold).alias("m"))


# fixed values: what a model is taken to be where its sidecar says nothing
DEFAULTS = {"version": "1.0.0", "architecture": "custom_unet", "input_size": 256, "stride": 224, "normalization": "scale_0_1", "threshold": 0.5}


def with_sidecars(models: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Each model (checkpoint: a path) with the sidecar (path and any of the fields) from its own folder, its parent's or its
    grandparent's, whichever comes first; fields it lacks, and models without one, get the defaults and their folder's name."""
    up = lambda n: F.concat(F.regexp_extract("checkpoint", rf"^(.*?)(?:/[^/]+){{{n}}}$", 1), F.lit("/model_info.json"))
    at = F.posexplode(F.array(up(0), up(1), up(2))).alias("step", "path")
    known = [c for c in sidecars.columns if c != "path"]
    met = models.select("checkpoint", at).join(sidecars, "path").groupBy("checkpoint").agg(F.min_by(F.struct("path", *known), "step").alias("s"))
    own = lambda c, default: F.coalesce(F.col(f"s.{c}"), default).alias(c) if c in known else default.alias(c)
    name = F.regexp_extract("checkpoint", r"([^/]*)/*$", 1)
    return models.join(met, "checkpoint", "left").select("checkpoint", own("name", name), *[own(c, F.lit(v)) for c, v in DEFAULTS.items()], F.col("s.path").alias("sidecar"))
