"""Tamper-evident manifests: canonical JSON, digests, seals and their checks; and the case as nested rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scenes import opened
from .documents import lowered


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def fingerprint(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 16)


def verify(manifests: DataFrame) -> DataFrame:
    """run_id, valid, reasons: what of (content, content_sha256, manifest, manifest_sha256, scene_sha256, sealed_scene_sha256) doesn't hold."""
    checks = [
        (F.col("content_sha256").isNull() | F.col("manifest_sha256").isNull(), "seal missing"),
        (digest(F.col("content")) != F.col("content_sha256"), "content changed"),
        (digest(F.col("manifest")) != F.col("manifest_sha256"), "manifest changed"),
        (F.col("scene_sha256") != F.col("sealed_scene_sha256"), "scene changed"),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in checks]))
    return manifests.select("run_id", (F.size(reasons) == 0).alias("valid"), F.array_join(reasons, "; ").alias("reasons"))


UNSEALED = ("created_at", "content_sha256", "manifest_sha256")


def canonical(fields: Column, but: tuple[str, ...] = ()) -> Column:
    """Canonical JSON of a map from name to text, but for some names: sorted keys, no spaces, control characters escaped in lower
    case. Values are text already, as every number of a manifest is; JSON of any shape goes through documents.canonical."""
    entries = F.map_entries(fields)
    kept = F.filter(entries, lambda e: ~e["key"].isin(*but)) if but else entries
    return lowered(F.to_json(F.map_from_entries(F.array_sort(kept))))


def sealed(manifests: DataFrame, fields: str = "fields") -> DataFrame:
    """Adds both seals to manifests (a map from name to text). The content's leaves out when it was made, so two runs of one
    analysis show the same; the manifest's holds that and the content's seal, so that a new issue is visible."""
    content = digest(canonical(F.col(fields), UNSEALED))
    with_content = manifests.withColumn("content_sha256", content)
    return with_content.withColumn("manifest_sha256", digest(canonical(F.map_concat(fields, F.create_map(F.lit("content_sha256"), F.col("content_sha256"))))))


def verified(manifests: DataFrame, key: str, fields: str = "fields") -> DataFrame:
    """key, valid, reasons: sealed manifests against what their fields give now, and against the files' digests where given
    (input_now, model_now; null: not checked). Each reason names what doesn't hold."""
    named = F.map_concat(F.map_filter(fields, lambda k, _: ~k.isin(*UNSEALED[1:])), F.create_map(F.lit("content_sha256"), F.col("content_sha256")))
    checks = [
        (~digest(canonical(named)).eqNullSafe(F.col("manifest_sha256")), "manifest_sha256"),
        (~digest(canonical(F.col(fields), UNSEALED)).eqNullSafe(F.col("content_sha256")), "content_sha256"),
        (F.col("input_now").isNotNull() & ~F.col("input_now").eqNullSafe(F.try_element_at(fields, F.lit("input_sha256"))), "input"),
        (F.col("model_now").isNotNull() & ~F.col("model_now").eqNullSafe(F.try_element_at(fields, F.lit("model_sha256"))), "model"),
    ]
    told = manifests.select(key, F.concat_ws(",", *[F.when(c, F.lit(r)) for c, r in checks]).alias("reasons"))
    return told.select(key, (F.col("reasons") == "").alias("valid"), "reasons")


def folder_digests(files: DataFrame, folder: str) -> DataFrame:
    """folder, sha256 of folders of files (folder, path inside it, sha256): a walk from the top, each folder's own files by
    name before its sub-folders by name; paths and digests are strung together and digested."""
    steps = F.split("path", "/")
    inner = F.slice(steps, 1, F.size(steps) - 1)
    # a file sorts before every sub-folder of its own folder: files' names get a lower mark than folders'
    order = F.concat(F.transform(inner, lambda s: F.concat(F.lit("1"), s)), F.array(F.concat(F.lit("0"), F.element_at(steps, -1))))
    each = files.select(folder, F.struct(order.alias("by"), "path", "sha256").alias("f"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.concat(f["path"], f["sha256"])), "")
    return each.groupBy(folder).agg(F.sha2(told, 256).alias("sha256"))


def walked(spark: SparkSession, folder: str) -> DataFrame:
    """file and path (inside the folder) of every file below a folder, hidden ones too."""
    system, inner = opened(folder)
    scheme = folder.split("://")[0] + "://" if "://" in folder and not folder.startswith("file:") else ""
    found = [f.path for f in system.get_file_info(arrow_fs.FileSelector(inner, recursive=True)) if f.is_file]
    cut = len(inner.rstrip("/")) + 1
    rows = spark.createDataFrame([(scheme + p, p[cut:]) for p in found], "file string, path string")
    return rows.repartition(max(1, min(len(found), 10 * spark.sparkContext.defaultParallelism)), "file")


def file_digests(files: DataFrame, chunk: int = 4 << 20) -> DataFrame:
    """Adds length, sha256 and error to rows with a file each. A file is read in chunks through a running digest, so its size doesn't
    matter; one that can't be read has a reason in error and neither of the others."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(file: str | None) -> tuple:
            state, length = hashlib.sha256(), 0
            try:
                system, inner = opened(file or "")
                with system.open_input_stream(inner) as stream:
                    while data := stream.read(chunk):
                        state.update(data)
                        length += len(data)
            except (OSError, ValueError, TypeError) as e:
                return None, None, f"unreadable: {e}"[:200]
            return length, state.hexdigest(), None

        for pdf in frames:
            told = [one(f) for f in pdf["file"]]
            yield pdf.assign(length=pd.array([t[0] for t in told], "Int64"), sha256=[t[1] for t in told], error=[t[2] for t in told])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(run, f"{kind}, length long, sha256 string, error string")


def code_version(commit: str | None, dirty: bool = False) -> str:
    return "unavailable" if not commit else f"{commit}-dirty" if dirty else commit


def dossier(runs: DataFrame, regions: DataFrame, suspects: DataFrame) -> DataFrame:
    """One nested row per run: its regions by falling area and its suspects by rank."""
    r = regions.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("area")).alias("by"), "region_id", "area"))).alias("regions"))
    s = suspects.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("rank", "mmsi", "posterior"))).alias("suspects"))
    out = runs.join(r, "run_id", "left").join(s, "run_id", "left")
    return out.withColumn("stale", F.coalesce(F.size("suspects"), F.lit(0)) <= 0)
