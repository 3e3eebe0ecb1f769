"""Raster files as a Spark data source: `spark.read.format("scenes").load(path)`.

`content` chooses what is read: `heads`, a row a file from its header alone, or `pixels` (the default), a row a pixel and band. Large
files are planned from their headers: a task decodes one batch of strips or tiles of bounded size, so a scene of any size is
spread over the cluster. Small files go to tasks in groups, unopened while planning. Files are reached through the file systems that
Arrow knows (local, HDFS, S3, GCS); a path without scheme is local or mounted everywhere.

A file that can't be read has a head with a reason in `error` and no pixels; of one that breaks off later, each strip that can't be
decoded gives one row with its corner and a null value. A folder without files gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .codecs import BAD, Layout, Read, Segment, layout_of, png_rows, segment_pixels

HEAD = "path string, width int, height int, bands int, kind string, min_lon double, min_lat double, max_lon double, max_lat double, error string"
PIXELS = "path string, band int, y int, x int, value double"
LARGE, TASK_BYTES, TASK_FILES = 32 << 20, 64 << 20, 512
BATCH = 1 << 20


@dataclass
class Files(InputPartition):
    """Whole files of one task: (path, length)."""

    files: list[tuple[str, int]]


@dataclass
class Part(InputPartition):
    """Some segments of one large file."""

    path: str
    length: int
    layout: Layout


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" not in path:
        return arrow_fs.LocalFileSystem(), path.removeprefix("file:")
    return arrow_fs.FileSystem.from_uri(path)


def reader_of(path: str) -> Read:
    system, inner = opened(path)
    file = system.open_input_file(inner)

    def read(offset: int, size: int) -> bytes:
        data = file.read_at(size, offset)
        if len(data) < min(size, 8):
            raise ValueError("cut short")
        return data

    return read


def listed(path: str) -> list[tuple[str, int]]:
    system, inner = opened(path)
    info = system.get_file_info(inner)
    found = [info] if info.is_file else system.get_file_info(arrow_fs.FileSelector(inner, recursive=True))
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return sorted((scheme + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def pixel_batch(path: str, band: int, y: int, x: int, pixels: np.ndarray) -> dict:
    """Columns of a block of pixels; band, y and x are its corner."""
    rows, columns, bands = pixels.shape
    shape = np.arange(rows, dtype=np.int32)[:, None, None] + y, np.arange(columns, dtype=np.int32)[None, :, None] + x, np.arange(bands, dtype=np.int32)[None, None, :] + band
    ys, xs, bs = (np.broadcast_to(a, pixels.shape).ravel() for a in shape)
    return {"path": path, "band": bs, "y": ys, "x": xs, "value": pixels.ravel().astype(float)}


def batches_of(blocks: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Blocks put together to batches of about BATCH pixels."""
    held, n = [], 0

    def told() -> pa.RecordBatch:
        sizes = [len(b["y"]) for b in held]
        paths = pa.array([b["path"] for b in held]).take(pa.array(np.repeat(np.arange(len(held)), sizes)))
        rest = [pa.array(np.concatenate([b[c] for b in held]), kind) for c, kind in (("band", pa.int32()), ("y", pa.int32()), ("x", pa.int32()))]
        value = np.concatenate([b["value"] for b in held])
        lost = np.concatenate([np.full(len(b["y"]), b.get("lost", False)) for b in held])
        return pa.RecordBatch.from_arrays([paths, *rest, pa.array(value, pa.float64(), mask=lost)], ["path", "band", "y", "x", "value"])

    for block in blocks:
        held.append(block)
        n += len(block["y"])
        if n >= BATCH:
            yield told()
            held, n = [], 0
    if held:
        yield told()


def blocks_of(path: str, layout: Layout, read: Read, length: int) -> Iterator[dict]:
    """The pixels of a layout's segments; a segment that can't be decoded is one pixel without value at its corner."""

    def lost(band: int, y: int, x: int) -> dict:
        return pixel_batch(path, band, y, x, np.full((1, 1, 1), np.nan)) | {"lost": True}

    if layout.packing == 0:
        y = 0
        try:
            for y, rows in png_rows(layout, read, length, max(1, BATCH // (layout.width * layout.bands))):
                yield pixel_batch(path, 0, y, 0, rows)
        except BAD:
            yield lost(0, y, 0)
        return
    for s in layout.segments:
        try:
            pixels = segment_pixels(layout, s, read)
        except BAD:
            yield lost(s.band, s.y, s.x)
            continue
        yield pixel_batch(path, s.band, s.y, s.x, pixels)


def head_row(path: str, read: Read | None, length: int) -> tuple:
    try:
        layout = layout_of(read or reader_of(path), length)
        return (path, layout.width, layout.height, layout.bands, layout.kind, *layout.place, None)
    except BAD as e:
        return (path, *(None,) * 8, f"unreadable: {e}"[:200])


class ScenesReader(DataSourceReader):
    def __init__(self, path: str, heads: bool) -> None:
        self.path, self.heads = path, heads

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        group: list[tuple[str, int]] = []
        for path, length in listed(self.path):
            if length >= LARGE and not self.heads:
                try:
                    layout = layout_of(reader_of(path), length)
                except BAD:
                    continue
                out += [Part(path, length, Layout(**(vars(layout) | {"segments": tuple(some)}))) for some in lots(layout)]
                continue
            if group and (len(group) == TASK_FILES or sum(n for _, n in group) + length > TASK_BYTES and not self.heads):
                out, group = [*out, Files(group)], []
            group.append((path, length))
        return [*out, *([Files(group)] if group else [])] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch | tuple]:
        if isinstance(partition, Part):
            yield from batches_of(blocks_of(partition.path, partition.layout, reader_of(partition.path), partition.length))
        elif self.heads:
            yield from (head_row(path, None, length) for path, length in partition.files)
        else:
            yield from batches_of(self.blocks(partition.files))

    def blocks(self, files: list[tuple[str, int]]) -> Iterator[dict]:
        for path, length in files:
            try:
                read = reader_of(path)
                layout = layout_of(read, length)
            except BAD:
                continue
            yield from blocks_of(path, layout, read, length)


def lots(layout: Layout) -> list[list[Segment]]:
    """Segments in batches whose pixels, decoded, take about TASK_BYTES as a task's rows."""
    out: list[list[Segment]] = [[]]
    weight = 0
    for s in layout.segments:
        cost = 8 * s.rows * s.columns * s.bands
        if out[-1] and weight + cost > TASK_BYTES:
            out.append([])
            weight = 0
        out[-1].append(s)
        weight += cost
    return out


class Scenes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scenes"

    def schema(self) -> str:
        return HEAD if self.options.get("content") == "heads" else PIXELS

    def reader(self, schema: object) -> DataSourceReader:
        if not self.options.get("path") or self.options.get("content", "pixels") not in ("heads", "pixels"):
            raise ValueError("scenes need a path; content is heads or pixels")
        return ScenesReader(self.options["path"], self.options.get("content") == "heads")


def scenes(spark: SparkSession, path: str, content: str = "pixels") -> DataFrame:
    """The raster files at a path; HEAD or PIXELS."""
    spark.dataSource.register(Scenes)
    return spark.read.format("scenes").option("content", content).load(path)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes rows of (path, content) as files below a folder; path and length of each. A retried task writes the same files again."""

    def run(frames: Iterator) -> Iterator:
        system, inner = opened(folder)
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                system.create_dir(f"{inner}/{path}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{inner}/{path}") as out:
                    out.write(bytes(content or b""))
            yield pdf[["path"]].assign(length=[len(c or b"") for c in pdf["content"]])

    return files.select("path", "content").mapInPandas(run, "path string, length long")
