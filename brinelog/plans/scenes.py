"""Raster files of every layout, written from the given tables and read back by the scenes source."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster as R
from ..session import spread
from ..sources import rasters
from ..sources import scenes as S
from ..sources.adapters import table
from ..sources.written import shared_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


LAYOUTS = ("strips", "planar", "tiles", "packbits", "deflate", "lzw", "big", "png")


def packed(data: bytes) -> bytes:
    """PackBits, by runs of equal bytes and stretches of unequal ones."""
    out, at = b"", 0
    while at < len(data):
        run = next((n for n in range(1, min(128, len(data) - at)) if data[at + n] != data[at]), min(128, len(data) - at))
        if run > 1:
            out, at = out + bytes([257 - run, data[at]]), at + run
        else:
            out, at = out + b"\0" + data[at : at + 1], at + 1
    return out


def lzw(data: bytes) -> bytes:
    """LZW with codes widened one early; begins and ends with its marks."""
    value = bits = 0
    table, word, width = {bytes([i]): i for i in range(256)}, b"", 9

    def put(code: int) -> None:
        nonlocal value, bits
        value, bits = (value << width) | code, bits + width

    put(256)
    size = 258
    for i in range(len(data)):
        step = data[i : i + 1]
        if word + step in table:
            word += step
            continue
        put(table[word])
        table[word + step] = size
        size += 1
        if size == 4095:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        else:
            width = max(9, min(12, size.bit_length()))
        word = step
    put(table[word])
    width = max(9, min(12, (size + 1).bit_length()))
    put(257)
    return (value << (-bits % 8)).to_bytes((bits + 7) // 8, "big")


def picture(pixels: np.ndarray, layout: str, lon: float = 0.0, lat: float = 0.0) -> bytes:
    """A file of height x width x bands unsigned numbers in one of LAYOUTS; strips of three rows, tiles of sixteen."""
    height, width, bands = pixels.shape
    if layout == "png":
        colour = {1: 0, 2: 4, 3: 2, 4: 6}[bands]
        lines = [pixels[y].astype(pixels.dtype.newbyteorder(">")).tobytes() for y in range(height)]
        step, rows = bands * pixels.dtype.itemsize, b""
        for y, line in enumerate(lines):
            own = np.frombuffer(line, np.uint8)
            left, above = np.concatenate([np.zeros(step, np.uint8), own[:-step]]), np.frombuffer(lines[y - 1], np.uint8) if y else np.zeros(len(own), np.uint8)
            corner = np.concatenate([np.zeros(step, np.uint8), above[:-step]])
            a, b, c = (v.astype(int) for v in (left, above, corner))
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            nearest = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
            rows += bytes([y % 5]) + (own - [np.zeros(len(own), int), a, b, (a + b) >> 1, nearest][y % 5]).astype(np.uint8).tobytes()
        chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        body, half = zlib.compress(rows), len(zlib.compress(rows)) // 2
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8 * pixels.dtype.itemsize, colour, 0, 0, 0)) + chunk(b"IDAT", body[:half]) + chunk(b"IDAT", body[half:]) + chunk(b"IEND", b"")
    order, big, tiled = (">", True, False) if layout == "big" else ("<", False, layout == "tiles")
    kind = pixels.dtype.newbyteorder(order)
    planes = [pixels[:, :, [b]] for b in range(bands)] if layout == "planar" else [pixels]
    if tiled:
        whole = np.pad(pixels, ((0, -height % 16), (0, -width % 16), (0, 0)))
        blocks = [whole[y : y + 16, x : x + 16] for y in range(0, height, 16) for x in range(0, width, 16)]
    else:
        blocks = [p[y : y + 3] for p in planes for y in range(0, height, 3)]
    differences = layout in ("deflate", "lzw")
    if differences:
        blocks = [np.diff(b, axis=1, prepend=np.zeros_like(b[:, :1])) for b in blocks]
    pack = {"packbits": (32773, packed), "deflate": (8, zlib.compress), "lzw": (5, lzw)}.get(layout, (1, bytes))
    parts = [pack[1](b.astype(kind).tobytes()) for b in blocks]
    offsets = np.cumsum([16, *map(len, parts)]).tolist()
    end = offsets.pop()
    short = {"256": (width,), "257": (height,), "258": (8 * pixels.dtype.itemsize,) * bands, "259": (pack[0],), "277": (bands,), "284": (2 if layout == "planar" else 1,), "317": (2 if differences else 1,)}
    long = {"322": (16,), "323": (16,), "324": offsets, "325": list(map(len, parts))} if tiled else {"273": offsets, "278": (3,), "279": list(map(len, parts))}
    values = [(int(t), 3, "H", v) for t, v in short.items()] + [(int(t), 16 if big else 4, "Q" if big else "I", v) for t, v in long.items()] + [(33550, 12, "d", (0.01, 0.02, 0.0)), (33922, 12, "d", (0.0, 0.0, 0.0, lon, lat, 0.0))]
    inline, word = (8, "Q") if big else (4, "I")
    beyond, entries = b"", b""
    for tag, code, letter, value in sorted(values):
        data = struct.pack(f"{order}{len(value)}{letter}", *value)
        if len(data) > inline:
            beyond, data = beyond + data, struct.pack(order + word, end + len(beyond))
        entries += struct.pack(f"{order}HH{word}", tag, code, len(value)) + data.ljust(inline, b"\0")
    at = end + len(beyond)
    head = struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at)
    count = struct.pack(order + ("Q" if big else "H"), len(values))
    return (b"MM" if order == ">" else b"II").ljust(2) + head.ljust(14, b"\0") + b"".join(parts) + beyond + count + entries + b"\0" * inline


def pictures(spark: SparkSession, sf: str) -> DataFrame:
    """path, content: each vector as an 8 x 8 picture of two bands, in the layout of its turn; some cut short."""

    def run(frames):
        for pdf in frames:
            rows = []
            for k, vector in zip(pdf["vec_id"].tolist(), pdf["embedding"], strict=True):
                own = np.floor(np.array(vector, float) * 256).astype(int).reshape(8, 8)
                kind = np.dtype("u2") if k % 3 == 0 else np.dtype("u1")
                content = picture(np.stack([own & 255, own + 37 * k & 255], 2).astype(kind), LAYOUTS[k % 8], -170 + k % 300, 80 - k % 100)
                rows.append((f"{LAYOUTS[k % 8]}/{k}.img", content[: len(content) // 2] if k % 23 == 0 else content))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return spread(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id").mapInPandas(run, "path string, content binary")


def written(spark: SparkSession, sf: str) -> str:
    folder = f"{shared_folder(spark)}/scenes-{uuid.uuid4().hex}"
    S.write_files(pictures(spark, sf), folder).agg(F.sum("length")).collect()
    return folder


NAMES = "[" + ", ".join(f"'{n}'" for n in LAYOUTS) + "]"


@query(f"""SELECT ({NAMES})[1 + vec_id % 8] || '/' || vec_id || '.img' AS path, CASE WHEN vec_id % 23 <> 0 THEN 8 END AS width, CASE WHEN vec_id % 23 <> 0 THEN 8 END AS height, CASE WHEN vec_id % 23 <> 0 THEN 2 END AS bands,
CASE WHEN vec_id % 23 <> 0 THEN CASE WHEN vec_id % 3 = 0 THEN 'uint16' ELSE 'uint8' END END AS kind, CASE WHEN vec_id % 23 <> 0 AND vec_id % 8 <> 7 THEN (-170 + vec_id % 300)::DOUBLE END AS min_lon, CASE WHEN vec_id % 23 <> 0 AND vec_id % 8 <> 7 THEN round(80 - vec_id % 100 - 0.16::DOUBLE, 6) END AS min_lat, vec_id % 23 <> 0 AS readable FROM embeddings""")
def scene_heads(spark: SparkSession, sf: str) -> DataFrame:
    heads = S.scenes(spark, written(spark, sf), "heads")
    return heads.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), "width", "height", "bands", "kind", "min_lon", F.round("min_lat", 6).alias("min_lat"), F.col("error").isNull().alias("readable"))


@query(f"""WITH v AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE vec_id % 23 <> 0),
b AS (SELECT vec_id, i, unnest([0, 1]) AS band, floor(256 * v::DOUBLE)::BIGINT AS own FROM v)
SELECT ({NAMES})[1 + vec_id % 8] || '/' || vec_id || '.img' AS path, band::INT AS band, count(*) AS n, sum(((own + CASE WHEN band = 1 THEN 37 * vec_id ELSE 0 END) & 255) * (1 + i))::DOUBLE AS mark FROM b GROUP BY ALL""")
def scene_pixels(spark: SparkSession, sf: str) -> DataFrame:
    pixels = S.scenes(spark, written(spark, sf))
    path = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path")
    return pixels.groupBy(path, "band").agg(F.count("value").alias("n"), F.sum(F.col("value") * (1 + F.col("y") * 8 + F.col("x"))).alias("mark"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE vec_id % 3 <> 0),
m AS (SELECT vec_id, (v::DOUBLE > 0.05::DOUBLE)::INT AS b, (v::DOUBLE > 0.08::DOUBLE OR i % 9 = 0)::INT AS a FROM v), s AS (SELECT vec_id, sum(a * b) AS i, sum(a) AS a, sum(b) AS b FROM m GROUP BY 1)
SELECT 'scene-' || vec_id AS scene, CASE WHEN a + b > 0 THEN round(2 * i / (a + b), 6) END AS dice, CASE WHEN a + b - i > 0 THEN round(i / (a + b - i), 6) END AS iou, CASE WHEN a > 0 THEN round(i / a, 6) END AS precision, CASE WHEN b > 0 THEN round(i / b, 6) END AS recall FROM s""")
def suite_truth_dice(spark: SparkSession, sf: str) -> DataFrame:
    """A suite's truth masks, written as PNG and named in its manifest, against what was found in its scenes."""

    def run(frames):
        for pdf in frames:
            made = [picture(((np.array(v, float) > 0.05) * 255).astype("u1").reshape(8, 8, 1), "png") for v in pdf["embedding"]]
            yield pd.DataFrame({"path": [f"truth/{k}.png" for k in pdf["vec_id"]], "content": made})

    vectors, folder = table(spark, sf, "embeddings"), f"{shared_folder(spark)}/suite-{uuid.uuid4().hex}"
    S.write_files(vectors.where("vec_id % 3 <> 0").select("vec_id", "embedding").mapInPandas(run, "path string, content binary"), folder).agg(F.sum("length")).collect()
    k = F.col("vec_id")
    listed = vectors.select((k % 8).alias("part"), F.struct(F.format_string("scene-%d", k).alias("scene"), (k % 3 != 0).alias("has_slick"), F.when(k % 3 != 0, F.format_string("truth/%d.png", k)).alias("truth")).alias("s"))
    listed.groupBy("part").agg(F.collect_list("s").alias("scenes")).write.json(f"{folder}/manifest")
    manifest = rasters.read_manifest(spark, f"{folder}/manifest")
    i = F.col("i")
    found = vectors.select(F.format_string("scene-%d", k).alias("scene"), F.posexplode("embedding").alias("i", "v"))
    found = found.select("scene", F.floor(i / 8).cast("int").alias("y"), (i % 8).alias("x"), ((F.col("v").cast("double") > 0.08) | (i % 9 == 0)).alias("m"))
    return R.dice(found, rasters.truth_masks(spark, manifest, folder)).select("scene", *[F.round(c, 6).alias(c) for c in ("dice", "iou", "precision", "recall")])
