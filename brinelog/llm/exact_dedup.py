"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Documents are written once, bucketed by the part of the scan they came in. Each part (a sender) sorts the 64-bit
fingerprints of its texts and sends every owner of a fingerprint range one compressed block. An owner decodes its blocks,
finds the fingerprints that occur more than once anywhere and answers each sender with a bitmap over the order that was
sent. Only texts whose bit is set (the suspects) are shuffled, to be compared as bytes; all others never leave their part.
Blocks are as many as documents at most: a sender has none for an owner that none of its fingerprints belong to.

Texts are compared after removing the characters [\\x20\\x09-\\x0D]; null counts as empty. Of equal texts the row
with the most code points stays, then the smallest doc_id (null before all others), then one row of those that
repeat an id: rows are told apart by their place, never by doc_id. An empty table gives an empty result. Extra columns
are ignored, or kept as they are by `without_copies`. A task holds the texts of one part (spark.sql.files.maxPartitionBytes).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, as_bytes, numbered, rows_at, saved

DIGESTS = "part long, row int, doc_id long, n_points long, text_sha256 string, owner int, slot int, n int, block binary"


def golomb_encode(values: np.ndarray, shift: int) -> bytes:
    """Sorted unsigned values as Golomb-Rice codes of their differences: all quotients by 2**shift in unary, then all low bits."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    stops = np.cumsum((gaps >> np.uint64(shift)).astype(np.int64) + 1)
    unary = np.ones(int(stops[-1]), np.uint8)
    unary[stops - 1] = 0
    low = (gaps[:, None] >> np.arange(shift, dtype=np.uint64)[::-1]) & np.uint64(1)
    return np.packbits(unary).tobytes() + np.packbits(low.astype(np.uint8).ravel()).tobytes()


def golomb_decode(block: bytes, n: int, shift: int) -> np.ndarray:
    cut = len(block) - -(-n * shift // 8)
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(block[:cut], np.uint8)) == 0)[:n]
    quotient = (np.diff(stops, prepend=-1) - 1).astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(block[cut:], np.uint8))[: n * shift].reshape(n, shift).astype(np.uint64)
    low = (bits << np.arange(shift, dtype=np.uint64)[::-1]).sum(1, dtype=np.uint64)
    return np.cumsum((quotient << np.uint64(shift)) | low, dtype=np.uint64)


def rice_shift(n: int, span: float) -> int:
    """Low bits to keep for n sorted values over a range of the given width."""
    return int(max(0, min(63, np.floor(np.log2(max(1.0, 0.69 * span / max(n, 1)))))))


def digests(rows: DataFrame, owner_bits: int) -> DataFrame:
    """One row per document with its fingerprint's place in the order sent, and one row per block sent (n not null)."""

    def run(texts: pa.Table) -> pa.Table:
        points, raw = [], []
        for text in as_bytes(texts.column("text")):
            text = text or b""
            points.append(len(text) if text.isascii() else len(text.decode()))
            raw.append(hashlib.sha256(text.translate(None, WHITESPACE)).digest())
        fp = np.frombuffer(b"".join(raw), ">u8")[::4].astype(np.uint64)
        order = np.argsort(fp, kind="stable")
        fp = fp[order]
        owner = (fp >> np.uint64(64 - owner_bits)).astype(np.int32)
        own, first, sizes = np.unique(owner, return_index=True, return_counts=True)
        part, width = texts.column("part")[0].as_py(), 1 << (64 - owner_bits)
        local = fp & np.uint64(width - 1)
        blocks = [golomb_encode(local[a : a + n], rice_shift(n, width)) for a, n in zip(first.tolist(), sizes.tolist(), strict=True)]
        none = lambda kind, n: pa.nulls(n, kind)
        n, k = len(fp), len(own)
        at = pa.array(order)
        sent = [
            pa.array(np.full(n + k, part, np.int64)), pa.concat_arrays([texts.column("row").combine_chunks().take(at), none(pa.int32(), k)]),
            pa.concat_arrays([texts.column("doc_id").combine_chunks().take(at), none(pa.int64(), k)]), pa.concat_arrays([pa.array(points, pa.int64()).take(at), none(pa.int64(), k)]),
            pa.array([*(raw[i].hex() for i in order.tolist()), *[None] * k], pa.string()), pa.array(np.concatenate((owner, own))),
            pa.concat_arrays([pa.array((np.arange(n) - np.repeat(first, sizes)).astype(np.int32)), none(pa.int32(), k)]),
            pa.concat_arrays([none(pa.int32(), n), pa.array(sizes.astype(np.int32))]), pa.concat_arrays([none(pa.binary(), n), pa.array(blocks, pa.binary())]),
        ]
        return pa.table(sent, [c.split()[0] for c in DIGESTS.split(", ")])

    return rows.groupBy("part").applyInArrow(run, DIGESTS)


def answers(blocks: DataFrame, owner_bits: int) -> DataFrame:
    """For each block received: the bitmap (64 bits a word) of fingerprints that occur more than once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        width = 1 << (64 - owner_bits)
        lists = [golomb_decode(b, n, rice_shift(n, width)) for b, n in zip(pdf["block"], pdf["n"], strict=True)]
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        twice = values[counts > 1]
        maps = []
        for own in lists:
            bits = np.zeros(-(-len(own) // 64) * 64, np.uint8)
            if len(twice):
                at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
                bits[: len(own)] = twice[at] == own
            maps.append(np.packbits(bits, bitorder="little").view(np.int64))
        return pd.DataFrame({"part": pdf["part"], "owner": pdf["owner"], "bitmap": maps})

    return blocks.groupBy("owner").applyInPandas(run, "part long, owner int, bitmap array<long>")


def marked_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (part, row, doc_id, text): the digests of documents that no other equals, and of the suspects with keep_id, group_size and kept."""
    owner_bits = max(4, (rows.count() // 1_000_000).bit_length())
    sent = saved(digests(rows, owner_bits), "digests")
    bitmaps = saved(answers(sent.where("n is not null").select("part", "owner", "n", "block"), owner_bits), "bitmaps")
    marked = sent.where("n is null").drop("n", "block").join(bitmaps, ["part", "owner"]).withColumn("suspect", F.expr("getbit(bitmap[slot div 64], slot % 64) = 1"))
    marked = saved(marked.drop("bitmap", "owner", "slot"), "marked")
    suspects = marked.where("suspect")

    # The suspects' texts themselves: a digest that stands for two different texts would end the job.
    norm = F.translate(F.coalesce("text", F.lit("")), WHITESPACE.decode(), "").alias("norm")
    bodies = rows_at(rows.select("part", "row", "text"), suspects).select(norm).select("norm", F.sha2("norm", 256).alias("sha"))
    verified = bodies.groupBy("sha", "norm").agg(F.count("*").alias("copies")).groupBy("sha").agg(F.count("*").alias("n_texts"))
    same = F.struct((-F.col("n_points")).alias("m"), "doc_id", "part", "row")
    groups = suspects.groupBy("text_sha256").agg(F.min(same).alias("first"), F.count("*").alias("group_size"))
    groups = groups.join(verified, groups.text_sha256 == verified.sha)
    size = F.when(F.col("n_texts") > 1, F.raise_error(F.lit("one digest, two texts"))).otherwise(F.col("group_size"))
    groups = saved(groups.select("text_sha256", "first", size.cast("long").alias("group_size")), "groups")
    told = suspects.join(groups, "text_sha256").select("part", "row", "doc_id", "text_sha256", F.col("first.doc_id").alias("keep_id"), "group_size", (same == F.col("first")).alias("kept"))
    return marked.where("NOT suspect"), told


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document, dropped ones too."""
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "texts")
    alone, told = marked_copies(rows)
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256").unionByName(told.select(out))


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents, but of each group of equal texts only the row that `exact_dedup` keeps; all columns as they are."""
    rows = numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "texts", "doc.text")
    _, told = marked_copies(rows.select("part", "row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text")))
    return rows_at(rows, told.where("NOT kept"), inside=False).select("doc.*")
