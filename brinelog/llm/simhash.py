"""Near-duplicates by 64-bit SimHash with deletion-variant signatures.

A fingerprint is cut into two segments of 32 bits, so that of two fingerprints at most two bits apart one segment
differs by at most one bit. Each segment is indexed once per bit with that bit wiped out (a one-wildcard variant):
segments at most one bit apart share a variant. Fingerprints meet by equality of (segment, wildcard, rest), links
are verified on all 64 bits, and components follow by star contraction, written out each round.

A-Z is lower-cased; words are [^\\x20\\x09-\\x0D]+; shingles are three words, repeats included (fewer words: the
whole sequence; none, or null text: fingerprint zero). Equal fingerprints are one node before anything is paired, so
copies never meet each other. Within one variant, links are found by flipping bits and looking the result up, not by
pairs, once it holds more fingerprints than there are flips. Null doc_ids give rows but never name a component
unless it has no other id. Extra columns and empty tables need no care.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, saved

BLOCK = 1 << 16
PAIRWISE = 96


def fingerprint(text: bytes, size: int = 3) -> int:
    words = text.lower().split()  # bytes: A-Z only, and exactly the six white-space bytes
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(flat, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    ends, starts = ends[size - 1 :].tolist(), starts[: len(words) - size + 1].tolist()
    digest, n = xxhash.xxh64_digest, len(starts)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = b"".join([digest(flat[a:b], 42) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t or b"") for t in as_bytes(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def variants(nodes: DataFrame) -> DataFrame:
    """(variant, fp): 2 segments x 32 wildcards. The variant holds segment, wildcard and the segment's other bits."""
    half = F.when(F.col("segment") == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    bit = F.expr("shiftleft(1L, wildcard)")
    each = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("segment")).withColumn("half", half).withColumn("wildcard", F.explode(F.sequence(F.lit(0), F.lit(31))))
    key = F.col("half").bitwiseAND(F.bitwise_not(bit)).bitwiseOR(F.expr("shiftleft(CAST(segment * 32 + wildcard AS BIGINT), 32)"))
    return each.select(key.alias("variant"), "fp")


def flips(mask_bits: list[int], most: int) -> np.ndarray:
    """Bit patterns with 1 to `most` (1 or 2) of the given bits."""
    one = [np.uint64(1) << np.uint64(b) for b in mask_bits]
    two = [a | b for i, a in enumerate(one) for b in one[:i]] if most > 1 else []
    return np.array(one + two, np.uint64)


def bucket_links(key: int, fps: np.ndarray) -> list[tuple[int, int]]:
    """Links between sorted, distinct fingerprints of one variant: those that differ in the wildcard bit and, at wildcard 0,
    those with equal segments. That way a link is found once in each segment that allows it."""
    segment, wildcard = key >> 37, (key >> 32) & 31
    own, other = (32, 0) if segment == 0 else (0, 32)
    if len(fps) <= PAIRWISE:
        a, b = np.triu_indices(len(fps), 1)
        x = fps[a] ^ fps[b]
        linked = np.bitwise_count(x) <= 2
        if wildcard:
            linked &= (x >> np.uint64(own + wildcard)) & np.uint64(1) == 1
        return list(zip(fps[a[linked]].tolist(), fps[b[linked]].tolist(), strict=True))
    far = list(range(other, other + 32))
    at = np.uint64(1) << np.uint64(own + wildcard)
    masks = [np.array([at], np.uint64), flips(far, 1) | at] + ([flips(far, 2)] if wildcard == 0 else [])
    found = []
    for mask in np.concatenate(masks):
        to = fps ^ mask
        place = np.minimum(np.searchsorted(fps, to), len(fps) - 1)
        hit = (fps[place] == to) & (fps < to)
        found += zip(fps[hit].tolist(), to[hit].tolist(), strict=True)
    return found


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): the distinct links between distinct fingerprints, a < b as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # the last variant so far and its fingerprints, batch by batch

        def found(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.diff(k)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(k)]))
            several = ends - starts > 1
            pairs = []
            for s, e in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
                pairs += bucket_links(int(k[s]), np.sort(f[s:e]))
            if pairs:
                ab = np.sort(np.array(pairs, np.uint64).view(np.int64), axis=1)
                ab = np.unique(ab, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

        def ended() -> Iterator[pa.RecordBatch]:
            f = np.concatenate(held)
            return found(np.full(len(f), key), f)

        for batch in batches:
            k, f = batch.column("variant").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if held and len(k):
                own = int(np.searchsorted(k, key, "right"))
                held.append(f[:own])
                k, f = k[own:], f[own:]
                if len(k):
                    yield from ended()
            if len(k):
                last = int(np.searchsorted(k, k[-1]))
                key, held = int(k[-1]), [f[last:]]
                if last:
                    yield from found(k[:last], f[:last])
        if held:
            yield from ended()

    sorted_variants = variants(nodes).repartition("variant").sortWithinPartitions("variant")
    return sorted_variants.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link, by alternating large-star and small-star steps over written tables."""

    def nearest(pairs: DataFrame) -> DataFrame:
        return saved(pairs.groupBy("u").agg(F.min("v").alias("m")), "stars")

    edges = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = nearest(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large, "large")
        m = nearest(large)
        small = large.join(m, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = saved(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per document."""
    rows = saved(fingerprints(docs), "fingerprints")
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = saved(components(links(nodes)), "roots")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = saved(rooted.join(names, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
