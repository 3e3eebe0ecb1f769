"""Hard-negative mining over Hilbert-ordered blocks of vectors with zone maps.

Components become floor(256 x). Vectors are laid along a Hilbert curve through eight of their coarse coordinates (means of
consecutive components, squashed to seven bits), label by label, and written as blocks: a range of the curve each, one folder of
Parquet a block. A block's zone map holds the least and greatest value of every component and of the label. For an anchor, interval
arithmetic on a zone map bounds the scores that the block can hold from both sides:
sum of min(a * low, a * high) <= score <= sum of max(a * low, a * high), widened by what rounding could take.

An anchor's positives are looked for in its own block first, which gives a score that the last of them reaches at least; then in those
blocks of its label that can reach it. The windows of its positives (a share of a positive's score up to the score itself) are filled from
the block of other labels that promises most, and then from every block whose bounds still meet a window above the scores already
found. A block is read for an anchor only then; whatever isn't read is proven unable to matter, and nothing is capped. On vectors without
any structure no block can be ruled out, and every anchor reads all.

Groups of anchors (in order of the curve too) have zone maps of their own, so whole lots of blocks are ruled out for a whole group before
anchors travel. A task holds one block and one group of anchors, of bounded size; equal vectors are dealt over several blocks by a hash.

Rows with a null label, vec_id or vector, or with a null or non-finite component take no part; vectors of different length never meet; an
anchor's own vec_id is neither its positive nor its negative, and other rows that repeat a vec_id are rows of their own. Ties go to the
smaller vec_id. A positive with a negative score has no window. Squared lengths must stay below 2**53, so that scores are exact; a longer
vector ends the job with an error. Vectors without components score 0. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, shared_folder

AXES, BITS = 8, 7
ANCHOR = ["anchor", "vec_id", "label", "x", "size", "own", "group", "windows"]
BUNDLE = 256
STRIP = 64
FOUND = "anchor long, slot long, vec_id long, score long"
LOW = -(2.0**62)


def hilbert_keys(axes: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points with whole coordinates of so many bits, one point a row (Skilling's transform)."""
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo excess work, from the highest bit
        low = bit - 1
        for i in range(n):
            on = (x[i] & bit) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    last, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        last ^= np.where((x[-1] & bit) > 0, bit - 1, 0)
        bit >>= 1
    x ^= last
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def coarse(x: np.ndarray) -> np.ndarray:
    """Means of consecutive components, each squashed to a whole number of BITS bits by its arc tangent at the scale of a row."""
    n = min(AXES, x.shape[1])
    if not n:
        return np.zeros((len(x), 1), np.int64)
    edges = np.linspace(0, x.shape[1], n + 1).astype(int)
    means = np.stack([x[:, a:b].mean(1) * np.sqrt(b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)], 1)
    scale = np.sqrt((x * x).mean(1, keepdims=True)) + 1e-9
    return np.clip(((np.arctan(means / scale) / np.pi + 0.5) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def score_bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the products of each row of a with anything between each row of low and high."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    slack = 1e-9 * (np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T) + 1e-6
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def box_bounds(a_low: np.ndarray, a_high: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the products of anything in one box with anything in each box, a row of low and high."""
    corners = np.stack([a_low * low, a_low * high, a_high * low, a_high * high])
    slack = 1e-9 * np.abs(corners).max(0).sum(1) + 1e-6
    return corners.min(0).sum(1) - slack, corners.max(0).sum(1) + slack


def first_best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores (those at -inf left out), of equal ones the first."""
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        above, equal = np.flatnonzero(score > kth), np.flatnonzero(score == kth)
        at = np.concatenate([above, equal[: k - len(above)]])
    else:
        at = np.arange(len(score))
    at = at[score[at] > -np.inf]
    return at[np.lexsort((at, -score[at]))]


def searched_block(anchors: pd.DataFrame, block: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """For every anchor and slot of a window (low, high) the k best rows of the block: of its label or of any other."""
    block = block.sort_values("vec_id", kind="stable")
    ids, labels, rows = block["vec_id"].to_numpy(), block["label"].to_numpy(), np.stack(block["x"])
    found = []
    for start in range(0, len(anchors), STRIP):
        part = anchors.iloc[start : start + STRIP]
        scores = np.stack(part["x"]) @ rows.T
        for key, anchor, label, windows, score in zip(part["anchor"], part["vec_id"], part["label"], part["windows"], scores, strict=True):
            score[(ids == anchor) | ((labels == label) != same)] = -np.inf
            for window in windows:
                inside = score if window["low"] <= LOW and window["high"] >= -LOW else np.where((score >= window["low"]) & (score <= window["high"]), score, -np.inf)
                found += [(key, window["slot"], ids[i], int(score[i])) for i in first_best(inside, k)]
    return pd.DataFrame(found, columns=["anchor", "slot", "vec_id", "score"], dtype="int64")


class Blocks:
    """The vectors of a table as Hilbert-ordered blocks, written once, with zone maps."""

    def __init__(self, vectors: DataFrame, is_anchor: Column, block_rows: int = 1 << 14, group_rows: int = 1 << 13, lot: int = 512) -> None:
        """vectors: vec_id, label, embedding."""
        x = F.transform("embedding", lambda v: F.floor(v.cast("double") * 256).cast("double"))
        usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
        usable &= ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where(usable)
        rows = rows.select("vec_id", "label", x.alias("x"), F.size("embedding").alias("size"))
        square = F.aggregate("x", F.lit(0.0), lambda total, v: total + v * v)
        rows = rows.withColumn("vec_id", F.when(square < 2.0**53, F.col("vec_id")).otherwise(F.raise_error(F.lit("a vector is too long for exact scores")).cast("long")))

        def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                key = np.zeros(len(pdf), np.int64)
                for size, at in pdf.groupby("size").indices.items():
                    key[at] = hilbert_keys(coarse(np.stack(pdf["x"].to_numpy()[at]).reshape(len(at), size)), BITS)
                yield pdf.assign(curve=key)

        rows = saved(rows.mapInPandas(keyed, "vec_id long, label long, x array<double>, size int, curve long"), "keyed")
        n = rows.count()
        blocks = max(8, -(-n // block_rows))
        dealt = rows.repartitionByRange(blocks, "size", "label", "curve", F.xxhash64("vec_id"), "vec_id").withColumn("block", F.spark_partition_id())
        path = f"{shared_folder(vectors.sparkSession)}/blocks-{uuid.uuid4().hex}"
        dealt.write.partitionBy("block").option("compression", "zstd").parquet(path)
        self.rows = vectors.sparkSession.read.schema(dealt.schema).parquet(path)
        anchors = self.rows.where(is_anchor).withColumnRenamed("block", "own")
        groups = max(1, -(-anchors.count() // group_rows))
        anchors = anchors.repartitionByRange(groups, "size", "own", F.xxhash64("vec_id")).withColumn("group", F.spark_partition_id())
        self.anchors = saved(anchors.select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "x", "size", "own", "group"), "anchors")

        def zone(pdf: pd.DataFrame) -> pd.DataFrame:
            stacked = np.stack(pdf["x"])
            return pd.DataFrame({"size": pdf["size"][:1], "block": pdf["block"][:1], "low": [stacked.min(0)], "high": [stacked.max(0)], "label_low": [pdf["label"].min()], "label_high": [pdf["label"].max()]})

        def hull(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"size": pdf["size"][:1], "lot": pdf["lot"][:1], "low": [np.stack(pdf["low"]).min(0)], "high": [np.stack(pdf["high"]).max(0)]})

        zones = self.rows.groupBy("size", "block").applyInPandas(zone, "size int, block int, low array<double>, high array<double>, label_low long, label_high long")
        self.zones = saved(zones.withColumn("lot", F.floor(F.col("block") / lot).cast("int")), "zones")
        hulls = self.zones.groupBy("size", "lot").applyInPandas(hull, "size int, lot int, low array<double>, high array<double>")
        self.lots = saved(hulls.withColumn("lots", F.floor(F.col("lot") / BUNDLE)), "lots")

    def read(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """FOUND: the k best rows in each window, within the blocks that anchors ask for (ANCHOR and block)."""
        keys = ["size", "group", "block"]

        def run(anchors: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            if not len(anchors) or not len(block):
                return pd.DataFrame({c: [] for c in ("anchor", "slot", "vec_id", "score")}, dtype="int64")
            return searched_block(anchors, block, k, same)

        wanted = asked.select(*[F.col(c).alias(c) for c in keys]).distinct()
        blocks = self.rows.join(wanted, ["size", "block"]).select("vec_id", "label", "x", *keys)
        return saved(asked.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(run, FOUND), "found")

    def asking(self, anchors: DataFrame, same: bool, best_only: bool = False) -> DataFrame:
        """What to read: each anchor (ANCHOR) with every block whose bounds meet one of its windows
        and which may hold its label (or another one), or only with the one that promises most. `own` names a block that has been read."""
        kind = "anchor long, vec_id long, label long, x array<double>, size int, own int, `group` int, windows array<struct<slot:int,low:double,high:double>>, block int, most double"
        columns = [*ANCHOR, "block", "most"]

        def reach(windows: list) -> tuple[float, float]:
            return min((w["low"] for w in windows), default=np.inf), max((w["high"] for w in windows), default=-np.inf)

        def box(pdf: pd.DataFrame) -> pd.DataFrame:
            stacked, reaches = np.stack(pdf["x"]), [reach(w) for w in pdf["windows"]]
            return pd.DataFrame({"size": pdf["size"][:1], "group": pdf["group"][:1], "g_low": [stacked.min(0)], "g_high": [stacked.max(0)], "least": [min(r[0] for r in reaches)], "most": [max(r[1] for r in reaches)]})

        boxes = saved(anchors.groupBy("size", "group").applyInPandas(box, "size int, `group` int, g_low array<double>, g_high array<double>, least double, most double"), "boxes")

        def met(groups: pd.DataFrame, lots: pd.DataFrame) -> pd.DataFrame:
            if not len(groups) or not len(lots):
                return pd.DataFrame({"size": [], "group": [], "lot": []}, dtype="int32")
            low, high, found = np.stack(lots["low"]), np.stack(lots["high"]), []
            for size, group, g_low, g_high, floor, ceiling in zip(*(groups[c] for c in ("size", "group", "g_low", "g_high", "least", "most")), strict=True):
                least, most = box_bounds(g_low, g_high, low, high)
                found += [(size, group, lot) for lot in lots["lot"].to_numpy()[(most >= floor) & (least <= ceiling)]]
            return pd.DataFrame(found, columns=["size", "group", "lot"], dtype="int32")

        def every(column: str, of: DataFrame) -> Column:
            last = of.agg(F.max(column)).first()[0]
            return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long"))).alias(column)

        boxes = boxes.withColumn("groups", F.floor(F.col("group") / BUNDLE))
        meet = ["size", "groups", "lots"]
        near, far = boxes.select("*", every("lots", self.lots)).groupBy(*meet), self.lots.select("*", every("groups", boxes)).groupBy(*meet)
        pairs = saved(near.cogroup(far).applyInPandas(met, "size int, `group` int, lot int"), "pairs")

        def called(asked: pd.DataFrame, zones: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(zones):
                return pd.DataFrame({c: [] for c in columns}, dtype=object)
            least, most = score_bounds(np.stack(asked["x"]), np.stack(zones["low"]), np.stack(zones["high"]))
            label, first, last = asked["label"].to_numpy()[:, None], zones["label_low"].to_numpy(), zones["label_high"].to_numpy()
            may = (first <= label) & (label <= last) if same else (first != label) | (last != label)
            may = may & (zones["block"].to_numpy() != asked["own"].to_numpy()[:, None])
            meets = np.zeros_like(may)
            for i, windows in enumerate(asked["windows"]):
                for w in windows:
                    meets[i] |= (most[i] >= w["low"]) & (least[i] <= w["high"])
            i, j = np.nonzero(may & meets)
            out = asked.iloc[i].assign(block=zones["block"].to_numpy()[j], most=most[i, j])
            if best_only:
                out = out.sort_values("most", ascending=False).drop_duplicates("anchor")
            return out[columns]

        asked = anchors.join(pairs, ["size", "group"]).groupBy("size", "group", "lot")
        again = pairs.select(*[F.col(c).alias(c) for c in ("size", "group", "lot")])
        told = self.zones.join(again, ["size", "lot"]).groupBy("size", "group", "lot")
        calls = asked.cogroup(told).applyInPandas(called, kind)
        if best_only:
            one = Window.partitionBy("anchor").orderBy(F.desc("most"), "block")
            calls = calls.withColumn("place", F.row_number().over(one)).where("place = 1").drop("place")
        return saved(calls.drop("most"), "calls")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """anchor, slot, rank, vec_id, score: the k best of all blocks' finds."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def floors_of(found: DataFrame, k: int) -> DataFrame:
    """anchor, slot, floor: the k-th best score so far, of windows that have k finds."""
    return best_of(found, k).where(F.col("rank") == k).select("anchor", "slot", F.col("score").cast("double").alias("floor"))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, **sizes: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from vec_id, label, embedding.

    Negatives of a positive have another label than the anchor and a score between `least` and `most` hundredths of the positive's."""
    blocks = Blocks(vectors, is_anchor, **sizes)
    window = lambda slot, low, high: F.struct(slot.cast("int").alias("slot"), low.cast("double").alias("low"), high.cast("double").alias("high"))
    everything = F.array(window(F.lit(0), F.lit(LOW), F.lit(-LOW)))
    anchors = blocks.anchors.withColumn("windows", everything)
    near = blocks.read(anchors.withColumn("block", F.col("own")), positives, True)
    known = anchors.join(floors_of(near, positives).drop("slot"), "anchor", "left")
    narrowed = known.withColumn("windows", F.array(window(F.lit(0), F.coalesce("floor", F.lit(LOW)), F.lit(-LOW)))).select(*ANCHOR)
    far = blocks.read(blocks.asking(saved(narrowed, "narrowed"), True), positives, True)
    chosen = best_of(near.unionByName(far), positives).select("anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    chosen = saved(chosen, "positives")

    p = F.col("positive_score")
    own = chosen.where(p >= 0).groupBy("anchor").agg(F.collect_list(window(F.col("slot"), F.expr(f"(positive_score * {least} + 99) div 100"), F.expr(f"positive_score * {most} div 100"))).alias("windows"))  # `positives` a row
    asking = saved(blocks.anchors.drop("own").join(own, "anchor").withColumn("own", F.lit(-1)).select(*ANCHOR), "windows")
    best = blocks.asking(asking, False, best_only=True)
    first = blocks.read(best, negatives, False)
    floors = floors_of(first, negatives).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "floor"))).alias("floors"))
    raised = F.transform("windows", lambda w: F.struct(w["slot"].alias("slot"), F.coalesce(F.col("floors")[w["slot"].cast("long")], w["low"]).alias("low"), w["high"].alias("high")))
    asking = asking.drop("own").join(best.select("anchor", F.col("block").alias("own")), "anchor").join(floors, "anchor", "left")
    rest = blocks.read(blocks.asking(saved(asking.withColumn("windows", raised).select(*ANCHOR), "raised"), False), negatives, False)
    found = best_of(first.unionByName(rest), negatives).withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    names = blocks.anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    return found.join(chosen, ["anchor", "slot"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
