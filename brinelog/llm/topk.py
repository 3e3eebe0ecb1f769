"""Exact top-k search by inner product with multi-resolution segment statistics.

Components are turned into floor(256 x). A vector is cut into equal segments, described by their means and
deviations; by Cauchy and Schwarz a segment of length n adds at most n (mean mean' + dev dev') to the inner product,
which bounds the squared distance |q|^2 + |c|^2 - 2 q.c from below. The bound is taken over few wide segments first
and over more and narrower ones for what is left; survivors get their exact integer product.

Candidates lie in blocks of like vectors (dealt by range of the signs of their segment means), and each block has an
envelope: the range of its segment means, its largest deviations. A query is first searched in its own block, which gives it
a score that its fifth best reaches at least. It then travels only to blocks whose envelope allows that score, and a block
travels only to groups of queries some of which call for it; whatever is left out is proven unable to matter. The best k of
every block are merged.

Null vectors and vectors with a null or non-finite component take no part; vectors of different length never meet; ties
go to the smaller vec_id; rows that repeat a vec_id are candidates of their own, except that a query never meets a row of
its own id. Products must stay below 2**53, so that they are exact in doubles: a vector whose squared length reaches that
ends the job with an error. Null vec_ids take no part. Extra columns and empty tables need no care.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

LEVELS = (2, 8, 16)
STRIP = 128
FOUND = "query_id long, vec_id long, score long"


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row the segments' means and deviations, scaled by the root of their length: products of rows bound inner products."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part, root = x[:, a:b], np.sqrt(b - a)
        out += [root * part.mean(1), root * part.std(1)]
    return np.stack(out, 1)


def block_topk(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """The best k candidates of each query within one block, of those that reach its floor."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    levels = [(statistics(q, n), statistics(c, n)) for n in LEVELS]
    slack = 1e-9 * (np.linalg.norm(q, axis=1).max(initial=0) * np.linalg.norm(c, axis=1).max(initial=0)) + 1e-6
    found = []
    for i, query_id in enumerate(q_ids):
        if i % STRIP == 0:
            coarse = levels[0][0][i : i + STRIP] @ levels[0][1].T
        bound = coarse[i % STRIP]
        bound[c_ids == query_id] = -np.inf
        near = np.argpartition(-bound, min(2 * k, len(bound)) - 1)[: 2 * k]
        near = near[bound[near] > -np.inf]
        floor = max(np.sort(c[near] @ q[i])[-k] if len(near) >= k else -np.inf, -np.inf if floors is None else floors[i])
        left = np.flatnonzero((bound >= floor - slack) & (bound > -np.inf))
        for q_stat, c_stat in levels[1:]:
            left = left[c_stat[left] @ q_stat[i] >= floor - slack]
        score = np.rint(c[left] @ q[i]).astype(np.int64)
        best = np.lexsort((c_ids[left], -score))[:k]
        found += [(int(query_id), int(c_ids[left[j]]), int(score[j])) for j in best]
    return found


def envelope_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bounds of queries' products with anything in blocks, from the ranges of the blocks' statistics (never negative deviations),
    widened by more than rounding can take from sums of so large terms, whatever their signs."""
    stats = statistics(q, LEVELS[-1])
    slack = 1e-9 * (np.abs(stats) @ np.maximum(np.abs(low), np.abs(high)).T) + 1e-6
    return np.maximum(stats, 0) @ high.T + np.minimum(stats, 0) @ low.T + slack


def exact_topk(vectors: DataFrame, is_query, k: int = 5, candidate_block: int = 1 << 15, query_block: int = 1 << 14, envelopes: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates, its own row left out."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * 256).cast("double"))
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable).select("vec_id", x.alias("x"), F.size("embedding").alias("size"))
    square = F.aggregate("x", F.lit(0.0), lambda total, v: total + v * v)
    rows = rows.withColumn("vec_id", F.when(square < 2.0**53, F.col("vec_id")).otherwise(F.raise_error(F.lit("a vector is too long for exact products"))))
    n = vectors.count()
    c_blocks = max(8, -(-n // candidate_block))
    share = lambda i: F.slice("x", F.floor(F.col("size") * i / 8).cast("int") + 1, F.greatest(F.lit(1), F.floor(F.col("size") / 8).cast("int")))
    signs = [F.when(F.aggregate(share(i), F.lit(0.0), lambda total, v: total + v) > 0, 1 << i).otherwise(0) for i in range(8)]
    code = sum(signs[1:], signs[0])
    dealt = rows.repartitionByRange(c_blocks, "size", code, F.xxhash64("vec_id", "x")).withColumn("cb", F.spark_partition_id())
    rows = saved(dealt, "vectors")
    queries = rows.where(is_query(F.col("vec_id")))
    q_blocks = max(1, -(-queries.count() // query_block))
    queries = saved(queries.withColumn("qb", F.floor(F.col("cb") * q_blocks / c_blocks).cast("int")), "queries")
    keys = ["size", "qb", "cb"]

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        floors = q["floor"].to_numpy() if "floor" in q else None
        found = block_topk(q["vec_id"].to_numpy(), np.stack(q["x"]), c["vec_id"].to_numpy(), np.stack(c["x"]), k, floors) if q["size"][0] else [
            (a, b, 0) for a in q["vec_id"] for b in sorted(x for x in c["vec_id"] if x != a)[:k]]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    def searched(queries: DataFrame) -> DataFrame:
        wanted = queries.select(*[F.col(c).alias(c) for c in keys]).distinct()
        return queries.groupBy(*keys).cogroup(rows.join(wanted, ["size", "cb"]).groupBy(*keys)).applyInPandas(run, FOUND)

    def envelope(pdf: pd.DataFrame) -> pd.DataFrame:
        stats = statistics(np.stack(pdf["x"]), LEVELS[-1]) if pdf["size"][0] else np.zeros((1, 1))
        return pd.DataFrame({"size": pdf["size"][:1], "cb": pdf["cb"][:1], "low": [stats.min(0)], "high": [stats.max(0)]})

    def called(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(e):
            return pd.DataFrame({"vec_id": [], "x": [], "size": [], "floor": [], "qb": [], "cb": []}, dtype=object)
        vectors = np.stack(q["x"])
        bound = envelope_bounds(vectors, np.stack(e["low"]), np.stack(e["high"])) if q["size"][0] else np.zeros((len(q), len(e)))
        may = (bound >= q["floor"].to_numpy()[:, None]) & (q["cb"].to_numpy()[:, None] != e["cb"].to_numpy())
        i, j = np.nonzero(may)
        return q.iloc[i][["vec_id", "x", "size", "floor", "qb"]].assign(cb=e["cb"].to_numpy()[j])

    near = saved(searched(queries.select("vec_id", "x", *keys)), "near")
    kth = F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).cast("double")
    floors = near.groupBy(F.col("query_id").alias("vec_id")).agg(kth.alias("floor"))
    known = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    ends = rows.groupBy("size", "cb").applyInPandas(envelope, "size int, cb int, low array<double>, high array<double>").withColumn("lot", F.floor(F.col("cb") / envelopes).cast("int"))
    ends = saved(ends, "envelopes")
    lots = F.explode(F.sequence(F.lit(0), F.lit((c_blocks + 1024) // envelopes))).alias("lot")
    asked = known.select("vec_id", "x", "floor", *keys, lots).groupBy("size", "qb", "lot")
    told = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(q_blocks))).alias("qb")).groupBy("size", "qb", "lot")
    far = saved(asked.cogroup(told).applyInPandas(called, "vec_id long, x array<double>, size int, floor double, qb int, cb int"), "called")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = near.unionByName(searched(far)).withColumn("rank", F.row_number().over(best))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
