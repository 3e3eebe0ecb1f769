"""Exact top-k where blocks are many and scores negative, tied or very large."""

import numpy as np
import pytest

from brinelog.llm import topk


def searched(spark, rows, **sizes):
    frame = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows], "vec_id long, embedding array<double>")
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_topk(frame, lambda v: v % 50 == 0, **sizes).collect())


def brute(rows):
    whole = [(i, np.floor(np.array(x, float) * 256)) for i, x in rows]
    found = []
    for i, x in whole:
        if i % 50 == 0:
            best = sorted((-sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), j) for j, y in whole if j != i)[:5]
            found += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    return sorted(found)


def test_equal_negative_scores_in_many_blocks(spark):
    rows = [(i, [-10, 1, 1, 1]) for i in range(1, 1000) if i % 50] + [(500, [10, 10, 10, 10])]
    assert searched(spark, rows, candidate_block=64, envelopes=4) == [(500, k, k, -4587520) for k in range(1, 6)]


@pytest.mark.parametrize("scale", [1e-2, 1.0, 1e4, 1.8e4])
def test_all_scores_negative(spark, scale):
    rng = np.random.default_rng(int(scale))
    rows = [(i, (rng.integers(1, 9, 6) * (scale if i % 50 == 0 else -scale)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[1][1]) for i in range(1, 40)]
    assert searched(spark, rows, candidate_block=40, query_block=4, envelopes=3) == brute(rows)
