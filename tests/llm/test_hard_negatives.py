"""Hard negatives against brute force: structure and none, ties, odd rows, signs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinelog.llm import hard_negatives

KIND = "vec_id long, label long, embedding array<float>, size string, block string"


def brute(rows, positives=5, negatives=5):
    whole = [(i, label, np.floor(np.float32(x).astype(float) * 256)) for i, label, x in rows if None not in (i, label, x) and None not in x and np.isfinite(x).all()]
    found = []
    for anchor, label, a in whole:
        if anchor % 100:
            continue
        scored = [(-int(a @ x), i, other) for i, other, x in whole if i != anchor and len(x) == len(a)]
        for score, i, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            inside = sorted(s[:2] for s in scored if s[2] != label and 80 * -score <= 100 * -s[0] <= 100 * -score)[:negatives]
            found += [(anchor, i, k + 1, n, -score, -s) for k, (s, n) in enumerate(inside)]
    return sorted(found)


def mined(spark, rows, **sizes):
    frame = spark.createDataFrame([(i, label, None if x is None else [v if v is None else float(v) for v in x], "s", "b") for i, label, x in rows], KIND)
    return sorted(map(tuple, hard_negatives.mine(frame, F.col("vec_id") % 100 == 0, **sizes).collect()))


def test_the_curve_takes_single_steps():
    for n, bits in ((2, 4), (3, 3), (5, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        keys = hard_negatives.hilbert_keys(points, bits)
        assert sorted(keys.tolist()) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for scale in (3, 1e4, 2.0**24):
        a, rows = np.floor(rng.normal(size=(9, 12)) * scale), np.floor(rng.normal(size=(50, 12)) * scale + scale / 2)
        low, high = rows.min(0, keepdims=True), rows.max(0, keepdims=True)
        least, most = hard_negatives.score_bounds(a, low, high)
        assert (least <= (a @ rows.T).min(1, keepdims=True)).all() and (most >= (a @ rows.T).max(1, keepdims=True)).all()
        least, most = hard_negatives.box_bounds(a.min(0), a.max(0), low, high)
        assert least[0] <= (a @ rows.T).min() and most[0] >= (a @ rows.T).max()


@pytest.mark.parametrize("structure", [0.05, 1.0])
def test_mining_is_brute_force(spark, structure):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 16))
    x = centres[rng.integers(0, 8, 900)] + structure * rng.normal(size=(900, 16))
    rows = [(i * 5, int(rng.integers(0, 3)), (x[i] / np.linalg.norm(x[i])).tolist()) for i in range(900)]
    got = mined(spark, rows, block_rows=32, group_rows=16, lot=4)
    assert got == brute(rows) and got


def test_ties_signs_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    same = [(100 + k, k % 2, [0.5, 0.25, 0.0]) for k in range(300)]  # 100, 200 and 300 are anchors among equal vectors
    against = [(1000, 0, [-1.0, -1.0, -1.0]), (1100, 5, [1.0, 1.0, 1.0]), (1200, 0, [0.0, 0.0, 0.0])]
    odd = [(None, 0, [1.0] * 3), (2000, None, [1.0] * 3), (2001, 1, None), (2100, 1, [None, 1.0, 1.0]), (2200, 1, [float("nan"), 1.0, 1.0]), (2300, 1, [float("inf"), 0.0, 0.0])]
    lengths = [(3000, 1, [0.5]), (3001, 1, [0.25]), (3002, 2, [0.25]), (3100, 1, []), (3101, 1, []), (3102, 2, [])]
    some = [(4000 + k, int(rng.integers(0, 4)), rng.normal(size=3).tolist()) for k in range(101)]
    rows = same + against + odd + lengths + some
    assert mined(spark, rows, block_rows=40, group_rows=2, lot=2) == brute(rows)


def test_repeated_rows_and_none(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 2, [0.0, 1.0]), (1, 1, [0.5, 0.5]), (2, 2, [0.45, 0.45]), (2, 2, [0.45, 0.45]), (3, 2, [0.4, 0.4])]
    assert mined(spark, rows) == brute(rows) != []
    assert mined(spark, [], block_rows=4) == [] == mined(spark, [(1, 1, [1.0])])
    with pytest.raises(Exception, match="too long"):
        mined(spark, [(0, 1, [1e9]), (1, 1, [1.0])])
