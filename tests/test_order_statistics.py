"""Percentiles by counting against numpy."""

import numpy as np
import pytest

from brinelog.operators.order_statistics import percentiles

SHARES = [0.0, 0.5, 0.9, 0.333, 1.0]


@pytest.mark.parametrize("gathered", [3, 4096])
def test_percentiles_are_numpys(spark, gathered):
    rng = np.random.default_rng(9)
    groups = {
        1: rng.normal(size=3000), 2: np.full(500, 7.5), 3: np.array([1.0]), 4: np.concatenate([np.zeros(400), [-1e300, 1e300, 5e-324, -5e-324]]),
        5: 2.0 ** rng.uniform(-1000, 1000, 800) * rng.choice([-1, 1], 800), 6: np.round(rng.uniform(0, 255, 2000)), 7: np.array([2.0, 1.0]), None: 1.0 + rng.integers(0, 9, 900) * 2.0**-52,
    }
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [(1, None), (8, None)]
    found = {r.g: r for r in percentiles(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", SHARES, gathered=gathered, bins=16).collect()}
    assert found.keys() == groups.keys()
    for k, xs in groups.items():
        assert found[k].n == len(xs)
        np.testing.assert_allclose(found[k].percentiles, np.quantile(xs, SHARES), rtol=1e-12, atol=0)


def test_nan_is_greatest_and_infinities_have_their_place(spark):
    xs = [float("nan"), float("inf"), float("-inf"), 0.0, 1.0]
    r = percentiles(spark.createDataFrame([(1, x) for x in xs], "g int, x double"), ["g"], "x", [0.0, 0.25, 0.5, 0.75, 1.0], gathered=1).first()
    assert r.percentiles[:4] == [float("-inf"), 0.0, 1.0, float("inf")] and np.isnan(r.percentiles[4])
    assert percentiles(spark.createDataFrame([], "g int, x double"), ["g"], "x", [0.5]).count() == 0
