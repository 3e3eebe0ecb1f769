"""Sums over points near places against every pair's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinelog.operators import attribution, sums, tracks


def every_pair(lat, lon, p_lat, p_lon, sigma, reach):
    a, b, c, d = (np.radians(x) for x in (lat[:, None], lon[:, None], p_lat, p_lon))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    km = 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1, h)))
    return np.where(km <= reach, np.exp(-0.5 * (km / sigma) ** 2), 0).sum(1), (km <= reach).sum(1)


@pytest.mark.parametrize("where", [(19.0, 72.0, 0.5, 1.2), (89.7, 10.0, 0.3, 180.0), (-40.0, 180.0, 0.6, 1.0), (5.0, 0.0, 60.0, 170.0), (0.0, 0.0, 0.0, 0.4)])
@pytest.mark.parametrize("sigma", [2.5, 30.0, 400.0])
def test_sums_are_those_of_every_pair(where, sigma):
    rng = np.random.default_rng(5)
    lat, lon, high, wide = where
    p_lat, p_lon = lat + high * rng.uniform(-1, 1, 6000), lon + wide * rng.uniform(-1, 1, 6000)
    p_lat, p_lon = np.clip(np.append(p_lat, [lat] * 300), -90, 90), np.append(p_lon, [lon] * 300)
    v_lat, v_lon = np.clip(lat + 2 * high * rng.uniform(-1, 1, 200) + 1e-3, -90, 90), lon + 2 * wide * rng.uniform(-1, 1, 200)
    weight, count = sums.near_sums(v_lat, v_lon, p_lat, p_lon, sigma, 3 * sigma)
    want, number = every_pair(v_lat, v_lon, p_lat, p_lon, sigma, 3 * sigma)
    assert (count == number).all() and np.abs(weight - want).max() < 1e-9


def test_steps_grow_slower_than_pairs(monkeypatch):
    steps, real = [], sums.squared_km
    monkeypatch.setattr(sums, "squared_km", lambda v, u: steps.append(len(v) * len(u)) or real(v, u))
    rng = np.random.default_rng(6)
    took = []
    for n in (2000, 32000):
        steps.clear()
        sums.near_sums(rng.uniform(17, 21, 100), rng.uniform(70, 74, 100), rng.uniform(18.8, 19.2, n), rng.uniform(71.8, 72.2, n), 30.0, 90.0)
        took.append(sum(steps))
    assert took[1] < 6 * took[0] and took[1] < 0.1 * 100 * 32000


@pytest.mark.parametrize("by", [[], ["kind"]])
def test_capture_deals_out_vessels_and_particles(spark, monkeypatch, by):
    monkeypatch.setattr(attribution, "DEALT", 3)
    monkeypatch.setattr(attribution, "CHUNK", 16)
    rng = np.random.default_rng(7)
    track = spark.createDataFrame([(m, m * 10 + i, 1800.0 * i, 10.0 + m / 9, 20.0 + i / 7, 5.0) for m in range(20) for i in range(5)], "mmsi long, ordinal long, t double, lat double, lon double, speed double")
    cloud = spark.createDataFrame([(i, 1800.0 * (i % 3) + 60, *rng.uniform([10, 20], [12, 21]).tolist(), f"k{i % 2}") for i in range(200)], "particle_id long, t double, lat double, lon double, kind string")
    found = {tuple(r[: len(by) + 1]): (round(r.weight, 9), r.captured) for r in attribution.soft_capture(track, cloud, 40.0, by=by).collect()}
    near = tracks.near_moments(tracks.segments(track), track, cloud, 60.0).groupBy(*by, "mmsi").agg(F.sum(F.exp(-0.5 * F.pow(F.col("km") / 20, 2))).alias("weight"), F.count("*").alias("captured"))
    assert found and found == {tuple(r[: len(by) + 1]): (round(r.weight, 9), r.captured) for r in near.collect()}
