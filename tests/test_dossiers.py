"""Whole dossiers, stages' records and truth masks on small, odd inputs."""

import json

import numpy as np

from pyspark.sql import functions as F

from brinelog.operators import documents, dossiers
from brinelog.plans.scenes import picture
from brinelog.sources import rasters, records


def told(frame):
    return {r.run_id: json.loads(r.p) for r in frame.selectExpr("run_id", "to_json(payload) AS p").collect()}


def test_dossier_keeps_what_lacks_parts(spark):
    runs = spark.createDataFrame([(1, "done", 2), (2, "done", 1), (3, None, None)], "run_id long, status string, suspects_ranked int")
    regions = spark.createDataFrame([(1, 11, 2.5), (1, 10, None), (2, 20, 1.0)], "run_id long, region_id long, area double")
    drifts = spark.createDataFrame([(10, 100, 0.0, "old"), (10, 101, 100000.0, "new"), (20, 200, 0.0, "one")], "region_id long, drift_id long, origin_t double, engine string")
    particles = spark.createDataFrame([(101, i, float(i), -float(i)) for i in range(7)] + [(100, 0, 9.0, 9.0)], "drift_id long, ordinal long, lat double, lon double")
    suspects = spark.createDataFrame([(1, 2, 7, None), (1, 1, 8, 0.5)], "run_id long, rank int, mmsi long, posterior double")
    tracks = spark.createDataFrame([(8, 100000.0, 1.0), (8, 99000.0, 2.0), (8, 0.0, 3.0), (9, 100000.0, 4.0), (8, None, 5.0)], "mmsi long, t double, lat double")
    found = told(dossiers.dossier(runs, regions, drifts, particles, suspects, tracks, most=3))
    assert [r["region_id"] for r in found[1]["regions"]] == [10, 11] and found[1]["regions"][1]["drift"] is None and found[1]["regions"][0]["area"] is None
    drift = found[1]["regions"][0]["drift"]
    assert (drift["drift_id"], drift["engine"], drift["n_particles"], [p["lat"] for p in drift["particles"]]) == (101, "new", 7, [0, 2, 4, 6])
    assert [(s["mmsi"], s["posterior"], [p["t"] for p in s["track"]]) for s in found[1]["suspects"]] == [(8, 0.5, [99000, 100000]), (7, None, [])]
    assert found[2]["stale"] is True and found[2]["regions"][0]["drift"]["particles"] == [] and found[2]["suspects"] == []
    assert (found[3]["stale"], found[3]["run"]["status"], found[3]["regions"]) == (False, None, []) and found[1]["stale"] is False


def test_a_stage_tried_again_replaces_its_own_rows(spark, tmp_path):
    path, kind = str(tmp_path / "case"), "run_id long, region_id long, area double"
    records.insert(spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0)], kind), path, "regions", "a")
    records.insert(spark.createDataFrame([(2, 3, 4.0)], kind), path, "regions", "b")
    records.insert(spark.createDataFrame([(1, 1, 1.5)], kind), path, "regions", "a")
    records.insert(spark.createDataFrame([(1, 9, 2)], "region_id long, drift_id long, degraded_steps long"), path, "drifts", "a")
    records.insert(spark.createDataFrame([(1, "detecting", 1.0, None), (1, "failed", 2.0, "why"), (2, "detecting", 1.0, None), (3, "queued", 0.0, None)], "run_id long, state string, at double, reason string"), path, "states", "a")
    found = {r.run_id: tuple(r)[1:] for r in records.written_case(spark, path).collect()}
    assert found == {1: ("failed", 1, 1.5, 1, 2), 2: ("detecting", 1, 4.0, 0, 0), 3: ("queued", 0, 0.0, 0, 0)}
    assert {r.run_id: r.reason for r in records.last_states(records.inserted(spark, path, "states")).collect()} == {1: "why", 2: None, 3: None}


def test_truth_masks_are_the_pictures_of_the_manifest(spark, tmp_path):
    folder = tmp_path / "suite"
    (folder / "truth").mkdir(parents=True)
    mask = np.random.default_rng(1).integers(0, 2, (5, 6, 1)).astype("u1") * 255
    (folder / "truth" / "a.png").write_bytes(picture(mask, "png"))
    (folder / "truth" / "b.png").write_bytes(b"no picture")
    manifest = spark.createDataFrame([("one", "truth/a.png"), ("two", "./truth/b.png"), ("three", None), ("four", "truth/gone.png"), ("five", "truth/a.png")], "scene string, truth string")
    found = {(r.scene, r.y, r.x): r.m for r in rasters.truth_masks(spark, manifest, str(folder)).collect()}
    assert found == {(s, y, x): bool(v) for s in ("one", "five") for (y, x, _), v in np.ndenumerate(mask)}


def test_a_dossier_is_told_without_a_row_that_holds_it(spark, monkeypatch):
    runs = spark.createDataFrame([(1, "done", 2), (2, "done", 1), (3, None, None)], "run_id long, status string, suspects_ranked int")
    regions = spark.createDataFrame([(1, 100 - i, float(i), None) for i in range(30)] + [(2, 200, 1.0, "n"), (9, 300, 1.0, "n")], "run_id long, region_id long, area double, note string")
    drifts = spark.createDataFrame([(r, r * 10 + k, 3600.0 * k, "e") for r in (80, 85, 90, 200) for k in (0, 1)], "region_id long, drift_id long, origin_t double, engine string")
    particles = spark.createDataFrame([(801, i, float(i), -float(i)) for i in range(7)], "drift_id long, ordinal long, lat double, lon double")
    suspects = spark.createDataFrame([(1, r, 500 + r, None) for r in (3, 1, 2)] + [(9, 1, 501, 0.1)], "run_id long, rank int, mmsi long, posterior double")
    tracks = spark.createDataFrame([(501, 600.0 * i, float(i)) for i in range(5)] + [(502, 1e9, 1.0)], "mmsi long, t double, lat double")
    given = (runs, regions, drifts, particles, suspects, tracks)
    want = documents.flattened_variants(dossiers.dossier(*given, most=3), "run_id", "payload")
    longest, real = [], dossiers.flattened_variants
    monkeypatch.setattr(dossiers, "flattened_variants", lambda rows, *names: longest.append(rows.agg(F.max(F.length(F.to_json("v")))).first()[0]) or real(rows, *names))
    found = dossiers.told(*given, most=3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select(*found.columns).collect()))
    assert longest[0] < 300
