"""Operators on awkward inputs, against plain Python."""

import hashlib
import json
import math
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinelog.operators import attribution, drift, evidence, fields, folds, geometry, raster, robustness, text, tracks
from brinelog.sources import ais_csv, rasters


def km(a, b, c, d):
    across = (math.radians(d - b) + math.pi) % (2 * math.pi) - math.pi
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(across / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def test_moments_meet_vessels_by_cell_as_they_do_without(spark):
    random.seed(4)
    rows, n = [], 0
    for mmsi in range(30):
        lat, lon, t = random.uniform(-88, 88), random.choice([179.9, -179.95, 0.0, random.uniform(-180, 180)]), random.uniform(0, 4000)
        for _ in range(random.choice([1, 2, 12])):
            rows.append((mmsi, n, t, lat, lon, 5.0))
            n, t = n + 1, t + random.uniform(0, 5000)
            lat, lon = max(-89.0, min(89.0, lat + random.gauss(0, 0.4))), (lon + random.gauss(0, 0.6) + 180) % 360 - 180
    points = [(i, t + random.uniform(-1500, 1500), max(-89.0, min(89.0, a + random.gauss(0, 0.3))), (b + random.gauss(0, 0.3) + 180) % 360 - 180) for i, (_, _, t, a, b, _) in enumerate(random.choices(rows, k=300))]
    track = spark.createDataFrame(rows, "mmsi long, ordinal long, t double, lat double, lon double, speed double")
    moments = spark.createDataFrame(points, "particle_id long, t double, lat double, lon double")
    for reach in (3.0, 45.0, 900.0):
        near = tracks.near_moments(tracks.segments(track), track, moments, reach)
        got = sorted((r.mmsi, r.particle_id) for r in near.collect())
        at = tracks.interpolate(track, moments.select("t", "particle_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")))
        want = sorted((r.mmsi, r.m_particle_id) for r in at.collect() if km(r.lat, r.lon, r.m_p_lat, r.m_p_lon) <= reach)
        assert got == want and len(got) == len(set(got)) and (got or reach < 10)


def test_many_cases_agree_with_single_ones(spark):
    random.seed(6)
    rows = [(m, m * 50 + i, i * 600.0, 10 + m * 0.02 + i * 0.001, 70 + m * 0.02, 9.0) for m in range(6) for i in range(30)]
    track = spark.createDataFrame(rows, "mmsi long, ordinal long, t double, lat double, lon double, speed double")
    cloud = [(d, i, random.uniform(2000, 9000), 10.03 + 0.05 * d + random.gauss(0, 0.02), 70.04 + random.gauss(0, 0.02)) for d in (1, 2) for i in range(80)]
    cloud += [(3, i, 5000.0, -40.0, -100.0) for i in range(5)]  # nobody near
    particles = spark.createDataFrame(cloud, "drift_id long, particle_id long, t double, lat double, lon double")
    every = attribution.attribute_cases(track, particles, 10.0)
    many = every.collect()
    for d in (1, 2):
        one = {r.mmsi: r for r in attribution.attribute(track, particles.where(F.col("drift_id") == d), 10.0).collect()}
        own = {r.mmsi: r for r in many if r.drift_id == d}
        assert own.keys() - {None} == one.keys()
        for m, r in one.items():
            assert abs(own[m].posterior - r.posterior) < 1e-9 and own[m].captured == r.captured and abs(own[None].posterior - r.unknown) < 1e-9
        assert abs(sum(r.posterior for r in own.values()) - 1) < 1e-9 and sorted(r["rank"] for r in own.values()) == list(range(1, 8))
    last = {r.drift_id: r for r in attribution.case_conclusions(every).collect()}
    assert last[3].best is None and last[3].conclusion == "insufficient_evidence" and last[3].unknown == 1.0


def test_loitering_is_the_plain_walk(spark):
    rng, rows = np.random.default_rng(3), []
    for mmsi in range(60):
        n = int(rng.integers(1, 200))
        t, lat, lon = np.cumsum(rng.uniform(0, 200, n)), np.cumsum(rng.normal(0, 0.1, n) ** 3), 179.9 + np.cumsum(rng.normal(0, 0.1, n) ** 3)
        rows += [(mmsi, k, float(t[k]), float(lat[k]), float((lon[k] + 180) % 360 - 180)) for k in range(n)]
    near = lambda a, b: km(a[3], a[4], b[3], b[4]) <= 2
    dwells, stays = {}, set()
    for mmsi in range(60):
        own, anchor = [r for r in rows if r[0] == mmsi], 0
        for j in range(1, len(own)):
            if not near(own[anchor], own[j]):
                anchor = j
            elif own[j][2] - own[anchor][2] > 3600 and len(own) >= 3:
                dwells[mmsi] = own[j][2] - own[anchor][2]
                break
        for i in range(len(own)):
            for j in range(i + 1, len(own)):
                if not near(own[i], own[j]):
                    break
                if own[j][2] - own[i][2] > 3600:
                    stays.add(mmsi)
                    break
    frame = spark.createDataFrame(rows + [(0, 999, None, 1.0, 1.0), (None, 0, 1.0, 1.0, 1.0)], "mmsi long, ordinal long, t double, lat double, lon double").repartition(4)
    assert {r.mmsi: r.dwell for r in folds.first_dwells(frame, 2.0, 3600.0).collect()} == pytest.approx(dwells) and dwells
    assert {r.mmsi for r in folds.stays_near(frame, 2.0, 3600.0).collect()} == stays
    assert folds.stays_near(frame.limit(0), 2.0, 3600.0).count() == 0


def test_a_store_with_a_breaker_is_the_plain_one(spark):
    random.seed(4)
    rows = sorted({(random.randrange(4000), i) for i in range(500)})
    rows = [(i, "s%d" % (i % 2), "k%d" % (i % 14), float(t), random.random() < 0.7, float(i)) for t, i in rows]
    want, store, broken = {}, {}, {}
    for i, service, key, t, ok, value in rows:
        hit = key in store and t < store[key][0] + 600
        if not hit:
            open_ = t < broken.get(service, -1e9) + 90
            if not open_ and not ok:
                broken[service] = t
            store[key] = (t, "open" if open_ else "closed", "fetched" if ok and not open_ else "default", value if ok and not open_ else None)
        since, state, source, value = store[key]
        want[i] = (state, hit, source, value, t - since)
    frame = spark.createDataFrame(rows, "request_id long, service string, key string, t double, ok boolean, value double").repartition(3)
    assert {r.request_id: tuple(r)[2:] for r in fields.served(frame, 600.0, 90.0).collect()} == want
    assert len({w[0] for w in want.values()}) == 2 and any(w[1] for w in want.values())


def test_dilation_and_distances_are_brute_force(spark):
    random.seed(2)
    marks = {(s, random.randrange(60), random.randrange(60)) for s in (0, 1) for _ in range(6)}
    mask = spark.createDataFrame([*marks], "scene long, y int, x int")
    for by in (0, 1, 25):
        got = [(r.scene, r.y, r.x) for r in raster.dilate(mask, by).collect()]
        want = {(s, y + a, x + b) for s, y, x in marks for a in range(-by, by + 1) for b in range(abs(a) - by, by - abs(a) + 1)}
        assert len(got) == len(set(got)) and set(got) == want
    scene = spark.createDataFrame([(s, y, x, (s, y, x) in marks) for s in (0, 1, 2) for y in range(60) for x in range(60)], "scene long, y int, x int, m boolean")
    for r in raster.distances(scene, "m", "away").collect():
        own = [abs(r.y - y) + abs(r.x - x) for s, y, x in marks if s == r.scene]
        assert r.away == (min(own) if own else None)


def test_geometry_of_odd_rings(spark):
    ring = lambda *p: [[float(x), float(y)] for x, y in p]
    rows = [(1, ring((0, 0), (20, 0), (20, 20), (0, 20)), [ring((1, 1), (1, 12), (12, 12), (12, 1)), ring((1, 1), (2, 1), (2, 2))]), (2, ring((0, 0), (30, 0), (60, 0)), []), (3, [], []), (4, ring((0, 0), (0, 20), (20, 20), (20, 0), (0, 0)), [])]
    frame = spark.createDataFrame(rows, "region_id long, ring array<array<double>>, holes array<array<array<double>>>")
    got = {r.region_id: r for r in geometry.measured(frame).collect()}
    assert set(got) == {1, 4} and got[1].area == 400 - 121 and len(got[1].holes) == 1 and (got[4].cx, got[4].cy, got[4].perimeter) == (10, 10, 80)
    flat = geometry.measured(frame, -1.0).where("region_id IN (2, 3)").collect()
    assert {(r.region_id, r.area, r.shape_complexity, r.cx) for r in flat} == {(2, 0.0, 0.0, 30), (3, 0.0, 0.0, None)}
    closed = {r.region_id: r.c for r in frame.select("region_id", geometry.closed(F.col("ring")).alias("c")).collect()}
    assert len(closed[1]) == 5 and closed[1][0] == closed[1][-1] and closed[3] == [] and len(closed[4]) == 5
    box = F.struct(*[F.lit(v).alias(n) for n, v in zip(("min_lon", "min_lat", "max_lon", "max_lat"), (179.0, -1.0, 181.0, 1.0), strict=True)])
    placed = geometry.georeferenced(geometry.measured(frame), F.lit(40), F.lit(40), box).collect()
    assert all(-180 <= p[0] < 180 for r in placed for p in r.ring) and all(r.area_sq_km > 0 for r in placed)


def test_seals_are_those_of_plain_json(spark, tmp_path):
    maps = [{"b": 'quo"te \\ back', "a": "ümlaut", "created_at": "now"}, {"only": "x"}, {}]
    frame = spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "run_id long, fields map<string,string>")
    dump = lambda m: hashlib.sha256(json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    sealed = evidence.sealed(frame)
    for r in sealed.collect():
        content = dump({k: v for k, v in maps[r.run_id].items() if k != "created_at"})
        assert (r.content_sha256, r.manifest_sha256) == (content, dump(maps[r.run_id] | {"content_sha256": content}))
    nothing = F.lit(None).cast("string")
    assert {(r.valid, r.reasons) for r in evidence.verified(sealed.withColumn("input_now", nothing).withColumn("model_now", nothing), "run_id").collect()} == {(True, "")}
    for name in ("z.bin", "a/b/1", "a/2", "a.txt", "b/é", "a/b.c/3"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    walked, files = hashlib.sha256(), []
    for root, folders, names in os.walk(tmp_path):
        folders.sort()
        for name in sorted(names):
            path = os.path.relpath(os.path.join(root, name), tmp_path)
            files.append((1, path, hashlib.sha256(path.encode()).hexdigest()))
            walked.update(path.encode() + files[-1][2].encode())
    random.shuffle(files)
    got = evidence.folder_digests(spark.createDataFrame(files, "folder long, path string, sha256 string"), "folder").collect()
    assert [r.sha256 for r in got] == [walked.hexdigest()]
    assert evidence.code_version(None) == "unavailable" and evidence.code_version("abc", True) == "abc-dirty"


def test_fields_fall_back_one_by_one(spark):
    hours = spark.createDataFrame([(10, 1.0, None, 2.0, 3.0), (12, None, 5.0, None, None)], "hour long, wind double, wind_from double, current double, current_to double")
    probes = spark.createDataFrame([(1, 10.4 * 3600), (2, 11.0 * 3600), (3, 11.5 * 3600), (4, 90.0 * 3600), (5, 90.0 * 3600)], "probe_id long, t double")
    point = spark.createDataFrame([(4, 8.0, None, None, None)], "probe_id long, wind double, wind_from double, current double, current_to double")
    got = {r.probe_id: r for r in fields.sampled(probes, hours, point).collect()}
    assert (got[1].hour, got[1].wind, got[1].wind_from, got[1].filled) == (10, 1.0, 180.0, "wind_from")
    assert got[2].hour == 10 and (got[3].hour, got[3].wind, got[3].wind_from, got[3].current) == (12, 5.0, 5.0, 0.3)
    assert (got[4].source, got[4].wind, got[4].current_to) == ("point", 8.0, 90.0) and (got[5].source, got[5].wind) == ("default", 5.0)
    assert fields.sampled(probes, hours.limit(0)).where("source = 'default'").count() == 5


def tiff(order, pixels, kind, extra=()):
    height, width, bands = pixels.shape
    form = {"u": 1, "f": 3}[np.dtype(kind).kind]
    raw = pixels.astype(np.dtype(kind).newbyteorder(order)).tobytes()
    tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 4, 1, np.dtype(kind).itemsize * 8), (273, 4, 1, 400), (277, 4, 1, bands), (279, 4, 1, len(raw)), (339, 4, 1, form), *extra]
    head = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HIH", 42, 8, len(tags)) + b"".join(struct.pack(order + "HHII", *t) for t in tags)
    return head.ljust(400, b"\0") + raw


def test_raster_files(spark):
    pixels = np.arange(24).reshape(3, 4, 2) / 2
    good = [(f"{o}{k}", bytearray(tiff(o, pixels, k))) for o in "<>" for k in ("u1", "u2", "f4", "f8")]
    bad = [("packed", bytearray(tiff("<", pixels, "u1", [(259, 4, 1, 7)]))), ("short", bytearray(b"II*")), ("text", bytearray(b"hello, no raster")), ("empty", bytearray()), ("null", None)]
    files = spark.createDataFrame(good + bad, "path string, content binary")
    heads = {r.path: r for r in rasters.read_tiff(files).collect()}
    assert all(heads[p].error is None and (heads[p].width, heads[p].height, heads[p].bands, heads[p].min_lon) == (4, 3, 2, None) for p, _ in good)
    assert all(heads[p].error and heads[p].width is None for p, _ in bad)
    for r in rasters.tiff_pixels(files).where("path LIKE '%f%'").collect():
        assert r.value == pixels[r.y, r.x, r.band]
    assert rasters.tiff_pixels(files).count() == 24 * 8


def test_hulls_of_few_and_repeated_points(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (2.0, 2.0), (2.0, 0.0)] * 5
    rows = [(1, *p) for p in square] + [(2, 1.0, 1.0)] * 3 + [(3, 0.0, 0.0), (3, 1.0, 1.0)]
    got = {r.cloud: [tuple(p) for p in r.ring] for r in drift.hulls(spark.createDataFrame(rows, "cloud long, lon double, lat double"), "cloud", 3).collect()}
    assert got[1] == [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    assert got[2] == [(1.0, 1.0)] * 2 and got[3] == [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]


def test_scenarios_take_each_stratum_once(spark):
    s = robustness.sample_scenarios(spark, 16, 3).toPandas()
    for name, (low, high) in robustness.RANGES.items():
        assert sorted(((s[name] - low) / (high - low) * 16).astype(int)) == list(range(16))
    assert s.equals(robustness.sample_scenarios(spark, 16, 3).toPandas())


def test_missing_numbers_are_dashes(spark):
    r = spark.range(1).select(text.shown(F.lit(None).cast("double")).alias("a"), text.shown(F.lit(1.5), 1, " km").alias("b"), text.percent(F.lit(0.126), 1).alias("c"), text.percent(F.lit(None).cast("double")).alias("d")).first()
    assert tuple(r) == ("—", "1.5 km", "12.6%", "—")


@pytest.mark.parametrize("size", [1, 3, 9])
def test_window_means_reflect_edges(spark, size):
    p = np.random.default_rng(1).random((7, 5))
    scene = spark.createDataFrame([(0, y, x, float(p[y, x])) for y in range(7) for x in range(5)], "scene long, y int, x int, p double")
    padded = np.pad(p, size // 2, mode="symmetric")
    for r in raster.window_means(scene, ["p"], size).collect():
        assert abs(r.p - padded[r.y : r.y + size, r.x : r.x + size].mean()) < 1e-12


def test_files_of_one_folder_with_headers_of_their_own(spark, tmp_path):
    folder = tmp_path / "in put+s"
    folder.mkdir()
    (folder / "a.csv").write_text('MMSI,BaseDateTime,LAT,LON,VesselName\n1,2026-01-01T00:00:00,11.0,71.0,"x, y"\n')
    (folder / "b.csv").write_text("lon,lat,basedatetime,mmsi\n71.5,11.5,2026-01-01T00:00:00,2\n\n")
    (folder / "c.csv").write_text('﻿"MMSI","BaseDateTime","LAT","LON","Status"\n3,2026-01-01T00:00:00,12,72,5\n')
    (folder / "d.csv").write_text("MMSI,BaseDateTime,LAT\n4,2026-01-01T00:00:00,1\n")
    (folder / "e.csv").write_text("")
    (folder / "f.csv").write_text("MMSI,BaseDateTime,LAT,LON\n")
    found = {r.mmsi: (r.lat, r.lon, r.name, r.status) for r in ais_csv.clean(ais_csv.read_csv(spark, str(folder))).collect()}
    assert found == {"1": (11.0, 71.0, "x, y", ""), "2": (11.5, 71.5, "", ""), "3": (12.0, 72.0, "", "5")}
    lacking = {r.file.rsplit("/", 1)[1]: r.missing for r in ais_csv.headers(spark, str(folder)).collect()}
    assert lacking == {"a.csv": [], "b.csv": [], "c.csv": [], "d.csv": ["lon"], "f.csv": []}


def test_a_load_counts_while_it_writes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("MMSI,BaseDateTime,LAT,LON\n1,2026-01-01T00:00:00,1,1\n1,never,1,1\n2,2026-01-01T00:00:00,1,1\n3,2026-01-01T00:00:00,,1\n")
    known = spark.createDataFrame([("1",), (None,)], "mmsi string")
    got = ais_csv.load(ais_csv.read_csv(spark, str(tmp_path / "a.csv")), str(tmp_path / "out"), known, unreadable=2)
    assert tuple(got.first()) == (1, 2, 4)
    none = ais_csv.load(ais_csv.read_csv(spark, str(tmp_path / "a.csv")).limit(0), str(tmp_path / "none"), known)
    assert tuple(none.first()) == (0, 0, 0)


def test_seals_escape_as_plain_json_does(spark):
    values = ["a\nb", 'q"\\', "".join(map(chr, range(1, 33))) + "\x7f\x85", "\\u001b \\\\u000E", "\x1b\\\x0e", "é/你", "", None, "\U0001f600"]
    rows = [(i, {"note": v, "b": "1", "É": v, "a\t": "x", "created_at": "now"}) for i, v in enumerate(values)]
    found = spark.createDataFrame(rows, "k int, m map<string,string>").select("k", evidence.canonical(F.col("m"), ("created_at",)).alias("c")).collect()
    for r in found:
        assert r.c == json.dumps({k: v for k, v in rows[r.k][1].items() if k != "created_at"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_folds_of_tracks_go_by_arrow_batches_and_keep_the_whole_order(spark):
    kind = "mmsi long, ordinal long, t double, lat double, lon double"
    rows = [(m, i, 60.0 * i, 10.0, 20.0 + (0 if m % 2 else 0.03 * i)) for m in range(6) for i in range(90)]  # odd ones stay, for longer than FEW positions
    rows += [(1, 100, None, 50.0, 50.0), (1, 101, 61.0, None, 50.0), (None, 0, 0.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows[::-1], kind)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        dwells, stays = folds.first_dwells(frame, 2.0, 3600.0), folds.stays_near(frame, 2.0, 3600.0)
        for found in (dwells, stays):
            assert "UDTF" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r.mmsi: r.dwell for r in dwells.collect()} == {1: 3660.0, 3: 3660.0, 5: 3660.0}
        assert {r.mmsi for r in stays.collect()} == {1, 3, 5}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
