"""Closed forms and behaviours each operator must show."""

import math

import pytest
from pyspark.sql import functions as F

from brinelog.functions import geo
from brinelog.operators import attribution, documents, drift, evidence, fields, robustness, tracks
from brinelog.sources import ais_csv

T0 = 1767268800.0


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def track(spark, pings):
    """pings: (mmsi, t, lat, lon, speed)"""
    return spark.createDataFrame([(m, i, float(t), float(a), float(o), float(s)) for i, (m, t, a, o, s) in enumerate(pings)], "mmsi long, ordinal long, t double, lat double, lon double, speed double")


def tight(spark, n=200, lat=19.0, lon=72.0, t=T0):
    return spark.createDataFrame([(i, lat, lon, t) for i in range(n)], "particle_id long, lat double, lon double, t double")


def station(m, lat, lon, t=T0, hours=3):
    return [(m, t + 600 * k, lat, lon, 1.0) for k in range(-6 * hours, 6 * hours + 1)]


def test_geodesy(spark):
    assert one(spark, geo.wrap_lon(F.lit(-190.0))) == 170
    assert one(spark, geo.haversine_km(F.lit(0.0), F.lit(179.5), F.lit(0.0), F.lit(-179.5))) == pytest.approx(111.195, rel=1e-4)
    box = lambda a, b: F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, a), (1, a), (1, b), (0, b))])
    for low, high in ((0, 1), (60, 61)):
        want = 6371.0**2 * math.radians(1) * (math.sin(math.radians(high)) - math.sin(math.radians(low)))
        assert one(spark, geo.ring_area_sq_km(box(low, high))) == pytest.approx(want, rel=1e-6)
    assert one(spark, geo.evaporated_fraction(F.lit(24.0), F.lit(5.0), 15.0)) == pytest.approx(0.26, abs=0.03)
    assert [one(spark, geo.wind_plausibility(F.lit(w))) for w in (0.0, 1.5, 3.0, 12.0, 16.0, 20.0)] == [0, 0.25, 1, 1, 0.5, 0]
    assert one(spark, geo.wind_plausibility(F.lit(None).cast("double"))) == 0.5


def test_vessel_on_the_scene_is_named(spark):
    r = attribution.attribute(track(spark, station(1, 19.0, 72.0) + station(2, 25.0, 80.0)), tight(spark)).collect()
    by = {x.mmsi: x for x in r}
    assert by[1].posterior > 0.70 and by[1].verdict == "strong" and by[1].likelihood > 0.9 and by[1].unknown < 0.30 and by[1]["rank"] == 1
    assert sum(x.posterior for x in r) + r[0].unknown == pytest.approx(1, abs=1e-9)


def test_vessel_at_the_wrong_time_is_not(spark):
    r = attribution.attribute(track(spark, [(1, T0 - 40 * 3600 + 600 * k, 19.009, 72.0, 9) for k in range(12)]), tight(spark))
    x = r.first()
    assert (x.likelihood, x.posterior, x.unknown) == (0, 0, 1) and attribution.conclusion(r).first().conclusion == "insufficient_evidence"


def test_decoys_change_nothing(spark):
    found = set()
    for n in (0, 9, 49):
        decoys = [p for k in range(n) for p in station(100 + k, 25.0, 80.0, hours=1)]
        r = attribution.attribute(track(spark, station(1, 19.0, 72.0) + decoys), tight(spark, 20)).where("mmsi = 1").first()
        found.add(round(r.posterior, 9))
    assert len(found) == 1


def test_interpolation(spark):
    t = track(spark, [(1, T0, 19.0, 72.0, 9), (1, T0 + 3600, 19.2, 72.0, 9), (1, T0 + 7 * 3600, 20.0, 72.0, 9), (1, T0 + 7.5 * 3600, 20.1, 72.0, 9), (2, T0, 5.0, 6.0, 9)])
    moments = spark.createDataFrame([(i, T0 + s) for i, s in enumerate((1800, 4 * 3600, 0, 3600, 7 * 3600, -60, -3600, -3601))], "k long, t double")
    got = {(r.mmsi, r.m_k): r.lat for r in tracks.interpolate(t, moments).collect()}
    assert got[1, 0] == pytest.approx(19.1) and got[1, 2] == 19.0 and got[1, 3] == pytest.approx(19.2)
    assert (1, 1) not in got and (1, 4) not in got and (1, 5) not in got  # over a long gap, on the ping that closes it, before the track
    assert {k for m, k in got if m == 2} == {0, 2, 3, 5, 6}


def test_closest_approach_between_pings(spark):
    t = track(spark, [(1, T0 - 1200, 18.9, 72.0, 9), (1, T0 + 1200, 19.1, 72.0, 9)])
    assert tracks.closest_approach(t, 19.0, 72.0, T0).first().cpa_km < 1


def test_dark_gap_and_integrity(spark):
    t = track(spark, [(1, T0 - 6000, 19.0, 72.0, 5)] + [(1, T0 - 600 + 600 * k, 19.0, 72.0, 5) for k in range(7)])
    assert tracks.gap_classes(t, 19.0, 72.0).first().code == "dark_vessel_gap"
    fast = track(spark, [(1, T0, 19, 72, 9), (1, T0 + 200, 20, 72, 9), (2, T0, 19, 72, 9), (2, T0 + 700, 19, 72, 9), (3, T0, 19, 72, 9), (3, T0, 19.1, 72, 9), (4, T0, 1.23456, 2.34567, 3)])
    flags = {(r.mmsi, r.code) for r in tracks.integrity_flags(fast).collect()}
    assert flags == {(1, "impossible_speed"), (1, "position_teleport"), (2, "frozen_position_underway"), (3, "duplicate_timestamps")}
    assert {r.mmsi: r.plausible for r in tracks.integrity(fast).collect()} == {1: False, 2: False, 3: False, 4: True}


def test_older_score(spark):
    near = [(1, T0 + 600 * k, 19.0 + 0.001 * k, 72.0, 12 - 8 * (k == 2)) for k in range(4)]
    r = attribution.legacy_score(track(spark, near + station(2, 19.3, 72.0, hours=1)), 19.0, 72.0, T0).collect()
    assert {x.mmsi: x["rank"] for x in r} == {1: 1, 2: 2}


def test_drift(spark):
    start = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "lat double, lon double, wind double, wind_from double, current double, current_to double")
    assert drift.trajectory(start, 1.0).first().end_lat == pytest.approx(-3600 / 6371000 * 180 / math.pi)
    west = start.withColumns({"wind": F.lit(10.0), "wind_from": F.lit(270.0), "current": F.lit(0.0)})
    assert drift.trajectory(west, 1.0).first().end_lon == pytest.approx(-0.3 * 3600 / 6371000 * 180 / math.pi)
    square = spark.createDataFrame([(1, float(x), float(y)) for x in range(3) for y in range(3)], "g long, lon double, lat double")
    assert drift.hulls(square, "g").first().ring == [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]


def test_nearest_hour_takes_the_earlier_of_two(spark):
    field = spark.createDataFrame([(10, 1.0), (12, 2.0)], "hour long, wind double")
    probes = spark.createDataFrame([(1, 11 * 3600.0), (2, 11 * 3600.0 + 1), (3, 99 * 3600.0)], "probe_id long, t double")
    assert {r.probe_id: r.wind for r in fields.nearest_hour(probes, field).collect()} == {1: 1.0, 2: 2.0, 3: None}


def test_scenarios_are_stratified(spark):
    rows = robustness.sample_scenarios(spark).collect()
    for k, (low, high) in robustness.RANGES.items():
        assert sorted(int((r[k] - low) / (high - low) * 32) for r in rows) == list(range(32))


def test_canonical_json(spark):
    texts = ['{"b": 1, "a": [true, 1.0, null, "é"]}', '{"a":[true,1,null,"é"],"b":1.0}', "no", None]
    got = sorted((r.k, r.c) for r in documents.canonical(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "t", "c").collect())
    assert got == [(0, '{"a":[true,"1",null,"é"],"b":"1"}'), (1, '{"a":[true,"1",null,"é"],"b":"1"}'), (2, None), (3, None)]


def test_position_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("mmsi,BaseDateTime,LAT,Lon,SOG,Status\n367000001234,2026-01-01T00:00:00,95,-181,7.5,0\n,2026-01-01T00:00:00,1,1,,\n5,never,1,1,,\n6,2026-01-01T00:00:00,1,2,,3\n")
    rows = {r.mmsi: r for r in ais_csv.clean(ais_csv.read_csv(spark, str(tmp_path / "a.csv"))).collect()}
    assert set(rows) == {"367000001", "6"}
    assert (rows["367000001"].lat, rows["367000001"].lon, rows["367000001"].status, rows["6"].status) == (90, -180, "", "3")
    (tmp_path / "b.csv").write_text("mmsi,lat\n1,2\n")
    with pytest.raises(ValueError, match="required"):
        ais_csv.read_csv(spark, str(tmp_path / "b.csv"))
    out = str(tmp_path / "t")
    ais_csv.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), out, "k")
    ais_csv.replace_partitions(spark.createDataFrame([(2, "c")], "k long, v string"), out, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(out).collect()} == {(1, "a"), (2, "c")}


def test_stream_gives_the_batch_anomalies(spark, tmp_path):
    from brinelog.sources.adapters import positions
    from brinelog.streaming.anomalies import pair_anomalies

    batch = positions(spark, "/root/testdata/sf0.001").select("mmsi", "ordinal", "t", "speed")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = pair_anomalies(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    drops = tracks.speed_drops(positions(spark, "/root/testdata/sf0.001")).count()
    assert spark.sql("SELECT * FROM found WHERE code = 'speed_drop'").count() == drops > 0


def test_each_step_takes_its_own_field(spark):
    cases = spark.createDataFrame([(1, 19.0, 72.0, T0, 4.0, 225.0, 0.1, 90.0, 6.0)], "case_id long, lat double, lon double, t double, wind double, wind_from double, current double, current_to double, hours double")
    hour = int(T0 // 3600)
    schema = "hour long, wind double, wind_from double, current double, current_to double"
    hours = spark.createDataFrame([(hour - k, 8.0, 0.0, None if k == 2 else 0.5, 10.0 * k) for k in range(6)], schema)
    told = drift.step_fields(cases, hours).first()
    assert [(s.wind, s.current, s.current_to) for s in told.steps] == [(8.0, 0.1 if k == 2 else 0.5, 10.0 * k) for k in range(6)] and told.degraded_steps == 0
    assert [(r.source, r.age_s) for r in drift.step_sources(cases, hours).orderBy("k").collect()] == [("filled" if k == 2 else "hour", T0 % 3600) for k in range(6)]
    none = drift.step_fields(cases, spark.createDataFrame([(hour - 99, 8.0, 0.0, 0.5, 0.0)], schema)).first()
    assert none.degraded_steps == 6 and none.steps == [None] * 6
