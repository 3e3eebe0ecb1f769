"""A watch over a replayed table against the whole table."""

import pytest
from pyspark.sql import functions as F

from brinelog.operators import folds, tracks
from brinelog.sources.adapters import positions
from brinelog.streaming.watch import STORE, late_rows, watch

SF = "/root/testdata/sf0.001"
KIND = "mmsi long, ordinal long, t double, lat double, lon double, speed double"


@pytest.fixture
def replayed(spark, tmp_path):
    """Runs a watch over lists of rows, a micro-batch each; what it told, how many rows came late, and how much state is left."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    runs = []

    def run(batches, **how):
        folder = tmp_path / f"run{len(runs)}"
        runs.append(folder)
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(folder / "in"))
            new = max((folder / "in").glob("part-*.parquet"), key=lambda p: p.stat().st_mtime_ns)
            new.rename(folder / "in" / f"{i:04}.parquet")
        name = f"watched{len(runs)}"
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        q = watch(stream, **how).writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "c")).outputMode("append").start()
        q.processAllAvailable()
        late, left = late_rows(q), q.lastProgress["stateOperators"][0]["numRowsTotal"]
        q.stop()
        return [tuple(r) for r in spark.table(name).collect()], late, left

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_shuffled_replay_tells_what_the_table_does(spark, replayed):
    table = positions(spark, SF).select("mmsi", "ordinal", "t", "lat", "lon", "speed")
    rows = sorted(map(tuple, table.where("mmsi % 3 = 0").collect()), key=lambda r: (r[2], r[1]))
    end = rows[-1][2]
    size = len(rows) // 5 + 1
    batches = [rows[i : i + size][::-1] for i in range(0, len(rows), size)]
    whole = table.where("mmsi % 3 = 0")
    told, late, left = replayed([*batches, [(-1, 0, end + 1e7, 0.0, 0.0, 0.0)]], delay="60 days", forget_s=1e9)
    told = [t for t in told if t[0] != -1]
    pick = lambda code: sorted((m, round(s, 9)) for m, _, c, s in told if c == code)
    assert late == 0 and pick("speed_drop") == sorted((r.mmsi, round(r.severity, 9)) for r in tracks.speed_drops(whole).collect())
    gaps = tracks.segments(whole).where("dt > 1800").select("mmsi", F.least(F.lit(1.0), F.col("dt") / 60 / 180).alias("s")).collect()
    assert sorted(pick("ais_gap_long") + pick("ais_gap_short")) == sorted((r.mmsi, round(r.s, 9)) for r in gaps)
    assert pick("loitering") == sorted((r.mmsi, round(min(1.0, r.dwell / 21600), 9)) for r in folds.first_dwells(whole, 2.0, 3600.0).collect())
    assert len(pick("speed_drop")) and len(pick("loitering"))


def test_silence_is_told_without_a_next_report_and_state_goes(replayed):
    quiet = [(1, 0, 1e9, 10.0, 10.0, 5.0), (2, 0, 1e9, 10.0, 10.0, 5.0)]
    others = [[(3, k, 1e9 + 1800.0 * k, 10.0, 10.0, 5.0)] for k in range(1, 6)]
    told, late, left = replayed([quiet, *others, [(1, 1, 1e9 + 100, 10.0, 10.0, 5.0)]], delay="1 minute", forget_s=7000.0)
    assert {t[:3] for t in told if t[0] < 3} == {(1, 1e9 + 2700, "went_silent"), (2, 1e9 + 2700, "went_silent")}
    assert late == 1 and {t[2] for t in told if t[0] == 3} == {"loitering"}
    again, _, left = replayed([quiet, *others, [(9, 0, 1e9 + 1e6, 0.0, 0.0, 0.0)], [(9, 1, 1e9 + 1e6 + 600, 0.0, 0.0, 0.0)]], delay="1 minute", forget_s=7000.0)
    assert left <= 5 and sum(t[2] == "went_silent" for t in again) == 3


def test_odd_rows_of_a_stream(replayed):
    rows = [(1, None, 1e9, 10.0, 10.0, None), (1, 1, 1e9 + 60, None, 10.0, 1.0), (None, 0, 1e9, 1.0, 1.0, 1.0), (1, 2, 1e9, 10.0, 10.0, 9.0), (1, 3, 1e9 + 120, 10.0, 10.0, 1.0)]
    told, *_ = replayed([rows, [(9, 0, 1e9 + 1e4, 0.0, 0.0, 0.0)]], delay="1 minute")
    assert [t[2] for t in told if t[0] == 1] == ["speed_drop", "went_silent"]
