"""Position store, pages, digests of files and sweeps: what is read, retries, odd values."""

import contextlib
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from brinelog.operators import evidence, robustness
from brinelog.sources import position_store
from brinelog.sources.pages import Pages


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def store(spark, tmp_path):
    random.seed(1)
    rows = [(i % 9, i, 86400.0 * random.randrange(20) + random.random() * 86400, random.uniform(-90, 90), random.uniform(-180, 180)) for i in range(2000)]
    rows += [(1, 5000, None, 1.0, 1.0), (1, 5001, 86400.0, None, 181.0)]
    frame = spark.createDataFrame(rows, "mmsi long, ordinal long, t double, lat double, lon double")
    path = str(tmp_path / "store")
    for load in ("a", "b", "b"):
        position_store.add_load(frame.where(F.col("ordinal") % 2 == int(load == "b")), path, load)
    return rows, position_store.stored(spark, path)


def test_a_repeated_load_adds_nothing(store):
    rows, kept = store
    assert kept.count() == len(rows) and kept.where("load = 'b'").count() == sum(r[1] % 2 for r in rows)


def test_reads_touch_only_their_days(spark, store):
    rows, kept = store
    near = position_store.between(kept, 86400.0 * 3 + 100, 86400.0 * 4 + 50)
    assert {r.ordinal for r in near.collect()} == {r[1] for r in rows if r[2] is not None and 86400 * 3 + 100 <= r[2] <= 86400 * 4 + 50}
    plan = plan_of(near)
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(t," in plan
    assert {r.day for r in near.select("day").distinct().collect()} == {3, 4}
    windows = spark.createDataFrame([(86400.0 * 2, 86400.0 * 2 + 9000), (86400.0 * 11 - 50, 86400.0 * 11 + 50), (86400.0 * 2, 86400.0 * 2 + 100), (9.0, 1.0), (None, 1.0)], "since double, until double")
    found = position_store.within(kept, windows)
    assert sorted(r.ordinal for r in found.collect()) == sorted(r[1] for r in rows if r[2] is not None and any(a is not None and a <= r[2] <= b for a, b in ((86400.0 * 2, 86400.0 * 2 + 9000), (86400.0 * 11 - 50, 86400.0 * 11 + 50))))
    assert "dynamicpruning" in plan_of(found)


def test_morton_puts_neighbours_together(spark):
    places = spark.createDataFrame([(-90.0, -180.0), (90.0, 180.0), (0.0, 0.0), (0.1, 0.1), (200.0, -999.0)], "lat double, lon double")
    cells = [r.c for r in places.select(position_store.morton(F.col("lat"), F.col("lon")).alias("c")).collect()]
    assert cells[:2] == [0, (1 << 20) - 1] and cells[2] == cells[3] and cells[4] == sum(1 << (2 * i + 1) for i in range(10))


@pytest.mark.parametrize("order", [[("a", True), ("k", False)], [("a", False), ("k", True)], [("k", False)]])
def test_pages_are_slices_of_the_whole(spark, order):
    random.seed(2)
    rows = [(k, random.randrange(6), f"x{k}") for k in range(300)]
    pages = Pages(spark.createDataFrame(rows, "k long, a long, x string").repartition(3), order, 8)
    want = sorted(rows, key=lambda r: [(-1 if down else 1) * r["ka".index(c)] for c, down in order])
    for number, size in ((1, 10), (3, 70), (5, 70), (6, 70), (30, 10), (31, 10)):
        assert [tuple(r) for r in pages.page(number, size).collect()] == want[(number - 1) * size : number * size]
    for i in (0, 57, 200, 298, 299):
        assert [tuple(r) for r in pages.after({"k": want[i][0], "a": want[i][1]}, 25).collect()] == want[i + 1 : i + 26]
    plan = plan_of(pages.page(2, 10))
    assert "PartitionFilters" in plan and "(range_" in plan.split("PartitionFilters")[1].split("]")[0]
    none = Pages(spark.createDataFrame([], "k long, a long, x string"), order, 4)
    assert none.page(1).count() == 0 == none.after({"k": 1, "a": 1}).count()


def test_digests_of_files_of_any_size(spark, tmp_path):
    contents = {"none": b"", "one": b"x", "d/three": random.Random(3).randbytes(3 * 1000), "d/.hidden": b"h", "d/odd ü+%20": b"o"}
    (tmp_path / "d").mkdir()
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    files = evidence.walked(spark, str(tmp_path))
    found = {r.path: (r.length, r.sha256, r.error) for r in evidence.file_digests(files, 1000).collect()}
    assert found == {n: (len(c), hashlib.sha256(c).hexdigest(), None) for n, c in contents.items()}
    gone = spark.createDataFrame([(str(tmp_path / "gone"), 1), (None, 2)], "file string, k int")
    assert [(r.length, r.sha256, r.error[:10]) for r in evidence.file_digests(gone).collect()] == [(None, None, "unreadable")] * 2
    whole = evidence.folder_digests(evidence.file_digests(files).withColumn("folder", F.lit("all")), "folder").first().sha256
    told = "".join(n + hashlib.sha256(contents[n]).hexdigest() for n in ("none", "one", "d/.hidden", "d/odd ü+%20", "d/three"))
    assert whole == hashlib.sha256(told.encode()).hexdigest()


def test_sweeps_take_every_stratum_once_in_each_run(spark):
    runs = spark.createDataFrame([(1,), (2,), (2,)], "run long")
    rows = robustness.sampled(runs, "run", 16, 3).toPandas()
    assert len(rows) == 32
    for _, own in rows.groupby("run"):
        assert sorted(own["scenario"]) == list(range(16))
        for k, (low, high) in robustness.RANGES.items():
            assert sorted(((own[k] - low) / (high - low) * 16).astype(int)) == list(range(16))
    one = robustness.sampled(runs.where("run = 2"), "run", 16, 3).toPandas().sort_values("scenario")
    assert one.reset_index(drop=True).equals(rows[rows["run"] == 2].sort_values("scenario").reset_index(drop=True))


def test_influence_and_breaking_points_by_run_are_those_of_each_run(spark):
    random.seed(5)
    rows = [(run, k, random.choice([1, 2, None]), random.random(), random.random()) for run in (1, 2, 3) for k in range(40)]
    results = spark.createDataFrame(rows, "run int, scenario int, winner int, a double, b double")
    base = F.when(F.col("run") != 3, F.col("run"))
    found = {(r.run, r.parameter): r.influence for r in robustness.influence(results, base, {"a": 1.0, "b": 2.0}, "run").collect()}
    points = robustness.breaking_points_of(results, base, {"a": (0.5, 1.0), "b": (0.4, 2.0)}, "run").collect()
    for run in (1, 2, 3):
        own, b = results.where(F.col("run") == run), F.lit(run if run != 3 else None).cast("int")
        assert {p: found[run, p] for p in "ab"} == {r.parameter: r.influence for r in robustness.influence(own, b, {"a": 1.0, "b": 2.0}).collect()}
        for p, (at, span) in {"a": (0.5, 1.0), "b": (0.4, 2.0)}.items():
            alone = [tuple(r) for r in robustness.breaking_points(own, b, p, at, span).collect()]
            assert [tuple(r)[3:] for r in sorted((r for r in points if (r.run, r.parameter) == (run, p)), key=lambda r: r.nearness)] == alone
