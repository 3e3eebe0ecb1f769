"""Parts of bounded size, whatever a partition holds."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from brinelog.llm import common, substring_dedup


def test_parts_are_small_and_rows_tell_apart(spark):
    sizes = [10] * 9000 + [None] * 500 + [20_000] * 5000 + [70_000] * 1500 + [3_000_000, 40_000_000, 40_000_000]
    frame = spark.createDataFrame([(s,) for s in sizes], "n int").repartition(2).select(F.expr("CASE WHEN n IS NOT NULL THEN repeat('x', n) END").alias("text"))
    number = frame.withColumn("row", F.monotonically_increasing_id())
    rows = number.select("row", common.part_of(F.col("row"), F.col("text")).alias("part"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect()
    count, weight, seen = Counter(), defaultdict(int), set()
    for r in rows:
        count[r.part] += 1
        weight[r.part] += r.n
        seen.add((r.part, r.row & ((1 << 33) - 1)))
    assert len(seen) == len(sizes) and max(count.values()) <= common.PART_ROWS
    alone = {p for p, n in count.items() if n == 1}
    assert all(w <= 2 * common.PART_ROWS * common.PART_TEXT or p in alone for p, w in weight.items())
    assert {p >> 37 for p in count} == {r.row >> 33 for r in rows} and all(p >> 37 == r.row >> 33 for r in rows for p in [r.part])


def test_runs_travel_packed_and_come_back_whole(spark):
    text = " ".join(f"word{i * i % 97} and" for i in range(60))
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    rows = substring_dedup.numbered(docs, "texts")
    told = substring_dedup.common_text(rows)
    chosen = substring_dedup.piece_uses(rows, 35, 8).drop("uses")
    plain, packed = (substring_dedup.travelling_runs(rows, chosen, 35, False, c).collect() for c in (None, told))
    assert sorted(substring_dedup.unpack(r.words, told) for r in packed) == sorted(r.words for r in plain)
    assert sum(len(r.words) for r in packed) < 0.75 * sum(len(r.words) for r in plain)
    assert {r.n_removed for r in substring_dedup.substring_dedup(docs).collect()} == {120}
