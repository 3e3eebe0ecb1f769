"""Pages of a large ordered result without sorting or reading what lies before them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .written import shared_folder


class Pages:
    """Rows dealt by range of their order, once; of each range its size and its first key are kept, at most `ranges` of them.

    The order's columns (name, descending) must not be null, and should end with one that tells rows apart: rows that tie may
    come in any order."""

    def __init__(self, rows: DataFrame, order: list[tuple[str, bool]], ranges: int = 200) -> None:
        self.order, self.columns = order, rows.columns
        self.by = [F.desc(c) if down else F.asc(c) for c, down in order]
        dealt = rows.repartitionByRange(ranges, *self.by).withColumn("range_", F.spark_partition_id())
        path = f"{shared_folder(rows.sparkSession)}/pages-{uuid.uuid4().hex}"
        dealt.write.partitionBy("range_").parquet(path)
        self.rows = rows.sparkSession.read.schema(dealt.schema).parquet(path)
        ends = [f(c).alias(f"{n}_{c}") for c, _ in order[:1] for n, f in (("least", F.min), ("most", F.max))]
        told = self.rows.groupBy("range_").agg(F.count("*").alias("n"), *ends).collect()  # `ranges` rows
        self.index = sorted((r.range_, r.n, r[2], r[3]) for r in told)

    def page(self, number: int, size: int = 50) -> DataFrame:
        """A page, from 1: only the ranges that hold it are read and sorted."""
        start, before, chosen, skipped = (number - 1) * size, 0, [], 0
        for part, n, *_ in self.index:
            if before + n > start and before < start + size:
                skipped = skipped if chosen else before
                chosen.append(part)
            before += n
        return self._read(chosen).offset(start - skipped if chosen else 0).limit(size).select(*self.columns)

    def after(self, last: dict, size: int = 50) -> DataFrame:
        """The page after a row, told by its values of the order's columns, whether or not it is still there. Ranges that end before
        it are left out, and those that follow are read only until a page is full."""
        (first, down), *_ = self.order
        beyond, same = F.lit(False), F.lit(True)
        for c, falling in self.order:
            beyond |= same & ((F.col(c) < F.lit(last[c])) if falling else (F.col(c) > F.lit(last[c])))
            same &= F.col(c) == F.lit(last[c])
        chosen, sure = [], 0
        for part, n, least, most in self.index:
            if (least > last[first]) if down else (most < last[first]):
                continue
            chosen.append(part)
            sure += n if ((most < last[first]) if down else (least > last[first])) else 0  # all of it lies beyond
            if sure >= size:
                break
        return self._read(chosen, beyond).limit(size).select(*self.columns)

    def _read(self, parts: list[int], where=None) -> DataFrame:
        some = self.rows.where(F.col("range_").isin(parts) if parts else F.lit(False))
        return (some if where is None else some.where(where)).orderBy(*self.by)
