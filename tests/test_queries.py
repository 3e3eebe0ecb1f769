"""Every registered query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def engine_queries():
    import __spark_entry__ as e

    return [n for n in e.queries() if not n.startswith("op") and n != "pipeline"]


def rows(columns, table):
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v + 0.0
        return str(v) if hasattr(v, "isoformat") else v

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in table), key=repr)


@pytest.mark.parametrize("name", engine_queries())
def test_matches_sql(spark, duck, name):
    import __spark_entry__ as e

    got = e.queries()[name](spark, SF)
    found = got.collect()
    sql = e.oracle_sql().get(name)
    if sql is None:
        assert found
        return
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in found]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
