"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from sparkchirp.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("embeddings", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(str, frame.astype(str).itertuples(index=False)))


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = rows(registry.QUERIES[name](spark, SF).toPandas())
    want = rows(duck.execute(registry.SQL[name]).fetchdf())
    assert got == want


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
