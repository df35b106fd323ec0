"""Each query with SQL gives the SQL's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from lumenpair.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    want = db.sql(catalog.SQL[name])
    order = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(str(r[i]) for i in order) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["o_orderkey", "status", "reason_code"]
    assert set(e.oracle_sql()) <= set(e.queries())
