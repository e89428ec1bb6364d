"""Every query against its SQL in DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from skyfold.plans import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(df):
    cols = sorted(df.columns)
    return cols, [str(df[c].dtype) for c in cols], sorted(map(repr, df[cols].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, str(DATA)).toPandas()
    assert len(got)
    if name in registry.oracle_sql():
        assert rows(got) == rows(duck.sql(registry.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
