"""Every registered query of the library proper against DuckDB, on the smallest tables (where they are given)."""

import os

import pandas as pd
import pytest

from textveil.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(df):
    clean = lambda v: None if pd.isna(v) else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(str([clean(v.item() if hasattr(v, "item") else v) for v in row]) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    import duckdb

    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in queries.ORACLES:
        con = duckdb.connect()
        for file in os.listdir(DATA):
            con.sql(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{file}')")
        want = con.sql(queries.ORACLES[name]).df()
        assert sorted(want.columns) == sorted(got.columns)
        assert plain(got) == plain(want)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
