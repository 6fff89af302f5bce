"""Every query with an oracle against DuckDB over the smallest tables."""

import decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from colloquy.plans import catalog, giants, merges, notes, outputs, reports  # noqa: F401  these add their queries to the catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def text(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return f"{float(v):.9g}"
    return str(v)


def rows(df):
    return sorted(tuple(map(text, (float(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else v for v in r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(got), "a query without rows compares nothing"
    want = con.sql(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
