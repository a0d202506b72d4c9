"""Every core query over the smallest tables against its SQL, and the contract of the entry module."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from ledgerloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if pd.isna(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return int(v) if math.isfinite(v) and v == int(v) else float(v)
    if hasattr(v, "hour") and (v.hour, v.minute, v.second) == (0, 0, 0):
        return str(v)[:10]
    if isinstance(v, (int, np.integer)):
        return int(v)
    return str(v)


def rows(frame):
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{data}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, duck, name):
    mine = QUERIES[name](spark, data).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(mine.columns) == sorted(want.columns)
    assert rows(mine) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["state", "window_date", "size", "purchase_count", "population_variance"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
