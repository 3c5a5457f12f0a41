"""Registered queries against their SQL in DuckDB."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_point
from rulelens.plans.catalog import QUERIES
from rulelens.plans.oracles import ORACLES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, float, np.integer, np.floating)):
        return round(float(value), 6)
    return pd.Timestamp(value).isoformat() if isinstance(value, pd.Timestamp) else value


def table(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"d1_separator_chunks"}
    assert set(ORACLES) < set(QUERIES) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sql, data, name):
    got = entry_point.queries()[name](spark, data).toPandas()
    want = sql.execute(entry_point.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)
