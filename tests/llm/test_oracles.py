"""Registered queries of this subpackage against their SQL."""

import duckdb
import pytest

from rulelens.llm.queries import LLM_ORACLES, LLM_QUERIES

from test_registry import TABLES, table


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = LLM_QUERIES[name](spark, folder).toPandas(), con.execute(LLM_ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)
