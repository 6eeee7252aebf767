"""Text queries against their SQL on the smallest tables, where those are."""

import os

import duckdb
import pytest

from panelforge.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, df.select(*rel.columns).collect()), key=key) == sorted(rel.fetchall(), key=key)
