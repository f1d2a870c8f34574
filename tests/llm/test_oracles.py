"""Queries with SQL against DuckDB on the small driver tables."""

import os

import duckdb
import pandas as pd
import pytest

from binsight.llm import catalog

SF = os.environ.get("BINSIGHT_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF)
    want = con.sql(catalog.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    plain = lambda rows: sorted(repr(tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r)) for r in rows)
    assert plain(tuple(r) for r in got.select(cols).collect()) == plain([tuple(r[i] for i in at) for r in want.fetchall()])
