"""Operators with SQL equal DuckDB on the smallest tables."""

import duckdb
import pytest

from spendlens.llm.oracle import ORACLE
from spendlens.llm.queries import QUERIES
from tests.conftest import SF001


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    want = con.sql(ORACLE[key])
    df = QUERIES[key](spark, SF001)
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(str(tuple(r)) for r in df.select(*want.columns).collect())
    assert got == sorted(str(r) for r in want.fetchall())
