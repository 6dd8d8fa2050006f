"""Every SQL-checkable catalogue key equals its DuckDB oracle at sf0.001."""

import datetime
import decimal
import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from spendlens.oracle.keys import ORACLE
from spendlens.plans.catalog import QUERIES
from tests.conftest import SF001

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ML_TRAINING = {"ml_06", "ml_07", "ml_08", "ml_09", "ml_13", "ml_14", "ml_15_model"}


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return str(v)
    if isinstance(v, datetime.date):
        return str(v)
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["risk_band", "transaction_count", "total_amount", "avg_leakage_score", "pct_of_all_transactions"]
    assert df.count() > 0


def test_every_key_has_oracle_or_is_ml():
    assert len(QUERIES) == 106 and set(QUERIES) <= set(E.queries())
    assert set(QUERIES) - set(ORACLE) == ML_TRAINING and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_key_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF001)
    srows = [tuple(r) for r in df.collect()]
    res = con.sql(ORACLE[key])
    orows = res.fetchall()
    scols = [c.lower() for c in df.columns]
    ocols = [c.lower() for c in res.columns]
    assert sorted(scols) == sorted(ocols)
    assert len(srows) == len(orows) > 0
    assert _digest(scols, srows) == _digest(ocols, orows)
