"""Multi-account runs: with ``by=["account_id"]`` each account equals its own single run."""

import uuid

from pyspark.sql import functions as F

from spendlens.operators.anonymize import clean_transactions
from spendlens.operators.features import FEATURE_COLUMNS, build_features
from spendlens.operators.scoring import score_transactions
from spendlens.plans.chain import build
from spendlens.session import materialize
from tests.conftest import SF001


def test_two_accounts_equal_single_runs(spark):
    t = build(spark, SF001)
    one = t.processed
    two = one.select(F.lit("A").alias("account_id"), "*").unionByName(
        one.select(F.lit("B").alias("account_id"), "*").filter(F.col("txn_date") >= "1997-01-01")
    )
    def run(df, by=()):
        # stage tables as in the chain: keeps each plan small
        c = materialize(clean_transactions(df, t.lookup, by=list(by)), "acct-clean", uuid.uuid4().hex)
        f = materialize(build_features(c, by=list(by)), "acct-features", uuid.uuid4().hex)
        return materialize(score_transactions(f, by=list(by)), "acct-scored", uuid.uuid4().hex)

    single_a = run(one)
    single_b = run(one.filter(F.col("txn_date") >= "1997-01-01"))
    multi = run(two, by=["account_id"])
    cols = [c for c in single_a.columns if c in FEATURE_COLUMNS or c.startswith("score") or c in ("leakage_score", "risk_band")]
    for acct, single in (("A", single_a), ("B", single_b)):
        m = multi.filter(F.col("account_id") == acct).select(*cols)
        assert m.exceptAll(single.select(*cols)).count() == 0
        assert single.select(*cols).exceptAll(m).count() == 0
