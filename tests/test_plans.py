"""Plan shape of real keys: no one-task exchange over rows, few scans, pruned partitions, no Python."""

import re

import pytest

from spendlens.plans.catalog import QUERIES
from spendlens.plans.chain import build
from tests.conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _children(plan: str) -> list[tuple[int, str]]:
    lines = [x for x in plan.split("\n") if re.search(r"[A-Za-z]", x)]
    return [(len(re.match(r"[\s:+\-*()0-9]*", x)[0]), x) for x in lines]


def one_task_row_exchanges(plan: str) -> list[str]:
    """SinglePartition exchanges whose input was not aggregated to few rows below them."""
    nodes, bad = _children(plan), []
    for i, (depth, line) in enumerate(nodes):
        if "Exchange SinglePartition" not in line:
            continue
        below = []
        for d, x in nodes[i + 1 :]:
            if d <= depth:
                break
            below.append(x)
        if not any("Aggregate" in x or "LocalLimit" in x or "TakeOrdered" in x or "Range (" in x for x in below):
            bad.append(line)
    return bad


@pytest.mark.parametrize("key", ["ano_02", "fea_12", "sco_02", "sco_06", "q09", "q15", "ing_10", "ml_03", "rep_14", "par_10", "snk_01"])
def test_no_single_task_over_rows(spark, key):
    assert one_task_row_exchanges(_plan(QUERIES[key](spark, SF001))) == []


def test_the_check_sees_a_plain_global_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    t = build(spark, SF001).clean
    assert one_task_row_exchanges(_plan(t.select(F.row_number().over(Window.orderBy("txn_date", "txn_no")))))


@pytest.mark.parametrize("key, scans", [("q01", 1), ("q09", 3), ("rep_14", 5), ("fea_04", 2), ("fea_13", 1), ("par_05", 1), ("par_06", 1), ("ano_01", 1), ("ano_02", 1)])
def test_scans_are_few(spark, key, scans):
    plan = _plan(QUERIES[key](spark, SF001))
    assert plan.count("FileScan") <= scans
    if key in ("par_05", "par_06", "ano_01"):
        assert "Join" not in plan


def test_insert_is_an_anti_join(spark):
    assert "LeftAnti" in _plan(QUERIES["snk_04"](spark, SF001))


def test_month_filter_prunes_partitions(spark):
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", _plan(QUERIES["q17"](spark, SF001)))[1]
    assert "month" in filters and "= 3" in filters


def test_chain_has_no_python_udf(spark):
    t = build(spark, SF001)
    for df in (t.clean, t.features, t.scored, t.transactions):
        plan = _plan(df)
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_amount_ranks_are_those_of_the_feature_rows(spark, tmp_path):
    """Rows without a date are not among the features and take no rank; features come with the predictions."""
    from pyspark.sql import functions as F

    from spendlens.operators.features import build_features
    from spendlens.operators.scoring import score_transactions

    orders = spark.read.parquet(f"{SF001}/orders.parquet")
    lost = F.when((F.col("o_orderkey") % 7 == 0) | (F.col("o_totalprice") > 150_000), None).otherwise(F.col("o_orderdate"))
    orders.withColumn("o_orderdate", lost).write.parquet(str(tmp_path / "orders.parquet"))
    t = build(spark, str(tmp_path))
    assert "clean" not in vars(t)  # nothing is made before it is read
    want = score_transactions(build_features(t.clean))
    assert 0 < want.count() < t.clean.count()
    assert t.scored.select(*want.columns).exceptAll(want).isEmpty() and want.exceptAll(t.scored.select(*want.columns)).isEmpty()
