"""The load refuses bad rows before writing, and holds totals of any size exactly."""

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendlens.operators import load
from spendlens.operators.predict import model_predictions
from spendlens.plans.chain import build
from tests.conftest import SF001


def test_bad_rows_stop_the_load(spark, tmp_path):
    good = build(spark, SF001).predictions
    bad = good.withColumn("dr_amount", F.col("dr_amount") + 10_000_000_000)
    path = str(tmp_path / "t")
    with pytest.raises(load.LoadError, match="dr_amount: overflows"):
        load.load_table(bad, path)
    assert not os.path.exists(path)
    load.load_table(good, path)
    assert spark.read.parquet(path).count() == good.count()


def test_large_totals_are_exact(spark):
    good = build(spark, SF001).predictions.limit(3)
    large = good.withColumn("running_income", F.lit("12345678901234567890.12").cast("decimal(38,2)"))
    assert load.rejects(large).count() == 0
    assert {r.running_income for r in load.conform(large).collect()} == {Decimal("12345678901234567890.12")}


def test_numbers_beyond_the_stored_type_are_an_error(spark):
    good = build(spark, SF001).predictions.limit(3)
    with pytest.raises(Exception, match="beyond decimal"):
        load.conform(good.withColumn("amount", F.lit("123456789012345678901.00").cast("decimal(38,2)"))).collect()


def test_a_models_predictions_replace_the_rule(spark):
    scored = build(spark, SF001).scored
    seen = scored.select("txn_no", F.col("potential_leakage").alias("predicted_leakage"), F.lit(0.75).alias("predicted_proba")).filter(
        F.substring("txn_no", 1, 1) != "U"
    )
    out = model_predictions(scored, seen)
    assert out.count() == scored.count()
    assert out.filter("predicted_leakage != potential_leakage or predicted_proba != 0.75").count() == 0
    assert out.filter("predicted_leakage is null").count() == scored.filter("substring(txn_no, 1, 1) = 'U'").count()
    assert load.conform(out).columns == load.LOAD_COLUMNS


def test_bucketed_target_is_not_shuffled(spark):
    """Only the batch moves; a delivery that is replayed inserts nothing."""
    from pyspark.sql import functions as F

    batch = spark.range(4000).select(F.concat(F.lit("T"), F.col("id") % 3000).alias("txn_no"), (F.col("id") * 2).alias("v"), F.col("id").alias("seq"))
    target = load.store_keyed(batch.where("id % 3 = 0").select("txn_no").distinct())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = load.insert_new(target, batch, ["seq"])
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(txn_no") == 1
        held = {r.txn_no for r in target.collect()}
        got = {r.txn_no: r.v for r in new.collect()}
        assert len(held) + len(got) == 3000 and not held & set(got)
        after = load.store_keyed(target.unionByName(new.select("txn_no")))
        assert load.insert_new(after, batch, ["seq"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
