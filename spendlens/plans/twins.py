"""DataFrame-API twins of the SQL reports Q01…Q17 (same columns, same values).

Both forms compile to the same kind of plan; the twins exist for callers composing
reports in Python.  Month-level windows run over the aggregated rows (≤ 12 per month key),
never over transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.plans.reports import debit_deciles, debit_percentiles


def _r2(x: Column, d: int = 2) -> Column:
    return F.round(x, d).cast("double")


def _avg(col: str) -> Column:
    return _r2(F.sum(col) / F.count(col))


def _pct(part: Column, whole: Column) -> Column:
    return _r2(part * F.lit(100.0).cast("decimal(4,1)") / whole)


def _debit() -> Column:
    return F.col("direction") == "DEBIT"


def _leak_dr() -> Column:
    return F.when(F.col("potential_leakage") == 1, F.col("dr_amount")).otherwise(F.lit(0).cast("decimal(12,2)"))


def q01(t: DataFrame) -> DataFrame:
    cr, dr = F.sum("cr_amount"), F.sum("dr_amount")
    return t.groupBy("month_name", "month").agg(
        _r2(cr).alias("total_income"), _r2(dr).alias("total_expenses"), _r2(cr - dr).alias("net_savings"),
        _r2((cr - dr) / F.nullif(cr, F.lit(0)) * 100).alias("savings_rate_pct"),
    ).orderBy("month")


def q02(t: DataFrame) -> DataFrame:
    return (
        t.filter(_debit() & (F.col("dr_amount") > 0)).groupBy("category")
        .agg(F.count(F.lit(1)).alias("transaction_count"), _r2(F.sum("dr_amount")).alias("total_spent"),
             _avg("dr_amount").alias("avg_per_transaction"), _r2(F.max("dr_amount")).alias("largest_transaction"))
        .orderBy(F.desc("total_spent"), "category").limit(5)
    )


def q03(t: DataFrame) -> DataFrame:
    g = t.groupBy("risk_band").agg(
        F.count(F.lit(1)).alias("transaction_count"), _r2(F.sum("dr_amount")).alias("total_amount"),
        _avg("leakage_score").alias("avg_leakage_score"),
    )
    total = F.sum("transaction_count").over(Window.partitionBy())  # ≤ 4 aggregated rows
    return g.withColumn("pct_of_all_transactions", _pct(F.col("transaction_count"), total)).orderBy(F.desc("avg_leakage_score"))


def q04(t: DataFrame) -> DataFrame:
    g = t.groupBy("month_name", "month").agg(
        F.count(F.lit(1)).alias("total_transactions"), F.sum("potential_leakage").cast("long").alias("leakage_count"),
        F.sum(_leak_dr()).alias("__amt"), _pct(F.sum("potential_leakage"), F.count(F.lit(1))).alias("leakage_rate_pct"),
    )
    w = Window.orderBy("month")  # over ≤ 12 aggregated rows
    return g.select(
        "month_name", "month", "total_transactions", "leakage_count", _r2(F.col("__amt")).alias("leakage_amount"),
        "leakage_rate_pct", _r2(F.col("__amt") - F.lag("__amt").over(w)).alias("mom_leakage_change"),
    ).orderBy("month")


def q05(t: DataFrame) -> DataFrame:
    g = t.groupBy("payment_mode").agg(
        F.count(F.lit(1)).alias("total_txn"), F.sum("potential_leakage").cast("long").alias("leakage_txn"),
        _r2(F.sum("dr_amount")).alias("total_spent"), _avg("leakage_score").alias("avg_leakage_score"),
    )
    return g.withColumn("leakage_rate_pct", _pct(F.col("leakage_txn"), F.nullif(F.col("total_txn"), F.lit(0)))).orderBy(
        F.desc("leakage_rate_pct")
    )


def q06(t: DataFrame) -> DataFrame:
    return (
        t.filter(_debit()).groupBy("is_weekend")
        .agg(F.count(F.lit(1)).alias("transaction_count"), _r2(F.sum("dr_amount")).alias("total_spent"),
             _avg("dr_amount").alias("avg_transaction"), F.sum("potential_leakage").cast("long").alias("leakage_count"),
             _avg("leakage_score").alias("avg_risk_score"))
        .select(F.when(F.col("is_weekend"), "Weekend").otherwise("Weekday").alias("day_type"), "transaction_count",
                "total_spent", "avg_transaction", "leakage_count", "avg_risk_score")
        .orderBy(F.desc("avg_risk_score"))
    )


def q07(t: DataFrame) -> DataFrame:
    return t.filter(_debit()).orderBy(F.desc("leakage_score"), "txn_no").limit(10).select(
        "txn_no", "txn_date", "category", "entity_id", _r2(F.col("dr_amount")).alias("amount"),
        F.col("leakage_score").cast("double").alias("leakage_score"), "risk_band",
        _r2(F.col("predicted_proba"), 4).alias("ml_leakage_probability"),
    )


def q08(t: DataFrame) -> DataFrame:
    keys = ["entity_id", "entity_type", "category", "entity_transaction_count", "entity_total_amount",
            "entity_avg_debit", "entity_days_active", "entity_transactions_per_day"]
    return (
        t.filter(F.col("entity_type").isin("PERSON", "MERCHANT") & _debit() & (F.col("entity_transaction_count") >= 3))
        .groupBy(*keys).agg(F.max("leakage_score").cast("double").alias("max_risk_score"))
        .select("entity_id", "entity_type", "category", F.col("entity_transaction_count").alias("times_paid"),
                _r2(F.col("entity_total_amount")).alias("total_paid"), _r2(F.col("entity_avg_debit")).alias("avg_payment"),
                F.col("entity_days_active").alias("days_span"),
                _r2(F.col("entity_transactions_per_day"), 3).alias("payments_per_day"), "max_risk_score")
        .orderBy(F.desc("total_paid"), "entity_id", "category").limit(10)
    )


def q09(t: DataFrame) -> DataFrame:
    return (
        debit_deciles(t).filter(F.col("score_decile") == 1).groupBy("month_name", "month")
        .agg(_r2(F.sum("dr_amount")).alias("total_high_risk_spend"),
             _r2(F.sum("dr_amount") * F.lit(0.5).cast("decimal(2,1)")).alias("potential_savings_if_halved"),
             F.count(F.lit(1)).alias("high_risk_transactions"))
        .orderBy("month")
    )


def q10(t: DataFrame) -> DataFrame:
    y, p = F.col("potential_leakage"), F.col("predicted_leakage")
    tp = F.count_if((y == 1) & (p == 1)).cast("long")
    return t.agg(
        F.count(F.lit(1)).alias("total_transactions"), F.sum(y).cast("long").alias("actual_leakage"),
        F.sum(p).cast("long").alias("predicted_leakage"), tp.alias("true_positives"),
        F.count_if((y == 0) & (p == 1)).cast("long").alias("false_positives"),
        F.count_if((y == 1) & (p == 0)).cast("long").alias("false_negatives"),
        F.count_if((y == 0) & (p == 0)).cast("long").alias("true_negatives"),
        _pct(tp, F.nullif(F.sum(y), F.lit(0))).alias("recall_pct"),
    )


def q11(t: DataFrame) -> DataFrame:
    first = t.orderBy("txn_date", "txn_no").limit(20)  # distributed top-k, then a 20-row window
    w = Window.orderBy("txn_date", "txn_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return first.select(
        "txn_date", "txn_no", "direction", _r2(F.col("dr_amount")).alias("debit"), _r2(F.col("cr_amount")).alias("credit"),
        _r2(F.col("running_expense")).alias("cumulative_expense"), _r2(F.col("running_income")).alias("cumulative_income"),
        _r2(F.col("net_cash_flow")).alias("net_cash_flow"),
        _r2(F.sum(F.col("cr_amount") - F.col("dr_amount")).over(w)).alias("running_balance"),
    ).orderBy("txn_date", "txn_no")


def q12(t: DataFrame) -> DataFrame:
    g = t.filter(_debit()).groupBy("month_name", "month", "category").agg(
        _r2(F.sum("dr_amount")).alias("category_spend"), F.sum("potential_leakage").cast("long").alias("leakage_count")
    )
    w = Window.partitionBy("month").orderBy(F.desc("category_spend"))  # over the aggregate
    return g.withColumn("spend_rank", F.rank().over(w)).filter(F.col("spend_rank") <= 3).orderBy("month", "spend_rank")


def q13(t: DataFrame) -> DataFrame:
    return (
        t.filter((F.col("category") == "Subscription") & _debit()).groupBy("entity_id")
        .agg(F.count(F.lit(1)).alias("charge_count"), _r2(F.min("dr_amount")).alias("min_charge"),
             _r2(F.max("dr_amount")).alias("max_charge"), _r2(F.sum("dr_amount")).alias("total_charged"),
             F.min("txn_date").alias("first_charge"), F.max("txn_date").alias("last_charge"),
             F.datediff(F.max("txn_date"), F.min("txn_date")).alias("days_subscribed"),
             _avg("leakage_score").alias("avg_risk_score"))
        .orderBy(F.desc("total_charged"))
    )


def q14(t: DataFrame) -> DataFrame:
    g = t.filter(_debit()).groupBy("weekday").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.sum("dr_amount").alias("__s"), _avg("dr_amount").alias("avg_spent"),
        F.sum("potential_leakage").cast("long").alias("leakage_transactions"), _avg("leakage_score").alias("avg_risk_score"),
    )
    return g.select(
        "weekday", "transaction_count", _r2(F.col("__s")).alias("total_spent"), "avg_spent", "leakage_transactions",
        "avg_risk_score", F.rank().over(Window.orderBy(F.desc("__s"))).alias("spend_rank"),  # ≤ 7 rows
    ).orderBy(F.desc("total_spent"))


def q15(t: DataFrame) -> DataFrame:
    p = F.broadcast(debit_percentiles(t))  # one row
    j = t.filter(_debit()).join(p, F.col("dr_amount") >= F.col("p75"), "inner")
    return j.select(
        "txn_date", "txn_no", "category", "entity_id", _r2(F.col("dr_amount")).alias("amount"),
        _r2(F.col("p75").cast("decimal(38,10)")).alias("p75_threshold"),
        _r2(F.col("p90").cast("decimal(38,10)")).alias("p90_threshold"),
        F.when(F.col("dr_amount") >= F.col("p90"), "Top 10% Spend").when(F.col("dr_amount") >= F.col("p75"), "Top 25% Spend").alias("alert_level"),
        F.col("leakage_score").cast("double").alias("leakage_score"), "risk_band",
    ).orderBy(F.desc("amount"))


def q16(t: DataFrame) -> DataFrame:
    return (
        t.filter(_debit()).groupBy("is_first_transaction")
        .agg(F.count(F.lit(1)).alias("transaction_count"), _avg("dr_amount").alias("avg_amount"),
             _avg("leakage_score").alias("avg_risk_score"), F.sum("potential_leakage").cast("long").alias("leakage_count"),
             _pct(F.sum("potential_leakage"), F.nullif(F.count(F.lit(1)), F.lit(0))).alias("leakage_rate_pct"))
        .select(F.when(F.col("is_first_transaction"), "First Visit").otherwise("Repeat Visit").alias("visit_type"),
                "transaction_count", "avg_amount", "avg_risk_score", "leakage_count", "leakage_rate_pct")
        .orderBy(F.desc("avg_risk_score"))
    )


def q17(t: DataFrame, month: int = 3) -> DataFrame:
    return (
        t.filter((F.col("month") == month) & _debit()).groupBy("category")
        .agg(F.count(F.lit(1)).alias("transactions"), _r2(F.sum("dr_amount")).alias("total_spent"),
             _avg("dr_amount").alias("avg_amount"), _r2(F.max("dr_amount")).alias("largest_transaction"),
             F.sum("potential_leakage").cast("long").alias("leakage_count"))
        .orderBy(F.desc("total_spent"))
    )


TWINS = {f"q{i:02d}": globals()[f"q{i:02d}"] for i in range(1, 18)}
