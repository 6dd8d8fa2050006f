"""Analytical reports: Q01…Q17 (Spark SQL over the ``transactions`` view) and REP-01…14.

The SQL files under ``plans/sql`` are the user-facing queries.  Two of them read helper
views that a distributed operator produces, because their plain SQL form would order the
whole table in one task:

* ``debit_deciles`` — NTILE(10) by score over debits (recipe R3, Q09);
* ``debit_percentiles`` — exact PERCENTILE_CONT(0.75 / 0.90) of positive debits from a
  histogram of distinct amounts and a running count (Q15).
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.rounding import round_half_even
from spendlens.operators.ordered import attach_group_totals, ntile, range_parts, running_sum

SQL_DIR = Path(__file__).parent / "sql"


def sql_text(name: str, **params) -> str:
    text = (SQL_DIR / f"{name}.sql").read_text()
    for k, v in params.items():
        text = text.replace("${" + k + "}", str(v))
    return text


# ---------------------------------------------------------------------------
# Helper views
# ---------------------------------------------------------------------------


def debit_deciles(transactions: DataFrame) -> DataFrame:
    """Debits with ``score_decile`` = NTILE(10) OVER (ORDER BY leakage_score DESC, txn_no)."""
    debits = transactions.filter(F.col("direction") == "DEBIT").select(
        "txn_no", "month_name", "month", "dr_amount", F.col("leakage_score").cast("int").alias("score")
    )
    return ntile(debits, 10, [("score", False), ("txn_no", True)], "score_decile")


def percentile_cont(df: DataFrame, value_col: str, fractions: dict[str, float]) -> DataFrame:
    """Exact ``PERCENTILE_CONT(f) WITHIN GROUP (ORDER BY value)`` for each named fraction.

    Histogram of distinct values (partial aggregation) → running count by value
    (distributed) → the two ranks around ``f·(n−1)`` are looked up and interpolated.  One
    output row; no task ever holds the values of the group.
    """
    hist = df.groupBy(value_col).agg(F.count(F.lit(1)).alias("__cnt"))
    stored = range_parts(hist, [(value_col, True)])
    cum = running_sum(stored, [(value_col, True)], ["__cnt"])
    totals = stored.agg(F.sum("__cnt").alias("__n"))
    j = attach_group_totals(cum, totals, [])
    before = F.col("__cnt__cum") - F.col("__cnt")  # rows strictly below this value
    aggs = []
    for name, f in fractions.items():
        h = F.lit(float(f)) * (F.col("__n") - 1)
        lo, hi = F.floor(h), F.ceil(h)
        aggs += [
            F.max(F.when((before <= lo) & (lo < F.col("__cnt__cum")), F.col(value_col).cast("double"))).alias(f"__{name}_lo"),
            F.max(F.when((before <= hi) & (hi < F.col("__cnt__cum")), F.col(value_col).cast("double"))).alias(f"__{name}_hi"),
            F.max(h - lo).alias(f"__{name}_frac"),
        ]
    one = j.agg(*aggs)
    return one.select(
        *[
            (F.col(f"__{n}_lo") + (F.col(f"__{n}_hi") - F.col(f"__{n}_lo")) * F.col(f"__{n}_frac")).alias(n)
            for n in fractions
        ]
    )


def debit_percentiles(transactions: DataFrame) -> DataFrame:
    positive = transactions.filter((F.col("direction") == "DEBIT") & (F.col("dr_amount") > 0)).select("dr_amount")
    return percentile_cont(positive, "dr_amount", {"p75": 0.75, "p90": 0.90})


# helper views by the report that reads them
HELPERS = {"q09": ("debit_deciles", debit_deciles), "q15": ("debit_percentiles", debit_percentiles)}


def run_query(spark: SparkSession, transactions: DataFrame, name: str, **params) -> DataFrame:
    """Q01…Q17 through ``spark.sql``.

    Tables are passed by name into the text (``{transactions}``), so nothing is registered in the
    session and two inputs never meet; only the helper that a report reads is built.
    """
    tables = {"transactions": transactions}
    if name in HELPERS:
        view, make = HELPERS[name]
        tables[view] = make(transactions)
    if name == "q17":
        params.setdefault("month", 3)
    text = sql_text(name, **params)
    return spark.sql(text, **{k: v for k, v in tables.items() if "{" + k + "}" in text})


# ---------------------------------------------------------------------------
# REP: profiling and dashboard datasets
# ---------------------------------------------------------------------------

def _describe_aggs(col: str) -> list:
    x = F.col(col).cast("double")
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [
        F.count(x).alias("count"),
        round_half_even(F.avg(x), 2).alias("mean"),
        round_half_even(F.stddev_samp(x), 2).alias("std"),
        round_half_even(F.min(x), 2).alias("min"),
        round_half_even(q[0], 2).alias("p25"),
        round_half_even(q[1], 2).alias("p50"),
        round_half_even(q[2], 2).alias("p75"),
        round_half_even(F.max(x), 2).alias("max"),
    ]


def score_describe(scored: DataFrame) -> DataFrame:
    """REP-01: pandas ``describe()`` of the score (exact quartiles: ≤101 distinct values)."""
    return scored.agg(*_describe_aggs("leakage_score"))


def score_describe_by_label(scored: DataFrame) -> DataFrame:
    """REP-03."""
    return scored.groupBy("potential_leakage").agg(*_describe_aggs("leakage_score"))


def top_scored(scored: DataFrame, k: int = 10) -> DataFrame:
    """REP-04: ``nlargest`` keeps the earliest rows among ties (date, then id)."""
    return (
        scored.select("txn_no", "txn_date", "category", F.col("dr_amount").cast("double").alias("dr_amount"), "leakage_score", "risk_band")
        .orderBy(F.desc("leakage_score"), "txn_date", "txn_no")
        .limit(k)
    )


def factor_means(scored: DataFrame) -> DataFrame:
    """REP-06: mean of each factor (half-even, 2 dp) as (factor, mean) rows."""
    from spendlens.operators.scoring import SCORE_COLUMNS

    wide = scored.agg(*[round_half_even(F.avg(F.col(c).cast("double")), 2).alias(c) for c in SCORE_COLUMNS])
    return wide.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("mean")) for c in SCORE_COLUMNS])).alias("kv")
    ).select("kv.factor", "kv.mean")


def kpi_cards(t: DataFrame) -> DataFrame:
    """REP-07: income, expenses, net savings, leakage rate."""
    return t.agg(
        F.sum("cr_amount").cast("double").alias("total_income"),
        F.sum("dr_amount").cast("double").alias("total_expenses"),
        (F.sum("cr_amount") - F.sum("dr_amount")).cast("double").alias("net_savings"),
        F.round(F.sum("potential_leakage") * F.lit(100.0).cast("decimal(4,1)") / F.count(F.lit(1)), 2).cast("double").alias("leakage_rate_pct"),
    )


def monthly_series(t: DataFrame) -> DataFrame:
    """REP-08 (Q01 subset)."""
    return t.groupBy("month_name", "month").agg(
        F.sum("cr_amount").cast("double").alias("total_income"),
        F.sum("dr_amount").cast("double").alias("total_expenses"),
    ).orderBy("month")


def group_sum(t: DataFrame, key: str, value: str = "dr_amount", debit_only: bool = True, flagged_only: bool = False) -> DataFrame:
    """REP-09/11/12: one group-sum with a key argument (plus a count when flagged)."""
    df = t
    if debit_only:
        df = df.filter(F.col("direction") == "DEBIT")
    if flagged_only:
        df = df.filter(F.col("potential_leakage") == 1)
        return df.groupBy(key).agg(
            F.count(F.lit(1)).alias("leakage_count"), F.sum(value).cast("double").alias("leakage_amount")
        )
    return df.groupBy(key).agg(F.sum(value).cast("double").alias("total_spent"))


def leakage_by_month(t: DataFrame) -> DataFrame:
    """REP-10."""
    return t.groupBy("month_name", "month").agg(F.sum("potential_leakage").cast("long").alias("leakage_count")).orderBy("month")


def high_risk_table(t: DataFrame) -> DataFrame:
    """REP-13: rows in the ``High Risk`` band only."""
    return t.filter(F.col("risk_band") == "High Risk").select(
        "txn_no", "txn_date", "category", "entity_id",
        F.col("dr_amount").cast("double").alias("amount"), F.col("leakage_score").cast("double").alias("leakage_score"),
    )


def findings(t: DataFrame) -> DataFrame:
    """REP-14: headline findings composed from Q04, Q05, Q14 and Q16 (one row).

    One pass groups the transactions by every attribute that a finding needs (months, weekdays,
    channels and two flags: a few thousand groups at most); the findings aggregate that table.
    """
    debit = F.col("direction") == "DEBIT"
    cube = t.groupBy("month_name", "month", "weekday", "payment_mode", debit.alias("debit"), "is_first_transaction").agg(
        F.count(F.lit(1)).alias("n"), F.sum("potential_leakage").alias("leaks"),
        F.sum("leakage_score").alias("score"), F.count("leakage_score").alias("scored"),
    )
    cube = cube.withColumn("kind", F.when(F.col("debit") & F.col("is_first_transaction"), "first").when(F.col("debit"), "repeat"))
    rate = F.round(F.sum("leaks") * F.lit(100.0).cast("decimal(4,1)") / F.sum("n"), 2).cast("double")
    mean = F.round(F.sum("score") / F.sum("scored"), 2).cast("double")
    whole = cube.agg(rate.alias("leakage_rate_pct"))
    month = cube.groupBy("month_name", "month").agg(rate.alias("r")).agg(
        F.min_by("month_name", F.struct(-F.col("r"), F.col("month"))).alias("highest_risk_month")
    )
    day = cube.where("debit").groupBy("weekday").agg(mean.alias("r")).agg(
        F.min_by("weekday", F.struct(-F.col("r"), F.col("weekday"))).alias("riskiest_day")
    )
    upi = cube.where("payment_mode = 'UPI'").agg(rate.alias("upi_leakage_rate_pct"))
    visits = cube.where("kind is not null").groupBy("kind").agg(rate.alias("r")).agg(
        F.max(F.when(F.col("kind") == "first", F.col("r"))).alias("first_visit_rate_pct"),
        F.max(F.when(F.col("kind") == "repeat", F.col("r"))).alias("repeat_visit_rate_pct"),
    )
    out = whole
    for part in (month, day, upi, visits):
        out = attach_group_totals(out, part, [])
    return out
