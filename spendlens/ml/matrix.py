"""ML-01/02: the model matrix and class statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions.rounding import round_half_even

# The model features, in order.
FEATURE_COLS = [
    "dr_amount", "cr_amount", "amount",
    "is_small_transaction", "is_medium_transaction", "is_high_value_transaction",
    "month", "day", "is_weekend", "quarter", "week",
    "entity_transaction_count", "entity_total_amount", "entity_avg_amount", "entity_days_active",
    "entity_transactions_per_day", "entity_debit_count", "entity_credit_count",
    "entity_avg_debit", "entity_avg_credit",
    "is_regular_entity", "is_long_term_entity", "is_weekend_spending", "is_recurring_entity",
    "is_subscription", "is_first_transaction", "is_recent_transaction",
    "running_expense", "net_cash_flow", "monthly_spend", "monthly_savings",
]
TARGET_COL = "potential_leakage"


def feature_matrix(scored: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(txn_no, <features as DOUBLE, booleans as 0/1, NULL → 0>, label INT).

    Features absent from the input are skipped (the reference only warns).
    """
    wanted = features or FEATURE_COLS
    present = [c for c in wanted if c in scored.columns]
    cols = []
    for c in present:
        dt = scored.schema[c].dataType
        x = F.col(c).cast("int") if isinstance(dt, T.BooleanType) else F.col(c)
        cols.append(F.coalesce(x.cast("double"), F.lit(0.0)).alias(c))
    return scored.select("txn_no", *cols, F.col(TARGET_COL).cast("int").alias("label"))


def class_stats(matrix: DataFrame) -> DataFrame:
    """ML-02: positives, negatives, positive rate, and ``round(neg/pos, 2)`` (pos weight)."""
    agg = matrix.agg(
        F.count_if(F.col("label") == 1).cast("long").alias("n_pos"),
        F.count_if(F.col("label") == 0).cast("long").alias("n_neg"),
    )
    return agg.select(
        "n_pos",
        "n_neg",
        (F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).alias("positive_rate"),
        round_half_even(F.col("n_neg") / F.col("n_pos"), 2).alias("scale_pos_weight"),
    )
