"""SCO-01…10: the 0–100 leakage risk score.

Five factors of 0–20 points.  Only the amount factor needs more than the row itself: the
average-tie percentile rank of the debit amount among all debits (recipe R2 — a histogram
of distinct amounts, a running count, one join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.rounding import round_half_even
from spendlens.operators.ordered import join_heavy_keys, pct_rank_table

# Category risk points (unknown categories score 5).
CATEGORY_RISK = {
    "Subscription": 20,
    "Entertainment": 18,
    "Food": 16,
    "Shopping": 15,
    "Recurring_Micro": 10,
    "One_off_Micro": 8,
    "Electronics": 12,
    "Travel": 8,
    "Recurring_Transfer": 5,
    "One_off_Transfer": 4,
    "Recurring_Large": 3,
    "One_off_Large": 3,
    "Utilities": 2,
    "Healthcare": 2,
    "Grocery": 2,
    "Finance": 1,
    "Income_Transfer": 0,
    "Interest": 0,
    "Bank Charges": 0,
    "Bank Transfer": 0,
    "Cash Withdrawal": 0,
}
UNKNOWN_CATEGORY_RISK = 5

# Frequency label points (anything else scores 5).
FREQUENCY_RISK = {"Frequent": 20, "Regular": 15, "Occasional": 8, "Rare": 3}
UNKNOWN_FREQUENCY_RISK = 5

SCORE_COLUMNS = ["score_category", "score_amount", "score_frequency", "score_timing", "score_recency"]


def _map_lookup(mapping: dict, key: F.Column, default: int) -> F.Column:
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.coalesce(F.try_element_at(F.create_map(*items), key), F.lit(default)).cast("int")


def score_category(category: F.Column) -> F.Column:
    """SCO-01."""
    return _map_lookup(CATEGORY_RISK, category, UNKNOWN_CATEGORY_RISK)


def score_frequency(label: F.Column) -> F.Column:
    """SCO-03."""
    return _map_lookup(FREQUENCY_RISK, label, UNKNOWN_FREQUENCY_RISK)


def score_timing(is_weekend: F.Column, day: F.Column) -> F.Column:
    """SCO-04: weekend +10, first five days of the month +10, clipped to 0–20."""
    s = is_weekend.cast("int") * 10 + (day <= 5).cast("int") * 10
    return F.least(F.greatest(s, F.lit(0)), F.lit(20))


def score_recency(count: F.Column, long_term: F.Column, first: F.Column) -> F.Column:
    """SCO-05: later rules override earlier ones (count ≥ 5 wins over long-term over first)."""
    s = F.when(count >= 5, 2).when(long_term, 5).when(first, 20).otherwise(10)
    return F.least(F.greatest(s, F.lit(0)), F.lit(20)).cast("int")


def risk_band(score: F.Column) -> F.Column:
    """SCO-07."""
    return (
        F.when(score <= 25, "Low Risk").when(score <= 50, "Moderate Risk").when(score <= 75, "High Risk").otherwise("Critical Risk")
    )


def amount_factor(features: DataFrame, by=(), amounts: DataFrame | None = None) -> DataFrame:
    """SCO-02: ``rint(pct_rank * 20)`` among debits, 0 for every other row and for missing amounts.

    ``amounts`` may be a stored table of the same transactions (direction, dr_amount) of one statement: the
    ranks come from it, and ``features`` is evaluated once.
    """
    ranked = (F.col("direction") == "DEBIT") & F.col("dr_amount").isNotNull()
    if amounts is not None:
        pct = pct_rank_table(amounts.filter(ranked).select("dr_amount"), "dr_amount", "__pct").withColumnRenamed("dr_amount", "__debit")
        # rows that are not ranked have a NULL key and are spread over the join's tasks
        keyed = features.withColumn("__debit", F.when(ranked, F.col("dr_amount")))
        points = F.when(ranked, F.rint(F.col("__pct") * 20.0).cast("int")).otherwise(0)
        return join_heavy_keys(keyed, pct, ["__debit"], "__cnt", how="left").select(*features.columns, points.alias("score_amount"))
    debits = features.filter(ranked)
    pct = pct_rank_table(debits.select(*by, "dr_amount"), "dr_amount", "__pct", by=by)
    # only debits are joined with the per-amount table; every other row scores 0 without a
    # shuffle (credits all have dr_amount = 0 and would land on one reducer); frequent prices apart
    scored = join_heavy_keys(debits, pct, [*by, "dr_amount"], "__cnt").select(
        *features.columns, F.rint(F.col("__pct") * 20.0).cast("int").alias("score_amount")
    )
    others = features.filter(~F.coalesce(ranked, F.lit(False))).withColumn("score_amount", F.lit(0))
    return scored.unionByName(others)


def score_transactions(features: DataFrame, by=(), amounts: DataFrame | None = None) -> DataFrame:
    """SCO-01…07: the 63-column scored table (the amount rank is per ``by`` group; ``amounts`` as in ``amount_factor``)."""
    df = amount_factor(features, list(by), amounts)
    df = df.select(
        *features.columns,
        score_category(F.col("category")).alias("score_category"),
        F.col("score_amount"),
        score_frequency(F.col("entity_frequency")).alias("score_frequency"),
        score_timing(F.col("is_weekend"), F.col("day")).alias("score_timing"),
        score_recency(F.col("entity_transaction_count"), F.col("is_long_term_entity"), F.col("is_first_transaction")).alias("score_recency"),
    )
    total = sum((F.col(c) for c in SCORE_COLUMNS[1:]), F.col(SCORE_COLUMNS[0]))
    df = df.withColumn("leakage_score", F.least(F.greatest(total, F.lit(0)), F.lit(100)).cast("int"))
    return df.withColumn("risk_band", risk_band(F.col("leakage_score")))


def leak_listing(scored: DataFrame) -> DataFrame:
    """SCO-08: flagged rows by score (descending)."""
    return (
        scored.filter(F.col("potential_leakage") == 1)
        .select("txn_no", "category", F.col("dr_amount").cast("double").alias("dr_amount"), "leakage_score", "risk_band")
        .orderBy(F.desc("leakage_score"), "txn_no")
    )


def band_histogram(scored: DataFrame) -> DataFrame:
    """SCO-09 / REP-02."""
    return scored.groupBy("risk_band").agg(F.count(F.lit(1)).alias("n"))


def mean_score_by(scored: DataFrame, key: str, debit_only: bool) -> DataFrame:
    """SCO-10 / REP-05: mean score per key, half-even 1 dp, descending."""
    df = scored.filter(F.col("direction") == "DEBIT") if debit_only else scored
    return (
        df.groupBy(key)
        .agg(round_half_even(F.sum("leakage_score").cast("double") / F.count(F.lit(1)), 1).alias("mean_score"))
        .orderBy(F.desc("mean_score"), key)
    )
