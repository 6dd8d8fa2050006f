"""FEA-01…14: the 56-column feature table.

Plan shape (row-level shuffles in brackets):

* time and amount columns are narrow expressions;
* one partial aggregate per ``(entity_id, txn_date)`` — ``day`` — carries counts, sums,
  the smallest ``txn_no`` of the day; entity aggregates (FEA-04/05/06) aggregate
  ``day`` again, and the previous active date of an entity (FEA-07, recipe R5) is a
  ``lag`` over ``day`` partitioned by entity (at most one row per active date, so a
  skewed entity such as ``BANK_TRANSFER`` or ``UNKNOWN`` stays small);
* running totals (FEA-12) are the distributed prefix sum R1 over the stored, range-partitioned clean
  table [shuffle 1];
* rows join the enriched ``day`` table once [shuffle 2], days that hold very many rows apart; the
  first row of a day takes the previous active date, the others the same date;
* monthly aggregates (FEA-13) are at most 12 rows per year: broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.rounding import round_half_even
from spendlens.operators.ordered import PART, attach_group_totals, join_heavy_keys, null_safe_join, prefix_sums, range_parts

# Thresholds of the feature definitions.
MICRO_LEAKAGE_MAX = 500
LARGE_SHOPPING_MIN = 2000
FOOD_HABIT_MIN = 200
RECURRING_MIN_COUNT = 3
REGULAR_MIN_COUNT = 5
LONG_TERM_DAYS = 30
RECENT_DAYS = 30
TOTAL = "decimal(38,2)"  # totals grow with the data
LEAKAGE_CATEGORIES = ("Food", "Shopping", "Entertainment", "Subscription")

FEATURE_COLUMNS = [
    "txn_no", "txn_date", "payment_mode", "direction", "category", "entity_type", "entity_id",
    "description", "dr_amount", "cr_amount",
    "year", "quarter", "month", "month_name", "week", "day", "weekday", "is_weekend",
    "amount", "transaction_sign", "is_debit", "is_credit",
    "is_small_transaction", "is_medium_transaction", "is_high_value_transaction",
    "entity_transaction_count", "entity_total_amount", "entity_avg_amount",
    "entity_first_seen", "entity_last_seen", "entity_debit_count", "entity_credit_count",
    "entity_avg_debit", "entity_avg_credit", "entity_days_active",
    "entity_transactions_per_day", "entity_frequency",
    "previous_transaction_date", "days_since_last_transaction",
    "is_first_transaction", "is_recent_transaction",
    "is_regular_entity", "is_long_term_entity", "is_weekend_spending",
    "is_recurring_entity", "is_subscription",
    "is_micro_leakage", "is_large_shopping", "is_food_habit", "potential_leakage",
    "running_income", "running_expense", "net_cash_flow",
    "monthly_spend", "monthly_income", "monthly_savings",
]


def time_features(df: DataFrame) -> DataFrame:
    """FEA-01."""
    d = F.col("txn_date")
    return df.select(
        "*",
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.weekofyear(d).alias("week"),
        F.dayofmonth(d).alias("day"),
        F.date_format(d, "EEEE").alias("weekday"),
        (F.weekday(d) >= 5).alias("is_weekend"),
    )


def amount_features(df: DataFrame) -> DataFrame:
    """FEA-03."""
    dr = F.col("dr_amount")
    direction = F.col("direction")
    return df.select(
        "*",
        (dr + F.col("cr_amount")).alias("amount"),
        F.when(direction == "DEBIT", -1).when(direction == "CREDIT", 1).otherwise(0).alias("transaction_sign"),
        (direction == "DEBIT").alias("is_debit"),
        (direction == "CREDIT").alias("is_credit"),
        ((dr > 0) & (dr <= 500)).alias("is_small_transaction"),
        ((dr > 500) & (dr <= 5000)).alias("is_medium_transaction"),
        (dr > 5000).alias("is_high_value_transaction"),
    )


def frequency_label(count: F.Column) -> F.Column:
    """FEA-06."""
    return (
        F.when(count >= 10, "Frequent").when(count >= 5, "Regular").when(count >= 3, "Occasional").otherwise("Rare")
    )


def refined_category(category: F.Column, direction: F.Column, count: F.Column, dr: F.Column) -> F.Column:
    """FEA-02: split ``Transfer`` by direction, entity count and debit amount."""
    recurring = (
        F.when(dr < 500, "Recurring_Micro").when(dr < 2000, "Recurring_Transfer").otherwise("Recurring_Large")
    )
    one_off = F.when(dr < 500, "One_off_Micro").when(dr < 5000, "One_off_Transfer").otherwise("One_off_Large")
    return (
        F.when(category != "Transfer", category)
        .when(direction == "CREDIT", "Income_Transfer")
        .when(count >= RECURRING_MIN_COUNT, recurring)
        .otherwise(one_off)
    )


def _day_sums(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per (entity, active date): partial sums and the first txn_no."""
    return df.groupBy(*by, "entity_id", "txn_date").agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum("dr_amount").alias("__dr"),
        F.sum("cr_amount").alias("__cr"),
        F.count_if(F.col("direction") == "DEBIT").alias("__ndebit"),
        F.count_if(F.col("direction") == "CREDIT").alias("__ncredit"),
        F.min("txn_no").alias("__first_no"),
    )


def entity_table(day: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """FEA-04/05/06 per entity, aggregated from the per-day sums."""
    by = list(by)
    ent = day.groupBy(*by, "entity_id").agg(
        F.sum("__n").alias("entity_transaction_count"),
        F.sum("__dr").cast(TOTAL).alias("entity_total_amount"),
        F.sum("__cr").alias("__cr_total"),
        F.min("txn_date").alias("entity_first_seen"),
        F.max("txn_date").alias("entity_last_seen"),
        F.sum("__ndebit").alias("entity_debit_count"),
        F.sum("__ncredit").alias("entity_credit_count"),
    )
    n = F.col("entity_transaction_count")
    avg_dr = round_half_even(F.col("entity_total_amount").cast("double") / n, 2)
    days_active = F.datediff("entity_last_seen", "entity_first_seen") + 1
    return ent.select(
        *by,
        "entity_id",
        "entity_transaction_count",
        "entity_total_amount",
        avg_dr.alias("entity_avg_amount"),
        "entity_first_seen",
        "entity_last_seen",
        "entity_debit_count",
        "entity_credit_count",
        avg_dr.alias("entity_avg_debit"),
        round_half_even(F.col("__cr_total").cast("double") / n, 2).alias("entity_avg_credit"),
        days_active.alias("entity_days_active"),
        round_half_even(n / days_active, 3).alias("entity_transactions_per_day"),
        frequency_label(n).alias("entity_frequency"),
    )


def entity_totals(clean: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """FEA-04/05/06: one row per entity."""
    return entity_table(_day_sums(clean, by), by)


def entity_day_table(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per (entity, active date): the number of rows, the first txn_no, entity aggregates, lag."""
    by = list(by)
    day = _day_sums(df, by)
    prev_day = F.lag("txn_date").over(Window.partitionBy(*by, "entity_id").orderBy("txn_date"))
    dated = day.select(*by, "entity_id", "txn_date", "__n", "__first_no", prev_day.alias("__prev_day"))
    return dated.join(entity_table(day, by), on=[*by, "entity_id"], how="inner")


def monthly_totals(clean: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """FEA-13: spend, income and savings per (year, month)."""
    d = F.col("txn_date")
    monthly = clean.groupBy(*by, F.year(d).alias("year"), F.month(d).alias("month")).agg(
        F.sum("dr_amount").cast(TOTAL).alias("monthly_spend"), F.sum("cr_amount").cast(TOTAL).alias("monthly_income")
    )
    return monthly.withColumn("monthly_savings", (F.col("monthly_income") - F.col("monthly_spend")).cast(TOTAL))


def build_features(clean: DataFrame, by: Sequence[str] = (), keep_part: bool = False) -> DataFrame:
    """FEA-01…13 in the reference's step order; returns the 56 columns (after ``by``; ``keep_part``: and ``PART``).

    ``clean`` is best stored by ``range_parts`` in (txn_date, txn_no) order (the chain does so);
    otherwise it is stored here.  ``by`` (e.g. ``["account_id"]``) makes every aggregate, lag, running
    total and monthly total per group; empty reproduces the single-statement reference.
    """
    by = list(by)
    stored = clean if PART in clean.columns else range_parts(clean, [("txn_date", True), ("txn_no", True)], by, "clean-ordered")
    plain = stored.drop(PART)
    days = entity_day_table(plain, by)

    # FEA-12 running totals in (txn_date, txn_no) order.
    running = prefix_sums(stored, "txn_date", "txn_no", ["cr_amount", "dr_amount"], by=by, keep_part=keep_part)
    income, expense = F.col("cr_amount__cum").cast(TOTAL), F.col("dr_amount__cum").cast(TOTAL)
    running = running.select(
        *plain.columns, *[PART] * keep_part, income.alias("running_income"), expense.alias("running_expense"), (income - expense).cast(TOTAL).alias("net_cash_flow")
    )
    base = amount_features(time_features(running))
    rows = join_heavy_keys(base, days, [*by, "entity_id", "txn_date"], "__n")

    # FEA-02 needs the entity count; the refined category feeds FEA-09/10.
    rows = rows.withColumn(
        "category",
        refined_category(F.col("category"), F.col("direction"), F.col("entity_transaction_count"), F.col("dr_amount")),
    )

    # FEA-07/08 recency.
    prev = F.when(F.col("txn_no") == F.col("__first_no"), F.col("__prev_day")).otherwise(F.col("txn_date"))
    max_date = days.groupBy(*by).agg(F.max("entity_last_seen").alias("__max_date"))
    rows = attach_group_totals(rows.withColumn("previous_transaction_date", prev), max_date, by)
    days_since = F.coalesce(F.datediff("txn_date", "previous_transaction_date"), F.lit(-1))
    rows = rows.select(
        "*",
        days_since.alias("days_since_last_transaction"),
        (days_since == -1).alias("is_first_transaction"),
        (F.datediff("__max_date", "txn_date") <= RECENT_DAYS).alias("is_recent_transaction"),
    )

    # FEA-09 behaviour, FEA-10 leakage.
    n = F.col("entity_transaction_count")
    debit = F.col("is_debit")
    cat = F.col("category")
    in_leak = cat.isin(*LEAKAGE_CATEGORIES)
    rows = rows.select(
        "*",
        (n >= REGULAR_MIN_COUNT).alias("is_regular_entity"),
        (F.col("entity_days_active") >= LONG_TERM_DAYS).alias("is_long_term_entity"),
        (F.col("is_weekend") & debit).alias("is_weekend_spending"),
        (n >= RECURRING_MIN_COUNT).alias("is_recurring_entity"),
        (cat == "Subscription").alias("is_subscription"),
        (debit & in_leak & F.col("is_small_transaction")).alias("is_micro_leakage"),
        (debit & (cat == "Shopping") & (F.col("dr_amount") >= LARGE_SHOPPING_MIN)).alias("is_large_shopping"),
        (debit & (cat == "Food") & (F.col("dr_amount") >= FOOD_HABIT_MIN)).alias("is_food_habit"),
        (debit & in_leak).cast("int").alias("potential_leakage"),
    )

    # FEA-13 monthly aggregates.  Without groups the table has ≤ 12 rows per year: broadcast; per
    # account it grows with the accounts, so the join strategy is left to AQE.
    monthly = monthly_totals(plain, by)
    if by:
        rows = null_safe_join(rows, monthly, [*by, "year", "month"])
    else:
        rows = rows.join(F.broadcast(monthly), on=["year", "month"], how="left")
    return rows.select(*by, *FEATURE_COLUMNS, *[PART] * keep_part)


def leakage_rate(features: DataFrame) -> DataFrame:
    """FEA-11: flagged count, total and percentage (half-even, 2 dp)."""
    return features.agg(
        F.sum("potential_leakage").cast("long").alias("leakage_count"),
        F.count(F.lit(1)).alias("transactions"),
        round_half_even(F.sum("potential_leakage") / F.count(F.lit(1)) * 100.0, 2).alias("leakage_pct"),
    )


def feature_summary(features: DataFrame) -> DataFrame:
    """FEA-14: leakage counts, category histogram and the first monthly values per month name.

    Long format ``(section, item, value DOUBLE)``; "first" is the earliest row in
    ``(txn_date, txn_no)`` order within a month name (so the earliest year).
    """
    leak = features.groupBy("potential_leakage").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("potential_leakage").alias("section"), F.col("potential_leakage").cast("string").alias("item"), F.col("n").cast("double").alias("value")
    )
    cats = features.groupBy("category").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("category").alias("section"), F.col("category").alias("item"), F.col("n").cast("double").alias("value")
    )
    first = features.groupBy("month_name").agg(
        F.min_by(
            F.struct("monthly_spend", "monthly_income", "monthly_savings"), F.struct("txn_date", "txn_no")
        ).alias("m")
    )
    monthly = first.select(
        "month_name",
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("section"), F.col(f"m.{c}").cast("double").alias("value")) for c in ("monthly_spend", "monthly_income", "monthly_savings")]
            )
        ).alias("kv"),
    ).select(F.col("kv.section").alias("section"), F.col("month_name").alias("item"), F.col("kv.value").alias("value"))
    return leak.unionByName(cats).unionByName(monthly)
