"""SNK-01…06: the typed 64-column load table and its checks.

The reference loads a CSV into a relational table (DROP + CREATE, insert with
``ON CONFLICT (txn_no) DO NOTHING``).  Here the table is parquet partitioned by
``(year, month)``; the keyed insert is an anti-join against the target plus a
keep-first per key; constraint violations are collected into a reject DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.operators.ordered import attach_group_totals
from spendlens.session import materialize_buckets

# Target columns and types of the load table, in table order.
LOAD_SCHEMA = [
    ("txn_no", "VARCHAR(20)"), ("txn_date", "DATE"),
    ("payment_mode", "VARCHAR(20)"), ("direction", "VARCHAR(10)"), ("category", "VARCHAR(50)"),
    ("entity_type", "VARCHAR(20)"), ("entity_id", "VARCHAR(20)"), ("description", "TEXT"),
    ("dr_amount", "NUMERIC(12,2)"), ("cr_amount", "NUMERIC(12,2)"), ("amount", "NUMERIC(12,2)"),
    ("year", "INT"), ("quarter", "INT"), ("month", "INT"), ("month_name", "VARCHAR(15)"),
    ("week", "INT"), ("day", "INT"), ("weekday", "VARCHAR(15)"), ("day_type", "VARCHAR(10)"),
    ("is_weekend", "BOOLEAN"),
    ("is_small_transaction", "BOOLEAN"), ("is_medium_transaction", "BOOLEAN"),
    ("is_high_value_transaction", "BOOLEAN"), ("transaction_sign", "INT"),
    ("is_debit", "BOOLEAN"), ("is_credit", "BOOLEAN"),
    ("entity_transaction_count", "INT"), ("entity_total_amount", "NUMERIC(12,2)"),
    ("entity_avg_amount", "NUMERIC(12,2)"), ("entity_days_active", "INT"),
    ("entity_transactions_per_day", "NUMERIC(8,3)"), ("entity_debit_count", "INT"),
    ("entity_credit_count", "INT"), ("entity_avg_debit", "NUMERIC(12,2)"),
    ("entity_avg_credit", "NUMERIC(12,2)"), ("entity_frequency", "VARCHAR(15)"),
    ("days_since_last_transaction", "INT"), ("is_first_transaction", "BOOLEAN"),
    ("is_recent_transaction", "BOOLEAN"),
    ("is_regular_entity", "BOOLEAN"), ("is_long_term_entity", "BOOLEAN"),
    ("is_weekend_spending", "BOOLEAN"), ("is_recurring_entity", "BOOLEAN"),
    ("is_subscription", "BOOLEAN"),
    ("is_micro_leakage", "BOOLEAN"), ("is_large_shopping", "BOOLEAN"), ("is_food_habit", "BOOLEAN"),
    ("potential_leakage", "INT"),
    ("leakage_score", "NUMERIC(6,2)"), ("score_category", "INT"), ("score_amount", "INT"),
    ("score_frequency", "INT"), ("score_timing", "INT"), ("score_recency", "INT"),
    ("risk_band", "VARCHAR(20)"),
    ("running_income", "NUMERIC(12,2)"), ("running_expense", "NUMERIC(12,2)"), ("net_cash_flow", "NUMERIC(12,2)"),
    ("monthly_spend", "NUMERIC(12,2)"), ("monthly_income", "NUMERIC(12,2)"), ("monthly_savings", "NUMERIC(12,2)"),
    ("predicted_leakage", "INT"), ("predicted_proba", "NUMERIC(6,4)"), ("correctly_identified", "BOOLEAN"),
]
LOAD_COLUMNS = [c for c, _ in LOAD_SCHEMA]

# Totals and counts grow with the data: the table holds them wider than the reference's types, so
# they are exact at any size.  Everything else must fit the reference's type (see ``rejects``).
TOTALS = {
    "entity_total_amount", "running_income", "running_expense", "net_cash_flow",
    "monthly_spend", "monthly_income", "monthly_savings",
}
COUNTS = {"entity_transaction_count", "entity_debit_count", "entity_credit_count"}
RATES = {"entity_transactions_per_day"}


def _spark_type(name: str, sql_type: str) -> str:
    t = sql_type.upper()
    if t.startswith("VARCHAR") or t == "TEXT":
        return "string"
    if t.startswith("NUMERIC"):
        p, s = _numeric_bound(t)
        return f"decimal({38 if name in TOTALS else max(p, 18)},{s})"
    if name in COUNTS:
        return "bigint"
    return {"INT": "int", "DATE": "date", "BOOLEAN": "boolean"}[t]


def _varchar_len(sql_type: str) -> int | None:
    t = sql_type.upper()
    return int(t[8:-1]) if t.startswith("VARCHAR(") else None


def _numeric_bound(sql_type: str):
    t = sql_type.upper()
    if not t.startswith("NUMERIC("):
        return None
    p, s = (int(x) for x in t[8:-1].split(","))
    return p, s


def missing_columns(df: DataFrame) -> list[str]:
    """SNK-01 report: target columns the input lacks (left NULL)."""
    return [c for c in LOAD_COLUMNS if c not in df.columns]


def conform(df: DataFrame) -> DataFrame:
    """SNK-01/02: project to the 64 target columns with the target types.

    Missing columns become typed NULLs; numerics are rounded to the column scale
    (half away from zero, like a NUMERIC insert).  No value is lost: a number beyond even the
    stored type is an error, never a NULL.
    """
    cols = []
    for name, sql_type in LOAD_SCHEMA:
        t = _spark_type(name, sql_type)
        if name not in df.columns:
            cols.append(F.lit(None).cast(t).alias(name))
            continue
        src = F.col(name)
        nb = _numeric_bound(sql_type)
        if nb is not None:
            exact = F.round(src, nb[1])
            kept = exact.try_cast(t)
            message = F.concat(F.lit(f"{name} beyond {t}: "), src.cast("string"))
            cols.append(F.when(src.isNotNull() & kept.isNull(), F.raise_error(message).cast(t)).otherwise(kept).alias(name))
            continue
        cols.append(src.cast(t).alias(name))
    return df.select(*cols)


def rejects(source: DataFrame) -> DataFrame:
    """SNK-02/05: rows that the table constraints would reject, with the reason.

    Checks VARCHAR lengths, NUMERIC overflow (totals and rates aside, which the table holds
    wider), ``txn_date NOT NULL`` and ``txn_no`` not null.  Duplicate keys are not rejected (the
    insert keeps the first).
    """
    reasons = []
    for name, sql_type in LOAD_SCHEMA:
        if name not in source.columns:
            continue
        n = _varchar_len(sql_type)
        if n is not None:
            reasons.append(F.when(F.length(F.col(name).cast("string")) > n, F.lit(f"{name}: longer than {n}")))
        nb = _numeric_bound(sql_type)
        if nb is not None and name not in TOTALS | RATES:
            p, s = nb
            limit = 10 ** (p - s)
            reasons.append(F.when(F.abs(F.round(F.col(name), s)) >= F.lit(limit), F.lit(f"{name}: overflows NUMERIC({p},{s})")))
    reasons.append(F.when(F.col("txn_date").isNull(), F.lit("txn_date: NOT NULL")))
    reasons.append(F.when(F.col("txn_no").isNull(), F.lit("txn_no: PRIMARY KEY is NULL")))
    arr = F.filter(F.array(*reasons), lambda x: x.isNotNull())
    return source.select("txn_no", arr.alias("reasons")).filter(F.size("reasons") > 0)


def constraint_counts(df: DataFrame) -> DataFrame:
    """SNK-05: NOT NULL and primary-key violations, as one row of counts."""
    keys = df.groupBy("txn_no").agg(F.count(F.lit(1)).alias("__n"))
    dup = keys.agg(
        F.coalesce(F.sum(F.when(F.col("__n") > 1, F.col("__n") - 1)), F.lit(0)).cast("long").alias("duplicate_keys"),
        F.count_if(F.col("txn_no").isNull()).cast("long").alias("null_keys"),
    )
    base = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("txn_date").isNull()).cast("long").alias("null_dates"))
    return attach_group_totals(base, dup, [])


def keep_first(incoming: DataFrame, seq_cols: list[str]) -> DataFrame:
    """SNK-04 (batch side): one row per ``txn_no`` — the first by ``seq_cols``.

    ``min_by`` over a struct is a partial aggregation, so a duplicated key is reduced
    map-side before the shuffle.
    """
    payload = [c for c in incoming.columns if c not in ("txn_no", *seq_cols)]
    agg = incoming.groupBy("txn_no").agg(
        F.min_by(F.struct(*payload), F.struct(*seq_cols)).alias("__row")
    )
    return agg.select("txn_no", "__row.*")


def insert_new(target: DataFrame | None, incoming: DataFrame, seq_cols: list[str]) -> DataFrame:
    """SNK-04: rows ``ON CONFLICT (txn_no) DO NOTHING`` would insert.

    Keep-first within the batch, then a ``left_anti`` join against existing keys.  A target bucketed by
    ``txn_no`` (``store_keyed``) is read as it lies: only the batch is shuffled, and into the same buckets.
    """
    batch = keep_first(incoming, seq_cols)
    if target is None:
        return batch
    return batch.join(target.select("txn_no"), on="txn_no", how="left_anti")


def store_keyed(df: DataFrame, name: str = "target") -> DataFrame:
    """``df`` stored in buckets of ``txn_no``, as many as shuffles have partitions."""
    return materialize_buckets(df, name, "txn_no", int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class LoadError(ValueError):
    """A load that the table constraints refuse; nothing was written."""


def load_table(source: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-02…05: check, conform and write ``source``; raises ``LoadError`` before writing anything.

    A source without one of the target columns loads NULLs there and is reported by a warning, like
    the reference's.
    """
    if absent := missing_columns(source):
        import logging

        logging.getLogger(__name__).warning("columns left NULL: %s", ", ".join(absent))
    bad = rejects(source).limit(5).collect()
    if bad:
        raise LoadError("; ".join(f"{r.txn_no}: {', '.join(r.reasons)}" for r in bad))
    write_table(conform(source), path, mode)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", max_records_per_file: int = 5_000_000) -> None:
    """SNK-03: full refresh (``overwrite``) or append, partitioned by year and month.

    Rows are range-partitioned on ``(year, month, txn_no)``: sampled boundaries give tasks
    of equal size even when one month holds most rows (``txn_no`` is unique), and each
    task covers a contiguous key range, so it writes into one or two partition folders.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        df.repartitionByRange(n, "year", "month", "txn_no")
        .write.mode(mode)
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("year", "month")
        .parquet(path)
    )


def verify(df: DataFrame) -> DataFrame:
    """SNK-06: total rows, flagged rows, date range."""
    return df.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(F.col("potential_leakage") == 1).cast("long").alias("leakage_flagged"),
        F.min("txn_date").alias("min_date"),
        F.max("txn_date").alias("max_date"),
    )

