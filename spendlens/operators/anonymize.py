"""Parse, categorise and tokenise transactions (PAR-01…10, ANO-01…05).

``clean_transactions`` turns the processed statement into the 10-column clean table:

1. channel rule per row (one CASE chain, codegen);
2. UPI payee keys are reduced to the **distinct** keys with their first appearance
   ``(txn_date, txn_no)`` — a partial aggregation, so a hot payee never lands in one task;
3. keys are categorised (lookup joins + keyword rules) and numbered per entity type in
   first-appearance order with the distributed row number (R4), giving
   ``PERSON_001``… / ``MERCHANT_001``… (``%03d`` widens past 999);
4. one join of the rows with the key table, frequent payees apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.describe import entity_type_of, parse_struct, stripped_description
from spendlens.operators.categorize import categorize_keys
from spendlens.operators.ordered import join_heavy_keys, row_number_by
from spendlens.session import materialize, read_if_there

HASH_DIGITS = 32  # hexadecimal: 128 bits

CLEAN_COLUMNS = [
    "txn_no",
    "txn_date",
    "payment_mode",
    "direction",
    "category",
    "entity_type",
    "entity_id",
    "description",
    "dr_amount",
    "cr_amount",
]


def parse_channels(processed: DataFrame) -> DataFrame:
    """PAR-01…06: adds ``__p``, the parsed struct (one CASE per row)."""
    return processed.withColumn("__p", parse_struct(stripped_description(F.col("description"))))


def payee_table(parsed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The distinct payee keys: first appearance and number of rows (a partial aggregation)."""
    by = list(by)
    return (
        parsed.select(*by, F.col("__p.payee_key").alias("payee_key"), "txn_date", "txn_no")
        .filter(F.col("payee_key").isNotNull())
        .groupBy(*by, "payee_key")
        .agg(F.min(F.struct("txn_date", "txn_no")).alias("__first"), F.count(F.lit(1)).alias("n_rows"))
        .select(*by, "payee_key", F.col("__first.txn_date").alias("first_date"), F.col("__first.txn_no").alias("first_no"), "n_rows")
    )


def typed_payees(keys: DataFrame, lookup: DataFrame) -> DataFrame:
    """PAR-10: category and entity type of distinct payee keys."""
    return categorize_keys(keys, lookup, "payee_key").withColumn("entity_type", entity_type_of(F.col("category")))


def payee_tokens(parsed: DataFrame, lookup: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ANO-02 key table: (payee_key, category, entity_type, entity_id, first_date, first_no, n_rows).

    The numbering stores its input by ranges of first appearance, so the categorisation runs once.
    """
    by = list(by)
    numbered = row_number_by(
        typed_payees(payee_table(parsed, by), lookup),
        [("first_date", True), ("first_no", True)],
        "token_no",
        by=[*by, "entity_type"],
    )
    return numbered.withColumn("entity_id", F.format_string("%s_%03d", F.col("entity_type"), F.col("token_no")))


def hashed_tokens(parsed: DataFrame, lookup: DataFrame, salt: str, by: Sequence[str] = ()) -> DataFrame:
    """ANO-02, second mode: tokens from 128 bits of a salted hash of the payee key.

    No counter, so no order: the same payee has the same token in every load, also across
    statements that are processed apart.  ``shared_tokens`` tells whether two payees met.
    """
    typed = typed_payees(payee_table(parsed, by), lookup)
    digest = F.substring(F.sha2(F.concat(F.lit(salt), F.lit("|"), F.col("payee_key")), 256), 1, HASH_DIGITS)
    return typed.withColumn("entity_id", F.concat_ws("_", F.col("entity_type"), digest))


def shared_tokens(tokens: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tokens that stand for more than one payee key: (by…, entity_id, n_keys); empty for a sound table."""
    counts = tokens.groupBy(*by, "entity_id").agg(F.count_distinct("payee_key").alias("n_keys"))
    return counts.where("n_keys > 1")


def new_tokens(known: DataFrame | None, parsed: DataFrame, lookup: DataFrame) -> DataFrame:
    """ANO-02 over deliveries: the rows that a delivery adds to the token dictionary ``known``.

    A payee that has a token keeps it, whatever the delivery or the lookup says.  New ones are numbered in
    order of first appearance after the last number of their entity type, so chronological deliveries give
    the tokens of one load.
    """
    payees = payee_table(parsed)
    if known is not None:
        payees = payees.join(known.select("payee_key"), "payee_key", "left_anti")
    order = [("first_date", True), ("first_no", True)]
    numbered = row_number_by(typed_payees(payees, lookup), order, "__place", by=["entity_type"])
    if known is None:
        placed = numbered.withColumn("token_no", F.col("__place"))
    else:
        last = known.groupBy("entity_type").agg(F.max("token_no").alias("__last"))  # one row per entity type
        placed = numbered.join(F.broadcast(last), "entity_type", "left").withColumn("token_no", F.coalesce("__last", F.lit(0)) + F.col("__place"))
    return placed.select(
        "payee_key", "category", "entity_type", "first_date", "first_no", "token_no",
        F.format_string("%s_%03d", F.col("entity_type"), F.col("token_no")).alias("entity_id"),
    )


def grow_dictionary(path: str, parsed: DataFrame, lookup: DataFrame) -> DataFrame:
    """Append a delivery's new payees to the token dictionary stored at ``path``; returns the dictionary.

    The dictionary only grows, and a delivery that is replayed adds nothing.
    """
    spark = parsed.sparkSession
    known = read_if_there(spark, path)
    added = materialize(new_tokens(known, parsed, lookup), "new-tokens", uuid.uuid4().hex)
    if known is None or not added.isEmpty():
        added.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def delivery_tokens(dictionary: DataFrame, parsed: DataFrame) -> DataFrame:
    """The dictionary's entries of one delivery, with its number of rows per payee (for ``clean_transactions``)."""
    return payee_table(parsed).select("payee_key", "n_rows").join(dictionary, "payee_key")


def parsed_rows(processed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The parse result per row: ids, amounts, the ``__p`` struct and ``payee_key``."""
    return parse_channels(processed).select(
        *by, "txn_no", "txn_date", "dr_amount", "cr_amount", "__p", F.col("__p.payee_key").alias("payee_key")
    )


def clean_transactions(
    processed: DataFrame, lookup: DataFrame, by: Sequence[str] = (), parsed: DataFrame | None = None,
    tokens: DataFrame | None = None,
) -> DataFrame:
    """ANO-03/04: the 10-column clean table (raw description, balance, branch, cheque dropped).

    ``parsed`` may be a stored ``parsed_rows`` table and ``tokens`` a stored ``payee_tokens`` table
    (their work is then not repeated).
    """
    by = list(by)
    if parsed is None:
        parsed = parsed_rows(processed, by)
    if tokens is None:
        tokens = payee_tokens(parsed, lookup, by)
    tokens = tokens.select(
        *by, "payee_key", F.col("category").alias("__cat"), F.col("entity_type").alias("__etype"), F.col("entity_id").alias("__eid"), "n_rows"
    )
    # Only UPI rows carry a payee key: they alone are joined.  The other rows (NULL key)
    # bypass the shuffle — NULL keys would all hash to one reducer.
    has_key = F.col("payee_key").isNotNull()
    # Frequent payees are joined apart.
    j = join_heavy_keys(parsed.filter(has_key), tokens, [*by, "payee_key"], "n_rows").unionByName(
        parsed.filter(~has_key).select(
            "*",
            F.lit(None).cast("string").alias("__cat"),
            F.lit(None).cast("string").alias("__etype"),
            F.lit(None).cast("string").alias("__eid"),
        )
    )
    p = lambda f: F.col(f"__p.{f}")
    clean_desc = F.coalesce(
        p("clean_description"),
        F.concat_ws("_", F.lit("UPI"), p("direction"), F.col("__etype"), F.col("__eid")),
    )
    return j.select(
        *by,
        "txn_no",
        "txn_date",
        p("payment_mode").alias("payment_mode"),
        p("direction").alias("direction"),
        F.coalesce(p("category"), F.col("__cat")).alias("category"),
        F.coalesce(p("entity_type"), F.col("__etype")).alias("entity_type"),
        F.coalesce(p("entity_id"), F.col("__eid")).alias("entity_id"),
        clean_desc.alias("description"),
        "dr_amount",
        "cr_amount",
    )


def anonymization_summary(clean: DataFrame) -> DataFrame:
    """ANO-05: (section, item, n) — totals and the category histogram."""
    totals = clean.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count_distinct(F.when(F.col("entity_type") == "PERSON", F.col("entity_id"))).alias("unique_persons"),
        F.count_distinct(
            F.when((F.col("entity_type") == "MERCHANT") & F.col("payment_mode").eqNullSafe("UPI"), F.col("entity_id"))
        ).alias("unique_merchants"),
    )
    totals_long = totals.select(
        F.lit("total").alias("section"),
        F.explode(
            F.array(
                F.struct(F.lit("transactions").alias("item"), F.col("transactions").alias("n")),
                F.struct(F.lit("unique_persons").alias("item"), F.col("unique_persons").alias("n")),
                F.struct(F.lit("unique_merchants").alias("item"), F.col("unique_merchants").alias("n")),
            )
        ).alias("kv"),
    ).select("section", "kv.item", "kv.n")
    hist = clean.groupBy("category").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("category").alias("section"), F.col("category").alias("item"), "n"
    )
    return totals_long.unionByName(hist)
