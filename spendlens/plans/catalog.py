"""The query catalogue: one DataFrame-returning callable per operator key.

Every callable takes ``(spark, sf_dir)``, reads the driver tables under ``sf_dir`` (or
data Spark derives from them) and returns a DataFrame whose column names match the
DuckDB oracle of the same key (``spendlens.oracle.keys``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions import describe as D
from spendlens.operators import anonymize, categorize, features, load, scoring
from spendlens.plans import reports
from spendlens.plans.chain import build
from spendlens.session import materialize, table_path
from spendlens.sources import records, statement
from spendlens.sources.fixture import processed_from_orders, read_table
from spendlens.sources.lookup import normalize_lookup, read_lookup_records, write_lookup_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def key(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


def reportable(df: DataFrame) -> DataFrame:
    """Decimals as DOUBLE (exact decimal → nearest double) for engine-neutral output."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _t(spark, sf):
    return build(spark, sf)


# ---------------------------------------------------------------------------
# Derived inputs shared by several keys
# ---------------------------------------------------------------------------


_STAGE: dict[tuple, Any] = {}


def _once(spark: SparkSession, sf: str, name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once per application and input folder."""
    k = (spark.sparkContext.applicationId, sf, name)
    if k not in _STAGE:
        _STAGE[k] = make()
    return _STAGE[k]


def statement_files(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the written statement files (file_path, block, value)."""

    def write() -> str:
        path = table_path(spark, "statements", sf)
        statement.write_statements(statement.statement_lines_from_processed(processed_from_orders(spark, sf)), path)
        return path

    return statement.read_statements(spark, _once(spark, sf, "statements", write))


def statement_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """How each block of the files begins, and its header: a stage table of one row per block."""
    make = lambda: materialize(records.block_states(records.block_summaries(statement_files(spark, sf))), "statement-blocks", sf)
    return _once(spark, sf, "blocks", make)


def _counted_rows(spark, sf) -> tuple[DataFrame, Observation]:
    """Repaired and id-checked records after the header, a stage table written once, and the counters of that write."""

    def write():
        rows, seen = statement.observed_counters(statement.statement_rows(statement_files(spark, sf), statement_blocks(spark, sf)))
        return materialize(rows, "statement-rows", sf), seen

    return _once(spark, sf, "rows", write)


def _after_header_rows(spark, sf) -> DataFrame:
    return _counted_rows(spark, sf)[0]


def customer_lookup_raw(spark: SparkSession, sf: str) -> DataFrame:
    """A merchant lookup file derived from ``customer``: ``PAYEE <custkey>`` → segment.

    In file order (``pos``): the entry itself, a repeated header row (custkey % 100 = 0),
    a nameless row (custkey % 97 = 0), and a re-listing of the previous key with a new
    category (custkey % 13 = 0: first position, last value).
    """
    c = read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    ck = F.col("c_custkey")
    rows = F.array(
        F.struct(F.lit(0).alias("j"), F.concat(F.lit("PAYEE "), ck.cast("string")).alias("merchant_name"), F.col("c_mktsegment").alias("category")),
        F.struct(F.lit(1).alias("j"), F.when(ck % 100 == 0, F.lit("merchant_name")).alias("merchant_name"), F.when(ck % 100 == 0, F.lit("category")).alias("category")),
        F.struct(F.lit(2).alias("j"), F.lit(None).cast("string").alias("merchant_name"), F.when(ck % 97 == 0, F.lit("Food")).alias("category")),
        F.struct(F.lit(3).alias("j"), F.when(ck % 13 == 0, F.concat(F.lit(" payee "), (ck - 1).cast("string"), F.lit(" "))).alias("merchant_name"),
                 F.when(ck % 13 == 0, F.concat(F.lower(F.col("c_mktsegment")), F.lit("_dup"))).alias("category")),
    )
    return (
        c.select(ck, F.explode(rows).alias("r"))
        .filter(F.col("r.merchant_name").isNotNull() | F.col("r.category").isNotNull())
        .select((ck * 4 + F.col("r.j")).cast("long").alias("pos"), "r.merchant_name", "r.category")
    )


def customer_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The lookup as read from its written CSV file, normalised: a stage table."""

    def read() -> DataFrame:
        path = table_path(spark, "lookup-csv", sf)
        write_lookup_csv(customer_lookup_raw(spark, sf), path)
        return materialize(normalize_lookup(read_lookup_records(spark, path)), "customer-lookup", sf)

    return _once(spark, sf, "lookup", read)


def payee_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf).parsed
    return p.select("payee_key").filter(F.col("payee_key").isNotNull()).distinct()


# ---------------------------------------------------------------------------
# ING
# ---------------------------------------------------------------------------


@key("ing_01")
def ing_01(spark, sf):
    return statement_blocks(spark, sf).groupBy("file_path").agg(F.sum("n_lines").alias("n_lines"))


@key("ing_02")
def ing_02(spark, sf):
    return records.header_positions(statement_blocks(spark, sf))


@key("ing_03")
def ing_03(spark, sf):
    return _after_header_rows(spark, sf).select("file_path", "pos", "n_cells", "popped", "kept")


@key("ing_04")
def ing_04(spark, sf):
    return _after_header_rows(spark, sf).filter("loaded").select("file_path", "pos", "txn_id")


@key("ing_05")
def ing_05(spark, sf):
    """The counters that came along with the write of the rows: no pass of their own."""
    schema = "rows_loaded long, rows_corrected long, rows_skipped long"
    return spark.createDataFrame([_counted_rows(spark, sf)[1].get], schema)


@key("ing_06")
def ing_06(spark, sf):
    return statement.normalize_missing(_after_header_rows(spark, sf))


def _typed(spark, sf) -> DataFrame:
    """Typed rows, parsed once: five products read them and one sorts them."""
    make = lambda: materialize(statement.typed_rows(statement.normalize_missing(_after_header_rows(spark, sf))), "statement-typed", sf)
    return _once(spark, sf, "typed", make)


def _sequenced(spark, sf) -> DataFrame:
    return _once(spark, sf, "sequenced", lambda: statement.with_sequence(_typed(spark, sf)))


@key("ing_07")
def ing_07(spark, sf):
    return reportable(_typed(spark, sf).select("txn_no", "dr_amount", "cr_amount"))


@key("ing_08")
def ing_08(spark, sf):
    return reportable(_typed(spark, sf).select("txn_no", "balance"))


@key("ing_09")
def ing_09(spark, sf):
    return _typed(spark, sf).select("txn_no", "txn_date")


@key("ing_10")
def ing_10(spark, sf):
    return _sequenced(spark, sf).select("txn_no", "txn_date", "seq")


@key("ing_11")
def ing_11(spark, sf):
    """The lookup from a written CSV file; ``pos`` is the record's number in it."""
    return customer_lookup(spark, sf)


@key("ing_12")
def ing_12(spark, sf):
    """Stage round trip: the processed statement as parquet, from there as CSV, and read back from the CSV."""
    df = _sequenced(spark, sf).select("txn_no", "txn_date", "dr_amount", "cr_amount", "seq")
    path = table_path(spark, "stage-processed", sf)
    df.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    stored.write.mode("overwrite").option("header", True).csv(path + "-csv")
    return reportable(spark.read.option("header", True).schema(stored.schema).csv(path + "-csv"))


# ---------------------------------------------------------------------------
# PAR / ANO
# ---------------------------------------------------------------------------


def _parsed(spark, sf) -> DataFrame:
    return _t(spark, sf).parsed


def _p(f):
    return F.col(f"__p.{f}").alias(f)


@key("par_01")
def par_01(spark, sf):
    return _parsed(spark, sf).select("txn_no", _p("kind"), _p("payment_mode"), _p("direction"))


def _fixed_rows(spark, sf, kinds):
    return _parsed(spark, sf).filter(F.col("__p.kind").isin(*kinds)).select(
        "txn_no", _p("payment_mode"), _p("direction"), _p("category"), _p("entity_type"), _p("entity_id"),
        F.col("__p.clean_description").alias("description"),
    )


@key("par_02")
def par_02(spark, sf):
    return _fixed_rows(spark, sf, ["SMS", "INTEREST"])


@key("par_03")
def par_03(spark, sf):
    return _fixed_rows(spark, sf, ["ATM", "IMPS", "CARD"])


@key("par_04")
def par_04(spark, sf):
    return _parsed(spark, sf).filter(F.col("__p.kind") == "NEFT").select("txn_no", _p("direction"))


def _upi(spark, sf):
    return _parsed(spark, sf).filter(F.col("__p.kind") == "UPI")


@key("par_05")
def par_05(spark, sf):
    return _upi(spark, sf).select("txn_no", _p("direction"), _p("n_parts"))


@key("par_06")
def par_06(spark, sf):
    return _upi(spark, sf).select("txn_no", _p("payee_raw"))


@key("par_07")
def par_07(spark, sf):
    return categorize.exact_match(payee_keys(spark, sf), customer_lookup(spark, sf))


@key("par_08")
def par_08(spark, sf):
    return categorize.first_substring_match(payee_keys(spark, sf), customer_lookup(spark, sf))


@key("par_09")
def par_09(spark, sf):
    return payee_keys(spark, sf).select("payee_key", D.keyword_category(F.col("payee_key")).alias("keyword_category"))


@key("par_10")
def par_10(spark, sf):
    return anonymize.typed_payees(payee_keys(spark, sf), _t(spark, sf).lookup).select("payee_key", "category", "entity_type")


@key("ano_01")
def ano_01(spark, sf):
    raw = F.col("__p.payee_raw")
    return _upi(spark, sf).select("txn_no", raw.alias("payee_raw"), D.scrub_pii(raw).alias("payee_name"))


@key("ano_02")
def ano_02(spark, sf):
    return _t(spark, sf).tokens.select("payee_key", "entity_type", "entity_id", "first_date", "first_no")


@key("ano_02_hashed")
def ano_02_hashed(spark, sf):
    """Order-free tokens, and how many payee keys share each (always one)."""
    tokens = anonymize.hashed_tokens(_parsed(spark, sf), _t(spark, sf).lookup, "fixture")
    shared = anonymize.shared_tokens(tokens).select("entity_id", "n_keys")
    return tokens.join(shared, "entity_id", "left").select(
        "payee_key", "entity_type", "entity_id", F.coalesce("n_keys", F.lit(1)).cast("long").alias("n_keys")
    )


@key("ano_02_deliveries")
def ano_02_deliveries(spark, sf):
    """The dictionary after two deliveries, the second one replayed: the tokens of one load."""
    path = f"{table_path(spark, 'token-dictionary', sf)}-{uuid.uuid4().hex}"
    early = F.year("txn_date") < 1998
    for part in (early, ~early, ~early):
        grown = anonymize.grow_dictionary(path, _parsed(spark, sf).where(part), _t(spark, sf).lookup)
    return grown.select("payee_key", "entity_type", "entity_id", "first_date", "first_no")


@key("ano_03")
def ano_03(spark, sf):
    return _t(spark, sf).clean.select("txn_no", "description")


@key("ano_04")
def ano_04(spark, sf):
    return reportable(_t(spark, sf).clean.select(*anonymize.CLEAN_COLUMNS))


@key("ano_05")
def ano_05(spark, sf):
    return anonymize.anonymization_summary(_t(spark, sf).clean)


# ---------------------------------------------------------------------------
# FEA
# ---------------------------------------------------------------------------


def _f(spark, sf):
    return _t(spark, sf).features


@key("fea_01")
def fea_01(spark, sf):
    return _f(spark, sf).select("txn_no", "year", "quarter", "month", "month_name", "week", "day", "weekday", "is_weekend")


@key("fea_02")
def fea_02(spark, sf):
    return _f(spark, sf).select("txn_no", "category")


@key("fea_03")
def fea_03(spark, sf):
    return reportable(_f(spark, sf).select(
        "txn_no", "amount", "transaction_sign", "is_debit", "is_credit",
        "is_small_transaction", "is_medium_transaction", "is_high_value_transaction",
    ))


def _entities(spark, sf):
    return features.entity_totals(_t(spark, sf).clean)


@key("fea_04")
def fea_04(spark, sf):
    return reportable(_entities(spark, sf).select(
        "entity_id", "entity_transaction_count", "entity_total_amount", "entity_avg_amount", "entity_first_seen",
        "entity_last_seen", "entity_debit_count", "entity_credit_count", "entity_avg_debit", "entity_avg_credit",
    ))


@key("fea_05")
def fea_05(spark, sf):
    return _entities(spark, sf).select("entity_id", "entity_days_active", "entity_transactions_per_day")


@key("fea_06")
def fea_06(spark, sf):
    return _entities(spark, sf).select("entity_id", "entity_frequency")


@key("fea_07")
def fea_07(spark, sf):
    return _f(spark, sf).select("txn_no", "previous_transaction_date", "days_since_last_transaction", "is_first_transaction")


@key("fea_08")
def fea_08(spark, sf):
    return _f(spark, sf).select("txn_no", "is_recent_transaction")


@key("fea_09")
def fea_09(spark, sf):
    return _f(spark, sf).select(
        "txn_no", "is_regular_entity", "is_long_term_entity", "is_weekend_spending", "is_recurring_entity", "is_subscription"
    )


@key("fea_10")
def fea_10(spark, sf):
    return _f(spark, sf).select("txn_no", "is_micro_leakage", "is_large_shopping", "is_food_habit", "potential_leakage")


@key("fea_11")
def fea_11(spark, sf):
    return features.leakage_rate(_f(spark, sf))


@key("fea_12")
def fea_12(spark, sf):
    return reportable(_f(spark, sf).select("txn_no", "running_income", "running_expense", "net_cash_flow"))


@key("fea_13")
def fea_13(spark, sf):
    return reportable(features.monthly_totals(_t(spark, sf).clean))


@key("fea_14")
def fea_14(spark, sf):
    return features.feature_summary(_f(spark, sf))


# ---------------------------------------------------------------------------
# SCO
# ---------------------------------------------------------------------------


def _s(spark, sf):
    return _t(spark, sf).scored


for _i, _c in enumerate(["score_category", "score_amount", "score_frequency", "score_timing", "score_recency"], start=1):
    def _mk(col):
        return lambda spark, sf: _s(spark, sf).select("txn_no", col)

    QUERIES[f"sco_0{_i}"] = _mk(_c)


@key("sco_06")
def sco_06(spark, sf):
    return _s(spark, sf).select("txn_no", "leakage_score")


@key("sco_07")
def sco_07(spark, sf):
    return _s(spark, sf).select("txn_no", "risk_band")


@key("sco_08")
def sco_08(spark, sf):
    return scoring.leak_listing(_s(spark, sf))


@key("sco_09")
def sco_09(spark, sf):
    return scoring.band_histogram(_s(spark, sf))


@key("sco_10")
def sco_10(spark, sf):
    return scoring.mean_score_by(_s(spark, sf), "category", debit_only=True)


# ---------------------------------------------------------------------------
# SNK
# ---------------------------------------------------------------------------


def _tx(spark, sf):
    return _t(spark, sf).transactions


@key("snk_01")
def snk_01(spark, sf):
    return reportable(_tx(spark, sf))


def _order():
    return F.substring("txn_no", 2, 20).cast("long")


@key("snk_02")
def snk_02(spark, sf):
    """The constraint report, on predictions with a too large amount and an over-long category put in."""
    spoilt = _t(spark, sf).predictions.withColumns({
        "dr_amount": F.when(_order() % 97 == 0, F.col("dr_amount") + 10_000_000_000).otherwise(F.col("dr_amount")),
        "category": F.when(_order() % 91 == 0, F.repeat(F.lit("x"), 60)).otherwise(F.col("category")),
    })
    return load.rejects(spoilt).select("txn_no", F.concat_ws("; ", "reasons").alias("reasons"))


@key("snk_03")
def snk_03(spark, sf):
    path = table_path(spark, "load-table", sf)
    load.load_table(_t(spark, sf).predictions, path)
    return reportable(spark.read.parquet(path).select(*load.LOAD_COLUMNS))


@key("snk_04")
def snk_04(spark, sf):
    """Two deliveries of every transaction; the target holds a third of the keys already."""
    t = _tx(spark, sf)
    target = load.store_keyed(t.filter(_order() % 3 == 0).select("txn_no"))
    first = t.select("txn_no", "description", "dr_amount", F.lit(1).alias("delivery"))
    again = t.select("txn_no", F.lit("REDELIVERED").alias("description"), "dr_amount", F.lit(2).alias("delivery"))
    return reportable(load.insert_new(target, first.unionByName(again), ["delivery"]))


@key("snk_05")
def snk_05(spark, sf):
    return load.constraint_counts(_tx(spark, sf))


@key("snk_06")
def snk_06(spark, sf):
    return load.verify(_tx(spark, sf))


# ---------------------------------------------------------------------------
# Q01…Q17
# ---------------------------------------------------------------------------

for _n in range(1, 18):
    def _mkq(name):
        return lambda spark, sf: reports.run_query(spark, _tx(spark, sf), name)

    QUERIES[f"q{_n:02d}"] = _mkq(f"q{_n:02d}")


# ---------------------------------------------------------------------------
# REP
# ---------------------------------------------------------------------------


@key("rep_01")
def rep_01(spark, sf):
    return reports.score_describe(_s(spark, sf))


@key("rep_02")
def rep_02(spark, sf):
    return scoring.band_histogram(_s(spark, sf))


@key("rep_03")
def rep_03(spark, sf):
    return reports.score_describe_by_label(_s(spark, sf))


@key("rep_04")
def rep_04(spark, sf):
    return reports.top_scored(_s(spark, sf))


@key("rep_05")
def rep_05(spark, sf):
    return scoring.mean_score_by(_s(spark, sf), "month_name", debit_only=False)


@key("rep_06")
def rep_06(spark, sf):
    return reports.factor_means(_s(spark, sf))


@key("rep_07")
def rep_07(spark, sf):
    return reports.kpi_cards(_tx(spark, sf))


@key("rep_08")
def rep_08(spark, sf):
    return reports.monthly_series(_tx(spark, sf))


@key("rep_09")
def rep_09(spark, sf):
    return reports.group_sum(_tx(spark, sf), "category")


@key("rep_10")
def rep_10(spark, sf):
    return reports.leakage_by_month(_tx(spark, sf))


@key("rep_11")
def rep_11(spark, sf):
    return reports.group_sum(_tx(spark, sf), "risk_band")


@key("rep_12")
def rep_12(spark, sf):
    return reports.group_sum(_tx(spark, sf), "category", flagged_only=True)


@key("rep_13")
def rep_13(spark, sf):
    return reports.high_risk_table(_tx(spark, sf))


@key("rep_14")
def rep_14(spark, sf):
    return reports.findings(_tx(spark, sf))



# ---------------------------------------------------------------------------
# ML (MLlib jobs; model outputs are materialised once per application and input)
# ---------------------------------------------------------------------------

def _matrix(spark, sf):
    from spendlens.ml.matrix import feature_matrix

    return feature_matrix(_s(spark, sf))


def _feature_cols(spark, sf):
    from spendlens.ml.matrix import FEATURE_COLS

    return [c for c in FEATURE_COLS if c in _s(spark, sf).columns]


def _folds(spark, sf):
    """The matrix with its folds, stored once."""
    from spendlens.ml.models import stored_folds

    return _once(spark, sf, "ml folds", lambda: stored_folds(_matrix(spark, sf), sf))


def _trainings(spark, sf):
    """The oversampled rows of the folds' models, stored once for all kinds of models."""
    from spendlens.ml.models import fold_trainings

    return _once(spark, sf, "ml trainings", lambda: fold_trainings(_folds(spark, sf), _feature_cols(spark, sf), sf))


def _edges(spark, sf):
    """The borders of the bins that the boosted models and the forests share, found once."""
    from spendlens.ml.boosting import bin_edges

    return _once(spark, sf, "ml edges", lambda: bin_edges(_trainings(spark, sf), _feature_cols(spark, sf)))


def _forest(spark, sf):
    """The forest's out-of-fold predictions, stored once."""
    from spendlens.ml.models import forest_predictions

    def make():
        return materialize(forest_predictions(_folds(spark, sf), _trainings(spark, sf), _feature_cols(spark, sf), _edges(spark, sf)), "oof-Random-Forest", sf)

    return _once(spark, sf, "ml forest", make)


@key("ml_01")
def ml_01(spark, sf):
    return _matrix(spark, sf)


@key("ml_02")
def ml_02(spark, sf):
    from spendlens.ml.matrix import class_stats

    return class_stats(_matrix(spark, sf))


@key("ml_03")
def ml_03(spark, sf):
    from spendlens.ml.folds import assign_folds

    return assign_folds(_matrix(spark, sf)).select("txn_no", "label", "fold")


@key("ml_04")
def ml_04(spark, sf):
    from spendlens.ml.oversample import smote

    over = smote(_matrix(spark, sf), _feature_cols(spark, sf))
    return over.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("synthetic").cast("long").alias("n_synthetic")
    )


@key("ml_05")
def ml_05(spark, sf):
    from spendlens.ml.models import scaling_stats

    return scaling_stats(_matrix(spark, sf), _feature_cols(spark, sf))


def _saved(spark, sf, name) -> DataFrame:
    """The folds' models, trained and saved once."""
    from spendlens.ml.models import fold_models

    def train():
        path = table_path(spark, "fold-models", sf, name)
        edges = _edges(spark, sf) if name == "Gradient Boosting" else None
        return fold_models(name, _folds(spark, sf), _trainings(spark, sf), _feature_cols(spark, sf), path, edges)

    return _once(spark, sf, f"models {name}", train)


def _by_model(spark, sf, name):
    """Out-of-fold predictions, from saved models where the model is a table."""
    from spendlens.ml.models import SAVED, saved_out_of_fold

    return saved_out_of_fold(name, _folds(spark, sf), _saved(spark, sf, name)) if name in SAVED else _forest(spark, sf)


@key("ml_06")
def ml_06(spark, sf):
    return _by_model(spark, sf, "Logistic Regression")


@key("ml_07")
def ml_07(spark, sf):
    return _by_model(spark, sf, "Random Forest")


@key("ml_08")
def ml_08(spark, sf):
    return _by_model(spark, sf, "Gradient Boosting")


@key("ml_09")
def ml_09(spark, sf):
    from functools import reduce

    from spendlens.ml.models import MODEL_NAMES

    return reduce(DataFrame.unionByName, [_by_model(spark, sf, n).withColumn("model", F.lit(n)) for n in MODEL_NAMES])


def _rule_pred(spark, sf):
    return _tx(spark, sf).select(
        "txn_no", F.col("potential_leakage").alias("label"), "predicted_leakage",
        F.col("predicted_proba").cast("double").alias("predicted_proba"),
    )


@key("ml_10")
def ml_10(spark, sf):
    from spendlens.ml.metrics import confusion

    return confusion(_rule_pred(spark, sf))


@key("ml_11")
def ml_11(spark, sf):
    from spendlens.ml.metrics import auc_metrics

    return auc_metrics(_rule_pred(spark, sf)).select("roc_auc")


@key("ml_12")
def ml_12(spark, sf):
    from spendlens.ml.metrics import auc_metrics

    return auc_metrics(_rule_pred(spark, sf)).select("pr_auc")


@key("ml_13")
def ml_13(spark, sf):
    from spendlens.ml.models import MODEL_NAMES, comparison, evaluate

    return comparison([evaluate(n, _by_model(spark, sf, n)) for n in MODEL_NAMES])


@key("ml_14")
def ml_14(spark, sf):
    from spendlens.ml.models import feature_importance

    return feature_importance(materialize(_matrix(spark, sf), "ml-matrix", sf), _feature_cols(spark, sf))


@key("ml_15")
def ml_15(spark, sf):
    return _tx(spark, sf).select(
        "txn_no", "potential_leakage", "predicted_leakage",
        F.col("predicted_proba").cast("double").alias("predicted_proba"), "correctly_identified",
    )


@key("ml_15_model")
def ml_15_model(spark, sf):
    """The prediction columns from the saved logistic models: each row by the model of its own fold."""
    from spendlens.operators.predict import model_predictions

    return model_predictions(_s(spark, sf), _by_model(spark, sf, "Logistic Regression")).select(
        "txn_no", "potential_leakage", "predicted_leakage",
        F.col("predicted_proba").cast("double").alias("predicted_proba"), "correctly_identified",
    )
