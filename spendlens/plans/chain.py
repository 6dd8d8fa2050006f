"""The product chain: statement → clean → features → scored → predictions → load table.

Each arrow is a ``DataFrame → DataFrame`` function, so Catalyst sees the whole chain.
Four boundaries are materialised to the shared checkpoint folder because several
products (or several branches of one plan) read them: the parsed rows, the payee tokens, the clean table
and the scored/predicted table, whose columns hold the features.  Each is written once per (application,
input folder), when a product first reads it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from spendlens.operators.anonymize import clean_transactions, parsed_rows, payee_tokens
from spendlens.operators.features import FEATURE_COLUMNS, build_features
from spendlens.operators.load import conform
from spendlens.operators.ordered import PART, range_parts
from spendlens.operators.predict import rule_predictions
from spendlens.operators.scoring import score_transactions
from spendlens.session import materialize
from spendlens.sources.fixture import processed_from_orders, raw_lookup
from spendlens.sources.lookup import normalize_lookup


class Tables:
    """The stage tables of one input folder, each made when it is first read."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def processed(self) -> DataFrame:
        return processed_from_orders(self.spark, self.sf_dir)

    @cached_property
    def lookup(self) -> DataFrame:
        return normalize_lookup(raw_lookup(self.spark))

    @cached_property
    def parsed(self) -> DataFrame:
        # the description parse is read by the payee table and by the row join (and by the
        # PAR/ANO products): parse once, store the stage
        return materialize(parsed_rows(self.processed), "parsed", self.sf_dir)

    @cached_property
    def tokens(self) -> DataFrame:
        return materialize(payee_tokens(self.parsed, self.lookup), "payee-tokens", self.sf_dir)

    @cached_property
    def clean(self) -> DataFrame:
        # stored by ranges of (date, id): the running totals add up per stored range
        rows = clean_transactions(self.processed, self.lookup, parsed=self.parsed, tokens=self.tokens)
        return range_parts(rows, [("txn_date", True), ("txn_no", True)], name="clean")

    @cached_property
    def predictions(self) -> DataFrame:
        features = build_features(self.clean, keep_part=True)
        # the features leave out rows without a date or an entity, so these are not ranked either
        amounts = self.clean.where("txn_date IS NOT NULL AND entity_id IS NOT NULL")
        made = rule_predictions(score_transactions(features, amounts=amounts))
        columns = [c for c in made.columns if c != PART]
        # the table every report reads: partitioned by (year, month) so month filters prune.  The clean table's
        # ranges of dates are ranges of months too: rows go back to them, and nothing is sampled
        return materialize(made, "predictions", self.sf_dir, partition_by=["year", "month"], ranges=PART).select(*columns)

    @cached_property
    def features(self) -> DataFrame:
        return self.predictions.select(*FEATURE_COLUMNS)

    @cached_property
    def scored(self) -> DataFrame:
        return self.predictions.drop("predicted_leakage", "predicted_proba", "correctly_identified")

    @cached_property
    def transactions(self) -> DataFrame:
        return conform(self.predictions)


_CACHE: dict[tuple[str, str], Tables] = {}


def build(spark: SparkSession, sf_dir: str) -> Tables:
    """All stage tables for the orders-derived statement under ``sf_dir``."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = Tables(spark, sf_dir)
    return _CACHE[key]
