"""ML-15 prediction columns, from a model or from the deterministic (model-free) predictor.

``model_predictions`` joins a model's out-of-fold label and probability; ``rule_predictions`` is the
score-threshold predictor used when no model output is given (and by the SQL oracle):
``predicted_leakage = leakage_score > 50``, ``predicted_proba = leakage_score / 100``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.rounding import round_half_even

RULE_THRESHOLD = 50


def finish_predictions(df: DataFrame, label: F.Column, proba: F.Column) -> DataFrame:
    """Add predicted_leakage INT, predicted_proba DOUBLE (half-even 4 dp), correctly_identified."""
    return df.select(
        "*",
        label.cast("int").alias("predicted_leakage"),
        round_half_even(proba, 4).alias("predicted_proba"),
    ).withColumn(
        "correctly_identified", (F.col("potential_leakage") == 1) & (F.col("predicted_leakage") == 1)
    )


def model_predictions(scored: DataFrame, predicted: DataFrame) -> DataFrame:
    """``scored`` with a model's (txn_no, predicted_leakage, predicted_proba); rows it did not see get NULL."""
    own = predicted.select("txn_no", F.col("predicted_leakage").alias("__label"), F.col("predicted_proba").alias("__proba"))
    joined = scored.join(own, on="txn_no", how="left")
    return finish_predictions(joined, F.col("__label"), F.col("__proba")).drop("__label", "__proba")


def rule_predictions(scored: DataFrame) -> DataFrame:
    return finish_predictions(
        scored,
        (F.col("leakage_score") > RULE_THRESHOLD),
        F.col("leakage_score") / F.lit(100.0),
    )
