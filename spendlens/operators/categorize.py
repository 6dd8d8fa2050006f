"""PAR-07…10: categorise payee keys with the merchant lookup, then keyword rules.

Work is done on the **distinct** payee keys, never per transaction.

* exact match: equi-join ``key = merchant_name``;
* first substring in lookup order: each lookup name is found through its rarest trigram —
  the payee keys are exploded into all their trigrams (whole text), equi-joined on the
  name's rarest trigram, and every candidate is verified with ``instr``; names of one or two
  characters are equi-joined with the keys' substrings of that length, an empty name matches all;
  ``min_by(category, pos)`` picks the first name in lookup order;
* otherwise the keyword rules (PAR-09).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.describe import keyword_category
from spendlens.operators.ordered import attach_group_totals

GRAM = 3


def _grams(df: DataFrame, text_col: str, size: int = GRAM) -> DataFrame:
    """Distinct (text, substring of ``size`` characters) pairs over the whole text."""
    return df.select(
        text_col,
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(text_col) - size + 1, F.lit(1))),
                lambda i: F.substring(F.col(text_col), i, size),
            )
        ).alias("__gram"),
    ).filter(F.length("__gram") == size).distinct()


def _substring_matches(keys: DataFrame, lookup: DataFrame, key_col: str) -> DataFrame:
    """(key, pos, category) for every lookup name contained in the key (exact).

    Each lookup name is probed through its **rarest** trigram among the keys' trigrams: if
    a name occurs in a key, every trigram of the name occurs there, so the rarest one
    finds all its keys with the fewest candidates; each candidate is verified.
    """
    key_grams = _grams(keys.select(key_col), key_col)
    gram_freq = key_grams.groupBy("__gram").agg(F.count(F.lit(1)).alias("__freq"))
    long_names = lookup.filter(F.length("merchant_name") >= GRAM)
    name_grams = _grams(long_names.select("merchant_name"), "merchant_name")
    probe = (
        name_grams.join(gram_freq, on="__gram", how="left")
        .groupBy("merchant_name")
        .agg(F.min_by("__gram", F.struct(F.coalesce(F.col("__freq"), F.lit(0)), F.col("__gram"))).alias("__gram"))
        .join(long_names, on="merchant_name", how="inner")
    )
    long_hits = (
        probe.join(key_grams, on="__gram", how="inner")
        .filter(F.instr(F.col(key_col), F.col("merchant_name")) > 0)
        .select(key_col, "pos", "category")
    )
    hits = long_hits
    for size in range(1, GRAM):
        names = lookup.filter(F.length("merchant_name") == size).withColumnRenamed("merchant_name", "__gram")
        hits = hits.unionByName(_grams(keys.select(key_col), key_col, size).join(names, on="__gram").select(key_col, "pos", "category"))
    # an empty name is in every key; normalised names are distinct, so there is at most one
    empty = lookup.filter(F.length("merchant_name") == 0).agg(F.min("pos").alias("pos"), F.min_by("category", "pos").alias("category"))
    everywhere = attach_group_totals(keys.select(key_col), empty, []).filter(F.col("pos").isNotNull())
    return hits.unionByName(everywhere.select(key_col, "pos", "category"))


def first_substring_match(keys: DataFrame, lookup: DataFrame, key_col: str = "payee_key") -> DataFrame:
    """PAR-08: (key, pos, category) of the first lookup name (in lookup order) inside the key."""
    return (
        _substring_matches(keys.select(key_col).distinct(), lookup, key_col)
        .groupBy(key_col)
        .agg(F.min_by(F.struct("pos", "category"), F.col("pos")).alias("__m"))
        .select(key_col, "__m.pos", "__m.category")
    )


def exact_match(keys: DataFrame, lookup: DataFrame, key_col: str = "payee_key") -> DataFrame:
    """PAR-07: (key, category) for keys equal to a lookup name."""
    return keys.select(key_col).distinct().join(
        lookup.select(F.col("merchant_name").alias(key_col), "category"), on=key_col, how="inner"
    )


def categorize_keys(keys: DataFrame, lookup: DataFrame, key_col: str = "payee_key") -> DataFrame:
    """Add ``category`` to a DataFrame of distinct, upper-cased payee keys."""
    exact = lookup.select(F.col("merchant_name").alias(key_col), F.col("category").alias("__exact"))
    first_sub = (
        _substring_matches(keys.select(key_col), lookup, key_col)
        .groupBy(key_col)
        .agg(F.min_by("category", "pos").alias("__sub"))
    )
    return (
        keys.join(exact, on=key_col, how="left")
        .join(first_sub, on=key_col, how="left")
        .withColumn(
            "category",
            F.coalesce(F.col("__exact"), F.col("__sub"), keyword_category(F.col(key_col))),
        )
        .drop("__exact", "__sub")
    )
