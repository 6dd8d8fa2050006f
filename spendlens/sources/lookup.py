"""ING-11: merchant lookup source.

A CSV of ``merchant_name,category`` rows that may repeat its header.  Order matters:
a key keeps the position of its **first** row and the category of its **last** row
(Python ``dict(zip(...))``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.functions.text import py_strip
from spendlens.session import materialize
from spendlens.sources import records

# Cells pandas' CSV reader turns into missing values by default.
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

LOOKUP_SCHEMA = "merchant_name STRING, category STRING"


def read_lookup_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw lookup rows ``(pos, merchant_name, category)``; ``pos`` follows file order.

    A missing file gives an empty lookup (the reference only warns).
    """
    try:
        raw = (
            spark.read.option("header", True)
            .option("nullValue", None)
            .option("emptyValue", "")
            .schema(LOOKUP_SCHEMA)
            .csv(path)
        )
        raw = raw.select(
            F.monotonically_increasing_id().alias("pos"), "merchant_name", "category"
        )
        raw.schema  # resolve now so a missing path fails here
    except Exception as exc:  # noqa: BLE001 - AnalysisException: path does not exist
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            import logging

            logging.getLogger(__name__).warning("merchant lookup not found at %s; category detection will be limited", path)
            return spark.createDataFrame([], "pos BIGINT, merchant_name STRING, category STRING")
        raise
    return raw


def read_lookup_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw lookup rows ``(pos, merchant_name, category)`` of large or many files.

    Files are read in splits although quoted names may hold line breaks (``records``).  ``pos`` is the
    record's number over all files in the order of their names; the first record names the columns, and
    further header records are rows (``normalize_lookup`` drops them).
    """
    lines = records.raw_lines(spark, path)
    states = materialize(records.block_states(records.block_summaries(lines)), "lookup-blocks", uuid.uuid4().hex)
    files = states.groupBy("file_path").agg(F.sum("records").alias("n"))  # one row per file
    along = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("file_path", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    rows = records.read_records(lines, states).join(before, "file_path").select((F.col("before") + F.col("pos")).alias("pos"), "cells")
    first = rows.where("pos = 0").first()
    names = [c.strip() for c in first.cells] if first else []
    cell = lambda name: F.get("cells", F.lit(names.index(name))) if name in names else F.lit(None).cast("string")
    return rows.where("pos > 0").select("pos", *[cell(c).alias(c) for c in ("merchant_name", "category")])


def write_lookup_csv(raw: DataFrame, path: str) -> None:
    """Write ``(pos, merchant_name, category)`` as CSV files in the order of ``pos``; the first begins with the header."""
    quoted = lambda c: F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    rows = raw.select("pos", F.concat_ws(",", quoted(F.col("merchant_name")), quoted(F.col("category"))).alias("value"))
    header = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("pos"), F.lit("merchant_name,category").alias("value"))
    header.unionByName(rows).repartitionByRange("pos").sortWithinPartitions("pos").select("value").write.mode("overwrite").text(path)


def normalize_lookup(raw: DataFrame) -> DataFrame:
    """Lookup entries ``(pos, merchant_name, category)``, one per normalised name.

    Drops repeated header rows and rows with a missing name or category, upper-cases and
    strips the name, strips the category; duplicates keep first position, last value.
    """
    na = list(PANDAS_NA_TOKENS)
    name = F.when(F.col("merchant_name").isin(na), None).otherwise(F.col("merchant_name"))
    cat = F.when(F.col("category").isin(na), None).otherwise(F.col("category"))
    cleaned = (
        raw.select("pos", name.alias("n"), cat.alias("c"))
        .filter(F.coalesce(F.lower(py_strip(F.col("n"))) != "merchant_name", F.lit(True)))
        .filter(F.col("n").isNotNull() & F.col("c").isNotNull())
        .select("pos", F.upper(py_strip(F.col("n"))).alias("merchant_name"), py_strip(F.col("c")).alias("category"))
    )
    return cleaned.groupBy("merchant_name").agg(
        F.min("pos").alias("pos"), F.max_by("category", "pos").alias("category")
    ).select("pos", "merchant_name", "category")
