"""Global-order operators without a single-partition window (recipes R1–R6).

The reference sorts the whole table and walks it (cumulative sums, ranks, NTILE,
first-appearance numbering).  A plain ``Window.orderBy`` with no partition puts every row
in one task.  Here every such operator is a *running sum* over a total order:

1. rows are range-partitioned on the order keys (sampled boundaries, so parts are of like size
   whatever the keys look like) and written once to the shared folder as a table bucketed by their
   part's number, one part per bucket;
2. sums per stored part, and a running sum over the parts (one row per part and group), give each
   part its offset;
3. each row adds its part's offset to a window partitioned by part.

The buckets are read back as they lie, so steps 2 and 3 shuffle none of the rows: one range shuffle in
all, at every size; nothing depends on the format of ids.  Order keys should
be unique per row (equal keys share a part).  NULL keys sort first in ascending and last in
descending order; group columns may be NULL.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.functions.rounding import idiv
from spendlens.session import materialize, materialize_buckets

Order = Sequence[tuple[str, bool]]  # (column, ascending)

PART = "__part"


def _sort(order: Order) -> list[Column]:
    return [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]


_CODES: dict[int, list[int]] = {}


def part_codes(spark: SparkSession, parts: int) -> list[int]:
    """Increasing numbers for parts 0, 1, ... that bucketing into ``parts`` buckets sends to bucket 0, 1, ...

    Plain part numbers would leave about a third of the buckets empty and fill others several times.
    """
    if parts not in _CODES:
        width = 16 * parts  # of tries per part: all fail for one in e^16, which then shares a bucket
        part = F.floor(F.col("id") / width)
        fit = spark.range(parts * width).where(F.pmod(F.hash("id"), F.lit(parts)) == part)
        found = {r.part: r.code for r in fit.groupBy(part.alias("part")).agg(F.min("id").alias("code")).collect()}
        _CODES[parts] = [found.get(p, p * width) for p in range(parts)]
    return _CODES[parts]


def range_parts(df: DataFrame, order: Order, by: Sequence[str] = (), name: str = "ordered") -> DataFrame:
    """``df`` stored by ranges of (by, order), bucketed by the range's number in ``__part``."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.drop(PART).repartitionByRange(*[F.col(c).asc() for c in by], *_sort(order))
    codes = F.array(*[F.lit(c).cast("long") for c in part_codes(spark, buckets)])
    return materialize_buckets(dealt.withColumn(PART, F.element_at(codes, F.spark_partition_id() + 1)), name, PART, buckets)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that matches NULL keys; the keys appear once (the left side's)."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(renamed, cond, how).drop(*[f"__r_{c}" for c in on])


def running_sum(
    df: DataFrame, order: Order, values: Sequence[str], by: Sequence[str] = (), suffix: str = "__cum", keep_part: bool = False
) -> DataFrame:
    """Inclusive running sums of ``values`` in ``order`` (per ``by`` group).

    Adds ``<value><suffix>`` columns.  A table that ``range_parts`` stored in this very order is
    used as it is; any other is stored first.  With ``keep_part`` the rows keep their part's number.
    """
    order, by = list(order), list(by)
    out_cols = [c for c in df.columns if c != PART] + [PART] * keep_part
    stored = df if PART in df.columns else range_parts(df, order, by)
    sums = stored.groupBy(*by, PART).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, PART, *[F.sum(v).over(before).alias(v + "__off") for v in values])
    # without groups the offsets are one row per part
    joined = null_safe_join(stored, offsets, by + [PART], "inner") if by else stored.join(F.broadcast(offsets), PART, "inner")
    inside = Window.partitionBy(*by, PART).orderBy(*_sort(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(
        *out_cols, *[(F.coalesce(F.col(v + "__off"), F.lit(0)) + F.sum(v).over(inside)).alias(v + suffix) for v in values]
    )


# ---------------------------------------------------------------------------
# Scalars per group without a cross join
# ---------------------------------------------------------------------------


def attach_group_totals(df: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Equi-join per-group aggregates back; with no group it is one broadcast row."""
    by = list(by)
    if by:
        return null_safe_join(df, totals, by)
    return (
        df.withColumn("__one", F.lit(1))
        .join(F.broadcast(totals.withColumn("__one", F.lit(1))), on="__one", how="left")
        .drop("__one")
    )


# ---------------------------------------------------------------------------
# Joins with frequent keys
# ---------------------------------------------------------------------------

MAX_HEAVY = 1000
SALTS = 1024


def join_heavy_keys(rows: DataFrame, side: DataFrame, on: Sequence[str], weight: str, how: str = "inner") -> DataFrame:
    """Equi-join ``rows`` with ``side`` (one row per key), frequent keys apart.

    ``weight`` is a column of ``side``: how many rows its key has.  Keys with more than one
    in ``MAX_HEAVY`` of all rows are fewer than ``MAX_HEAVY`` by counting; they are broadcast, so a
    key that holds half of the rows never meets in one task.  All other keys are shuffled; rows that found
    their partner already, and rows with a NULL key, are spread over ``SALTS`` places of that shuffle.
    ``rows`` is evaluated once; ``side`` is stored.
    """
    on = list(on)
    side = materialize(side, "join-side", uuid.uuid4().hex)
    values = [c for c in side.columns if c not in on and c != weight]
    total = side.agg(F.sum(weight)).first()[0] or 0
    found = lambda name: F.struct(*values).alias(name)
    heavy = side.where(F.col(weight) * MAX_HEAVY > F.lit(total)).select(*on, found("__heavy"))
    light = side.where(F.col(weight) * MAX_HEAVY <= F.lit(total)).select(*on, F.lit(-1).alias("__salt"), found("__light"))
    marked = rows.join(F.broadcast(heavy), on=on, how="left")
    if how == "inner":
        for c in on:
            marked = marked.where(F.col(c).isNotNull())
    settled = F.col("__heavy").isNotNull()
    for c in on:
        settled = settled | F.col(c).isNull()
    salted = marked.withColumn("__salt", F.when(settled, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(F.lit(-1)))
    joined = salted.join(light, on=[*on, "__salt"], how="left").withColumn("__found", F.coalesce("__heavy", "__light"))
    if how == "inner":
        joined = joined.where(F.col("__found").isNotNull())
    return joined.select(*on, *[c for c in rows.columns if c not in on], *[F.col(f"__found.{c}").alias(c) for c in values])


# ---------------------------------------------------------------------------
# R1 prefix sums over (date, id)
# ---------------------------------------------------------------------------


def prefix_sums(
    df: DataFrame, date_col: str, id_col: str, values: Sequence[str], by: Sequence[str] = (), keep_part: bool = False
) -> DataFrame:
    """Cumulative sums in (date, id) order (FEA-12, Q11) — adds ``<v>__cum``."""
    return running_sum(df, [(date_col, True), (id_col, True)], values, by=by, keep_part=keep_part)


# ---------------------------------------------------------------------------
# R2 average-tie percentile rank
# ---------------------------------------------------------------------------


def pct_rank_table(df: DataFrame, value_col: str, out_col: str, by: Sequence[str] = ()) -> DataFrame:
    """pandas ``rank(pct=True)`` (ties get their average rank) per distinct value.

    Returns ``(by…, value, __cnt, out_col DOUBLE)``: histogram of distinct values → running
    count by value.  Callers join it back on the value.  NULL values have no rank and do not count.
    """
    by = list(by)
    hist = df.where(F.col(value_col).isNotNull()).groupBy(*by, value_col).agg(F.count(F.lit(1)).alias("__cnt"))
    stored = range_parts(hist, [(value_col, True)], by)
    cum = running_sum(stored, [(value_col, True)], ["__cnt"], by=by)
    totals = stored.groupBy(*by).agg(F.sum("__cnt").alias("__n"))
    return attach_group_totals(cum, totals, by).select(
        *by,
        value_col,
        "__cnt",
        (
            (F.col("__cnt__cum") - F.col("__cnt") + (F.col("__cnt") + 1) / F.lit(2.0)) / F.col("__n")
        ).alias(out_col),
    )


# ---------------------------------------------------------------------------
# R3 NTILE
# ---------------------------------------------------------------------------


def ntile(df: DataFrame, k: int, order: Order, out_col: str, by: Sequence[str] = ()) -> DataFrame:
    """SQL ``NTILE(k) OVER (PARTITION BY by ORDER BY order)`` without one big partition."""
    by = list(by)
    stored = range_parts(df, order, by)
    ranked = row_number_by(stored, order, "__rank", by=by)
    totals = stored.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    r = F.col("__rank")
    n = F.col("__n")
    q = idiv(n, F.lit(k))
    m = n - q * k
    big = m * (q + 1)
    bucket = F.when(r <= big, idiv(r + q, q + 1)).otherwise(m + idiv(r - big + q - 1, q))
    return attach_group_totals(ranked, totals, by).withColumn(out_col, bucket.cast("int")).drop("__rank", "__n")


# ---------------------------------------------------------------------------
# R4 row numbers by a total order (first-appearance tokens, hashed folds)
# ---------------------------------------------------------------------------


def row_number_by(df: DataFrame, order: Order, out_col: str, by: Sequence[str] = ()) -> DataFrame:
    """1-based ``row_number() OVER (PARTITION BY by ORDER BY order)``, distributed."""
    ranked = running_sum(df.withColumn("__one", F.lit(1).cast("long")), order, ["__one"], by=by)
    return ranked.withColumnRenamed("__one__cum", out_col).drop("__one")


# ---------------------------------------------------------------------------
# R6 curve metrics (tie-aware ROC-AUC, average precision)
# ---------------------------------------------------------------------------


def curve_metrics(df: DataFrame, label_col: str, score_col: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (trapezoid over distinct thresholds) and average precision Σ ΔR·P.

    One row per ``by`` group with columns ``roc_auc``, ``pr_auc`` (DOUBLE).
    """
    by = list(by)
    hist = df.groupBy(*by, score_col).agg(
        F.sum(F.col(label_col).cast("long")).alias("__pos"),
        F.count(F.lit(1)).alias("__cnt"),
    )
    stored = range_parts(hist, [(score_col, False)], by)
    cum = running_sum(stored, [(score_col, False)], ["__pos", "__cnt"], by=by)
    totals = stored.groupBy(*by).agg(F.sum("__pos").alias("__npos_total"), (F.sum("__cnt") - F.sum("__pos")).alias("__nneg_total"))
    j = attach_group_totals(cum, totals, by)
    tp = F.col("__pos__cum")
    seen = F.col("__cnt__cum")
    pos = F.col("__pos")
    neg = F.col("__cnt") - F.col("__pos")
    P = F.col("__npos_total").cast("double")
    N = F.col("__nneg_total").cast("double")
    terms = j.select(
        *by,
        ((pos / P) * (tp / seen)).alias("__ap"),
        ((neg * (tp - pos) + neg * pos / 2.0) / (P * N)).alias("__auc"),
    )
    return terms.groupBy(*by).agg(F.sum("__auc").alias("roc_auc"), F.sum("__ap").alias("pr_auc"))
