"""Quality rules with risk-controlled thresholds (operator 10, native).

Fixed base rules reject a text outright.  Beside them, each rule of ``RULES`` has a family of
cutoffs from lenient to strict, and labelled documents decide how strict it may be.  Per stratum
(language) and rule, good labelled documents that pass the base rules are a holdout sample: a
cutoff is admitted when an exact binomial test rejects "this cutoff turns away more than
``MAX_REJECTED`` of good documents" at ``ERROR`` shared by all strata and rules (Bonferroni).  Cutoffs
are tested from lenient to strict and testing stops at the first failure (fixed-sequence testing),
which keeps the family-wise error without a further division by the number of cutoffs.  A stratum
with too few labels admits nothing, so it loses no document to these rules.

``kept`` is false for a base failure or a value beyond an admitted cutoff.  Everything is column
expressions, one text per row: 8-word windows are compared inside their row as 64-bit hashes made
by doubling, and only texts with an equal pair of windows sort them.

Cases: null, empty and blank texts have no words, fail the base rule and count 0 everywhere;
a null language is a stratum; repeated labels of a document are good only if all say so; a labelled
document that several rows of a stratum repeat is one trial, turned away if any of them is; without
labels no cutoff is admitted; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of words
MAX_REJECTED = 0.01
ERROR = 0.05

#: measure -> cutoffs from lenient to strict; a text is beyond a cutoff when its measure is larger
RULES = {
    "symbols_per_word": [4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25],
    "repeated_share": [0.28, 0.25, 0.2, 0.15, 0.1],
    "duplicate_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "chars_per_word": [100.0, 50.0, 30.0, 20.0, 15.0, 12.0],
}


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows of ``WINDOW`` words that occur twice or more, from the words' hashes."""
    n = F.size(hashes)

    def doubled(h: Column, step: int) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            same = lambda x, j: x == F.get(s, j).getField("h")
            twice = F.filter(s, lambda x, j: F.coalesce(same(x["h"], j - 1), F.lit(False)) | F.coalesce(same(x["h"], j + 1), F.lit(False)))
            return _bind(F.sort_array(F.transform(twice, lambda x: x["i"])), gaps)

        def gaps(at: Column) -> Column:
            # each window adds its words up to the next window's first
            step = lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW)))
            return F.aggregate(F.transform(at, step), F.lit(0).cast("long"), lambda a, b: a + b)

        return _bind(placed, again)

    def windows(h8: Column) -> Column:
        whole = F.slice(h8, 1, F.greatest(F.lit(0), n - (WINDOW - 1)))
        return _bind(whole, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))

    eight = _bind(doubled(hashes, 1), lambda h2: _bind(doubled(h2, 2), lambda h4: _bind(doubled(h4, 4), windows)))
    return F.when(n > WINDOW, eight).otherwise(F.lit(0).cast("long"))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return F.when(F.instr(text, "\n") > 0, _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0).cast("long")


def describe(docs: DataFrame, stratum: str) -> DataFrame:
    """doc_id, stratum and the base counts of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w))
    return docs.select(
        "doc_id", F.col(stratum).alias("stratum"),
        F.size(hashes).cast("long").alias("n_words"),
        (F.length(text) - F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))).alias("__blank"),
        F.length(text).alias("__chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
        F.greatest(F.lit(1), F.size(F.split(text, "\n"))).alias("__lines"),
        _bind(hashes, repeated_words).alias("n_repeat_words"),
    ).select(
        "doc_id", "stratum", "n_words", (F.col("__chars") - F.col("__blank")).cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines", "n_repeat_words", "__lines",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))).alias("base_failed"),
    )


def rule_values() -> dict[str, Column]:
    words = F.greatest(F.lit(1), F.col("n_words"))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "repeated_share": F.col("n_repeat_words") / words,
        "duplicate_line_share": F.col("n_dup_lines") / F.col("__lines"),
        "chars_per_word": F.col("word_chars") / words,
    }


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exactly summed in logarithms.

    The p-value of "the rate is above p" after k failures in n.  Beyond the mean it is over one
    half in any case and is given as 1, so the sum never has more than n * p terms.
    """
    import math

    odds = math.log(p / (1 - p))
    start = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), k))).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.when(n == 0, 1.0).when(k >= n * p, 1.0).otherwise(F.exp(F.aggregate(terms, start, add, lambda acc: acc["total"])))


def admitted_cutoffs(described: DataFrame, labels: DataFrame, max_rejected: float, error: float) -> DataFrame:
    """(stratum, rule, cutoff): the strictest admitted cutoff of each stratum and rule."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    good = described.where(~F.col("base_failed")).join(known.where("good = 1").select("doc_id"), "doc_id")
    # the test's trials are documents: rows that repeat one count once, by their largest values
    good = good.groupBy("stratum", "doc_id").agg(*[F.max(v).alias(r) for r, v in rule_values().items()])
    beyond = [F.sum((F.col(r) > c).cast("long")).alias(f"{r}:{i}") for r, cutoffs in RULES.items() for i, c in enumerate(cutoffs)]
    counted = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *beyond)
    tests = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"), F.col(f"{r}:{i}").alias("k"))
        for r, cutoffs in RULES.items() for i, c in enumerate(cutoffs)
    ]))
    strata = F.count(F.lit(1)).over(Window.partitionBy())  # one row per stratum
    level = F.lit(error) / (F.col("strata") * len(RULES))
    tested = counted.withColumn("strata", strata).select("stratum", "n", "strata", tests.alias("t"))
    tested = tested.select("stratum", "t.*", (binomial_tail(F.col("n"), F.col("t.k"), max_rejected) <= level).alias("passed"))
    so_far = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = tested.withColumn("open", F.min(F.col("passed").cast("int")).over(so_far)).where("open = 1")
    return open_.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def apply_rules(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_rejected: float = MAX_REJECTED, error: float = ERROR
) -> DataFrame:
    """doc_id, the base counts, base_failed, the rules a text breaks and kept, for every row of ``docs``."""
    described = stage(describe(docs, stratum), "described")
    cutoffs = admitted_cutoffs(described, labels, max_rejected, error)
    wide = cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    wide = wide.select(F.col("stratum").alias("__stratum"), *[F.col(r).alias(f"cut_{r}") for r in RULES])
    joined = described.join(wide, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    broken = F.array_compact(F.array(*[F.when(v > F.col(f"cut_{r}"), F.lit(r)) for r, v in rule_values().items()]))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.array_join(broken, ",").alias("rules_broken"),
        (~F.col("base_failed") & (F.size(broken) == 0)).alias("kept"),
    )
