"""Base counts against plain Python; binomial tails and cutoffs against exact sums; no Python in the plan."""

import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spendlens.llm import rules
from tests.llm.common import BLANK_WORD, documents, edge_texts, empty, prose


def plain(text):
    text = text or ""
    w = BLANK_WORD.findall(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if BLANK_WORD.search(line):
            dup += line in seen
            seen.add(line)
    out = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit))
    return (*out, out[0] < 20 or 100 * out[4] > 30 * out[0])


def check(spark, texts):
    docs = documents(spark, texts)
    for r in rules.describe(docs, "lang").collect():
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(texts[r.doc_id]), texts[r.doc_id]


def test_base_counts_equal_brute_force(spark):
    check(spark, edge_texts() + ["x# *y | <z>", "a\n\na\n \n \nb\r\na", " a  b\x0bc\x0cd\x1ce\xa0f ", "a " * 9, "a b " * 8 + "c " + "a b " * 4])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "\n", "é#"]), max_size=40).map(" ".join), min_size=30, max_size=30))
def test_random_base_counts(spark, texts):
    check(spark, texts)


@pytest.mark.parametrize("n, k, p", [(0, 0, 0.01), (100, 0, 0.01), (5000, 20, 0.01), (200000, 1900, 0.01), (50, 2, 0.1), (10, 3, 0.1)])
def test_binomial_tail_is_exact(spark, n, k, p):
    got = spark.range(1).select(rules.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p).alias("t")).first().t
    lc = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
    want = 1.0 if n == 0 or k >= n * p else math.fsum(math.exp(lc(i) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    assert got == pytest.approx(want, rel=1e-7)


def test_cutoffs_stop_at_the_first_risky_step(spark):
    # 2000 good documents; one in 100 has symbols: the strict symbol cutoffs would reject too many
    texts = [prose(i, 40) + (" #" * 16 if i % 100 == 0 else "") for i in range(2000)]
    docs = documents(spark, texts, clash=False).where("doc_id is not null").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    cut = {r.rule: r.cutoff for r in rules.admitted_cutoffs(rules.describe(docs, "lang"), labels, rules.MAX_REJECTED, rules.ERROR).collect()}
    assert cut["symbols_per_word"] == 0.35  # 16 of 56 words: the next step, 0.25, is beyond
    rows = rules.apply_rules(docs, labels).collect()
    assert all(r.kept for r in rows)
    assert not rules.admitted_cutoffs(rules.describe(docs, "lang"), labels.limit(50), rules.MAX_REJECTED, rules.ERROR).collect()


def test_repeated_rows_are_one_trial(spark):
    rows = [(i % 50, prose(i, 40), "en") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    found = lambda d, known: rules.admitted_cutoffs(rules.describe(d, "lang"), known, rules.MAX_REJECTED, rules.ERROR).collect()
    assert found(docs, labels) == []
    apart = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], docs.schema)
    every = spark.createDataFrame([(i, 1, 0) for i in range(2000)], labels.schema)
    assert found(apart, every) and sorted(found(apart.unionAll(apart), every)) == sorted(found(apart, every))


def test_awkward_tables_and_plan(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(0, None, None), (None, 1, 1), (7, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    out = rules.apply_rules(docs, labels)
    assert out.count() == docs.count()
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert rules.apply_rules(empty(docs), labels).collect() == []
    assert all(r.kept != r.base_failed for r in rules.apply_rules(docs, empty(labels)).collect())
