"""Held-out ranking, independence from id, source and labels of the held-out fold, edge cases."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from spendlens.llm import toxicity
from tests.llm.common import ALNUM_WORD, documents, edge_texts, empty, lower, prose

BAD = ["vile", "awful", "nasty"]


def corpus(n=600):
    r, texts, labels = random.Random(3), [], []
    for i in range(n):
        words = prose(1000 + i, 60).split(" ")
        toxic = i % 5 == 1
        if toxic:
            for _ in range(3):
                words[r.randrange(60)] = r.choice(BAD)
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    return texts, labels


def label_table(spark, labels):
    return spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def test_held_out_documents_are_told_apart(spark):
    texts, labels = corpus()
    rows = toxicity.score_toxicity(documents(spark, texts), label_table(spark, labels)).where("doc_id is not null").collect()
    known = dict(labels)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == known[r.doc_id] for r in held) >= 0.97 * len(held)


def test_held_out_labels_are_not_read(spark):
    texts, labels = corpus(200)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    a, b = (sorted(map(tuple, toxicity.score_toxicity(documents(spark, texts, clash=False).where("doc_id is not null"), label_table(spark, x)).collect())) for x in (labels, flipped))
    assert a == b


def test_equal_texts_score_equal_and_odd_tables_work(spark):
    texts, labels = corpus(100)
    both = texts + edge_texts()
    rows = toxicity.score_toxicity(documents(spark, both), label_table(spark, labels + [(None, 1), (5, None), (1, 1)])).collect()
    assert len(rows) == len(both) + 2
    by_text = {}
    for r in rows:
        if r.doc_id is not None:
            assert by_text.setdefault(both[r.doc_id], r.score) == r.score
    docs, known = documents(spark), label_table(spark, labels)
    assert toxicity.score_toxicity(empty(docs), known).collect() == []
    assert {r.score for r in toxicity.score_toxicity(docs, empty(known)).collect()} == {0.0}
    assert {r.score for r in toxicity.score_toxicity(docs, known.withColumn("toxic", F.lit(1))).collect()} == {1.0}


def plain_grams(text):
    words = ALNUM_WORD.findall(lower(text or ""))
    grams = {(w,) for w in words} | {(1, *pair) for pair in zip(words, words[1:], strict=False)}
    return sorted(grams | {(2, *pair) for pair in zip(words, words[2:], strict=False)}, key=repr)


def plain_scores(rows, texts):
    """FTRL-proximal over n-grams in dictionaries, one row and one coordinate after the other."""
    z, n = {}, {}

    def weight(g):
        at, over = z.get(g, 0.0), abs(z.get(g, 0.0)) - (0.0 if g is None else toxicity.L1)
        return -math.copysign(over, at) / ((toxicity.BETA + math.sqrt(n.get(g, 0.0))) / toxicity.ALPHA + toxicity.L2) if over > 0 else 0.0

    for _ in range(toxicity.EPOCHS):
        for text, label in rows:
            grams = [*plain_grams(text), None]
            weights = [weight(g) for g in grams]
            slope = 1 / (1 + math.exp(-max(-30, min(30, sum(weights))))) - label
            for g, w in zip(grams, weights, strict=True):
                rate = (math.sqrt(n.get(g, 0.0) + slope**2) - math.sqrt(n.get(g, 0.0))) / toxicity.ALPHA
                z[g] = z.get(g, 0.0) + slope - rate * w
                n[g] = n.get(g, 0.0) + slope**2
    return [1 / (1 + math.exp(-sum(weight(g) for g in [*plain_grams(t), None]))) for t in texts]


def test_scores_equal_a_plain_loop(spark):
    texts, labels = corpus(300)
    learned = label_table(spark, labels).withColumn("place", F.xxhash64("doc_id")).orderBy("place").collect()
    rows = [(texts[r.doc_id], r.toxic) for r in learned if zlib.crc32(str(r.doc_id).encode()) % 5]
    want = plain_scores(rows, texts)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(documents(spark, texts), label_table(spark, labels)).collect()}
    assert max(want) > 0.9 and min(want) < 0.1
    assert [got[i] for i in range(300)] == pytest.approx(want, abs=1e-4)
