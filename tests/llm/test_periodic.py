"""Runs against a brute force over all stretches, the planted repetition, and awkward rows."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from spendlens.llm import periodic
from spendlens.llm.queries import op11_periodic_runs
from tests.llm import common


def plain_runs(words):
    """Every period, every maximal stretch; smallest periods only."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q):
                found.setdefault((start, length), q)
    return sorted((s, n_, q) for (s, n_), q in found.items())


def plain_row(text, doc_id):
    words = common.BLANK_WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    top = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    best = (*top[0], 1000 * top[0][1] // top[0][2]) if top else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return n, len(found), *best, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def numbers(words):
    return np.array(words, np.int64)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_random_sequences_equal_brute_force(letters):
    r = random.Random(letters)
    for _ in range(400):
        words = [r.randrange(letters) for _ in range(r.randrange(0, 60))]
        assert periodic.runs(numbers(words)) == plain_runs(words)


def test_planted_periods_equal_brute_force():
    r = random.Random(9)
    for _ in range(300):
        words = []
        for _ in range(r.randrange(1, 6)):
            block = [r.randrange(4) for _ in range(r.randrange(1, 9))]
            words += block * r.randrange(1, 8) + [r.randrange(4) for _ in range(r.randrange(4))]
        assert periodic.runs(numbers(words)) == plain_runs(words)


def test_one_word_only_and_nested_runs():
    assert periodic.runs(numbers([7] * 6)) == [(0, 6, 1)]
    assert periodic.runs(numbers([7] * 5)) == []
    assert periodic.runs(numbers([1, 2] * 4)) == [(0, 8, 2)]
    assert periodic.runs(numbers([1, 2] * 3)) == []  # six words, but under four periods
    words = ([1] * 6 + [2]) * 4
    assert periodic.runs(numbers(words)) == plain_runs(words) and len(plain_runs(words)) == 5


def test_long_run_and_frequent_phrase_stay_linear():
    """A run of 200,000 words and a phrase in 20,000 other contexts: no pair of places is tried twice."""
    t = time.perf_counter()
    assert periodic.runs(numbers([1, 2, 3] * 66_000)) == [(0, 198_000, 3)]
    phrase = [x for i in range(20_000) for x in (100 + i, 1, 2, 3, 4, 5, 6, 7, 50_000 + i)]
    assert periodic.runs(numbers(phrase)) == []
    assert time.perf_counter() - t < 60


def test_rows_equal_brute_force(spark):
    texts = common.edge_texts()[:14] + common.edge_texts()[17:]  # the long ones follow
    texts += [("ab cd " * 9 + "x ") * 5, "z " * 300, "  ".join("aa"), "eé " * 40 + "é"] + [common.prose(i, 90) for i in range(60)]
    docs = common.documents(spark, texts)
    got = sorted(map(tuple, periodic.find_runs(docs).collect()), key=str)
    want = sorted(((r.doc_id, *plain_row(r.text, r.doc_id)) for r in docs.select("doc_id", "text").collect()), key=str)
    assert got == want
    assert any(r[2] for r in got) and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in got)


def test_long_text(spark):
    text = common.prose(3, 30_000) + " " + "again and again " * 5_000
    row = periodic.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    words = text.split()
    assert (row.n_words, row.length >= 15_000, row.period) == (len(words), True, 3)


def test_empty_table(spark):
    assert periodic.find_runs(common.empty(common.documents(spark))).collect() == []


def test_query_equals_brute_force(spark):
    """The registered query over the whole smallest table."""
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: plain_row(r.text, r.doc_id) for r in docs}
