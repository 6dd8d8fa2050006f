"""Index search against a scan of all windows; more blocks, near matches, edge cases."""

import hashlib

import pytest

from spendlens.llm import decontaminate as D
from tests.llm.common import ALNUM_WORD, documents, edge_texts, empty, lower, prose


def items(spark):
    rows = [
        (1, prose(1, 120)[100:200]), (2, "one"), (3, "no such words anywhere here"), (4, None), (5, "..."), (None, "two words"),
        (7, "a b c d e f g h a b c d"), (7, "a b c d e f g h a b c d"), (12, prose(3, 400)), (13, "漢字 é ü"),
    ]
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(texts, rows):
    windows = {}
    for i, t in rows:
        w = ALNUM_WORD.findall(lower(t or ""))
        span = min(10, len(w))
        for k in range(len(w) - span + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + span]), set()).add(i)
    out = []
    for t in texts:
        w = ALNUM_WORD.findall(lower(t or ""))
        hit, found = set(), set()
        for span in {len(x) for x in windows}:
            for k in range(len(w) - span + 1):
                if tuple(w[k : k + span]) in windows:
                    hit |= set(range(k, k + span))
                    found |= windows[tuple(w[k : k + span])]
        names = sorted(str(i) for i in found - {None})
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 60])
def test_report_equals_brute_force(spark, block_words):
    docs, bench = documents(spark), items(spark)
    rows = D.decontaminate(docs, bench, block_words=block_words).collect()
    want = brute(edge_texts(), [tuple(r) for r in bench.collect()])
    assert len(rows) == len(want) + 2
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id], r


def test_near_matches_allow_moved_words(spark):
    words = [f"w{i}" for i in range(10)]
    exact, moved, far = " ".join(words), " ".join(words[:5] + ["x", "y"] + words[5:]), " ".join(words[:5] + ["x"] * 5 + words[5:])
    docs = spark.createDataFrame([(1, exact), (2, moved), (3, far)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, exact)], "item_id long, text string")
    for slop, found in ((0, {1}), (2, {1, 2}), (5, {1, 2, 3})):
        marked = D.find_passages(docs, bench, slop=slop)
        assert {r.doc_id for r in marked.collect() if r["items"]} == found


def near_items(text, rows, play=2):
    """Items with a window whose every word stands within ``play`` places of its place from some start."""
    w = ALNUM_WORD.findall(lower(text or ""))
    found = set()
    for i, t in rows:
        own = ALNUM_WORD.findall(lower(t or ""))
        span = min(10, len(own))
        for k in range(len(own) - span + 1 if own else 0):
            window = own[k : k + span]
            for start in range(-2 * play, len(w) + play):
                near = [any(0 <= p < len(w) and w[p] == x for p in range(start + j - play, start + j + play + 1)) for j, x in enumerate(window)]
                if all(near) and i is not None:
                    found.add(i)
    return found


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 25])
def test_report_counts_near_items(spark, block_words):
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(words), " ".join(words[:5] + ["x"] + words[5:]), " ".join(words[:5] + ["x"] * 4 + words[5:]), "w1 w0 w3 w2 w5 w4 w7 w6 w9 w8", "", None, "q r"]
    bench = [(1, " ".join(words[:10])), (2, " ".join(words[2:])), (3, "q r"), (None, "w1 w2")] + [(10 + k, f"u{k} v{k} " * 20) for k in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = D.decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string"), block_words=block_words).collect()
    want = brute(texts, bench)
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id]
        assert r.n_near == len(near_items(texts[r.doc_id], bench)) >= r.n_items
    assert {r.doc_id: (r.n_items, r.n_near) for r in rows}[1] == (0, 2)
    assert {r.doc_id: r.n_near for r in rows}[2] == 2  # either side of four words more is two places off a common start


def test_empty_tables(spark):
    docs, bench = documents(spark), items(spark)
    assert D.decontaminate(empty(docs), bench).collect() == []
    assert all(not r.contaminated and r.n_items == 0 for r in D.decontaminate(docs, empty(bench)).collect())
