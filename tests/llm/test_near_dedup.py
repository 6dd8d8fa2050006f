"""Near duplicates against all pairs of full sets."""

import random

import pytest

from spendlens.llm import near_dedup
from tests.llm.common import BLANK_WORD, documents, edge_texts, empty, lower, prose


def brute(texts, n, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = BLANK_WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def groups_of_copies():
    """A large group of near copies (a chain, so its ends do not link), a passage that many texts share, noise."""
    r = random.Random(5)
    words = prose(11, 200).split(" ")
    texts = []
    for k in range(60):
        texts.append(" ".join(words))
        words[r.randrange(len(words))] = f"edit{k}"
        words[r.randrange(len(words))] = f"more{k}"
    passage = prose(12, 150)
    texts += [passage + " " + prose(100 + k, 25 if k % 2 else 200) for k in range(60)]
    texts += [prose(300 + k, 5) for k in range(30)]
    return texts


@pytest.mark.parametrize("shingle, percent", [(3, 85), (5, 80)])
@pytest.mark.parametrize("make", [edge_texts, groups_of_copies])
def test_components_equal_brute_force(spark, make, shingle, percent):
    texts = make()
    rows = near_dedup.near_duplicates(documents(spark, texts), shingle, percent).collect()
    want = brute(texts, shingle, percent)
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)


def pairs_at_the_threshold(percent):
    """Pairs of 58 to 64 one-word shingles that share the fewest words that still link, and one word less."""
    texts = []
    for x in range(58, 65):
        for y in range(x, 65):
            least = -(-percent * (x + y) // (100 + percent))
            for shared in {least, least - 1}:
                own = f"p{len(texts)}w"
                both = [f"{own}{i}" for i in range(shared)]
                texts += [" ".join(both + [f"{own}{side}{i}" for i in range(n - shared)]) for side, n in (("a", x), ("b", y)) if n >= shared]
    return texts


@pytest.mark.parametrize("percent", [85, 80])
def test_pairs_that_fill_a_sketch_are_exact(spark, percent):
    texts = pairs_at_the_threshold(percent)
    want = brute(texts, 1, percent)
    assert len({c for _, c in want.values()}) < len(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(documents(spark, texts), 1, percent).collect() if r.doc_id is not None}
    assert got == want


def test_empty_table(spark):
    assert near_dedup.near_duplicates(empty(documents(spark)), 3, 85).collect() == []


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "u long, v long")
    got = {r.node: r.comp for r in near_dedup.components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def edited_copies(n, edits):
    """Copies of one text, each with edits of its own."""
    base, r = prose(5, 150).split(" "), random.Random(8)
    texts = []
    for i in range(n):
        words = list(base)
        for k in r.sample(range(150), r.choice(edits)):
            words[k] = f"edit{i}x{k}"
        texts.append(" ".join(words))
    return texts


@pytest.fixture
def cross_pairs_made(monkeypatch):
    made, plain = [], near_dedup.cross_pairs

    def counted(*args):
        pairs = plain(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dedup, "cross_pairs", counted)
    return made


def test_copies_with_many_edits_of_their_own_make_few_pairs(spark, cross_pairs_made):
    """1,200 copies below the threshold: what they have left from a list's value on tells them apart."""
    docs = spark.createDataFrame(list(enumerate(edited_copies(1200, [5, 6, 7, 8]))), "doc_id long, text string")
    assert near_dedup.near_duplicates(docs, 3, 85).where("not kept").count() == 0
    assert cross_pairs_made[0] < 10 * 1200, cross_pairs_made


def test_copies_about_the_threshold_equal_brute_force(spark, cross_pairs_made):
    """Here lone values do not decide: the pairs are whole, and grow with the square of the group (README)."""
    texts = edited_copies(400, [3, 4, 5])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(docs, 3, 85).collect()}
    assert got == {i: c for i, (_, c) in brute(texts, 3, 85).items()}
    assert cross_pairs_made[0] < 400 * 399 / 2
