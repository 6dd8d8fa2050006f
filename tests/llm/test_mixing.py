"""Apportionment against all quotients, water level against repeated sharing, the mix as a whole."""

import random
from collections import defaultdict

import pytest

from spendlens.llm import mixing
from tests.llm.common import documents, empty, prose


@pytest.mark.parametrize("seed", range(4))
def test_sainte_lague_equals_all_quotients(spark, seed):
    r = random.Random(seed)
    values, seats_in_all = [float(r.choice([0, 1, 3, 40, 900]) * r.random()) for _ in range(40)], r.choice([0, 7, 100, 333, 2000])
    # limits cut off less than a seat, as the mix's do
    limits = [r.choice([int(v * seats_in_all / sum(values)) + 1, 4000]) for v in values]
    rows = [("g", 0, f"p{i}", v, m, seats_in_all) for i, (v, m) in enumerate(zip(values, limits, strict=True))]
    df = spark.createDataFrame(rows, "g string, z int, k string, v double, m long, s long")
    got = {x.k: x.seats for x in mixing.sainte_lague(df, "v", "s", "m", ["g"], "k", "seats").collect()}
    seats = sorted(((-v / (2 * s + 1), k) for _, _, k, v, m, _ in rows for s in range(m) if v > 0))[: rows[0][5]]
    want = defaultdict(int)
    for _, k in seats:
        want[k] += 1
    assert {k: n for k, n in got.items() if n} == dict(want)


def shared_again(sizes, share=1.5, limit=2):
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in target]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > limit * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        # only the fullest ones are surely full; share again
        for s in over:
            target[s] = limit * sizes[s]
        left = share * sum(sizes.values()) - sum(target.values())


@pytest.mark.parametrize("seed", range(3))
def test_targets_equal_repeated_sharing(spark, seed):
    r = random.Random(seed)
    sizes = {(None if i == 3 else f"s{i}"): r.choice([0, 5, 100, 4000, 90000]) for i in range(14)} | {"big": 1000}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {x.source: x.target for x in mixing.source_targets(df).collect()}
    assert got == pytest.approx(shared_again(sizes))


def test_mix_comes_near_its_targets(spark):
    texts = [prose(i, 5 + i * 7 % 300) for i in range(400)]
    docs = documents(spark, texts)
    rows = mixing.mix(docs, shard_rows=30).collect()
    assert len(rows) == len(texts) + 2
    taken, target = defaultdict(int), {}
    for x in rows:
        assert 0 <= x.taken <= 2 * x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
    assert all(abs(taken[s] - target[s]) <= 3 * mixing.BLOCK for s in target), (taken, target)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, shard_rows=30).collect()))


def test_every_source_meets_its_target(spark):
    """Sources of a few words, of less than a block, and with many small shards: the words taken are the rounded target."""
    rows = [(i, f"tiny{i % 3}", "a b c d e") for i in range(6)] + [(10 + i, "one", prose(i, 10)) for i in range(1)]
    rows += [(100 + i, f"s{i % 2}", prose(i, 1 + i % 40)) for i in range(500)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), shard_rows=20).collect()
    taken, target = defaultdict(int), {}
    for x in out:
        assert 0 <= x.taken <= 2 * x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
    assert {s: int(t + 0.5) for s, t in target.items()} == dict(taken) and taken["one"] == 20


def test_awkward_and_empty_tables(spark):
    assert len(mixing.mix(documents(spark)).collect()) == documents(spark).count()
    assert mixing.mix(empty(documents(spark))).collect() == []
    blank = mixing.mix(documents(spark, [None, "", " "]).where("doc_id is not null")).collect()
    assert [r.taken for r in blank] == [0] * 4
