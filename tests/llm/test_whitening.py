"""Whitening against plain integers, fractions and a float eigen solver."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from spendlens.llm import whitening as W
from spendlens.llm.queries import op12_whitening
from tests.llm import common

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>"


def plain_polynomial(m):
    """det(y I - m) by Faddeev and LeVerrier's recurrence in fractions, constant coefficient first."""
    d = len(m)
    out, held = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        for i in range(d):
            held[i][i] += out[-1]
        held = [[sum(m[i][x] * held[x][j] for x in range(d)) for j in range(d)] for i in range(d)]
        out.append(-sum(held[i][i] for i in range(d)) / k)
    return [int(c) for c in reversed(out)]


def scatter_of(rows):
    n, d = len(rows), len(rows[0])
    s = [sum(r[i] for r in rows) for i in range(d)]
    return n, s, [[n * sum(r[i] * r[j] for r in rows) - s[i] * s[j] for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("d", [1, 2, 3, 7])
def test_polynomial_equals_plain(spark, d):
    r = random.Random(d)
    rows = [[r.randrange(-500, 500) for _ in range(d)] for _ in range(20)]
    rows = [x[: d - 1] + x[: 1] for x in rows] if d == 7 else rows  # one of a dependent pair: a root of zero
    _, _, m = scatter_of(rows)
    assert W.characteristic(spark.range(1), m) == plain_polynomial(m)


def test_counts_of_roots_are_exact():
    poly = [1]
    for root in (0, 3, 3, 8, 50):  # (y - root) multiplied out
        poly = [a - root * b for a, b in zip([0, *poly], [*poly, 0], strict=True)]
    roots = W.Roots(poly)
    assert [roots.above(a, 0) for a in (0, 2, 3, 7, 8, 49, 50)] == [4, 4, 2, 2, 1, 1, 0]
    assert roots.above(5, 1) == 4 and roots.above(6, 1) == 2  # 2.5 and 3
    place, scale = roots.isolate(2, 64)
    assert place < 8 << scale <= place + 1


def check(got, vectors, most=4):
    """``got`` rows against plain integers and numpy's eigen solver."""
    width = max((len(v) for v in vectors.values()), default=0)
    x = {k: [math.floor(256 * float(c)) for c in v] + [0] * (width - len(v)) for k, v in vectors.items()}
    fit = [list(v) for v in sorted({tuple(v) for v in x.values()})]
    n, s, m = scatter_of(fit)
    e = np.linalg.eigvalsh(np.array(m, np.float64) / n / n)[::-1]
    count = min(most, int((e > 1e-9 * e[0]).sum()))
    assert sorted((r.vec_id, r.component) for r in got) == sorted((k, c) for k in x for c in range(1, count + 1))
    for r in got:
        assert r.n == n and r.deviation == sum((n * c - t) ** 2 for c, t in zip(x[r.vec_id], s, strict=True))
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9 and r.identity_error < 1e-9
    named = {tuple(v): k for k, v in x.items()}
    white = {(r.vec_id, r.component): r.whitened for r in got}
    w = np.array([[white[named[tuple(v)], c] for c in range(1, count + 1)] for v in fit])
    c = np.array(fit, np.float64) - np.array(s) / n
    assert np.abs(w.mean(axis=0)).max() < 1e-9 and np.abs(w.T @ w / n - np.eye(count)).max() < 1e-9
    # whitened = c v / sqrt(e) with V v = e v: then V (c' w / n) = e (c' w / n)
    v = c.T @ w / n
    assert np.abs((c.T @ c / n) @ v - v * e[:count]).max() < 1e-9 * e[0] * np.abs(v).max()
    return count


def test_rows_and_cases(spark):
    r = random.Random(4)
    vectors = {i: [r.gauss(0, 1), r.gauss(1, 2), r.gauss(0, 0.1), 0.5, r.gauss(-3, 1), 0.25 * i][: 4 if i == 7 else 6] for i in range(40)}
    vectors = {k: np.array(v, np.float32).tolist() for k, v in vectors.items()}
    vectors[50] = vectors[3]
    vectors[51] = []
    bad = [(60, None), (61, [1.0, None]), (62, [float("nan")]), (63, [float("inf"), 1.0]), (64, [float("-inf")])]
    df = spark.createDataFrame([*vectors.items(), *bad], KIND).withColumn("x", common.F.lit("clash")).withColumn("n", common.F.lit(None))
    assert check(W.whiten(df).collect(), vectors) == 4
    again = W.whiten(df.unionAll(df.where("vec_id = 3"))).where("vec_id = 3").collect()
    assert len(again) == 8
    assert {x.component for x in W.whiten(df.unionAll(df.where("vec_id = 3").withColumn("vec_id", common.F.lit(None).cast("long")))).where("vec_id is null").collect()} == {1, 2, 3, 4}


def test_equal_eigenvalues(spark):
    """The corners of a cross polytope: one eigenvalue five times, so any basis will do."""
    vectors = {2 * i + k: [(1.0 if k else -1.0) * (i == j) for j in range(5)] for i in range(5) for k in (0, 1)}
    assert check(W.whiten(spark.createDataFrame(list(vectors.items()), KIND)).collect(), vectors) == 4


def test_few_components_and_none(spark):
    line = {i: [float(i), 2.0 * i, 0.0] for i in range(9)}
    assert check(W.whiten(spark.createDataFrame(list(line.items()), KIND)).collect(), line) == 1
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], KIND)
    assert W.whiten(same).collect() == []
    assert W.whiten(spark.createDataFrame([(1, []), (2, None)], KIND)).collect() == []
    assert W.whiten(spark.createDataFrame([], KIND)).collect() == []


def test_large_entries_stay_exact(spark):
    """Sums and deviations beyond doubles and longs."""
    big = spark.createDataFrame([(i, [2.0**k * (1 if i & (1 << k) else -1) for k in range(3)] + [2.0**36 * i]) for i in range(8)], "vec_id long, embedding array<double>")
    vectors = {r.vec_id: r.embedding for r in big.collect()}
    x = [[math.floor(256 * c) for c in v] for v in vectors.values()]
    n, s, m = scatter_of(x)
    fit = big.select(W.integers(common.F.col("embedding"), 4).alias("x"))
    assert W.scatter(fit, 4) == (n, s, m)
    out = W.whiten(big).collect()
    assert all(r.deviation is None or r.deviation == sum((n * c - t) ** 2 for c, t in zip(x[r.vec_id], s, strict=True)) for r in out)
    assert out[0].identity_error < 1e-9 and any(r.deviation is None for r in out)
    ends = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert {r.component for r in W.whiten(ends).collect()} == {1, 2}


def test_query_over_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check(op12_whitening(spark, SF).collect(), {r.vec_id: r.embedding for r in rows})
