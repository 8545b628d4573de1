"""Operator 11 against numpy's dense eigensolver and exact Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import feast_whitening as W


def symmetric(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return (q * np.asarray(values, float)) @ q.T


SPECTRA = {
    "spread": np.linspace(1, 50, 40),
    "noise": np.sort(np.random.default_rng(2).uniform(45, 90, 64)),
    "one large": [*np.random.default_rng(3).uniform(1, 1.1, 63), 400],
    "twins": [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9, 9, 9, 9],
    "all equal": [3.0] * 20,
    "close": [1 + 1e-7 * i for i in range(30)],
    "low rank": [0] * 30 + [5, 6, 7],
    "one": [4.0],
    "two": [4.0, 1.0],
    "wide": [10.0 ** -i for i in range(10)],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_leading_components(name):
    v = symmetric(SPECTRA[name])
    e, q = W.leading_components(v, 16)
    want = np.sort(SPECTRA[name])[::-1]
    want = want[want > 1e-10][:16]
    assert len(e) == len(want)
    np.testing.assert_allclose(e, want, rtol=1e-9, atol=1e-15 * want[0])
    np.testing.assert_allclose(v @ q, q * e, atol=1e-12 * want[0])
    np.testing.assert_allclose(q.T @ q, np.eye(len(e)), atol=1e-12)


def test_inertia_counts():
    v = symmetric(SPECTRA["noise"])
    form = W.tridiagonal(v)
    for shift in (0, 45, 50.5, 60, 89, 91):
        assert W.count_above(form, np.array([shift]))[0] == (SPECTRA["noise"] > shift).sum()
    np.testing.assert_allclose(W.places(form, 64), np.sort(SPECTRA["noise"])[::-1], rtol=1e-12)


def held(spark, table, components=16):
    """The operator's rows equal those of exact integers and numpy's eigensolver."""
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    for c in ("x", "n", "i", "task", "v", "whitened", "deviation"):
        df = df.withColumn(c, F.lit("other"))
    got = W.whitened_components(df, components).collect()
    good = [(i, v) for i, v in table if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in good]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n)) if good else 0
    rows = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in good if len(v) == dim]
    fit = sorted({x for _, x in rows})
    n = len(fit)
    sums = [sum(x[j] for x in fit) for j in range(dim)]
    want = {}
    if n > 1:
        d = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], float) / n
        v = d.T @ d / n
        e, q = np.linalg.eigh(v)
        e, q = e[::-1], q[:, ::-1]
        k = min(components, int((e > 1e-10 * np.trace(v)).sum()))
        for i, x in rows:
            c = [n * a - s for a, s in zip(x, sums)]
            w = np.array(c, float) / n @ q[:, :k] / np.sqrt(e[:k])
            for j in range(k):
                total = sum(a * a for a in c)
                want.setdefault((i, j + 1, total if total < 1 << 63 else None), []).append((w[j], e[j] / np.trace(v)))
    have = {}
    for r in got:
        assert r.n == n and abs(r.identity_error) <= 1e-10
        have.setdefault((r.vec_id, r.component, r.deviation), []).append((r.whitened, r.explained))
    assert have.keys() == want.keys()
    signs = {}
    for key, pairs in want.items():
        assert len(have[key]) == len(pairs)
        for (a, b), (c, d) in zip(sorted(have[key], key=lambda p: abs(p[0])), sorted(pairs, key=lambda p: abs(p[0]))):
            assert b == pytest.approx(d, rel=1e-9)
            assert abs(a) == pytest.approx(abs(c), abs=1e-7)
            if abs(a) > 1e-5:
                assert signs.setdefault(key[1], a * c > 0) == (a * c > 0)
    return got


def test_against_brute_force(spark):
    rnd = random.Random(9)
    table = [(i, [rnd.gauss(0, 0.1 * (j + 1)) for j in range(20)]) for i in range(400)]
    table += table[:30] + [(5, table[0][1])] * 200                    # repeated rows, and a vector of a third of all
    table += [(900, None), (901, []), (902, [None] * 20), (903, [math.nan] + [0.1] * 19), (904, [math.inf] * 20),
              (None, [0.2] * 20), (905, [0.1] * 19)]
    held(spark, table)


def test_edges(spark):
    held(spark, [])
    assert held(spark, [(1, [0.5, 0.25])]) == []                      # one vector: no variance
    assert held(spark, [(1, None), (2, [])]) == []
    held(spark, [(1, [0.5, 0.25]), (2, [0.5, 1.25]), (3, [0.5, 7.0])])     # one dimension without variance
    held(spark, [(i, [1e9 * math.sin(7 * i + j) for j in range(3)]) for i in range(8)])
    got = held(spark, [(i, [math.sin(i * j) for j in range(1, 4)]) for i in range(30)], components=2)
    assert {r.component for r in got} == {1, 2}


def test_deviation_beyond_a_long():
    model = W.Whitening(10, [10 ** 14], np.ones(1), np.ones((1, 1)))
    assert model.deviation(np.array([[10 ** 13], [10 ** 13 + 5]])) == [0, 2500]
    assert model.deviation(np.array([[1 << 51]])) == [None]
