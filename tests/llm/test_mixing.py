"""Soft-membership mixing: totals match targets, rates solve the fixed point, edge cases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import mixing
from sitelens.llm.mixing import _rate, fit_rates, mix, mixing_rates

SF = "/root/testdata/sf0.1"


def slim_table(spark, seed, n, sharp):
    rnd = np.random.default_rng(seed)
    p = rnd.dirichlet([sharp] * 3, n)
    w = rnd.integers(0, 2000, n)
    return spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(w, p)], "__n long, __p array<double>"), w, p


@pytest.mark.parametrize("sharp,targets", [(0.3, [0.2, 0.3, 0.5]), (0.1, [0.02, 0.08, 0.9]), (2.0, [0.3, 0.3, 0.4])])
def test_rates_match_targets_and_equal_plain_numpy(spark, sharp, targets):
    df, w, p = slim_table(spark, 1, 400, sharp)
    start, steps = fit_rates(df, targets, 1.0)
    x = np.array([r.x for r in df.select("__n", "__p", _rate(start, steps).alias("x")).collect()])
    y = np.full(len(w), start)
    for s in steps:
        y = np.maximum(0, y - p @ s)
    assert np.allclose(np.sort(x), np.sort(y)) and (x >= 0).all()
    have = (y * w) @ p
    assert np.abs(have / have.sum() - np.array(targets)).max() < 1e-4 and abs(have.sum() / w.sum() - 1) < 1e-4


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_posteriors_and_expected_totals_on_the_test_tables(spark):
    df, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = mixing_rates(df, lab).join(lab, "doc_id", "left").collect()
    n = np.array([r.n_tokens for r in rows])
    p = np.array([[r.p_low, r.p_high] for r in rows])
    x = np.array([r.rate for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and (x >= 0).all()
    share = (x * n) @ p / ((x * n).sum())
    assert np.abs(share - [0.1, 0.9]).max() < 1e-3
    q = np.array([-1 if r.quality is None else r.quality for r in rows])
    low = p[:, 0]
    print("mean low posterior", low[q == 0].mean(), low[q == 1].mean(), "copies 0:", sum(r.copies == 0 for r in rows), "rates", np.percentile(x, [1, 10, 50, 90, 99]))
    assert low[q == 0].mean() > 2 * low[q == 1].mean()
    assert sum(r.copies == 0 for r in rows if r.quality == 1) < 0.01 * (q == 1).sum()   # good documents stay
    assert abs(sum(r.copies for r in rows) - x.sum()) < 6 * np.sqrt(len(rows))


def test_mix_repeats_and_drops_rows_with_all_columns(spark):
    texts = [" ".join(f"w{(i * 7 + j) % 50}" for j in range(30)) if i % 2 else "x " * 30 for i in range(200)]
    df = spark.createDataFrame([(i, t, "en", i) for i, t in enumerate(texts)] + [(None, None, None, None), (5000, "", "a", 1)],
                               "doc_id long, text string, quality string, copies int").repartition(3)
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 200, 2)] + [(i, 1, 0) for i in range(1, 200, 2)] + [(None, 1, 1), (7, None, 1)],
                                "doc_id long, quality int, toxic int")
    rates = {r.doc_id: r.copies for r in mixing_rates(df, lab).collect()}
    got = mix(df, lab)
    assert got.columns == df.columns
    uses = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert uses == {i: c for i, c in rates.items() if c > 0}
    assert mix(df.limit(0), lab).count() == 0
    none = mixing_rates(df, lab.limit(0)).collect()
    assert len(none) == 202 and len({r.rate for r in none}) == 1


def test_the_fit_is_not_the_drivers(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    monkeypatch.setattr(mixing, "fit_posterior", lambda texts, domain, k: (os.getpid(), texts, domain.tolist()))
    pid, texts, domain = mixing.train(df, lab, mixing.quality_domain(), 2)
    assert pid != os.getpid()
    assert texts == [b"text %d" % i for i in range(30)] and domain == [i % 2 for i in range(30)]
