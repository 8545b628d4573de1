"""Operator 12 against plain Python integers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sitelens.llm.norm_sorted_topk import top_products


def held(spark, table, k=5, modulo=3, cell_rows=None):
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    for c in ("id", "y", "norm", "ids", "part", "seq", "score", "top", "rank", "asks"):
        df = df.withColumn(c, F.lit("other"))
    got = sorted(tuple(r) for r in top_products(df, F.col("vec_id") % modulo == 0, k, cell_rows=cell_rows)
                 .select("query_id", "rank", "vec_id", "score").collect())
    rows = [(i, [math.floor(256 * c) for c in v]) for i, v in table
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    rows = [(i, y) for i, y in rows if sum(c * c for c in y) <= 1 << 62]
    want = []
    for n, (q, y) in enumerate(rows):
        if q is None or q % modulo:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(y, c)), i is None, i or 0) for m, (i, c) in enumerate(rows) if m != n))
        want += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scores[:k])]
    order = lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[3])
    assert sorted(got, key=order) == sorted(want, key=order)


@pytest.mark.parametrize("cell_rows", [None, 37])
def test_random_vectors(spark, cell_rows):
    rnd = random.Random(1)
    table = [(i, [rnd.gauss(0, 0.3) * 2 ** rnd.randint(-2, 2) for _ in range(24)]) for i in range(700)]
    held(spark, table, cell_rows=cell_rows)


@pytest.mark.parametrize("cell_rows", [None, 5])
def test_ties_copies_and_repeated_ids(spark, cell_rows):
    rnd = random.Random(2)
    table = [(rnd.randint(0, 40), [rnd.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(3)]) for _ in range(150)]
    table += [(i, [0.5, 0.5, 0.5]) for i in range(100, 180)]        # one vector of a third of all rows
    table += [(12, [0.0, 0.0, 0.0])] * 3 + [(None, [0.5, 0.5, 0.5])] * 2 + [(3, [0.5, 0.5]), (6, []), (9, [0.5, 0.5, 0.5, 2.0])]
    held(spark, table, cell_rows=cell_rows)


def test_values_that_are_none_or_too_large(spark):
    table = [(0, None), (3, [None, 1.0]), (6, [math.nan, 1.0]), (9, [math.inf, 1.0]), (12, [1e30, 1.0]), (15, [4e6, -4e6]),
             (18, [-4e6, 4e6]), (1, [1.5, -2.25]), (21, [0.001, -0.001]), (24, [8e6, 0.0])]
    held(spark, table)


def test_small_tables(spark):
    held(spark, [])
    held(spark, [(3, [1.0])])
    held(spark, [(1, [1.0]), (2, [2.0])])
    held(spark, [(3, [1.0]), (3, [1.0])])
    held(spark, [(3, [1.0] * 600), (6, [-1.0] * 600), (7, [0.1] * 600)])


def test_long_vectors_first(spark):
    """Bounds from the longest vectors stop the search: short vectors are never scored, and nothing is lost."""
    rnd = random.Random(3)
    table = [(i, [rnd.gauss(0, 1) * (50 if i % 40 == 0 else 0.01) for _ in range(8)]) for i in range(1200)]
    held(spark, table, k=4, modulo=20, cell_rows=100)
