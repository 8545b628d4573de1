"""Mixing documents to target weights by soft domain membership.

A softmax classifier, fitted on a bounded sample of the labelled table, gives every document a posterior over the
domains (by default the two values of the quality label). Each document d has n_d tokens (words) and gets
a rate x_d >= 0; the expected tokens of domain k are sum_d x_d n_d p_dk. Rates are fitted so that these totals match the
targets, by projected gradient descent on the weighted squares of the differences:

    f(x) = r' M^-1 r / 2,   r_k = sum_d x_d n_d p_dk - T_k,   M = sum_d n_d p_d p_d'

scaled per document by 1 / n_d, starting from one rate for all. In these coordinates the Hessian is a projection, so
step 1 is safe and only the bound x >= 0 makes more than one step necessary; steps are first tried with the M of the
documents whose rate is not at the bound, and replaced by the safe ones if they overshoot. A step needs K sums r and
the K x K of M: it is one aggregation over (n_d, p_d), and a document's rate is a fold over the steps so far. Nothing per document ever leaves
the executors. If no rates can match (a domain without tokens), the closest totals remain.

``total`` is the wanted number of tokens as a multiple of what there is. A document is used floor(x_d + u_d) times, u_d being
a hash of its id in [0, 1), so expected uses equal its rate. Null and empty texts have no tokens, the posterior
of an empty text, and a rate like all others; null ids share one u_d. Without labelled rows of two domains or more, all
posteriors are equal.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm import chunks as C
from sitelens.llm.buffers import blocks, is_space, span_hashes, text_column, word_bounds
from sitelens.llm.samples import fit_in_task

#: domains: (name, target weight) for the values 0 and 1 of the quality label
DOMAINS = (("low", 0.1), ("high", 0.9))
TOTAL = 1.1
SLOTS, MAX_ROWS, MAX_BYTES = 512, 4000, 16384


def shape_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, words) per text: ten measures of its shape, and the hashed shares of its words."""
    starts, ends, first = word_bounds(buf, offs)
    n, words = offs.size - 1, np.diff(first)
    codes = span_hashes(buf, starts, ends)
    row = np.repeat(np.arange(n), words)
    size = np.maximum(words, 1).astype(float)
    order = np.lexsort((codes, row))
    new = np.ones(row.size, bool)
    if row.size:
        new[1:] = (codes[order][1:] != codes[order][:-1]) | (row[order][1:] != row[order][:-1])
    run = np.diff(np.append(np.flatnonzero(new), row.size))
    most = np.zeros(n)
    np.maximum.at(most, row[order][new], run)
    again = np.zeros(row.size, bool)
    again[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    length = np.maximum(np.diff(offs), 1).astype(float)

    def share(mask):
        c = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(c[offs]) / length

    shape = np.column_stack([
        np.log1p(words) / 10, np.bincount(row[order][new], minlength=n) / size, most / size,
        np.bincount(row[again], minlength=n) / size, share((buf >= 48) & (buf <= 57)), share((buf >= 65) & (buf <= 90)),
        share(buf == 10) * 10, share(buf == 124) * 10, share(np.isin(buf, np.frombuffer(b".,;:!?", np.uint8))) * 10,
        share(~is_space(buf)) * length / size / 10])
    slot = (codes >> np.uint64(40)).astype(np.int64) % SLOTS
    bag = np.bincount(row * SLOTS + slot, minlength=n * SLOTS).reshape(n, SLOTS) / np.sqrt(size)[:, None]
    return np.column_stack([np.ones(n), shape * 3, bag]), words


@dataclass
class Posterior:
    weights: np.ndarray     # features x domains

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_posterior(texts: list[bytes], domain: np.ndarray, k: int, steps: int = 300, ridge: float = 1e-3) -> Posterior:
    buf = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    x = np.concatenate([shape_features(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a])[0] for a, b in blocks(offs)])
    y = np.eye(k)[domain]
    w, m, v = np.zeros((x.shape[1], k)), 0.0, 0.0
    for t in range(1, steps + 1):
        g = x.T @ (Posterior(w)(x) - y) / len(x) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return Posterior(w)


def train(docs: DataFrame, labels: DataFrame, domain: Column, k: int, id_col: str = "doc_id", text_col: str = "text",
          max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Posterior:
    """Classifier from at most ``max_rows`` labelled rows (chosen by a hash of the id), texts of at most ``max_bytes``.
    ``domain`` is the domain's number as an expression over ``labels`` (null: not used)."""
    lab = (labels.select(F.col(id_col).cast("long").alias("i"), domain.cast("int").alias("y"))
           .where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y"))
           .orderBy(F.xxhash64("i"), "i").limit(max_rows))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t")).where(F.octet_length("t") <= max_bytes)
    one = rows.join(F.broadcast(lab), "i").groupBy("i", "y").agg(F.min("t").alias("t"))    # repeated rows of one id count once

    def learn(got: list[tuple[int, int, bytes]]) -> Posterior:
        got = sorted(got, key=lambda r: r[0])
        y = np.array([r[1] for r in got], np.int64)
        if np.unique(y).size < 2:
            return Posterior(np.zeros((11 + SLOTS, k)))
        return fit_posterior([r[2] for r in got], y, k)

    return fit_in_task(one.select("i", "y", "t"), learn)    # at most max_rows


def _posteriors(docs: DataFrame, model: Posterior, text_col: str, n_col: str = "__n", p_col: str = "__p") -> DataFrame:
    """``docs`` with columns for words and posterior added, in one narrow pass."""
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(n_col, T.LongType()), T.StructField(p_col, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_column(b.column(at))
            ps, ns = [np.zeros((0, model.weights.shape[1]))], [np.zeros(0, np.int64)]
            for x, y in blocks(offs, 1 << 18):
                for u in range(x, y, 2048):     # bounds the dense features of very short texts
                    w = min(y, u + 2048)
                    f, n = shape_features(buf[offs[u]:offs[w]], offs[u:w + 1] - offs[u])
                    ps.append(model(f))
                    ns.append(n)
            p = np.concatenate(ps)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(ns), pa.int64()), lists],
                                             [*b.schema.names, n_col, p_col])

    return docs.mapInArrow(run, schema)


def _rate(start: float, steps: list[np.ndarray], p_col: str = "__p") -> Column:
    """A document's rate: a fold of the projected steps over its posterior."""
    if not steps:
        return F.lit(start)
    k = len(steps[0])
    flat = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in steps])
    p = F.col(p_col)
    dot = lambda g: sum((p[i] * g[i] for i in range(1, k)), p[0] * g[0])
    return F.aggregate(flat, F.lit(float(start)), lambda x, g: F.greatest(F.lit(0.0), x - dot(g)))


def fit_rates(slim: DataFrame, targets: Sequence[float], total: float, tolerance: float = 1e-6, max_steps: int = 50):
    """(start rate, steps) for a table of (__n, __p)."""
    k = len(targets)
    n, p = F.col("__n").cast("double"), F.col("__p")
    sums = slim.agg(F.coalesce(F.sum(n), F.lit(0.0)), *[F.coalesce(F.sum(n * p[i] * p[j]), F.lit(0.0))
                                                       for i in range(k) for j in range(i, k)]).first()
    tokens, m, at = float(sums[0]), np.zeros((k, k)), 1
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = sums[at]
            at += 1
    if tokens == 0:
        return total, []
    small = 1e-9 * tokens * np.eye(k)
    inverse = np.linalg.pinv(m + small)
    want = np.array(targets, float) / sum(targets) * tokens * total
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    steps: list[np.ndarray] = []
    before: tuple[float, np.ndarray] | None = None     # value and residual before a step in the free metric
    for _ in range(max_steps):
        x = slim.select((_rate(total, steps) * n).alias("xn"), n.alias("n"), "__p")
        free = F.when(F.col("xn") > 0, F.col("n")).otherwise(F.lit(0.0))
        got = x.agg(*[F.sum(F.col("xn") * p[i]) for i in range(k)], *[F.sum(free * p[i] * p[j]) for i, j in pairs]).first()
        r = np.array(got[:k], float) - want
        value = float(r @ inverse @ r)
        if np.abs(r).max() <= tolerance * tokens:
            break
        if before is not None and value > before[0]:    # too far: take the safe step from there instead
            steps[-1] = inverse @ before[1]
            before = None
            continue
        mf = np.zeros((k, k))
        for (i, j), v in zip(pairs, got[k:]):
            mf[i, j] = mf[j, i] = v
        if before is not None and value > before[0] * (1 - 1e-9):
            break       # the closest totals that rates of at least 0 allow
        before = (value, r)
        steps.append(np.linalg.pinv(mf + small) @ r)
    else:
        warnings.warn(f"rates after {max_steps} steps: totals still differ from their targets by up to {np.abs(r).max() / tokens:.2e} of all tokens", stacklevel=2)
    return total, steps


def _fitted(docs: DataFrame, labels: DataFrame, domain: Column, domains, total: float, id_col: str, text_col: str,
            names: list[str]) -> DataFrame:
    """``docs`` with four columns added, called ``names``: words, posterior, rate, copies."""
    n, p, rate, copies = names
    model = train(docs, labels, domain, len(domains), id_col, text_col)
    full = _posteriors(docs, model, text_col, n, p)
    slim = _posteriors(docs.select(text_col), model, text_col).select("__n", "__p").checkpoint(True)
    start, steps = fit_rates(slim, [w for _, w in domains], total)
    u = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return full.withColumn(rate, _rate(start, steps, p)).withColumn(copies, F.floor(F.col(rate) + u).cast("int"))


def quality_domain() -> Column:
    """The domain's number from the labelled table: its quality, 0 or 1."""
    return F.when(F.col("quality").isin(0, 1), F.col("quality"))


def mixing_rates(docs: DataFrame, labels: DataFrame, domains: Sequence[tuple[str, float]] = DOMAINS, total: float = TOTAL,
                 domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, p_<domain>..., rate, copies) of every row. ``domain`` gives a labelled row's domain number."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    labels = labels.withColumnRenamed(id_col, "__id")
    out = _fitted(rows, labels, quality_domain() if domain is None else domain, domains, total, "__id", "__text",
                  ["__n", "__p", "__rate", "__copies"])
    return out.select(F.col("__id").alias(id_col), F.col("__n").alias("n_tokens"),
                      *[F.col("__p")[i].alias(f"p_{name}") for i, (name, _) in enumerate(domains)],
                      F.col("__rate").alias("rate"), F.col("__copies").alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, domains: Sequence[tuple[str, float]] = DOMAINS, total: float = TOTAL,
        domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, with all their columns."""
    *names, i = C.fresh(docs.columns, "n_words", "posterior", "rate", "copies", "i")
    out = _fitted(docs, labels, quality_domain() if domain is None else domain, domains, total, id_col, text_col, names)
    once = out.where(F.col(names[3]) > 0).withColumn(i, F.explode(F.sequence(F.lit(1), F.col(names[3]))))
    return once.select(*[f"`{c}`" for c in docs.columns])
