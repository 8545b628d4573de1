"""Embedding whitening by FEAST contour integration.

Vectors become whole numbers x = floor(64 c) + 1000000. Means and covariance are taken over the distinct x vectors, by sums
that every task makes for itself and Spark adds up; centring comes before multiplying. The leading eigenvectors of the
covariance come from FEAST: a subspace is filtered by a quadrature of complex shifted solves around an interval of
eigenvalues, Rayleigh-Ritz extracts eigenpairs from it, and this repeats until the residuals are at rounding. Inertia counts
(signs of the pivots of shifted tridiagonal forms) place the intervals in gaps of the spectrum and verify that each holds as
many components as were found: none is missed. Only a matrix of the vectors' dimensions reaches the driver.

Defined cases: rows whose vector is null, empty, holds a null or non-finite component, or one of which 64 c exceeds 2**52,
are dropped; so are vectors of another length than the most common one (of equally common ones the longest). Repeated rows
are returned each, and count once in the fit. Components whose variance is zero to rounding (1e-12 of the trace) cannot be
scaled to one and are not returned: none at all of a table with one distinct vector. A deviation beyond a long is null.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.vectors import matrix, sum_matrices, usable, whole

SCALE, OFFSET = 64, 1_000_000
QUADRATURE, PER_INTERVAL, NO_VARIANCE = 8, 12, 1e-12
_HALF = 26


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix orthogonally similar to symmetric ``a`` (Householder)."""
    a = a.copy()
    for j in range(len(a) - 2):
        v = a[j + 1:, j].copy()
        length = np.linalg.norm(v)
        if length == 0 or not np.any(v[1:]):
            continue
        v[0] += length if v[0] >= 0 else -length
        v /= np.linalg.norm(v)
        a[j + 1:] -= 2 * np.outer(v, v @ a[j + 1:])
        a[:, j + 1:] -= 2 * np.outer(a[:, j + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_above(form: tuple[np.ndarray, np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """Inertia: how many eigenvalues exceed each shift, by the signs of the pivots of the shifted form."""
    diagonal, off = form
    shifts = np.asarray(shifts, float)
    tiny = np.finfo(float).tiny ** 0.5
    pivot = np.full(shifts.shape, 1.0)
    count = np.zeros(shifts.shape, int)
    for i, d in enumerate(diagonal):
        pivot = d - shifts - (off[i - 1] ** 2 / pivot if i else 0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot > 0
    return count


def places(form: tuple[np.ndarray, np.ndarray], wanted: int) -> np.ndarray:
    """The ``wanted`` largest eigenvalues, falling, by bisection on inertia counts: where to put the intervals' ends."""
    reach = np.abs(form[0]).max() + 2 * (np.abs(form[1]).max() if len(form[1]) else 0) + 1e-300
    low, high = np.full(wanted, -reach), np.full(wanted, reach)
    for _ in range(70):
        mid = (low + high) / 2
        up = count_above(form, mid) > np.arange(wanted)
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return (low + high) / 2


def intervals(values: np.ndarray, wanted: int, per: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """(low, high, number of eigenvalues) of intervals that hold the ``wanted`` largest of ``values`` (falling, scaled to a
    norm of about one); ends lie in the widest gaps. Close eigenvalues stay in one interval."""
    n = len(values)
    gaps = np.append(values[:-1] - values[1:], np.inf)      # after the last one everything is free
    last = wanted - 1
    options = range(last, min(n, wanted + per))
    last = max(options, key=lambda i: gaps[i])
    while gaps[last] < 1e-9:
        last += 1

    def cut(a: int, b: int) -> list[tuple[int, int]]:       # positions a..b, both counted
        if b > a:
            at = a + int(np.argmax(gaps[a:b]))
            if gaps[at] > 1e-6 and (gaps[at] > 0.3 * (values[a] - values[b]) or b - a + 1 > per and gaps[at] > 1e-3 * values[0]):
                return cut(a, at) + cut(at + 1, b)
        return [(a, b)]
    out = []
    for a, b in cut(0, last):
        above, below = (gaps[a - 1] if a else np.inf) / 2, gaps[b] / 2
        room = max(values[a] - values[b], min(above, below, 0.1))       # a contour much wider than its values would blur them
        out.append((values[b] - min(below, room), values[a] + min(above, room), b - a + 1))
    return out


def feast(a: np.ndarray, low: float, high: float, count: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of symmetric ``a`` between ``low`` and ``high``, values falling."""
    dim, rnd = len(a), np.random.default_rng(11)
    x, w = np.polynomial.legendre.leggauss(QUADRATURE)
    angle = np.pi / 2 * (x + 1)
    centre, radius = (low + high) / 2, (high - low) / 2
    y = rnd.normal(size=(dim, min(dim, 2 * count + 8)))
    target = 4 * np.finfo(float).eps * dim ** 0.5 * max(1.0, np.linalg.norm(a, 2))
    best = None
    for _ in range(rounds):
        q = np.zeros_like(y)
        for t, weight in zip(angle, w):         # the lower half of the contour is the conjugate of the upper one
            turn = radius * np.exp(1j * t)
            q += weight / 2 * (turn * np.linalg.solve((centre + turn) * np.eye(dim) - a, y.astype(complex))).real
        q = np.linalg.qr(q)[0]
        ritz, s = np.linalg.eigh(q.T @ a @ q)    # Rayleigh-Ritz
        y = q @ s
        inside = np.flatnonzero((ritz > low) & (ritz < high))
        if len(inside) == count:
            worst = np.linalg.norm(a @ y[:, inside] - y[:, inside] * ritz[inside], axis=0).max()
            if best is None or worst < best[0]:
                best = worst, ritz[inside][::-1], y[:, inside][:, ::-1]
            elif best[0] <= 100 * target:
                break                            # no more to gain
            if worst <= target:
                break
    if best is None or best[0] > 1e-10:
        raise ArithmeticError(f"FEAST found no {count} eigenpairs between {low} and {high}")
    return best[1], best[2]


def leading_components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns, largest entry positive) of covariance ``v``: the ``wanted``
    largest, fewer if the others have no variance."""
    scale = np.trace(v) / max(1, len(v))
    if not scale > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    a = (v + v.T) / (2 * scale)
    form = tridiagonal(a)
    wanted = min(wanted, int(count_above(form, np.array([NO_VARIANCE * len(v)]))[0]))
    found = [feast(a, *i) for i in intervals(places(form, len(a)), wanted)]
    q = np.linalg.qr(np.concatenate([f[1] for f in found], axis=1))[0]     # one more Rayleigh-Ritz over all intervals
    e, s = np.linalg.eigh(q.T @ a @ q)
    e, q = e[::-1], (q @ s)[:, ::-1]
    # counts once more: the kept ones are the largest, and none lies between or above them
    slack = 1e-10 * max(1.0, e[0])
    if count_above(form, np.array([e[wanted - 1] + slack]))[0] > wanted - 1 or count_above(form, np.array([e[wanted - 1] - slack]))[0] < wanted:
        raise ArithmeticError("the inertia counts do not agree with the eigenvalues found")
    e, q = e[:wanted] * scale, q[:, :wanted]
    return e, q * np.where(q[np.abs(q).argmax(axis=0), np.arange(wanted)] < 0, -1, 1)


@dataclass
class Whitening:
    n: int
    sums: list[int]             # per dimension, over the distinct vectors
    values: np.ndarray          # eigenvalues, falling
    vectors: np.ndarray         # dimension x components
    trace: float = 0.0
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part of the mean is taken off exactly."""
        whole_mean = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole_mean) - np.array([(s % self.n) / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)**2, exact; None where no long holds it."""
        largest = max((abs(self.n * int(c) - s) for c, s in zip((*x.max(axis=0), *x.min(axis=0)), self.sums * 2)), default=0)
        if len(x) == 0 or largest ** 2 * x.shape[1] < 1 << 63:
            if self.n * int(np.abs(x).max(initial=0)) < 1 << 62:
                return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        out = [sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums)) for row in x.tolist()]
        return [d if d < 1 << 63 else None for d in out]


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, x of the rows that take part."""
    rows = df.where(usable(F.col(vector_col), SCALE) & (F.size(vector_col) > 0)).select(
        id_col, whole(F.col(vector_col), SCALE, OFFSET).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("x") == F.lit(lengths[0]["n"] if lengths else 0))


def fit(rows: DataFrame, components: int = 16) -> Whitening:
    """Whitening of ``rows`` (id, x), fitted on each distinct x once."""
    distinct = rows.select("x").distinct().checkpoint(eager=True)      # read three times
    first = distinct.limit(1).collect()
    if not first:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)))
    dim = len(first[0]["x"])

    def sums(b: pa.RecordBatch) -> np.ndarray:      # two halves of each sum, and the number of rows: no overflow
        x = matrix(b.column(0), dim)
        return np.concatenate([[(x >> _HALF).sum(axis=0), (x & (1 << _HALF) - 1).sum(axis=0)],
                               np.full((2, 1), len(x), np.int64)], axis=1).astype(np.int64)
    halves = sum_matrices(distinct, sums, (2, dim + 1), "long")
    n = int(halves[0, dim])
    out = Whitening(n, [(int(h) << _HALF) + int(low) for h, low in zip(halves[0, :dim], halves[1, :dim])], np.zeros(0), np.zeros((dim, 0)))

    def products(b: pa.RecordBatch) -> np.ndarray:
        d = out.centred(matrix(b.column(0), dim))
        return d.T @ d
    v = sum_matrices(distinct, products, (dim, dim)) / n
    out.trace = float(np.trace(v))
    out.values, out.vectors = leading_components(v, components)
    k = len(out.values)
    if k:
        def whitened(b: pa.RecordBatch) -> np.ndarray:
            w = out.whiten(matrix(b.column(0), dim))
            return np.concatenate([w.sum(axis=0)[None], w.T @ w])
        s = sum_matrices(distinct, whitened, (k + 1, k)) / n
        out.identity_error = float(np.abs(s[1:] - np.outer(s[0], s[0]) - np.eye(k)).max())
    return out


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """The id column, deviation and ``whitened`` (array, one entry a component) of each of ``rows`` (id, x)."""
    id_col = rows.columns[0]
    dim = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1), dim)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.deviation(x), pa.int64()), pa.array(
                    model.whiten(x).tolist(), pa.list_(pa.float64()))], names=[id_col, "deviation", "whitened"])
    if not len(model.values):
        rows = rows.limit(0)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, deviation long, whitened array<double>")


def whitened_components(df: DataFrame, components: int = 16) -> DataFrame:
    """The contract's rows: one for each row that takes part and each component."""
    rows = whole_vectors(df)
    model = fit(rows, components)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values]) if len(model.values) else F.array(F.lit(0.0))
    out = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                      "whitened", F.get(explained, F.col("i")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
