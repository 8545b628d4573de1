"""Embedding columns as matrices of whole numbers, and sums of matrices over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beyond this a double holds no fraction and a whole number times 2 may not be exact: such entries count as not finite.
LARGEST = float(1 << 52)


def whole(vector: Column, scale: int, offset: int = 0) -> Column:
    """floor(scale * c) + offset of each component c (as double): array of longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long") + F.lit(offset))


def usable(vector: Column, scale: int) -> Column:
    """Whether the vector is there and all its components are finite, and so small that ``whole`` is exact."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double") * F.lit(float(scale))) > LARGEST)
    return vector.isNotNull() & ~F.exists(vector, bad)


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix of ``dim`` columns; shorter rows are filled with zeros."""
    flat, sizes = col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())
    if dim and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(col), dim), flat.dtype if len(flat) else np.int64)
    ends = np.cumsum(sizes)
    rows = np.repeat(np.arange(len(col)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
    return out


def sum_matrices(df: DataFrame, of_batch: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int],
                 kind: str = "double") -> np.ndarray:
    """Sum of ``of_batch``'s matrices over all batches of ``df``; ``kind`` is what they hold, double or long.

    Each task adds up its own; the rows of these sums are added on Spark, row i by the owner of i. The driver gets one
    matrix of ``shape``, whatever the number of rows or tasks.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                total = of_batch(b) if total is None else total + of_batch(b)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int64()), "task": pa.array(
                [TaskContext.get().partitionId()] * len(total), pa.int64()), "v": pa.array([r.tolist() for r in total])})

    def add(t: pa.Table) -> pa.Table:
        rows = t.sort_by("task")["v"].combine_chunks()
        v = rows.flatten().to_numpy().reshape(len(rows), -1).sum(axis=0)
        return pa.table({"i": t["i"].slice(0, 1), "v": pa.array([v.tolist()], pa.list_(pa.int64() if kind == "long" else pa.float64()))})

    sums = df.mapInArrow(partial, f"i long, task long, v array<{kind}>").groupBy("i").applyInArrow(add, f"i long, v array<{kind}>")
    out = np.zeros(shape, np.int64 if kind == "long" else np.float64)
    for r in sums.collect():        # shape[0] rows
        out[r["i"]] = r["v"]
    return out

