"""Exact top-k inner products over norm-sorted vectors, with rotated partial sums and Cauchy-Schwarz bounds.

Components become whole numbers y = floor(256 x), scores are their exact integer inner products. Candidates are ordered by
falling length and cut into cells of bounded size; queries are taken in blocks. Waves of cells (1, 2, 4, ... of them, the
longest vectors first) are searched; after each, a query's bound is its (k+1)-th best score so far. Then

* a cell is sent a block of queries only if some query's length times the cell's greatest length reaches its bound;
* within a cell, a query stops at the first group of candidates whose greatest length cannot reach its bound;
* vectors are rotated by the right singular vectors of all candidates, so that few leading coordinates hold most of an inner
  product: a pair goes on only if its partial sum plus the product of the residual lengths (Cauchy-Schwarz) reaches the bound,
  first over a quarter, then over half of the coordinates;
* what is left is scored exactly. Bounds carry a slack for rounding, so nothing is lost: no cap, no approximation.

Equal vectors are one candidate with its k+1 smallest ids (more can never be among the k best, ties going to the smaller id),
and queries with equal vectors are answered once. A cell's task holds one cell and one block of queries at a time.

Defined cases: vectors that are null, hold a null or non-finite component, or whose squared length (of y) exceeds 2**62 (no
long would hold their scores) take no part; shorter vectors count as filled with zeros, an empty one scores 0. A query
excludes its own row only: other rows with its id are candidates, and a repeated query row is answered each time. Rows
without an id are candidates after all others of equal score. An empty table gives an empty result. Ids are whole numbers.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.vectors import matrix, sum_matrices, usable, whole

SCALE = 256
GROUP, QUERY_BLOCK = 1024, 256              # candidates and queries that are compared as one matrix product
CELL_BYTES, LEAST_CELL = 64 << 20, 2048     # candidates of a cell, as whole and rotated numbers
QUERIES_A_TASK = 1 << 16                    # beyond it the queries of a cell are searched by several tasks
_SLACK = 1e-9
_LONGEST = float(1 << 62)


def _best_rows(n: int, q, score, low, unknown) -> np.ndarray:
    """Indices of the n best entries of each q: largest score, then smallest low (unknown ones last)."""
    order = np.lexsort((low, unknown, -score, q))
    qs = q[order]
    first = np.searchsorted(qs, qs, "left")
    return order[np.arange(len(qs)) - first < n]


def _packed(dim: int, with_ids: bool):
    """Groups of rows (y, norm[, ids]) of a partition, in their order, as one row of bytes each."""
    size = GROUP if with_ids else QUERY_BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, count = TaskContext.get().partitionId(), 0, [], 0

        def made(t: pa.Table) -> pa.RecordBatch:
            nonlocal seq
            t = t.combine_chunks()
            y = matrix(t["y"].chunk(0), dim)
            row = {"part": [part], "seq": [seq], "n": [len(y)], "top": [float(np.sqrt((y.astype(float) ** 2).sum(axis=1)).max())],
                   "y": [y.tobytes()]}
            if with_ids:
                row["ids"] = [pa.array(t["ids"].to_pylist(), pa.list_(pa.int64())).to_pylist()]
            seq += 1
            out = pa.RecordBatch.from_pydict(row)
            return out.cast(_packed_schema(with_ids)) if with_ids else out

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            count += b.num_rows
            if count >= size:
                t = pa.concat_tables(held)
                whole_groups = count // size * size
                for a in range(0, whole_groups, size):
                    yield made(t.slice(a, size))
                held, count = [t.slice(whole_groups)], count - whole_groups
        if count:
            yield made(pa.concat_tables(held))
    return run


def _packed_schema(with_ids: bool) -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n", pa.int64()), ("top", pa.float64()), ("y", pa.binary()),
                      *([("ids", pa.list_(pa.list_(pa.int64())))] if with_ids else [])])


_PACKED_SQL = "part long, seq long, n long, top double, y binary"
_FOUND = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("pos", pa.int64()), ("length", pa.float64()), ("score", pa.int64()),
                    ("own", pa.bool_()), ("ids", pa.list_(pa.int64()))])
_FOUND_SQL = "part long, seq long, pos long, length double, score long, own boolean, ids array<long>"


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner product of a[i] and b[j] for each pair, a bounded number of pairs at a time. Sums of longs may wrap around on the
    way: the result fits one."""
    out, step = np.empty(len(i), a.dtype), max(1, (1 << 22) // max(1, a.shape[1]))
    for n in range(0, len(i), step):
        out[n:n + step] = (a[i[n:n + step]] * b[j[n:n + step]]).sum(axis=1)
    return out


class _Cell:
    """One cell's candidates, groups in falling order of length, with their rotated forms."""

    def __init__(self, rotation: np.ndarray, keep: int):
        self.rotation, self.keep, self.groups = rotation, keep, []
        dim = len(rotation)
        self.heads = sorted({h for h in (dim // 4, dim // 2) if 0 < h < dim})

    def add(self, y: np.ndarray, ids: list, top: float) -> None:
        low = np.array([i[0] if i[0] is not None else 0 for i in ids], np.int64)
        unknown = np.array([i[0] is None for i in ids], bool)
        self.groups.append((y, *self.rotated(y), low, unknown, ids, top))

    def rotated(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Rotated rows, their lengths, and the lengths of what lies beyond each head."""
        z = y.astype(float) @ self.rotation
        rest = lambda h: np.sqrt((z[:, h:] ** 2).sum(axis=1))
        return z, rest(0), [rest(h) for h in self.heads]

    def search(self, y: np.ndarray, bound: np.ndarray):
        """(query, score, own, ids, length) of each query's best candidates here that reach its bound."""
        z, length, rests = self.rotated(y)
        bound = bound.copy()
        q, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, unknown, at = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((0, 2), np.int64)
        for g, (cy, cz, clen, crests, clow, cunknown, _, top) in enumerate(self.groups):
            reach = length * top * (1 + _SLACK) + 1
            live = np.flatnonzero(reach >= bound)
            if not len(live):
                break               # every later group is shorter
            i = j = None
            done, total = 0, None
            for h, qrest, crest in zip(self.heads, rests, crests):
                slack = _SLACK * np.outer(length[live], clen) + 1 if i is None else _SLACK * length[i] * clen[j] + 1
                if i is None:       # all live pairs at once
                    total = z[live, :h] @ cz[:, :h].T
                    a, j = np.nonzero(total + np.outer(qrest[live], crest) + slack >= bound[live][:, None])
                    i, total = live[a], total[a, j]
                else:               # only the pairs left, one product each
                    total = total + _products(z[:, done:h], cz[:, done:h], i, j)
                    stay = total + qrest[i] * crest[j] + slack >= bound[i]
                    i, j, total = i[stay], j[stay], total[stay]
                done = h
            if i is None:
                i, j = np.repeat(live, len(cy)), np.tile(np.arange(len(cy)), len(live))
            s = _products(y, cy, i, j)
            stay = s.astype(float) * (1 + np.sign(s) * _SLACK) + 1 >= bound[i]
            q, score = np.append(q, i[stay]), np.append(score, s[stay])
            low, unknown = np.append(low, clow[j[stay]]), np.append(unknown, cunknown[j[stay]])
            at = np.concatenate([at, np.stack([np.full(stay.sum(), g), j[stay]], axis=1)])
            best = _best_rows(self.keep, q, score, low, unknown)
            q, score, low, unknown, at = q[best], score[best], low[best], unknown[best], at[best]
            ends = np.flatnonzero(np.append(q[1:] != q[:-1], True)) if len(q) else np.zeros(0, np.int64)
            counts = np.diff(np.append(-1, ends))
            full = ends[counts >= self.keep]        # the last of keep entries is the worst
            bound[q[full]] = np.maximum(bound[q[full]], score[full].astype(float))
        square = (y * y).sum(axis=1)
        own = np.array([score[n] == square[q[n]] and (self.groups[g][0][r] == y[q[n]]).all() for n, (g, r) in enumerate(at)], bool)
        return q, score, own, [self.groups[g][6][r] for g, r in at], length


def _search_cells(dim: int, rotation: np.ndarray, keep: int):
    """Streams (cell, queries) in order: a cell's groups come first, then the blocks of queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, None
        for b in batches:
            for r in b.to_pylist():
                y = np.frombuffer(r["y"], np.int64).reshape(r["n"], dim)
                if (r["cell"], r["task"]) != at:
                    at, cell = (r["cell"], r["task"]), _Cell(rotation, keep)
                if r["ids"] is not None:
                    cell.add(y, r["ids"], r["top"])
                    continue
                bound = np.full(len(y), -np.inf)
                for p, v in zip(r["known"] or [], r["bounds"] or []):
                    bound[p] = v
                q, score, own, ids, length = cell.search(y, bound)
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((
                        np.full(len(q), r["part"]), np.full(len(q), r["seq"]), q, length[q], score, own, ids), _FOUND)], schema=_FOUND)
    return run


def _unpack(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                y = np.frombuffer(r["y"], np.int64).reshape(r["n"], dim)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in (
                    ([r["part"]] * len(y), pa.int64()), ([r["seq"]] * len(y), pa.int64()), (range(len(y)), pa.int64()),
                    (y.tolist(), pa.list_(pa.int64())))], names=["part", "seq", "pos", "y"])
    return run


def top_products(df: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
                 cell_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest integer inner products of each row that ``queries`` chooses with all
    other rows, ties to the smaller id. ``cell_rows`` sets the size of a cell; any value gives the same rows."""
    spark = df.sparkSession
    keep = k + 1
    y = whole(F.col(vector_col), SCALE)
    square = F.aggregate(F.col("y"), F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    rows = df.where(usable(F.col(vector_col), SCALE)).select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), y.alias("y")) \
        .withColumn("norm", F.sqrt(square)).where(F.col("norm") * F.col("norm") <= _LONGEST)

    # one row for each distinct vector, with its smallest ids
    by_id = Window.partitionBy("y").orderBy(F.col("id").asc_nulls_last())
    classes = (rows.select("y", "norm", "id").withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= keep)
               .groupBy("y").agg(F.first("norm").alias("norm"), F.sort_array(F.collect_list(F.struct("place", "id"))).alias("ids"))
               .select("y", "norm", F.transform("ids", lambda s: s["id"]).alias("ids"))).checkpoint(eager=True)
    stats = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("y")).alias("dim")).collect()[0]
    asked = rows.where("asks").select("y").distinct().checkpoint(eager=True)
    n_asked = asked.count()
    out_schema = "query_id long, rank int, vec_id long, score long"
    if not stats["n"] or not n_asked:
        return spark.createDataFrame([], out_schema)
    dim = max(1, stats["dim"])

    def products(b: pa.RecordBatch) -> np.ndarray:
        m = matrix(b.column(0), dim).astype(float)
        return m.T @ m
    rotation = np.linalg.svd(sum_matrices(classes.select("y"), products, (dim, dim)))[0]

    most = max(LEAST_CELL, CELL_BYTES // (16 * dim))
    per_cell = cell_rows or min(most, max(LEAST_CELL, stats["n"] // (4 * spark.sparkContext.defaultParallelism)))
    cells = classes.repartitionByRange(-(-stats["n"] // per_cell), F.desc("norm"), F.xxhash64("y")) \
        .sortWithinPartitions(F.desc("norm")).select("y", "ids") \
        .mapInArrow(_packed(dim, True), f"{_PACKED_SQL}, ids array<array<long>>").checkpoint(eager=True)
    tasks = -(-n_asked // QUERIES_A_TASK)
    blocks = asked.repartition(tasks).mapInArrow(_packed(dim, False), _PACKED_SQL).checkpoint(eager=True)
    n_cells = cells.agg(F.max("part")).collect()[0][0] + 1
    tops = cells.groupBy(F.col("part").alias("cell")).agg(F.max("top").alias("cell_top"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None)
    by_score = Window.partitionBy("part", "seq", "pos").orderBy(F.desc("score"), F.col("ids")[0].asc_nulls_last())
    best, first = None, 0
    while first < n_cells:
        last = min(n_cells, 2 * first + 1)      # waves of 1, 2, 4, ... cells
        search = blocks.withColumnRenamed("n", "asked")
        if best is None:
            search = search.withColumns({"reach": none.cast("double"), "known": none.cast("array<long>"), "bounds": none.cast("array<double>")})
        else:
            bounds = (best.groupBy("part", "seq", "pos").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("v"),
                                                              F.first("length").alias("length")).where(F.col("c") == keep))
            # the shortest candidate that can still matter to any query of the block
            least = F.when(F.col("length") > 0, F.col("v") / F.col("length")).when(F.col("v") <= 0, float("-inf")).otherwise(float("inf"))
            bounds = bounds.groupBy("part", "seq").agg(
                F.min(least).alias("least"), F.count(F.lit(1)).alias("c"), F.collect_list(F.struct("pos", "v")).alias("b"))
            search = search.join(bounds, ["part", "seq"], "left").select(
                "part", "seq", "asked", "top", "y", F.when(F.col("c") == F.col("asked"), F.col("least")).alias("reach"),
                F.col("b.pos").alias("known"), F.transform(F.col("b.v"), lambda v: v.cast("double")).alias("bounds"))
        search = search.withColumn("cell", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last - 1).cast("long")))).join(tops, "cell")
        search = search.where(F.col("reach").isNull() | (F.col("cell_top") * (1 + 1e-6) >= F.col("reach"))).select(
            "cell", F.col("part").alias("task"), F.lit(1).alias("kind"), "part", "seq", F.col("asked").alias("n"), "top", "y",
            none.cast("array<array<long>>").alias("ids"), "known", "bounds")
        groups = cells.where((F.col("part") >= first) & (F.col("part") < last)).select(
            F.col("part").alias("cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))).alias("task"),
            F.lit(0).alias("kind"), "part", "seq", "n", "top", "y", "ids", none.cast("array<long>").alias("known"),
            none.cast("array<double>").alias("bounds"))
        found = (groups.unionByName(search).repartition(parts, "cell", "task").sortWithinPartitions("cell", "task", "kind", "seq")
                 .mapInArrow(_search_cells(dim, rotation, keep), _FOUND_SQL))
        found = found if best is None else found.unionByName(best)
        best = found.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= keep).drop("place").checkpoint(eager=True)
        first = last

    # the k+1 best rows of each distinct query vector; each query row then leaves itself out
    at = ["part", "seq", "pos"]
    by_row = Window.partitionBy(*at).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    lists = (best.select(*at, "score", "own", F.explode("ids").alias("vec_id")).withColumn("place", F.row_number().over(by_row))
             .where(F.col("place") <= keep).groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", "own"))).alias("top")))
    answers = blocks.mapInArrow(_unpack(dim), "part long, seq long, pos long, y array<long>").join(lists, at)
    padded = F.when(F.size("y") == dim, F.col("y")).otherwise(F.concat("y", F.array_repeat(F.lit(0).cast("long"), dim - F.size("y"))))
    asks = rows.where("asks").select(F.col("id").alias("query_id"), padded.alias("y"))
    out = asks.join(answers.select("y", "top").dropDuplicates(["y"]), "y")
    itself = F.array_position(F.transform("top", lambda t: t["own"] & t["vec_id"].eqNullSafe(F.col("query_id"))), True)
    out = out.withColumn("itself", itself - 1)
    others = F.slice(F.filter("top", lambda t, i: i != F.col("itself")), 1, k)
    return out.select("query_id", F.posexplode(others).alias("i", "t")).select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))
