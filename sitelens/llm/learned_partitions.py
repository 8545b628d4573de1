"""Approximate nearest neighbours by learned partitions.

1. A bounded sample of vectors (``sample`` rows, a parameter) makes an exact neighbour graph; the graph is cut into
   balanced parts (median splits along principal directions, then capacity-bound moves towards the neighbours' part).
2. A small classifier (one hidden layer) learns each vector's part, with its neighbours' parts as soft targets.
3. Every row is indexed under its most probable part; a query goes to its most probable parts, as many as the sample
   needs for a recall of ``target_recall``, and all rows there are ranked by their exact inner product in double precision.

Parts are searched in blocks of bounded size, of rows and of queries alike, so neither a part with a third of all rows
nor one that all queries go to lands in one task. A block returns at most its ``k + 1`` best rows per query, and of
these only the ones that reach the query's (k + 1)-th best score among the sample's rows in the parts it goes to; a query
whose parts hold no ``k + 1`` rows goes to further ones. So a list is short only if the table is. Equal vectors are one
class: it is indexed once, with its ``k + 1`` smallest ids (more can never be among the k nearest, ties going to the
smaller id), and queries with equal vectors are answered once.

Vectors that are null, empty, all zero, hold a null or non-finite component, or differ in length from the most common
one, take no part, and neither do rows without an id. Repeated ids count once (the smallest vector).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, ROWS_PER_PART, MAX_PARTS, BLOCK = 8192, 1500, 128, 4096


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest (largest inner product) other rows of each row."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a:a + 1024] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        out[a:a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """Part of each row: near-equal sizes, few neighbour pairs cut."""
    part = np.zeros(len(x), np.int64)
    todo, made = [(np.arange(len(x)), parts)], 0
    while todo:     # split along the principal direction, in proportion to the parts wanted on either side
        rows, n = todo.pop()
        if n == 1:
            part[rows] = made
            made += 1
            continue
        y = x[rows] - x[rows].mean(axis=0)
        v = np.linalg.eigh(y.T @ y)[1][:, -1]
        order, cut = np.argsort(y @ v, kind="stable"), len(rows) * (n // 2) // n
        todo += [(rows[order[:cut]], n // 2), (rows[order[cut:]], n - n // 2)]
    cap = int(np.ceil(1.1 * len(x) / parts))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (np.arange(len(x))[:, None], part[near]), 1)
        np.add.at(votes, (near, np.broadcast_to(part[:, None], near.shape)), 1)
        want = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), want] - votes[np.arange(len(x)), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < cap:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """Classifier of vectors into parts."""
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x * self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def top(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def fit_router(x: np.ndarray, parts: int, k: int, target_recall: float, seed: int = 7) -> Router:
    """Graph, partition, classifier, and the number of parts a query has to visit."""
    dim, rnd = x.shape[1], np.random.default_rng(seed)
    scale = float(np.sqrt(dim) / max(1e-300, np.sqrt((x * x).sum(axis=1)).mean()))
    if parts == 1 or len(x) < 4 * parts:
        return Router(scale, np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    near = neighbour_graph(x, min(10, len(x) - 1))
    part = balanced_parts(x * scale, near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x))[:, None], part[near]), 0.5 / near.shape[1])
    target[np.arange(len(x)), part] += 0.5
    h = 128
    p = [rnd.normal(0, dim ** -0.5, (dim, h)), np.zeros(h), rnd.normal(0, h ** -0.5, (h, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = x * scale
    for _ in range(30):     # Adam on the soft cross entropy
        for b in np.array_split(rnd.permutation(len(z)), max(1, len(z) // 256)):
            a = np.maximum(z[b] @ p[0] + p[1], 0)
            o = a @ p[2] + p[3]
            o = np.exp(o - o.max(axis=1, keepdims=True))
            d = (o / o.sum(axis=1, keepdims=True) - target[b]) / len(b)
            da = (d @ p[2].T) * (a > 0)
            t += 1
            for i, g in enumerate((z[b].T @ da, da.sum(axis=0), a.T @ d, d.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= 0.003 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    r = Router(scale, *p)
    # probes: share of the sample's true neighbours whose part is among the first n
    order = np.argsort(-r.logits(x), axis=1, kind="stable")
    place = np.empty_like(order)
    place[np.arange(len(x))[:, None], order] = np.arange(parts)[None, :]
    true = neighbour_graph(x, min(k, len(x) - 1))
    rank = place[np.arange(len(x))[:, None], order[true, 0]]
    found = np.cumsum(np.bincount(rank.ravel(), minlength=parts)) / rank.size
    r.probes = int(min(parts, np.searchsorted(found, target_recall) + 1))
    return r


def _bound(q: np.ndarray, seen: np.ndarray, home: np.ndarray, goes: np.ndarray, k: int) -> np.ndarray:
    """A score that the k nearest other rows of the parts a query goes to (``goes``: query by part) certainly reach: the
    (k + 1)-th best of the sample's rows there (one may be the row itself), -inf if there are fewer."""
    if len(seen) <= k:
        return np.full(len(q), -np.inf)
    s = q @ seen.T
    s[~goes[:, home]] = -np.inf
    s.partition(len(seen) - k - 1, axis=1)
    # less what a sum in another order can differ by
    slack = 4 * q.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(seen, axis=1).max()
    return s[:, len(seen) - k - 1] - slack


def _matrix(col: pa.ListArray, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20,
            sample: int = SAMPLE, rows_per_part: int = ROWS_PER_PART, target_recall: float = 0.98,
            probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row for which ``is_query`` (an expression
    over ``vec_id``) holds, itself excluded."""
    v = F.col("v")
    rows = (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & (F.size("v") > 0)
                   & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                   & F.exists(v, lambda x: x != 0)))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return df.sparkSession.createDataFrame([], schema)
    dim = int(sizes.n)
    rows = rows.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    # classes of equal vectors; a hot one is cut to its k + 1 smallest ids per task before the shuffle
    low = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(low)).where(F.col("n") <= k + 1)
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members")) \
        .withColumn("cls", F.col("members")[0]).checkpoint(True)
    queries = rows.where(is_query).join(classes.select("v", "cls"), "v").select(F.col("vec_id").alias("query_id"), "cls")
    queries = queries.checkpoint(True)
    n = classes.count()
    parts = int(np.clip(n // rows_per_part, 1, min(MAX_PARTS, sample // 32)))
    picked = classes.orderBy(F.xxhash64("cls"), "cls").select("v").limit(sample).collect()   # bounded by `sample`
    seen = np.array([r.v for r in picked], float)
    router = fit_router(seen, parts, k, target_recall)
    visits = probes or router.probes
    # the sample's rows and their parts; a row between two parts may be indexed under either and sets no bound
    logits = np.sort(router.logits(seen), axis=1)
    clear = logits[:, -1] - logits[:, -2] > 1e-9 * (1 + np.abs(logits[:, -1])) if logits.shape[1] > 1 else np.full(len(seen), True)
    seen = seen[clear]
    home = router.top(seen, 1)[:, 0]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            top = router.top(_matrix(b.column(1), dim), 1)[:, 0]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(top, pa.int32())], ["cls", "v", "part"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b.column(1), dim)
            top = router.top(q, held.size)
            # parts in order until they hold k + 1 rows, and at least `visits` of them
            enough = (np.cumsum(held[top], axis=1) <= k).sum(axis=1) + 1
            take, place = np.nonzero(np.arange(held.size) < np.maximum(enough, visits)[:, None])
            goes = np.zeros(top.shape, bool)
            goes[take, top[take, place]] = True
            bound = np.concatenate([_bound(q[a:a + 512], seen, home, goes[a:a + 512], k) for a in range(0, len(q), 512)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take)), b.column(1).take(pa.array(take)),
                                              pa.array(top[take, place], pa.int32()), pa.array(bound[take])], ["cls", "v", "part", "bound"])

    kept = classes.select("cls", "v")
    asked = kept.join(queries.select("cls").distinct(), "cls", "left_semi")
    indexed = kept.mapInArrow(index, "cls long, v array<double>, part int")
    count_i = {r.part: r["count"] for r in indexed.groupBy("part").count().collect()}   # at most MAX_PARTS counts
    held = np.array([count_i.get(p, 0) for p in range(logits.shape[1])])
    routed = asked.mapInArrow(route, "cls long, v array<double>, part int, bound double")
    # blocks per part
    count_q = {r.part: r["count"] for r in routed.groupBy("part").count().collect()}
    plan = [(p, -(-c // block), -(-count_q[p] // block)) for p, c in count_i.items() if p in count_q]
    if not plan:
        return df.sparkSession.createDataFrame([], schema)
    sizes = df.sparkSession.createDataFrame(plan, "part int, ib int, qb int")

    def salted(side: DataFrame, mine: str, other: str) -> DataFrame:
        """Rows with their own block number, once for each block of the other side."""
        j = side.join(F.broadcast(sizes), "part")
        return j.select(*side.columns, F.pmod(F.xxhash64("cls"), F.col(mine)).cast("int").alias(mine),
                        F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            ids = left.column("cls").to_numpy()
            x, q = (_matrix(t.column("v").combine_chunks(), dim) for t in (left, right))
            qid, bound, parts_ = right.column("cls").to_numpy(), right.column("bound").to_numpy(), ([], [], [])
            top = min(len(x), k + 9)
            for a in range(0, len(q), 512):
                s = q[a:a + 512] @ x.T
                best = np.argpartition(-s, top - 1, axis=1)[:, :top]
                exact = (q[a:a + 512][:, None, :] * x[best]).sum(axis=2)    # a sum that depends on the two vectors only
                order = np.lexsort((ids[best], -exact), axis=1)[:, :k + 1]
                score = np.take_along_axis(exact, order, 1)
                good = ~(score < bound[a:a + 512, None])
                parts_[0].append(np.broadcast_to(qid[a:a + 512, None], good.shape)[good])
                parts_[1].append(np.take_along_axis(ids[best], order, 1)[good])
                parts_[2].append(score[good])
            out = [np.concatenate(p) for p in parts_]
        return pa.table({"q": pa.array(out[0], pa.int64()), "cls": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    keys = ["part", "ib", "qb"]
    found = (salted(indexed, "ib", "qb").groupBy(*keys).cogroup(salted(routed, "qb", "ib").groupBy(*keys))
             .applyInArrow(search, "q long, cls long, score double"))
    by_class = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    found = found.withColumn("n", F.row_number().over(by_class)).where(F.col("n") <= k + 1)
    members = found.join(classes.select("cls", "members"), "cls").select("q", "score", F.explode("members").alias("vec_id"))
    by_row = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    members = members.withColumn("n", F.row_number().over(by_row)).where(F.col("n") <= k + 1).drop("n")
    # own row out; at most k + 1 rows per query, so positions can be closed up without another window
    lists = members.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("l"))
    answers = queries.join(lists, queries.cls == lists.q).select(
        "query_id", F.slice(F.filter("l", lambda e: e["vec_id"] != F.col("query_id")), 1, k).alias("l"))
    return answers.select("query_id", F.posexplode("l").alias("pos", "e")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.s")).alias("score"))
