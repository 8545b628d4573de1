"""Bucketed Parquet tables on shared storage, and a seen-set made of them.

A bucketed table keeps its hash partitioning on disk: joins on the bucket columns read it bucket by bucket, without an
exchange, and whether or not the plan is adaptive. The session's catalog only holds the bucket layout; a folder is put
into it again with ``open_bucketed`` (by another driver, say).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sitelens.session import delete_path


ROWS_A_BUCKET = 100_000


def buckets_for(spark: SparkSession, rows: int = 0) -> int:
    """Buckets of tables that will hold ``rows`` rows: a task for every core, more only where a bucket would get large. Each of many
    small jobs starts a task and opens a file a bucket, so their number follows the rows; the shuffle partitions are its limit."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(spark.sparkContext.defaultParallelism, 1 + rows // ROWS_A_BUCKET))


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> tuple[DataFrame, int]:
    """Write ``df`` to ``path``; returns the table and its number of rows, counted while it was written."""
    spark = df.sparkSession
    delete_path(spark, path)        # what a killed driver may have left there
    name, seen = f"sitelens_{uuid.uuid4().hex}", Observation()
    (df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(name))
    return spark.table(name), int(seen.get["n"])


def open_bucketed(spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """The table that ``write_bucketed`` wrote to ``path``."""
    name, by = f"sitelens_{uuid.uuid4().hex}", ", ".join(keys)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


class Run(NamedTuple):
    size: int           # size class
    rows: int
    path: str
    table: DataFrame


class TieredTable:
    """Rows with distinct ``unique`` columns, as a size-tiered set of disjoint tables bucketed by ``keys``.

    Every addition is a table of its own. When ``FAN_IN`` tables of one size class are there, they are merged into one of the next
    class; they lie in the same buckets, so merging exchanges nothing. A row is rewritten once a class, so the bytes
    written grow as n log n, and a lookup joins with at most FAN_IN - 1 tables a class.
    """

    FAN_IN = 4

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str], buckets: int, unique: Sequence[str] | None = None):
        self.spark, self.folder, self.schema, self.buckets = spark, folder, schema, buckets
        self.keys, self.unique = list(keys), list(unique or keys)
        self.columns = [c.split()[0] for c in schema.split(", ")]
        self.runs: list[Run] = []

    def _class(self, rows: int) -> int:
        return len(f"{rows - 1:b}") // 2 if rows > 1024 else 0     # powers of four; all small tables are one class

    def _path(self) -> str:
        return f"{self.folder}/run-{uuid.uuid4().hex}"

    def write(self, df: DataFrame) -> tuple[DataFrame, int]:
        """Write rows that are not in the table yet and add them; returns them and their number."""
        path = self._path()
        table, rows = write_bucketed(df.select(*self.columns), path, self.keys, self.buckets)
        self.add(table, rows, path)
        return table, rows

    def add(self, table: DataFrame, rows: int, path: str = "") -> None:
        """Add a table written with ``write_bucketed`` whose rows are not in this one."""
        if not rows:
            return
        self.runs.append(Run(self._class(rows), rows, path, table.select(*self.columns)))
        while True:
            level = next((r.size for r in self.runs if sum(o.size == r.size for o in self.runs) >= self.FAN_IN), None)
            if level is None:
                return
            both, *rest = [r.table for r in self.runs if r.size == level]
            for t in rest:
                both = both.unionByName(t)
            to = self._path()
            merged, n = write_bucketed(both.dropDuplicates(self.unique), to, self.keys, self.buckets)
            self.runs = [r for r in self.runs if r.size != level] + [Run(max(level + 1, self._class(n)), n, to, merged)]

    def load(self, df: DataFrame) -> None:
        """Add rows that are not bucketed yet (one exchange), such as those of a stored crawl."""
        self.write(df.select(*self.columns).dropDuplicates(self.unique))

    def without(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose keys are not here: only ``df`` is exchanged. Merge joins read the buckets in place; to
        broadcast each of several small tables would cost a job each."""
        for r in self.runs:
            df = df.join(r.table.hint("merge"), self.keys, "left_anti")
        return df

    def lookup(self, df: DataFrame) -> DataFrame:
        """``df`` joined with the rows of the same keys: only ``df`` is exchanged."""
        out = None
        for r in self.runs:
            part = df.join(r.table.hint("merge"), self.keys)
            out = part if out is None else out.unionByName(part)
        return df.join(self.spark.createDataFrame([], self.schema), self.keys) if out is None else out

    def all(self) -> DataFrame:
        out = self.spark.createDataFrame([], self.schema)
        for r in self.runs:
            out = out.unionByName(r.table)
        return out

    def manifest(self) -> list[tuple[int, int, str]]:
        return [(r.size, r.rows, r.path) for r in self.runs]

    def restore(self, manifest: Sequence[tuple[int, int, str]]) -> None:
        self.runs = [Run(size, rows, path, open_bucketed(self.spark, path, self.schema, self.keys, self.buckets)) for size, rows, path in manifest]


class SeenSet(TieredTable):
    """Keys seen so far."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], buckets: int):
        super().__init__(spark, folder, ", ".join(f"{k} string" for k in keys), keys, buckets)
