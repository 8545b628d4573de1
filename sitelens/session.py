"""Spark session helper and shared-storage scratch locations.

Iterative jobs (crawl levels, redirect hops) cut lineage by writing each level
to the folder named by ``spark.checkpoint.dir``. On a cluster that setting
points at shared storage; it is read from the session and only filled in with
a local folder when it is unset (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"
_PARTITIONS_KEY = "spark.sql.shuffle.partitions"


def _default_driver_memory() -> str:
    """Local mode runs everything in the driver JVM: 60% of physical memory, 2-16 GiB."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "8g"
    gib = int(total * 0.6) >> 30
    return f"{max(2, min(16, gib))}g"


def get_spark(master: str | None = None, partitions: int | None = None,
              app: str = "sitelens") -> SparkSession:
    """Session with UTC time, AQE (coalescing + skew join) and no UI."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    partitions = partitions or int(cpus) * 2
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SITELENS_DRIVER_MEM", _default_driver_memory()))
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    event_dir = os.environ.get("SITELENS_EVENT_LOG")
    if event_dir:  # stage/task timings for profiling, written to a scratch folder
        builder = (builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_dir)
                   .config("spark.eventLog.compress", "false"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per SparkContext).

    UDFs are pickled by reference to their module, so workers must be able to
    import ``sitelens``; ``addPyFile`` distributes a zip of it with the job.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="sitelens-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get(_CKPT_KEY, None) \
        or sc.getConf().get(_CKPT_KEY, None)
    if not current:
        master = sc.master or ""
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: iterative jobs "
                               "(crawl levels, redirect hops) write their state there")
        current = tempfile.mkdtemp(prefix="sitelens-ckpt-")   # local mode only (tests)
        spark.conf.set(_CKPT_KEY, current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/sitelens/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffle_partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """Jobs started inside are planned with ``n`` shuffle partitions (such as the buckets of the tables they join)."""
    before = spark.conf.get(_PARTITIONS_KEY)
    spark.conf.set(_PARTITIONS_KEY, str(n))
    try:
        yield
    finally:
        spark.conf.set(_PARTITIONS_KEY, before)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, by the file system that Spark uses for it (other errors are raised)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of this library's own, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def modified_at(spark: SparkSession, path: str) -> int:
    """When a file was last written, in milliseconds."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime())


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]


def spread(df, min_partitions: int | None = None):
    """Round-robin the rows over at least ``defaultParallelism`` tasks when the
    scan yields fewer partitions (e.g. a single-row-group file feeding CPU-heavy
    per-row work). A large input already has many splits and is left alone,
    so no shuffle is added there."""
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)
