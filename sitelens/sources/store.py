"""Content-addressed body store (S3 sink, S4 read).

Table ``(prefix, hash, body, batch)`` partitioned by ``prefix = substr(hash, 1, 2)`` and ``batch`` (the save that added the row); one
row per hash, files sorted by hash.

* Saving is decided on hashes alone: the winners are the distinct hashes less the stored ones (columns of 64 characters on both
  sides). Then bodies move once, to the (prefix, salt) they are written at; stored bodies are never read. The number of
  salts follows from the bytes to be written, so a file holds about ``FILE_BYTES``.
* Loading reads only the prefixes that the keys have (at most 256 values), and skips row groups by hash where keys are few.
* ``compact_store`` rewrites prefixes that many saves have left small files in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.content import content_hash
from sitelens.session import delete_path, list_folders, path_exists

FILE_BYTES = 128 << 20
FEW_KEYS = 1000         # keys that are put into the scan's filter one by one
STORED = "hash string, body binary, prefix string, batch string"


def _all(spark: SparkSession, store: str) -> DataFrame | None:
    return spark.read.schema(STORED).parquet(store) if path_exists(spark, store) else None


def read_store(spark: SparkSession, store: str) -> DataFrame | None:
    """The stored rows; None if nothing has been stored yet (any other error is raised). While a compaction is under way, either
    what it replaces or what it has written so far is left out, so each hash is there once."""
    rows = _all(spark, store)
    if rows is None:
        return None
    if path_exists(spark, f"{store}/_replaced/_SUCCESS"):
        return rows.join(spark.read.schema("prefix string, batch string").parquet(f"{store}/_replaced"), ["prefix", "batch"], "left_anti")
    if path_exists(spark, f"{store}/_pending/_SUCCESS"):
        return rows.join(spark.read.schema("batch string").parquet(f"{store}/_pending"), "batch", "left_anti")
    return rows


def _salted(prefix: Column, hash_: Column, salts: int) -> Column:
    """Where a hash is written: a number below 256 * salts, equal prefixes side by side."""
    at = F.conv(prefix, 16, 10).cast("int") * salts
    return at if salts == 1 else at + F.pmod(F.xxhash64(hash_), F.lit(salts)).cast("int")


def _write(rows: DataFrame, store: str, batch: str, total: int) -> None:
    """Append (hash, body), each hash once, in files of about FILE_BYTES and at most one a prefix beyond that."""
    salts = max(1, -(-total // (256 * FILE_BYTES)))
    tasks = max(1, min(256 * salts, -(-total // FILE_BYTES)))       # a small save is written by few tasks
    place = rows.withColumn("prefix", F.substring("hash", 1, 2)).withColumn("_at", _salted(F.col("prefix"), F.col("hash"), salts))
    place = place.withColumn("_task", F.floor(F.col("_at") * tasks / (256 * salts)).cast("int"))
    (place.repartition(tasks, "_task").dropDuplicates(["_task", "hash"]).withColumn("batch", F.lit(batch))
     .sortWithinPartitions("prefix", "batch", "hash").select("hash", "body", "prefix", "batch")
     .write.mode("append").partitionBy("prefix", "batch").parquet(store))


def winners(responses: DataFrame, store: str) -> DataFrame:
    """hash, n_bytes of the bodies that are not stored yet: no body is read for it from the store, none is exchanged."""
    slim = responses.select("hash", F.length("body").cast("long").alias("n_bytes")).groupBy("hash").agg(F.max("n_bytes").alias("n_bytes"))
    stored = read_store(responses.sparkSession, store)
    return slim if stored is None else slim.join(stored.select("hash"), "hash", "left_anti")


def save_content(responses: DataFrame, store: str) -> DataFrame:
    """S3: store bodies of 2xx responses not yet stored; returns the rows added.

    ``responses`` needs status and body (hash is computed when absent). Each
    call appends under its own ``batch`` id, so the rows it added are read back
    from the store itself: every body is written once, and what is returned
    does not change when later calls add more.
    """
    spark = responses.sparkSession
    r = responses.where(F.col("status").between(200, 299) & F.col("body").isNotNull())
    if "hash" not in r.columns:
        r = r.withColumn("hash", content_hash(F.col("body")))
    new = winners(r, store).checkpoint(eager=True)
    total = new.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    batch = uuid.uuid4().hex
    _write(r.select("hash", "body").join(new.select("hash"), "hash", "left_semi"), store, batch, int(total))
    return spark.read.schema(STORED).parquet(store).where(F.col("batch") == batch).select("hash", "body")


def load_content(keys: DataFrame, store: str, hash_col: str = "hash") -> DataFrame:
    """``keys`` with the stored ``body`` (null when the hash is not stored).

    Two small questions about the keys decide what is read: which prefixes they have (at most 256), and, where they are at
    most ``FEW_KEYS``, which hashes: both go into the scan as filters on partitions and row groups.
    """
    spark = keys.sparkSession
    st = read_store(spark, store)
    if st is None:
        return keys.withColumn("body", F.lit(None).cast("binary"))
    wanted = keys.select(F.col(hash_col).alias("h")).where("h is not null")
    prefixes = [r.p for r in wanted.select(F.substring("h", 1, 2).alias("p")).distinct().collect()]
    few = [r.h for r in wanted.distinct().limit(FEW_KEYS + 1).collect()]
    st = st.where(F.col("prefix").isin(prefixes))
    if len(few) <= FEW_KEYS:
        st = st.where(F.col("hash").isin(few))
    s = st.select(F.col("hash").alias("_h"), "body")
    return keys.join(s, keys[hash_col] == F.col("_h"), "left").drop("_h")


def compact_store(spark: SparkSession, store: str, most: int = 8) -> int:
    """Rewrite the prefixes that more than ``most`` saves have files in as one batch; returns how many there were.

    The new batch is announced as pending, then appended; then the replaced (prefix, batch) pairs are committed to a list, which
    takes the announcement's place; then their files go. A run that is stopped anywhere leaves a store that reads the same,
    and the next one goes on from there.
    """
    _finish_compaction(spark, store)
    rows = read_store(spark, store)
    if rows is None:
        return 0
    held = rows.select("prefix", "batch").distinct()
    many = held.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("prefix")
    old = sorted((r["prefix"], r["batch"]) for r in held.join(many, "prefix", "left_semi").collect())      # names of folders
    if not old:
        return 0
    prefixes = sorted({p for p, _ in old})
    mine = rows.where(F.col("prefix").isin(prefixes))
    total = mine.agg(F.sum(F.length("body"))).first()[0]
    batch = uuid.uuid4().hex
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{store}/_pending")
    _write(mine.select("hash", "body"), store, batch, int(total))
    spark.createDataFrame(old, "prefix string, batch string").coalesce(1).write.mode("overwrite").parquet(f"{store}/_replaced")
    _finish_compaction(spark, store)
    return len(prefixes)


def _finish_compaction(spark: SparkSession, store: str) -> None:
    """Clear up after a compaction: a committed one loses its old files, one that was stopped before loses its new ones."""
    if path_exists(spark, f"{store}/_replaced/_SUCCESS"):
        for r in spark.read.schema("prefix string, batch string").parquet(f"{store}/_replaced").collect():
            delete_path(spark, f"{store}/prefix={r['prefix']}/batch={r['batch']}")
    elif path_exists(spark, f"{store}/_pending/_SUCCESS"):
        batch = spark.read.schema("batch string").parquet(f"{store}/_pending").first()["batch"]
        for p in list_folders(spark, store):
            if p.startswith("prefix="):
                delete_path(spark, f"{store}/{p}/batch={batch}")
    for name in ("_pending", "_replaced"):
        delete_path(spark, f"{store}/{name}")
