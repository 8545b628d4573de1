"""Change sets between two snapshots.

A snapshot is any DataFrame with ``ord`` (position in its report), ``url`` and
``hash``; ``last_modified`` is optional. Duplicate urls are allowed: lookups
are last-wins by ``ord``, output is one row per input row.

Plan shape: the old side is reduced to one row per url with ``max_by`` (partial
aggregation before the shuffle, so a url repeated a million times costs one
row per task), the new side is hash-joined against it; removed rows are an
anti join against the distinct new urls. Nulls are matched null-safely via a
non-null join key, so every join stays a plain equi-join whose partitioning
can be reused; AQE splits skewed partitions of the streamed side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Join key standing for a null url; a parsed URL never contains U+0000.
_NULL_URL = "\u0000"

CHANGE_TYPES = ("added", "modified", "removed")


def _key(url: Column, by: Sequence[str] = ()) -> Column:
    """Join key of a url, within the report that the ``by`` columns name."""
    key = F.coalesce(url, F.lit(_NULL_URL))
    # lengths keep (ab, c) and (a, bc) apart
    return key if not by else F.concat(*[x for c in by for x in (
        F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string"), F.lit(":"),
        F.coalesce(F.col(c).cast("string"), F.lit(_NULL_URL)))], key)


def _side(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    cols = [*by, "ord", "url", "hash"]
    lm = F.col("last_modified") if "last_modified" in df.columns else F.lit(None).cast("string")
    return df.select(*cols, lm.alias("last_modified")).withColumn("ukey", _key(F.col("url"), by))


def last_by_url(assets: DataFrame, columns: list[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row per url (null url is one group), the row with the largest ``ord``; with ``by`` (such as crawl_id), per url
    and report."""
    columns = columns or [c for c in assets.columns if c not in ("ord",)]
    payload = F.struct(F.col("ord"), *[F.col(c) for c in columns if c != "ord"])
    return (assets.groupBy(_key(F.col("url"), by).alias("ukey"))
            .agg(F.max_by(payload, F.col("ord")).alias("last"))
            .select("ukey", "last.*"))


def diff_snapshots(old: DataFrame, new: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Change set with one row per added/modified new row and per removed old row.

    With ``by`` (such as crawl_id) both sides hold many reports: each is compared with the one of the same name, and the
    columns are returned first; ``ord`` need only be a position within its own report.

    Columns: change_type, url, section (0 = walk of new, 1 = walk of old), ord
    (position in the walked snapshot), old_url, old_ord, old_hash,
    old_last_modified, new_url, new_ord, new_hash, new_last_modified.
    Sorting by (section, ord) gives the reference's output order.
    """
    o = _side(old, by)
    n = _side(new, by)
    last_old = last_by_url(o, ["url", "hash", "last_modified"], by)
    last_old = last_old.select(
        "ukey",
        F.col("ord").alias("old_ord"), F.col("url").alias("old_url"),
        F.col("hash").alias("old_hash"), F.col("last_modified").alias("old_last_modified"))

    joined = n.join(last_old, "ukey", "left")
    matched = F.col("old_ord").isNotNull()
    new_side = (joined
                .where(~matched | ~F.col("hash").eqNullSafe(F.col("old_hash")))
                .select(
                    *by, F.when(matched, F.lit("modified")).otherwise(F.lit("added")).alias("change_type"),
                    F.col("url"),
                    F.lit(0).alias("section"),
                    F.col("ord"),
                    F.when(matched, F.col("old_url")).alias("old_url"),
                    F.col("old_ord"), F.col("old_hash"), F.col("old_last_modified"),
                    F.col("url").alias("new_url"), F.col("ord").alias("new_ord"),
                    F.col("hash").alias("new_hash"),
                    F.col("last_modified").alias("new_last_modified")))

    new_keys = n.select("ukey").distinct()
    removed = (o.join(new_keys, "ukey", "left_anti")
               .select(
                   *by, F.lit("removed").alias("change_type"),
                   F.col("url"),
                   F.lit(1).alias("section"),
                   F.col("ord"),
                   F.col("url").alias("old_url"), F.col("ord").alias("old_ord"),
                   F.col("hash").alias("old_hash"),
                   F.col("last_modified").alias("old_last_modified"),
                   F.lit(None).cast("string").alias("new_url"),
                   F.lit(None).cast("long").alias("new_ord"),
                   F.lit(None).cast("string").alias("new_hash"),
                   F.lit(None).cast("string").alias("new_last_modified")))
    return new_side.unionByName(removed)


def change_listing(changes: DataFrame) -> DataFrame:
    """Url, change_type, last_modified as the listing shows them.

    Added and modified show the new row's url and date, removed the old url
    and an empty date; a missing value shows as the empty string.
    """
    removed = F.col("change_type") == "removed"
    return changes.select(
        F.coalesce(F.when(removed, F.col("old_url")).otherwise(F.col("new_url")), F.lit("")).alias("url"),
        F.col("change_type"),
        F.when(removed, F.lit("")).otherwise(F.coalesce(F.col("new_last_modified"), F.lit(""))).alias("last_modified"),
        F.col("section"), F.col("ord"))


def change_summary(changes: DataFrame) -> DataFrame:
    """One row per change type with its count (zero when absent).

    All three counts zero is the "no differences" answer. The counts have at
    most three rows (one per change type), so broadcasting them is bounded.
    """
    spark = changes.sparkSession
    types = spark.createDataFrame([(t,) for t in CHANGE_TYPES], "change_type string")
    counts = changes.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))
    return (types.join(F.broadcast(counts), "change_type", "left")
            .select("change_type", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def has_differences(changes: DataFrame) -> bool:
    """D7 as a boolean; reads at most one row."""
    return not changes.isEmpty()


def _text(col: str) -> Column:
    from sitelens.functions.content import decode_text
    return decode_text(F.col(col))


def line_changes(changes: DataFrame, content: DataFrame) -> DataFrame:
    """Per modified row, the lines whose multiplicity differs (multiset difference).

    Lines of both bodies are exploded and counted with a signed aggregate keyed
    by (url, ord, line); partial aggregation collapses repeated lines before the
    shuffle, and the key includes the line, so one large document spreads over
    all partitions.
    """
    side = F.explode(F.array(F.struct(F.col("old_hash").alias("hash"), F.lit(0).alias("new")),
                             F.struct(F.col("new_hash").alias("hash"), F.lit(1).alias("new"))))
    rows = changes.where(F.col("change_type") == "modified").select("url", "ord", side.alias("s"))
    rows = rows.select("url", "ord", F.col("s.hash").alias("hash"), F.col("s.new").alias("new"))
    bodies = rows.join(content.select("hash", "body"), "hash")      # both sides in one join; a missing body has no lines
    # explode_outer + filter keeps Spark from inferring a size() > 0 filter
    # and evaluating the split below the generator a second time
    lines = bodies.select("url", "ord", "new", F.explode_outer(F.split(_text("body"), "\n", -1)).alias("line"))
    return (lines.where(F.col("line").isNotNull())
            .groupBy("url", "ord", "line")
            .agg(F.sum(1 - F.col("new")).cast("long").alias("n_old"), F.sum("new").cast("long").alias("n_new"))
            .where(F.col("n_old") != F.col("n_new")))
