"""Report scan (S1) and sink.

Canonical layout (splittable, any size): a folder with JSON-lines tables
``assets`` (crawl_id, ord, asset fields), ``meta`` (crawl_id + meta fields),
``queue`` (crawl_id, url, rank) and ``processed`` (crawl_id, url).

Document layout (the reference's interchange format): one JSON document per
crawl, ``{"assets": [...], "meta": {...}}``, a file each. Documents are written
line by line from sorted rows, so no crawl is ever one row on the way out.
Documents that do not parse are set apart with their file and a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.schemas import ASSET, ASSET_COLUMNS, META, REPORT
from sitelens.session import path_exists

_ASSET_LINE = T.StructType([T.StructField("crawl_id", T.StringType()), T.StructField("ord", T.LongType()),
                            *ASSET.fields])
_META_LINE = T.StructType([T.StructField("crawl_id", T.StringType()), *META.fields])


def write_report(assets: DataFrame, path: str, meta: DataFrame | None = None,
                 queue: DataFrame | None = None, processed: DataFrame | None = None,
                 fmt: str = "json") -> None:
    """S2 (canonical): asset rows, and optionally meta/queue/processed tables.

    ``fmt="json"`` writes JSON lines (interchange); ``fmt="parquet"`` writes
    Parquet with the assets partitioned by ``snapshot_id`` when that column is
    present (storage). Both are splittable and have no size limit.
    """
    def out(df, name, partition=None):
        w = df.write.mode("overwrite")
        if fmt == "parquet":
            (w.partitionBy(partition) if partition else w).parquet(f"{path}/{name}")
        else:
            w.json(f"{path}/{name}")
    cols = ["crawl_id", "ord", *ASSET_COLUMNS] + (["snapshot_id"] if "snapshot_id" in assets.columns else [])
    out(assets.select(*cols), "assets", "snapshot_id" if "snapshot_id" in assets.columns else None)
    if meta is not None:
        out(meta, "meta")
    if queue is not None:
        out(queue.select("crawl_id", "url", "rank"), "queue")
    if processed is not None:
        out(processed.select("crawl_id", "url"), "processed")


def read_report(spark: SparkSession, path: str, layout: str = "lines", multi_line: bool = False,
                fmt: str = "json"):
    """(meta, assets, queue, processed) DataFrames.

    ``layout="lines"`` reads the canonical folder; ``layout="documents"`` reads
    report documents (``multi_line=True`` for pretty-printed files, one per
    file). Document assets get ``ord`` from their array position; ``crawl_id``
    is the document's ``meta.url``.
    """
    if layout == "lines":
        def rd(schema, name):
            r = spark.read.schema(schema) if fmt == "json" else spark.read
            return r.json(f"{path}/{name}") if fmt == "json" else r.parquet(f"{path}/{name}")
        assets = rd(_ASSET_LINE, "assets")
        def optional(schema, name):
            """A table that may be absent; an error on one that is there is raised."""
            return rd(schema, name) if path_exists(spark, f"{path}/{name}") else spark.createDataFrame([], schema)
        meta = optional(_META_LINE, "meta")
        queue = optional("crawl_id string, url string, rank long", "queue")
        processed = optional("crawl_id string, url string", "processed")
        return meta, assets, queue, processed
    docs = _documents(spark, path, multi_line).where(F.col("reason").isNull())
    docs = docs.withColumn("crawl_id", F.col("meta.url"))
    meta = docs.select("crawl_id", "meta.*")
    assets = docs.select("crawl_id", F.posexplode("assets").alias("ord", "a")).select(
        "crawl_id", F.col("ord").cast("long"), "a.*")
    queue = docs.select("crawl_id", F.posexplode("meta.queue").alias("p", "url")).select(
        "crawl_id", "url", (F.col("p") + 1).cast("long").alias("rank"))
    processed = docs.select("crawl_id", F.explode("meta.processed").alias("url"))
    return meta, assets, queue, processed


def _documents(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """meta, assets, file, text (of a record that did not parse), reason (null: a sound document)."""
    schema = T.StructType([*REPORT.fields, T.StructField("_damaged", T.StringType())])
    docs = (spark.read.schema(schema).option("multiLine", multi_line).option("recursiveFileLookup", "true").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_damaged").json(path))
    reason = (F.when(F.col("_damaged").isNotNull(), "not a JSON document").when(F.col("assets").isNull(), "no assets")
              .when(F.col("meta").isNull(), "no meta"))
    return docs.select("meta", "assets", F.col("_metadata.file_path").alias("file"), F.col("_damaged").alias("text"), reason.alias("reason"))


def damaged_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """S1's quarantine: file, reason, n_chars and beginning of every record under ``path`` that is no report document."""
    return _documents(spark, path, multi_line).where(F.col("reason").isNotNull()).select(
        "file", "reason", F.length("text").cast("long").alias("n_chars"), F.substring("text", 1, 200).alias("beginning"))


def export_report_documents(report, path: str) -> None:
    """S2 (document layout): one JSON document, in a file of its own, for every crawl in ``report.meta`` (a ``plans.crawl.Report``).

    Assets are in the order of ``ord``. A finished crawl has ``finished``; an unfinished one ``queue`` (pending urls in order) and
    ``processed`` (all seen urls). A document is many rows of text, one an asset or url, sorted within the task that writes its
    file: the sort spills, so a crawl may be larger than a task's memory.
    """
    meta = report.meta
    text = lambda c: F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})      # noqa: E731
    value = lambda c: F.regexp_extract(text(c), r'(?s)^\{"v":(.*)\}$', 1)                    # noqa: E731

    def lines(rows: DataFrame, section: int, order, item) -> DataFrame:
        """Items of an array; all but a crawl's first begin with a comma."""
        rows = rows.select("crawl_id", order.alias("ord"), item.alias("item"))
        place = F.struct("ord", "item")
        first = rows.groupBy("crawl_id").agg(F.min(place).alias("first"))
        comma = F.when(place == F.col("first"), F.lit(" ")).otherwise(F.lit(","))
        return rows.join(first, "crawl_id").select("crawl_id", F.lit(section).alias("section"), "ord", F.concat(comma, "item").alias("value"))

    def fixed(section: int, value, rows: DataFrame = meta) -> DataFrame:
        return rows.select("crawl_id", F.lit(section).alias("section"), F.lit(0).cast("long").alias("ord"), value.alias("value"))

    finished = F.when(F.col("finished").isNotNull(), F.concat(F.lit(',"finished":'), value(F.col("finished")))).otherwise(F.lit(""))
    settings = F.coalesce(F.col("settings"), F.create_map().cast("map<string,string>"))
    head = F.concat(F.lit('],"meta":{"url":'), value(F.col("url")), F.lit(',"started":'), value(F.col("started")), finished,
                    F.lit(',"version":'), value(F.col("version")), F.lit(',"settings":'), F.to_json(settings))
    asset = F.to_json(F.struct(*ASSET_COLUMNS), {"ignoreNullFields": "false"})
    open_ = meta.where("finished is null")
    unfinished = open_.select("crawl_id")
    queue, processed = (d.join(unfinished, "crawl_id", "left_semi").dropDuplicates(["crawl_id", "url"]) for d in (report.queue, report.processed))
    rank = F.col("rank") if "rank" in processed.columns else F.monotonically_increasing_id()
    parts = [fixed(0, F.lit('{"assets":[')), lines(report.assets.join(meta.select("crawl_id"), "crawl_id", "left_semi"), 1, F.col("ord"), asset),
             fixed(2, head), fixed(3, F.lit(',"queue":['), open_), lines(queue, 4, F.col("rank"), value(F.col("url"))),
             fixed(5, F.lit('],"processed":['), open_), lines(processed.withColumn("_r", rank), 6, F.col("_r"), value(F.col("url"))),
             fixed(7, F.lit("]"), open_), fixed(8, F.lit("}}"))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    n = int(meta.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("document", F.sha2(F.col("crawl_id").cast("binary"), 256))
    (rows.repartition(n, "document").sortWithinPartitions("document", "section", "ord", F.substring("value", 2, 1 << 30)).select("document", "value")
     .write.mode("overwrite").partitionBy("document").text(path))
