"""The crawl itself over a stream of responses: seen urls, frontier and assets, batch by batch.

Responses arrive in any order, many batches apart. The state is a set of bucketed tables (size-tiered, ``sources.bucketed``), of
which every batch writes a new version: only what is new is written, and a manifest that names the tables of the version.

* ``answers``  request_url, ord, status, location of answered urls;
* ``assets``   the asset rows of 2xx responses, by their own url (bodies are dropped);
* ``ended``    redirect chains that ended: request_url, where and how;
* ``open``     chains that wait for an answer: request_url, the url waited for;
* ``edges``    links of the requests whose chain ended well;
* ``seen``     queued urls by (crawl, url), and ``crawls_at`` the same by url.

A late answer reopens the chains that wait for it. The requests whose chain then ends are looked up in ``crawls_at``: crawls that
have seen them process them, and what these discover is expanded through links that arrived before, until nothing new is
seen. So after every batch the seen urls are those of a crawl over all responses so far, and the frontier is what is seen and
unanswered. Lookups read the tables bucket by bucket; what is exchanged are the rows of the batch and what they lead to.

A batch reads the version before it and its manifest is written last, so a batch that failed or is replayed starts from the
same state: a replay changes nothing. A url is answered once: of several answers in one batch the greatest ``ord`` counts, later
ones are ignored. Which link was first depends on the order of arrival, so no FIFO order is kept here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators.assets import build_assets
from sitelens.operators.extract import link_edges
from sitelens.operators.frontier import filter_asset_mime_by, skip_reason_by
from sitelens.operators.responses import REDIRECT_LIMIT, resolve_redirects
from sitelens.plans.crawl import KEYS, _crawls
from sitelens.schemas import ASSET_COLUMNS
from sitelens.session import delete_path, list_folders, path_exists, shuffle_partitions
from sitelens.sources.bucketed import TieredTable, buckets_for
from sitelens.sources.responses import stream_responses

#: name: (schema, bucket columns, unique columns)
TABLES = {
    "answers": ("request_url string, ord long, status int, location string", ["request_url"], ["request_url"]),
    "assets": ("src_url string, src_ord long, url string, last_modified string, data_mime string, charset string, hash string, "
               "references array<string>", ["src_url"], ["src_url"]),
    "ended": ("request_url string, final_url string, outcome string, response_ord long", ["request_url"], ["request_url"]),
    "edges": ("request_url string, pos int, dst_queue string", ["request_url"], ["request_url", "pos"]),
    "seen": ("crawl_id string, url string", KEYS, KEYS),
    "crawls_at": ("url string, crawl_id string", ["url"], KEYS),
}
OPEN = "request_url string, waits_for string"
MANIFEST = "name string, size int, rows long, path string"


class CrawlStream:
    """Crawls over a stream, in a state folder. ``seeds`` (crawl_id, seed, optionally settings) starts a new folder; without it an
    existing one is taken up. ``buckets`` are those of a new folder's tables (default: one a core, whatever the shuffle partitions:
    a batch is many small jobs)."""

    def __init__(self, spark: SparkSession, state: str, seeds: DataFrame | None = None, buckets: int | None = None):
        self.spark, self.state = spark, state.rstrip("/")
        if seeds is not None and not path_exists(spark, f"{self.state}/layout/_SUCCESS"):
            n = buckets or buckets_for(spark)
            _crawls(seeds, (), None, None).write.mode("overwrite").parquet(f"{self.state}/crawls")
            spark.createDataFrame([(n,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.state}/layout")
        self.buckets = int(spark.read.parquet(f"{self.state}/layout").first()["buckets"])
        self.crawls = spark.read.parquet(f"{self.state}/crawls")

    def batches(self) -> list[int]:
        """Committed batches, in order."""
        if not path_exists(self.spark, f"{self.state}/batches"):
            return []
        found = [int(n.split("=")[1]) for n in list_folders(self.spark, f"{self.state}/batches") if n.startswith("batch=")]
        return sorted(b for b in found if path_exists(self.spark, f"{self.state}/batches/batch={b}/manifest/_SUCCESS"))

    def tables(self, batch: int | None, folder: str) -> dict[str, TieredTable]:
        """The tables after ``batch`` (None: before the first one); what is added to them is written under ``folder``."""
        out = {name: TieredTable(self.spark, f"{folder}/{name}", schema, keys, self.buckets, unique)
               for name, (schema, keys, unique) in TABLES.items()}
        if batch is None:
            start = self.crawls.select("crawl_id", F.col("target_url").alias("url")).distinct()
            for name in ("seen", "crawls_at"):
                out[name].write(start)
            return out
        runs: dict[str, list] = {}
        for r in self.spark.read.parquet(f"{self.state}/batches/batch={batch}/manifest").collect():   # a few per table
            runs.setdefault(r["name"], []).append((r["size"], r["rows"], r["path"]))
        for name, of in runs.items():
            out[name].restore(sorted(of, key=lambda m: m[2]))
        return out

    # --- reading ---------------------------------------------------------------------------------------------------

    def _now(self) -> dict[str, TieredTable]:
        done = self.batches()
        return self.tables(done[-1] if done else None, f"{self.state}/start")

    def seen(self) -> DataFrame:
        """crawl_id, url of everything queued so far."""
        return self._now()["seen"].all()

    def frontier(self) -> DataFrame:
        """crawl_id, url of what was seen and has no final answer yet."""
        t = self._now()
        ended = t["ended"].all().select(F.col("request_url").alias("url"))
        return t["crawls_at"].all().join(ended, "url", "left_anti").select(*KEYS)

    def report_assets(self) -> DataFrame:
        """crawl_id, request_url and the asset columns of every seen url that ended well and that its crawl reports."""
        t = self._now()
        at = t["crawls_at"].all().withColumnRenamed("url", "request_url")
        ended = t["ended"].all().where("outcome = 'ok'").select("request_url", "final_url")
        out = at.join(ended, "request_url").join(t["assets"].all().withColumnRenamed("src_url", "final_url"), "final_url")
        out = filter_asset_mime_by(out.join(self.crawls.select("crawl_id", "mimes"), "crawl_id"), F.col("mimes"))
        return out.select("crawl_id", "request_url", *ASSET_COLUMNS)

    # --- writing ----------------------------------------------------------------------------------------------------

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Take in one batch of responses (what ``foreachBatch`` calls). Its jobs have as many shuffle partitions as the tables have
        buckets, in the session of the batch, which is the stream's own, too."""
        with shuffle_partitions(self.spark, self.buckets), shuffle_partitions(batch.sparkSession, self.buckets):
            self._process(batch, batch_id)

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        spark, folder = self.spark, f"{self.state}/batches/batch={batch_id}"
        delete_path(spark, folder)
        before = [b for b in self.batches() if b < batch_id]
        t = self.tables(before[-1] if before else None, folder)

        # answers of urls that had none
        slim = (batch.groupBy(F.col("request_url").cast("string").alias("request_url"))
                .agg(F.max_by(F.struct(F.col("ord").cast("long").alias("ord"), F.col("status").cast("int").alias("status"), "location"), "ord").alias("r"))
                .select("request_url", "r.*"))
        fresh, _ = t["answers"].write(t["answers"].without(slim))
        counted = fresh.select(F.col("request_url").alias("src_url"), F.col("ord").alias("src_ord"))
        src = batch.withColumns({"final_url": F.col("request_url"), "src_url": F.col("request_url"), "src_ord": F.col("ord").cast("long")})
        assets = build_assets(src, keep=["src_url", "src_ord"]).join(counted, ["src_url", "src_ord"], "left_semi")
        t["assets"].write(assets.dropDuplicates(["src_url"]).repartition(self.buckets, "src_url"))

        # chains that start at a new answer, and open ones that waited for one
        waiting = spark.createDataFrame([], OPEN) if not before else \
            spark.read.schema(OPEN).parquet(f"{self.state}/batches/batch={before[-1]}/open")
        woken = waiting.join(fresh.select(F.col("request_url").alias("waits_for")), "waits_for", "left_semi")
        requests = fresh.select("request_url").unionByName(woken.select("request_url")).distinct().checkpoint(eager=True)
        chains = resolve_redirects(self._answers_along(requests, t["answers"]), requests)
        chains = chains.select("request_url", "final_url", "outcome", "response_ord").checkpoint(eager=True)
        ended, _ = t["ended"].write(chains.where("outcome <> 'missing'").repartition(self.buckets, "request_url"))
        still = waiting.join(requests, "request_url", "left_anti").unionByName(
            chains.where("outcome = 'missing'").select("request_url", F.col("final_url").alias("waits_for")))
        still.write.mode("overwrite").parquet(f"{folder}/open")

        # links of the requests whose chain ended well now
        ok = ended.where("outcome = 'ok'").select("request_url", F.col("final_url").alias("src_url"))
        own = t["assets"].lookup(ok).select("request_url", "url", "references")
        links = link_edges(own, src_col="url", keep=["request_url"]).select("request_url", F.col("pos").cast("int").alias("pos"), "dst_queue")
        edges, _ = t["edges"].write(links.repartition(self.buckets, "request_url"))

        # crawls that have seen them process them now; what they discover goes on through all links so far
        done = t["crawls_at"].lookup(ended.select(F.col("request_url").alias("url")))
        found = done.select("crawl_id", F.col("url").alias("request_url")).join(edges, "request_url")
        rules = self.crawls.select("crawl_id", "target_host", "mimes", "include", "exclude")
        news = []
        while True:
            cand = found.select("crawl_id", F.col("dst_queue").alias("url")).distinct().join(rules, "crawl_id")
            reason = skip_reason_by(F.col("url"), F.col("target_host"), F.col("mimes"), F.col("include"), F.col("exclude"))
            new, count = t["seen"].write(t["seen"].without(cand.where(reason.isNull()).select(*KEYS)))
            if count == 0:
                break
            news.append(new)
            found = t["edges"].lookup(new.withColumnRenamed("url", "request_url"))
        if news:        # only the next batch looks them up by url
            t["crawls_at"].write(reduce(DataFrame.unionByName, news).repartition(self.buckets, "url"))

        rows = [(name, *m) for name, table in t.items() for m in table.manifest()]
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")

    def _answers_along(self, requests: DataFrame, answers: TieredTable) -> DataFrame:
        """The answers that the chains of ``requests`` pass, by one lookup a hop."""
        urls, out = requests, None
        for _ in range(REDIRECT_LIMIT):
            step = answers.lookup(urls).checkpoint(eager=True)
            out = step if out is None else out.unionByName(step)
            urls = step.where(F.col("location").isNotNull() & F.col("status").between(300, 399)).select(F.col("location").alias("request_url")).distinct()
            if urls.isEmpty():
                break
        return out.dropDuplicates(["request_url"])


def stream_crawl(spark: SparkSession, in_dir: str, state: str, checkpoint: str, seeds: DataFrame | None = None,
                 max_files_per_trigger: int | None = None) -> CrawlStream:
    """Take in every response file not yet seen, then stop (``availableNow``)."""
    crawl = CrawlStream(spark, state, seeds)
    q = (stream_responses(spark, in_dir, max_files_per_trigger).writeStream.foreachBatch(crawl.process)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return crawl
