"""Crawls over a stream of responses equal one run, in any order of arrival, replayed or not."""

import random

import pytest

from sitelens.plans import crawl as CR
from sitelens.sources.responses import write_responses
from sitelens.streaming.crawl_stream import CrawlStream, stream_crawl
from tests.test_crawl import RESP

SEEDS = "crawl_id string, seed string, settings map<string,string>"


def _page(*links):
    return "".join(f'<a href="{x}">l</a>' for x in links).encode()


def _rows():
    h = "https://h.com"
    site = [(f"{h}/", 200, None, _page("/a", "/b", "https://o.com/")), (f"{h}/a", 301, f"{h}/a2", None), (f"{h}/a2", 301, f"{h}/a3", None),
            (f"{h}/a3", 200, None, _page("/c", "/late")), (f"{h}/b", 404, None, None), (f"{h}/c", 200, None, _page("/d", "/")),
            (f"{h}/d", 301, "/rel", None), (f"{h}/e", 200, None, _page("/f")), (f"{h}/late", 200, None, _page("/e", "/never")),
            (f"{h}/x", 301, f"{h}/y", None), (f"{h}/y", 301, f"{h}/x", None), (f"{h}/f", 200, None, _page("/x", "/a3")),
            ("https://o.com/", 200, None, _page("/a"))]
    return [(1, i, u, s, loc, "text/html", None, body) for i, (u, s, loc, body) in enumerate(site)]


def _seeds(spark):
    return spark.createDataFrame([("all", "https://h.com/", {}), ("no", "https://h.com/", {"excludeUrls": "/late"}), ("o", "https://o.com/", {})], SEEDS)


def _state(crawl):
    rows = lambda df, cols: sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    return (rows(crawl.seen(), CR.KEYS), rows(crawl.frontier(), CR.KEYS), rows(crawl.report_assets(), ["crawl_id", "request_url", "url", "hash", "references"]))


@pytest.fixture(scope="module")
def one_run(spark):
    """What a closure over all responses says: seen urls, frontier, assets."""
    responses = spark.createDataFrame(_rows(), RESP)
    fetched = CR.fetched_table(responses)
    log, state, _ = CR.crawl_closure(fetched, _seeds(spark))
    seen = sorted((r.crawl_id, r.url) for r in log.collect())
    ended = {r.request_url for r in fetched.where("outcome <> 'missing'").collect()}
    a = log.join(fetched.where("outcome = 'ok'").withColumnRenamed("url", "final"), log.url == CR.F.col("request_url"))
    assets = sorted((r.crawl_id, r.request_url, r.final, r.hash, str(r.references)) for r in a.collect())
    return seen, [s for s in seen if s[1] not in ended], assets


@pytest.mark.parametrize("batches,seed", [(5, 2)])
def test_any_order_of_arrival_equals_one_run(spark, one_run, tmp_dir, batches, seed):
    rows = _rows()
    random.Random(seed).shuffle(rows)
    crawl = CrawlStream(spark, f"{tmp_dir}/state", _seeds(spark))
    for i in range(batches):
        CrawlStream(spark, f"{tmp_dir}/state").process(spark.createDataFrame(rows[i::batches], RESP), i)    # a new driver each time
    assert _state(crawl) == one_run


def test_a_replayed_batch_and_late_answers_change_nothing(spark, one_run, tmp_dir):
    rows = _rows()[::-1]
    crawl = CrawlStream(spark, f"{tmp_dir}/state", _seeds(spark))
    parts = [spark.createDataFrame(rows[:7], RESP), spark.createDataFrame(rows[7:], RESP)]
    start = _state(crawl)
    assert start[0] == start[1] and len(start[0]) == 3        # only the seeds are queued
    crawl.process(parts[0], 0)
    half = _state(crawl)
    crawl.process(parts[0], 0)
    assert _state(crawl) == half
    crawl.process(parts[1], 1)
    crawl.process(parts[1], 1)
    assert _state(crawl) == one_run
    again = spark.createDataFrame([(1, 99, "https://h.com/", 404, None, None, None, None)], RESP)   # answered before
    crawl.process(again, 2)
    crawl.process(spark.createDataFrame([], RESP), 3)
    assert _state(crawl) == one_run and crawl.batches() == [0, 1, 2, 3]


def test_files_of_a_stream(spark, one_run, tmp_dir):
    rows = _rows()
    for i in (0, 1):
        write_responses(spark.createDataFrame(rows[i::2], RESP).coalesce(1), f"{tmp_dir}/in")
        crawl = stream_crawl(spark, f"{tmp_dir}/in", f"{tmp_dir}/state", f"{tmp_dir}/ck", _seeds(spark) if i == 0 else None)
    assert _state(crawl) == one_run


def test_a_batch_of_many_levels_writes_few_tables_of_few_buckets(spark, one_run, tmp_dir):
    """One table a batch by url, a bucket a core, whatever the shuffle partitions: each costs a job, and a job a task a bucket."""
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        crawl = CrawlStream(spark, f"{tmp_dir}/state", _seeds(spark))
        assert crawl.buckets == spark.sparkContext.defaultParallelism
        crawl.process(spark.createDataFrame(_rows(), RESP), 0)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    assert _state(crawl) == one_run
    tables = crawl.tables(0, f"{tmp_dir}/x")
    assert len(tables["crawls_at"].runs) == 2 and CrawlStream(spark, f"{tmp_dir}/other", _seeds(spark), buckets=7).buckets == 7
