"""S1-S5, V1-V2, T1 and the driver contract."""

from pyspark.sql import functions as F

from sitelens.operators.lookup import path_index, resolve_requests
from sitelens.sources.report import read_report, write_report
from sitelens.sources.store import load_content, save_content

ASSETS = "ord long, url string, hash string, data_mime string"


def test_store_dedup_and_anti(spark, tmp_dir):
    store = f"{tmp_dir}/store"
    r1 = spark.createDataFrame([(200, b"a"), (200, b"a"), (404, b"b"), (200, None)], "status int, body binary")
    assert save_content(r1, store).count() == 1
    r2 = spark.createDataFrame([(200, b"a"), (201, b"c")], "status int, body binary")
    added = save_content(r2, store).collect()
    assert [bytes(x.body) for x in added] == [b"c"]
    keys = spark.createDataFrame([("x", added[0].hash), ("y", "00ff")], "k string, hash string")
    got = {r.k: r.body for r in load_content(keys, store).collect()}
    assert bytes(got["x"]) == b"c" and got["y"] is None


def _bodies(spark, a, b, status=200):
    return spark.range(a, b).select(F.lit(status).alias("status"), F.concat(F.lit("body "), F.col("id")).cast("binary").alias("body"))


def test_saving_reads_and_moves_no_stored_body(spark, tmp_dir):
    """Winners are decided on hashes alone; bodies are exchanged once, on their way to the files."""
    import re

    from sitelens.sources import store as S
    from sitelens.functions.content import content_hash
    save_content(_bodies(spark, 0, 500), f"{tmp_dir}/s")
    r = _bodies(spark, 400, 900).withColumn("hash", content_hash(F.col("body")))
    plan = S.winners(r, f"{tmp_dir}/s")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert len(scans) == 1 and "body" not in re.search(r"ReadSchema: (.*)", scans[0])[1]
    assert all("body" not in x for x in plan.splitlines() if "Exchange" in x)
    stored = {x.hash for x in S.read_store(spark, f"{tmp_dir}/s").collect()}
    assert {x.hash for x in S.winners(r, f"{tmp_dir}/s").collect()} == {x.hash for x in r.collect()} - stored
    added = save_content(r, f"{tmp_dir}/s")
    assert added.count() == 400 and S.read_store(spark, f"{tmp_dir}/s").count() == 900


def test_a_save_leaves_few_files(spark, tmp_dir):
    import glob

    from sitelens.sources import store as S
    rows = _bodies(spark, 0, 3000).repartition(16)
    save_content(rows, f"{tmp_dir}/s")
    assert len(glob.glob(f"{tmp_dir}/s/*/*/*.parquet")) <= 256       # 16 tasks, one file a prefix
    before, S.FILE_BYTES = S.FILE_BYTES, 40
    try:
        save_content(rows, f"{tmp_dir}/t")
    finally:
        S.FILE_BYTES = before
    big = glob.glob(f"{tmp_dir}/t/*/*/*.parquet")
    assert 256 < len(big) <= 3 * 256 and spark.read.parquet(f"{tmp_dir}/t").count() == 3000


def test_loading_reads_only_the_prefixes_asked_for(spark, tmp_dir):
    from sitelens.sources import store as S
    save_content(_bodies(spark, 0, 4000), f"{tmp_dir}/s")
    held = {r.hash: bytes(r.body) for r in S.read_store(spark, f"{tmp_dir}/s").collect()}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        read = {}
        for n in (2, 20, 4000):
            keys = spark.createDataFrame([(h,) for h in sorted(held)[:: len(held) // n][:n]] + [(None,), ("ff" * 32,)], "hash string")
            got = load_content(keys, f"{tmp_dir}/s")
            plan = got._jdf.queryExecution().executedPlan()
            assert {r.hash: r.body and bytes(r.body) for r in got.collect()} == {r.hash: held.get(r.hash) for r in keys.collect()}
            leaves = [plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size())]
            read[n] = sum(x.metrics().apply("filesSize").value() for x in leaves if x.nodeName().startswith("Scan parquet"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < read[2] * 20 < read[4000] and read[2] < read[20] < read[4000] / 5


def test_compaction_keeps_the_rows_and_can_be_stopped(spark, tmp_dir):
    import glob

    from sitelens.sources import store as S
    path = f"{tmp_dir}/s"
    for i in range(4):
        save_content(_bodies(spark, i * 300, i * 300 + 300), path)
    want = sorted((r.hash, bytes(r.body)) for r in S.read_store(spark, path).collect())
    rows = lambda: sorted((r.hash, bytes(r.body)) for r in S.read_store(spark, path).collect())
    finish, S._finish_compaction = S._finish_compaction, lambda *a: None
    try:
        S.compact_store(spark, path, most=2)        # stopped after the commit: nothing cleared up yet
        assert rows() == want and len(want) == 1200
        moved = f"{path}/_replaced/_SUCCESS"
        import os
        os.rename(moved, moved + "-later")
        assert rows() == want                       # stopped before the commit
        os.rename(moved + "-later", moved)
    finally:
        S._finish_compaction = finish
    files = len(glob.glob(f"{path}/*/*/*.parquet"))
    S.compact_store(spark, path, most=2)
    assert rows() == want and len(glob.glob(f"{path}/*/*/*.parquet")) < files and not glob.glob(f"{path}/_*/*.parquet")
    assert S.compact_store(spark, path, most=2) == 0 and S.compact_store(spark, f"{tmp_dir}/none") == 0
    assert save_content(_bodies(spark, 1190, 1210), path).count() == 10


def test_path_lookup(spark):
    assets = spark.createDataFrame([
        (1, "https://a.com/p?x=1", "h1", "text/html"),
        (2, "https://b.com/p?x=2", "h2", ""),       # same path, other host and query: last wins
        (3, "https://a.com/gone", None, "text/html"),
        (4, "https://a.com/nostore", "h9", "text/css"),
        (5, "https://a.com/é", "h1", "text/html"),
    ], ASSETS)
    idx = {r.path: (r.hash, r.data_mime) for r in path_index(assets).collect()}
    assert idx["/p"] == ("h2", "")
    content = spark.createDataFrame([("h1", b"1"), ("h2", b"2")], "hash string, body binary")
    req = spark.createDataFrame([("/p",), ("/gone",), ("/nostore",), ("/unknown",), ("/é",)], "path string")
    got = {r.path: (r.status, r.content_type) for r in resolve_requests(req, assets, content).collect()}
    assert got == {"/p": (200, "application/octet-stream"), "/gone": (404, None), "/nostore": (500, None),
                   "/unknown": (404, None), "/é": (200, "text/html")}


def test_report_round_trip(spark, tmp_dir):
    a = spark.createDataFrame([("c", 0, "https://h/", None, "text/html", "utf-8", "h", ["https://h/a"]),
                               ("c", 1, "https://h/a", "2020-01-01T00:00:00.000Z", None, None, None, [])],
                              "crawl_id string, ord long, url string, last_modified string, data_mime string, "
                              "charset string, hash string, references array<string>")
    write_report(a, f"{tmp_dir}/rep")
    _, back, q, p = read_report(spark, f"{tmp_dir}/rep")
    assert sorted(map(tuple, back.select(*a.columns).collect())) == sorted(map(tuple, a.collect()))
    assert q.count() == 0 and p.count() == 0


def test_reference_document_format(spark, tmp_dir):
    doc = """{
  "assets": [
    {"url": "https://h/", "last_modified": null, "data_mime": "text/html", "charset": null,
     "hash": "ab", "references": ["https://h/a"]},
    {"url": "https://h/a", "last_modified": null, "data_mime": "text/html", "charset": null,
     "hash": null, "references": []}
  ],
  "meta": {"url": "https://h", "started": "2024-01-01T00:00:00.000Z", "queue": ["https://h/b"],
           "processed": ["https://h", "https://h/a", "https://h/b"], "version": "x", "settings": {"delay": "500"}}
}"""
    with open(f"{tmp_dir}/report.json", "w") as fh:
        fh.write(doc)
    meta, assets, queue, processed = read_report(spark, f"{tmp_dir}/report.json", layout="documents", multi_line=True)
    assert [r.ord for r in assets.orderBy("ord").collect()] == [0, 1]
    assert [(r.url, r.rank) for r in queue.collect()] == [("https://h/b", 1)]
    assert processed.count() == 3 and meta.first().settings == {"delay": "500"}


def test_stream_two_runs_equal_one(spark):
    from sitelens.streaming.assets_stream import run_assets_stream_on
    rows = [(1, i, f"https://h/{i}", 200, None, "text/html", None, f'<a href="/{i + 1}">n</a>'.encode())
            for i in range(6)]
    resp = spark.createDataFrame(rows, "snapshot_id int, ord long, request_url string, status int, location string, "
                                       "content_type string, last_modified_hdr string, body binary")
    out = run_assets_stream_on(spark, resp).collect()
    assert sorted(r.ord for r in out) == list(range(6))
    assert {r.url: r.references for r in out}["https://h/0"] == ["https://h/1"]


def test_entry_contract(spark):
    import __spark_entry__ as se
    df = se.entry(spark)
    assert df.count() >= 0 and "change_type" in df.columns
    qs, sql = se.queries(), se.oracle_sql()
    own = {q for q in qs if not q.startswith("op") and q != "pipeline"}
    assert set(sql) <= set(qs) and own <= set(sql)


def test_report_parquet_and_crawl_store(spark, tmp_dir):
    from sitelens.plans import crawl as CR
    a = spark.createDataFrame([("c", 0, "https://h/", None, "text/html", None, "h", [], 1)],
                              "crawl_id string, ord long, url string, last_modified string, data_mime string, "
                              "charset string, hash string, references array<string>, snapshot_id int")
    write_report(a, f"{tmp_dir}/pq", fmt="parquet")
    _, back, _, _ = read_report(spark, f"{tmp_dir}/pq", fmt="parquet")
    assert back.first().snapshot_id == 1 and back.count() == 1
    resp = spark.createDataFrame([(200, b"kept"), (200, b"filtered")], "status int, body binary")
    kept = resp.where("body = cast('kept' as binary)").select(F.sha2("body", 256).alias("hash"))
    added = CR.save_crawl_content(resp, kept, f"{tmp_dir}/store")
    assert [bytes(r.body) for r in added.collect()] == [b"kept"]


def test_mime_registry_file(spark, tmp_dir):
    from sitelens.functions import mime as M
    before = dict(M.EXTENSION_MIME)
    with open(f"{tmp_dir}/mime.types", "w") as fh:
        fh.write("# types\napplication/x-own  own1 own2\ntext/other html\n")
    M.load_registry(f"{tmp_dir}/mime.types")
    got = spark.createDataFrame([("/a.own2",), ("/a.HTML",), ("/a.nope",), ("/a.epub",)], "p string").select(M.mime_for_path(F.col("p")).alias("m")).collect()
    M.EXTENSION_MIME.clear()
    M.EXTENSION_MIME.update(before)
    assert [g.m for g in got][:3] == ["application/x-own", "text/html", None]


def test_report_errors_and_missing_tables(spark, tmp_dir):
    """Only a table that is absent counts as empty; one that cannot be read raises."""
    import pytest
    a = spark.createDataFrame([("c", 0, "https://h/", None, "text/html", None, "h", [])],
                              "crawl_id string, ord long, url string, last_modified string, data_mime string, "
                              "charset string, hash string, references array<string>")
    q = spark.createDataFrame([("c", "https://h/b", 1)], "crawl_id string, url string, rank long")
    write_report(a, f"{tmp_dir}/r", queue=q)
    _, assets, queue, processed = read_report(spark, f"{tmp_dir}/r")
    assert (assets.count(), queue.count(), processed.count()) == (1, 1, 0)
    with pytest.raises(Exception):
        read_report(spark, f"{tmp_dir}/none")[1].count()
