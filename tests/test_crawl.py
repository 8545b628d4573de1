"""Redirects, enqueue rules, closure vs brute force, resume equality."""

import glob
import json
import os
from collections import deque

from pyspark.sql import functions as F

from sitelens.functions import whatwg
from sitelens.operators import frontier as FR
from sitelens.operators import robots as B
from sitelens.operators.responses import resolve_redirects
from sitelens.plans import crawl as CR
from sitelens.sources.report import damaged_documents, export_report_documents, read_report, write_report

RESP = "snapshot_id int, ord long, request_url string, status int, location string, content_type string, last_modified_hdr string, body binary"


def _responses(spark, rows):
    return spark.createDataFrame([(1, i, u, s, loc, ct, None, body) for i, (u, s, loc, ct, body) in enumerate(rows)], RESP)


def test_redirect_rules(spark):
    rows = []
    for i in range(10):            # chain a0 -> a1 -> ... -> a9 (200): 9 redirects
        rows.append((f"https://h/a{i}", 301 if i < 9 else 200, f"https://h/a{i + 1}" if i < 9 else None, "text/html", b"x"))
    for i in range(11):            # chain b0 -> ... -> b10 (200): 10 redirects, limit
        rows.append((f"https://h/b{i}", 301 if i < 10 else 200, f"https://h/b{i + 1}" if i < 10 else None, "text/html", b"x"))
    rows += [("https://h/c1", 301, "https://h/c2", None, None), ("https://h/c2", 301, "https://h/c1", None, None),
             ("https://h/n", 301, None, None, None), ("https://h/r", 301, "/rel", None, None),
             ("https://h/t", 302, "https://h/a9", None, None), ("https://h/x", 404, None, None, None),
             ("https://h/m", 301, "https://h/missing", None, None)]
    got = {r.request_url: (r.final_url, r.hops, r.outcome)
           for r in resolve_redirects(_responses(spark, rows)).collect()}
    assert got["https://h/a0"] == ("https://h/a9", 9, "ok")
    assert got["https://h/b0"][1:] == (10, "redirect_limit")
    assert got["https://h/c1"][2] == "redirect_limit"
    assert got["https://h/n"] == ("https://h/n", 0, "status")        # 301 without Location fails
    assert got["https://h/r"] == ("/rel", 1, "bad_location")
    assert got["https://h/t"] == ("https://h/t", 0, "status")        # only 301 is followed
    assert got["https://h/x"][2] == "status"
    assert got["https://h/m"] == ("https://h/missing", 1, "missing")


def _hops(table, url, limit, relative):
    """One request at a time, as a fetcher follows it: (final url, hops, outcome)."""
    at, hops = url, 0
    while True:
        status, loc = table.get(at, (None, None))
        if status != 301 or not loc:
            return at, hops, "missing" if status is None else "ok" if 200 <= status < 300 else "status"
        at, hops = (whatwg.resolve(loc, at) if relative else loc), hops + 1
        if hops >= limit:
            return at, hops, "redirect_limit"
        if "://" not in at:
            return at, hops, "bad_location"


def test_redirects_by_doubling_equal_one_request_at_a_time(spark):
    import random
    rnd = random.Random(4)
    urls = [f"https://h{i % 3}/a{i}" for i in range(120)]
    rows = []
    for i, u in enumerate(urls):
        kind = rnd.random()
        if kind < 0.75:
            loc = urls[i + 1] if kind < 0.6 and i + 1 < len(urls) else rnd.choice([*urls, "/a7", "/none", "https://h0/gone", "", None])
            rows.append((u, 301, loc, None, None))
        else:
            rows.append((u, rnd.choice([200, 204, 404, 302]), None, None, b"x"))
    table = {u: (s, loc) for u, s, loc, _, _ in rows}
    df = _responses(spark, rows)
    asked = df.select("request_url").withColumn("most", F.explode(F.sequence(F.lit(1), F.lit(17))))
    for relative in (False, True):
        got = {(r.request_url, r.most): (r.final_url, r.hops, r.outcome)
               for r in resolve_redirects(df, asked, limit="most", relative=relative).collect()}
        assert got == {(u, n): _hops(table, u, n, relative) for u in table for n in range(1, 18)}
    one = {r.request_url: (r.final_url, r.hops, r.outcome) for r in resolve_redirects(df, limit=3).collect()}
    assert one == {u: _hops(table, u, 3, False) for u in table}


def test_enqueue_reasons(spark):
    rows = [("https://h.com/a.pdf",), ("https://h.com/a",), ("https://o.com/a",), ("https://h.com/x/a",),
            ("https://h.com/en/a?q",), ("https://h.com/en/a.unknownext",)]
    df = spark.createDataFrame(rows, "u string").withColumn("host", F.lit("h.com"))
    got = FR.enqueue_decisions(df, "u", "host", ["text/html"], "/en/", r"\?").collect()
    assert [r.skip_reason for r in got] == ["mime", "include", "host", "include", "exclude", None]


def test_new_frontier_and_rank(spark):
    c = spark.createDataFrame([("c", "x", 2, 0), ("c", "x", 1, 5), ("c", "y", 1, 1), ("c", "z", 1, 0), ("c", "s", 0, 0)],
                              "crawl_id string, url string, parent_rank long, pos int")
    seen = spark.createDataFrame([("c", "s")], "crawl_id string, url string")
    nf = FR.new_frontier(c, seen)
    ranked = sorted((r.rank, r.url) for r in FR.fifo_rank(nf).collect())
    assert ranked == [(1, "z"), (2, "y"), (3, "x")]


def _site(spark):
    """Pages with links; /p3 redirects to /p4; /p5 is an image (MIME-filtered but still parsed)."""
    def page(links):
        return "".join(f'<a href="{l}">l</a>' for l in links).encode()
    rows = [
        ("https://h.com/", 200, None, "text/html", page(["/p1", "/p2", "https://o.com/x", "/p1#frag"])),
        ("https://h.com/p1", 200, None, "text/html", page(["/p3", "/", "/p5"])),
        ("https://h.com/p2", 200, None, "text/html", page(["/p6", "/p2"])),
        ("https://h.com/p3", 301, "https://h.com/p4", None, None),
        ("https://h.com/p4", 200, None, "text/html", page(["/p7"])),
        ("https://h.com/p5", 200, None, "text/html", page(["/p8"])),
        ("https://h.com/p6", 404, None, None, None),
        ("https://h.com/p7", 200, None, "text/html", page([])),
        ("https://h.com/p8", 200, None, "text/html", page(["/p9"])),
        ("https://o.com/x", 200, None, "text/html", page(["/y"])),
    ]
    return _responses(spark, rows)


def _bfs(fetched_rows, seed):
    refs = {r.request_url: (r.references or []) for r in fetched_rows}
    host = seed.split("/")[2]
    seen, order, q = {seed}, [], deque([(seed, 0)])
    while q:
        u, d = q.popleft()
        order.append((u, d))
        for ref in refs.get(u, []):
            k = whatwg.queue_key(ref)
            if k.split("/")[2] == host and k not in seen:
                seen.add(k)
                q.append((k, d + 1))
    return order


def test_closure_matches_fifo_queue(spark):
    fetched = CR.fetched_table(_site(spark))
    seeds = spark.createDataFrame([("https://h.com/", "https://h.com")], "crawl_id string, seed string")
    log, state, finished = CR.crawl_closure(fetched, seeds)
    assert finished
    ranked = CR.ranked_log(log).orderBy("depth", "rank").collect()
    assert [(r.url, r.depth) for r in ranked] == _bfs(fetched.collect(), "https://h.com/")
    assets = {r.url for r in CR.crawl_assets(log, fetched).collect()}
    assert "https://h.com/p4" in assets and "https://h.com/p6" not in assets
    only_pdf = {r.url for r in CR.crawl_assets(log, fetched, ["image/png"]).collect()}
    assert only_pdf == set()


SETTINGS = {"delay": "250", "excludeUrls": "p9$"}
STARTED = "2024-02-03T04:05:06.789Z"
TYPED = "crawl_id string, seed string, started string, settings map<string,string>"


def _report_rows(report):
    assets = sorted((r.crawl_id, r.ord, r.url, r.data_mime, r.hash, tuple(r.references)) for r in report.assets.collect())
    meta = sorted((r.crawl_id, r.url, r.started, r.finished is not None, sorted(r.settings.items())) for r in report.meta.collect())
    return assets, meta


def _stored(spark, report, path):
    write_report(report.assets, path, report.meta, report.queue, report.processed)
    return CR.Report(*read_report(spark, path))


def test_resume_equals_uninterrupted_at_every_level(spark, tmp_dir):
    """Assets with their ordinals, target, start time and settings of a resumed crawl are those of one that was never cut."""
    fetched = CR.fetched_table(_site(spark))
    seeds = spark.createDataFrame([("c", "https://h.com/", STARTED, SETTINGS)], TYPED)
    _, state, _ = CR.crawl_closure(fetched, seeds)
    want = _report_rows(CR.crawl_report(spark, state, fetched))
    assert [a[1] for a in want[0]] == list(range(len(want[0]))) and want[1][0][1:4] == ("https://h.com/", STARTED, True)
    assert not any(a[2].endswith("p9") for a in want[0])
    for cut in range(CR.last_level(spark, state)):
        _, part, finished = CR.crawl_closure(fetched, seeds, max_levels=cut)
        assert not finished
        st = CR.crawl_state(spark, part).first()
        assert not st.finished and st.n_queue > 0
        stored = _stored(spark, CR.crawl_report(spark, part, fetched), f"{tmp_dir}/r{cut}")
        assert stored.meta.first().finished is None
        whole, _ = CR.resume_reports(stored, fetched)
        assert _report_rows(whole) == want and whole.refused.count() == 0


def test_resume_twice_and_by_documents(spark, tmp_dir):
    """A resumed crawl that is stopped again reports a queue, and goes on from there; documents serve as well as tables."""
    fetched = CR.fetched_table(_site(spark))
    seeds = spark.createDataFrame([("https://h.com/", "https://h.com/", STARTED, SETTINGS)], TYPED)
    _, state, _ = CR.crawl_closure(fetched, seeds)
    want = _report_rows(CR.crawl_report(spark, state, fetched))
    _, part, _ = CR.crawl_closure(fetched, seeds, max_levels=1)
    export_report_documents(CR.crawl_report(spark, part, fetched), f"{tmp_dir}/d0")
    for i in (1, 2):
        report = CR.Report(*read_report(spark, f"{tmp_dir}/d{i - 1}", layout="documents", multi_line=True))
        more, _ = CR.resume_reports(report, fetched, max_levels=1 if i == 1 else None)
        export_report_documents(more, f"{tmp_dir}/d{i}")
    got = CR.Report(*read_report(spark, f"{tmp_dir}/d2", layout="documents", multi_line=True))
    assert _report_rows(got) == want


def test_only_crawls_that_cannot_go_on_are_refused(spark):
    fetched = CR.fetched_table(_site(spark))
    seeds = spark.createDataFrame([(c, "https://h.com/", STARTED, SETTINGS) for c in ("open", "done", "empty", "lost")], TYPED)
    _, state, _ = CR.crawl_closure(fetched, seeds, max_levels=1)
    cut = CR.crawl_report(spark, state, fetched)
    meta = cut.meta.withColumn("finished", F.when(F.col("crawl_id") == "done", STARTED)) \
        .withColumn("url", F.when(F.col("crawl_id") != "lost", F.col("url")))
    report = CR.Report(meta, cut.assets, cut.queue.where("crawl_id <> 'empty'"), cut.processed)
    whole, _ = CR.resume_reports(report, fetched)
    assert dict(map(tuple, whole.refused.collect())) == {"done": "finished", "empty": "empty queue", "lost": "no target url"}
    assert {r.crawl_id for r in whole.meta.collect()} == {"open"} == {r.crawl_id for r in whole.assets.collect()}
    none, _ = CR.resume_reports(CR.Report(meta.where("crawl_id = 'done'"), cut.assets, cut.queue, cut.processed), fetched)
    assert none.assets.count() == 0 and none.refused.count() == 1


def test_a_report_only_crawl_reports_urls_that_redirect_forever(spark):
    def page(*links):
        return "".join(f'<a href="{x}">l</a>' for x in links).encode()
    rows = [("https://h.com/", 200, None, "text/html", page("/l0", "/x")), ("https://h.com/x", 301, "https://h.com/y", None, None),
            ("https://h.com/y", 301, "https://h.com/x", None, None), ("https://h.com/l0", 200, None, "text/css", b"")]
    fetched = CR.fetched_table(_responses(spark, rows))
    seeds = spark.createDataFrame([("both", "https://h.com/", STARTED, {}), ("only", "https://h.com/", STARTED, {"reportOnly": "true"})], TYPED)
    _, state, _ = CR.crawl_closure(fetched, seeds)
    got = sorted((r.crawl_id, r.ord, r.url, r.hash is None, r.references) for r in CR.crawl_report(spark, state, fetched).assets.collect())
    assert [g[:4] for g in got] == [("both", 0, "https://h.com/", False), ("both", 1, "https://h.com/l0", False),
                                    ("only", 0, "https://h.com/", False), ("only", 1, "https://h.com/l0", False), ("only", 2, "https://h.com/x", True)]
    assert got[-1][4] == []


def test_settings_hold_for_their_own_crawl(spark):
    """Stored settings win unless overridden; each crawl of one closure has its own filters, in crawling and in the report."""
    fetched = CR.fetched_table(_site(spark))
    seeds = spark.createDataFrame([
        ("all", "https://h.com/", STARTED, {}), ("no2", "https://h.com/", STARTED, {"excludeUrls": "p2"}),
        ("in1", "https://h.com/", STARTED, {"includeUrls": "p[13]"}), ("png", "https://h.com/", STARTED, {"mimeFilter": " image/png , text/css", "excludeUrls": ""})],
        TYPED)
    log, state, _ = CR.crawl_closure(fetched, seeds)
    got = {}
    for r in log.collect():
        got.setdefault(r.crawl_id, set()).add(r.url.removeprefix("https://h.com/"))
    assert got["all"] == {"", "p1", "p2", "p3", "p5", "p6", "p7", "p8", "p9"} - ({"p7"} - got["all"])
    assert "p2" not in got["no2"] and "p6" not in got["no2"] and "p1" in got["no2"]
    assert got["in1"] == {"", "p1", "p3"}
    listed = {r.crawl_id: r.n for r in CR.crawl_report(spark, state, fetched).assets.groupBy("crawl_id").agg(F.count("*").alias("n")).collect()}
    assert "png" not in listed and listed["all"] > listed["no2"] > listed["in1"]
    cut = CR.crawl_closure(fetched, seeds.where("crawl_id = 'no2'"), max_levels=0)[1]
    report = CR.crawl_report(spark, cut, fetched)
    now = lambda over: spark.createDataFrame([("no2", {"excludeUrls": "p1"}, over)], "crawl_id string, current map<string,string>, override boolean")
    urls = lambda over: {r.url for r in CR.resume_reports(report, fetched, now(over))[0].assets.collect()}
    stored, overridden = urls(False), urls(True)
    assert "https://h.com/p1" in stored and "https://h.com/p2" not in stored
    assert "https://h.com/p1" not in overridden and "https://h.com/p2" in overridden


def test_robots(spark):
    content = "User-agent: *\nAllow:\nSitemap: https://h/s.xml\nSitemap: https://h/s.xml\nDisallow: /x\nCrawl-delay: 2.5\nCrawl-delay: 7\n# Sitemap: https://h/c.xml\n"
    df = spark.createDataFrame([("c", content), ("d", "")], "crawl_id string, content string")
    r = B.parse_robots(df).collect()
    # case-sensitive: "Disallow:" is not "Allow:"; an empty Allow: captures the next token
    assert r[0].allowed == ["Sitemap:"] and r[0].sitemaps == ["https://h/s.xml", "https://h/c.xml"]
    assert r[0].min_crawl_delay == 2 and r[1].min_crawl_delay is None and r[1].allowed == []
    seeds = spark.createDataFrame([("c", "https://h/")], "crawl_id string, url string")
    lvl0 = B.seed_frontier(seeds, df.where("crawl_id = 'c'")).orderBy("rank").collect()
    assert [x.url for x in lvl0] == ["https://h/", "https://h/s.xml", "https://h/c.xml"]


def test_merge_settings(spark):
    df = spark.createDataFrame([({"delay": "100"}, {"delay": "500", "autosave": "60"}, False),
                                ({"delay": "100"}, {"delay": "500"}, True)],
                               "stored map<string,string>, current map<string,string>, o boolean")
    got = df.select(CR.merge_settings(F.col("stored"), F.col("current"), F.col("o")).alias("m")).collect()
    assert got[0].m == {"autosave": "60", "delay": "100"} and got[1].m == {"delay": "500"}


def test_crawl_filters_and_robots_seeds(spark):
    def page(links):
        return "".join(f'<a href="{l}">l</a>' for l in links).encode()
    rows = [
        ("https://h.com/", 200, None, "text/html", page(["/a.png", "/b.html", "/c.weird", "/x/skip"])),
        ("https://h.com/b.html", 200, None, "text/html", page([])),
        ("https://h.com/c.weird", 200, None, "text/html", page([])),
        ("https://h.com/a.png", 200, None, "image/png", b"png"),
        ("https://other.org/sitemap.xml", 200, None, "application/xml",
         b"<urlset><url><loc>https://h.com/from-sitemap.png</loc></url></urlset>"),
    ]
    fetched = CR.fetched_table(_responses(spark, rows))
    seeds = spark.createDataFrame([("c", "https://h.com/")], "crawl_id string, seed string")
    robots = spark.createDataFrame([("c", "Sitemap: https://other.org/sitemap.xml\n")], "crawl_id string, content string")
    log, _, fin = CR.crawl_closure(fetched, seeds, mimes=["text/html"], exclude="/x/", robots=robots)
    got = {(r.url, r.depth) for r in log.collect()}
    # the off-host sitemap is seeded (filters bypassed); its same-host .png link is then filtered by MIME;
    # .png rejected (known, not listed), unknown extension passes, /x/ excluded
    assert got == {("https://h.com/", 0), ("https://other.org/sitemap.xml", 0),
                   ("https://h.com/b.html", 1), ("https://h.com/c.weird", 1)}
    assert fin


def _exchanges(df):
    """(exchanges of the plan, scans that keep their buckets)."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Bucketed: true")


def test_the_seen_set_is_never_exchanged(spark, tmp_dir):
    """Anti joins exchange the new frontier only, whatever the number of tables, adaptive plans included; merging exchanges nothing."""
    from sitelens.sources.bucketed import SeenSet, write_bucketed
    keys = lambda a, b: spark.range(a, b).select((F.col("id") % 7).cast("string").alias("crawl_id"), F.col("id").cast("string").alias("url"))
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = SeenSet(spark, f"{tmp_dir}/seen", CR.KEYS, 4)
        for i in range(3):
            seen.add(*write_bucketed(keys(i * 700, i * 700 + 700).repartition(4, *CR.KEYS), f"{tmp_dir}/t{i}", CR.KEYS, 4))
        assert len(seen.runs) == 3
        cand = spark.range(3000).select((F.col("id") % 7).cast("string").alias("crawl_id"), (F.col("id") * 3).cast("string").alias("url"),
                                        F.col("id").alias("parent_rank"), F.lit(0).alias("pos"))
        cand = cand.withColumn("crawl_id", (F.col("url").cast("long") % 7).cast("string"))
        left = seen.without(CR._first_discovery(cand))
        assert _exchanges(left) == (1, 3)
        assert {int(r.url) for r in left.collect()} == {3 * i for i in range(3000)} - set(range(2100))
        both = seen.runs[0].table.unionByName(seen.runs[1].table).dropDuplicates(CR.KEYS)
        assert _exchanges(both) == (0, 2)
        seen.add(*write_bucketed(keys(2100, 2800).repartition(4, *CR.KEYS), f"{tmp_dir}/t3", CR.KEYS, 4))
        assert [(r.rows, r.table.count()) for r in seen.runs] == [(2800, 2800)]
        assert {int(r.url) for r in seen.without(CR._first_discovery(cand)).collect()} == {3 * i for i in range(3000)} - set(range(2800))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_a_deep_seen_set_keeps_few_tables(spark, tmp_dir):
    """What a chain of many levels rewrites grows as n log n, its tables as log n."""
    from sitelens.sources import bucketed
    written, write = [], bucketed.write_bucketed
    seen = bucketed.SeenSet(spark, f"{tmp_dir}/seen", CR.KEYS, 2)
    try:
        bucketed.write_bucketed = lambda *a: written.append(write(*a)) or written[-1]
        for i in range(66):
            one = spark.range(i, i + 1).select(F.lit("c").alias("crawl_id"), F.col("id").cast("string").alias("url"))
            seen.add(*write(one, f"{tmp_dir}/l{i}", CR.KEYS, 2))
            assert len(seen.runs) <= 9
    finally:
        bucketed.write_bucketed = write
    assert sum(n for _, n in written) <= 66 * 3 and sum(r.rows for r in seen.runs) == 66
    assert seen.without(spark.range(100).select(F.lit("c").alias("crawl_id"), F.col("id").cast("string").alias("url"))).count() == 34


def _chain(spark, n):
    rows = [(f"https://h.com/{i}", 200, None, "text/html", f'<a href="/{i + 1}">n</a><a href="/{i // 2}">b</a>'.encode()) for i in range(n)]
    return _responses(spark, rows)


def test_a_deep_chain_keeps_rows_of_one_size(spark):
    fetched = CR.fetched_table(_chain(spark, 14))
    seeds = spark.createDataFrame([("c", "https://h.com/0")], "crawl_id string, seed string")
    log, state, finished = CR.crawl_closure(fetched, seeds)
    rows = log.collect()
    assert finished and {(r.url, r.depth) for r in rows} == {(f"https://h.com/{i}", i) for i in range(15)}
    assert dict(log.dtypes) == {"crawl_id": "string", "url": "string", "depth": "int", "parent_rank": "bigint", "pos": "int"}


def test_going_on_from_a_state_folder_equals_an_uninterrupted_crawl(spark, tmp_dir):
    fetched = CR.fetched_table(_site(spark))
    seeds = spark.createDataFrame([("https://h.com/", "https://h.com/")], "crawl_id string, seed string")
    full, _, _ = CR.crawl_closure(fetched, seeds)
    want = {(r.url, r.depth) for r in full.collect()}
    for cut in (0, 2):
        _, state, _ = CR.crawl_closure(fetched, seeds, max_levels=cut)
        last = CR.last_level(spark, state)
        assert last == cut
        before = {(r.url, r.depth) for r in CR.frontier_log(spark, state).collect()}
        # a level whose write was not committed does not count, and is written anew
        folder = f"{state.removeprefix('file:')}/levels/level={last + 1}"
        os.makedirs(folder)
        part = glob.glob(f"{state.removeprefix('file:')}/levels/level={last}/part-*")[0]
        with open(part, "rb") as f, open(f"{folder}/{os.path.basename(part)}", "wb") as g:
            g.write(f.read())
        assert CR.last_level(spark, state) == last
        assert {(r.url, r.depth) for r in CR.frontier_log(spark, state).collect()} == before
        assert CR.crawl_report(spark, state, fetched).queue.count() == sum(d == last for _, d in before)
        log, finished = CR.continue_crawl(spark, state, fetched)
        assert finished and {(r.url, r.depth) for r in log.collect()} == want
        assert CR.crawl_state(spark, state).first().finished


def test_a_crawl_without_a_reported_asset_is_exported(spark, tmp_dir):
    rows = [("https://a.com/", 200, None, "text/html", b"x"), ("https://b.com/", 404, None, None, None)]
    fetched = CR.fetched_table(_responses(spark, rows))
    seeds = spark.createDataFrame([(u, u) for u in ("https://a.com/", "https://b.com/")], "crawl_id string, seed string")
    log, state, _ = CR.crawl_closure(fetched, seeds)
    export_report_documents(CR.crawl_report(spark, state, fetched), f"{tmp_dir}/docs")
    meta, assets, _, _ = read_report(spark, f"{tmp_dir}/docs", layout="documents", multi_line=True)
    assert {r.url for r in meta.collect()} == {"https://a.com/", "https://b.com/"} and assets.count() == 1


def test_crawl_assets_go_into_a_report_and_a_diff(spark, tmp_dir):
    from sitelens.operators.diff import diff_snapshots
    from sitelens.operators.lookup import path_index
    fetched = CR.fetched_table(_site(spark))
    seeds = spark.createDataFrame([("https://h.com/", "https://h.com/")], "crawl_id string, seed string")
    log, _, _ = CR.crawl_closure(fetched, seeds)
    a = CR.crawl_assets(log, fetched, snapshot_id=3)
    order = [r.url for r in a.orderBy("depth", "parent_rank", "pos").collect()]
    assert [(r.ord, r.url) for r in a.orderBy("ord").collect()] == list(enumerate(order))
    write_report(a, f"{tmp_dir}/rep", fmt="parquet")
    back = read_report(spark, f"{tmp_dir}/rep", fmt="parquet")[1]
    assert diff_snapshots(a, back).count() == 0 and path_index(back).count() == len(order)


def test_documents_are_valid_json_whatever_the_size(spark, tmp_dir):
    """Documents as a JSON reader sees them: finished and open crawls, no assets, texts that need escapes, a large crawl."""
    n = 30_000
    names = ["crawl_id", "ord", "url", "last_modified", "data_mime", "charset", "hash", "references"]
    big = spark.range(n).select(F.lit("big").alias("crawl_id"), F.col("id").alias("ord"), F.concat(F.lit('https://h/"\\é\n'), "id").alias("url"),
                                F.lit(None).cast("string").alias("last_modified"), F.lit("text/html").alias("data_mime"), F.lit(None).cast("string").alias("charset"),
                                F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.array(F.lit("https://h/a")).alias("references")).select(*names)
    small = big.where("ord in (0, 1)").withColumn("crawl_id", F.lit("open"))
    meta = spark.createDataFrame([("big", "https://h", STARTED, STARTED, "v", {"a": 'x"y'}), ("open", "https://o", STARTED, None, "v", {}),
                                  ("none", "https://n", STARTED, STARTED, "v", None)],
                                 "crawl_id string, url string, started string, finished string, version string, settings map<string,string>")
    queue = spark.createDataFrame([("open", f"q{i}", i) for i in range(12, 0, -1)] + [("big", "never", 1)], "crawl_id string, url string, rank long")
    seen = queue.unionByName(spark.createDataFrame([("open", "z", 0), ("open", "y", 0), ("open", "z", 0)], "crawl_id string, url string, rank long"))
    export_report_documents(CR.Report(meta, big.unionByName(small).repartition(7), queue, seen), f"{tmp_dir}/docs")
    docs = {}
    for f in glob.glob(f"{tmp_dir}/docs/*/*.txt"):
        with open(f, encoding="utf-8") as fh:
            d = json.load(fh)
        assert d["meta"]["url"] not in docs
        docs[d["meta"]["url"]] = d
    assert set(docs) == {"https://h", "https://o", "https://n"}
    assert [a["url"] for a in docs["https://h"]["assets"]] == [f'https://h/"\\é\n{i}' for i in range(n)]
    assert docs["https://h"]["meta"] == {"url": "https://h", "started": STARTED, "finished": STARTED, "version": "v", "settings": {"a": 'x"y'}}
    assert list(docs["https://h"]["assets"][0]) == names[2:] and docs["https://h"]["assets"][0]["charset"] is None
    assert docs["https://n"]["assets"] == [] and docs["https://n"]["meta"]["settings"] == {}
    o = docs["https://o"]["meta"]
    assert "finished" not in o and o["queue"] == [f"q{i}" for i in range(1, 13)] and o["processed"] == ["y", "z", *o["queue"]]
    back = read_report(spark, f"{tmp_dir}/docs", layout="documents", multi_line=True)
    assert back[0].count() == 3 and back[1].count() == n + 2 and back[2].count() == 12 and back[3].count() == 14


def test_damaged_documents_are_set_apart(spark, tmp_dir):
    good = json.dumps({"assets": [], "meta": {"url": "https://g", "started": STARTED, "version": "v", "settings": {}}})
    os.makedirs(f"{tmp_dir}/many")
    for name, text in (("good", good), ("cut", good[:30]), ("list", "[1, 2"), ("bare", '{"meta": {"url": "x"}}'), ("anon", '{"assets": []}')):
        with open(f"{tmp_dir}/many/{name}.json", "w") as f:
            f.write(text)
    for multi in (True, False):
        meta, assets, _, _ = read_report(spark, f"{tmp_dir}/many", layout="documents", multi_line=multi)
        assert [r.crawl_id for r in meta.collect()] == ["https://g"]
        lost = {os.path.basename(r.file): r.reason for r in damaged_documents(spark, f"{tmp_dir}/many", multi).collect()}
        assert lost == {"cut.json": "not a JSON document", "list.json": "not a JSON document", "bare.json": "no assets", "anon.json": "no meta"}


def test_buckets_follow_the_links_not_the_shuffle_partitions(spark, tmp_dir):
    """Each of a crawl's many small jobs starts a task a bucket: 64 shuffle partitions give no more buckets than cores here."""
    from sitelens.sources import bucketed
    h = "https://h.com"
    rows = [(1, i, f"{h}/{i or ''}", 200, None, "text/html", None, f'<a href="/{i + 1}">n</a><a href="/">s</a>'.encode()) for i in range(4)]
    fetched = CR.fetched_table(spark.createDataFrame(rows, RESP))
    seeds = spark.createDataFrame([("c", f"{h}/")], "crawl_id string, seed string")
    prev, limit = spark.conf.get("spark.sql.shuffle.partitions"), bucketed.ROWS_A_BUCKET
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        log, _, finished = CR.crawl_closure(fetched, seeds, state=f"{tmp_dir}/s")
        bucketed.ROWS_A_BUCKET = 1
        more, _, _ = CR.crawl_closure(fetched, seeds, state=f"{tmp_dir}/m")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        bucketed.ROWS_A_BUCKET = limit
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    cores = spark.sparkContext.defaultParallelism
    assert [CR._buckets(spark, f"{tmp_dir}/{d}") for d in "sm"] == [cores, max(cores, 9)] and finished
    want = [(f"{h}/{i or ''}", i) for i in range(5)]
    assert sorted((r.url, r.depth) for r in log.collect()) == want == sorted((r.url, r.depth) for r in more.collect())
