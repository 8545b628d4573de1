"""Registered queries: one per operator of SURVEY §2, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the whole ``pages`` table (through ``fixtures``) and returns
flat, aliased columns so the DuckDB twins in ``oracle_sql`` can be compared
row for row. Arrays are returned joined with a newline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import content as C
from sitelens.functions import mime as M
from sitelens.functions import urls as U
from sitelens.operators import diff as D
from sitelens.operators import extract as E
from sitelens.operators import frontier as FR
from sitelens.operators import robots as B
from sitelens.operators.assets import build_assets
from sitelens.operators.responses import asset_kind, guess_mime, ok_responses, resolve_redirects
from sitelens.plans import crawl as CR
from sitelens.plans import fixtures as FX

NL = "\n"
# Parameters of the filter queries (fixed values of the test setup).
URL_MIMES = ["text/html"]
INCLUDE_RX = "/(en|es|de)/"
EXCLUDE_RX = "[?]"
REPORT_MIMES = ["text/html", "image/png"]


def _joined(c) -> F.Column:
    return F.array_join(c, NL)


# --- diff ------------------------------------------------------------------

def _changes(spark, sf):
    a, b = FX.snapshots(spark, sf)
    return D.diff_snapshots(a, b)


def q_d1(spark, sf):
    a, _ = FX.snapshots(spark, sf)
    return D.last_by_url(a.select("ord", "url", "hash"), ["url", "hash"]).select("url", "ord", "hash")


def q_d5(spark, sf):
    return _changes(spark, sf).select("change_type", "url", "section", "ord", "old_hash", "new_hash")


def _only(kind):
    def q(spark, sf):
        return _changes(spark, sf).where(F.col("change_type") == kind).select("url", "ord", "old_hash", "new_hash")
    return q


def q_d6(spark, sf):
    return D.change_listing(_changes(spark, sf))


def q_d7(spark, sf):
    return D.change_summary(_changes(spark, sf))


def _content(spark, sf):
    a, b = FX.snapshots(spark, sf)
    return a.select("hash", F.col("body").cast("binary").alias("body")).unionByName(
        b.select("hash", F.col("body").cast("binary").alias("body"))).dropDuplicates(["hash"])


def q_d9(spark, sf):
    return D.line_changes(_changes(spark, sf), _content(spark, sf))


# --- response columns --------------------------------------------------------

def q_r1(spark, sf):
    r = resolve_redirects(FX.redirect_responses(spark, sf))
    return r.select("request_url", "final_url", "hops", "outcome", "status")


def q_r1_limits(spark, sf):
    """Every request under limits 1 to 10, with relative Locations failing and resolved."""
    r = FX.redirect_responses(spark, sf).checkpoint(eager=True)
    asked = r.select("request_url").distinct().withColumn("most", F.explode(F.sequence(F.lit(1), F.lit(10))))
    out = [resolve_redirects(r, asked, limit="most", relative=rel).select(
        "request_url", F.col("most").alias("most"), F.lit(rel).alias("relative"), "final_url", "hops", "outcome", "status") for rel in (False, True)]
    return out[0].unionByName(out[1])


def q_r2(spark, sf):
    resp = FX.redirect_responses(spark, sf)
    return ok_responses(resp).select("request_url", "status")


def q_r3(spark, sf):
    r = FX.responses(spark, sf)
    ct = C.parse_content_type(F.col("content_type"))
    return r.select("page_id", ct["media_type"].alias("media_type"), ct["charset"].alias("charset"))


def q_r4(spark, sf):
    r = FX.responses(spark, sf)
    ct = C.parse_content_type(F.col("content_type"))
    return r.select("page_id", guess_mime(ct["media_type"], F.col("request_url")).alias("data_mime"))


def q_r5(spark, sf):
    r = FX.responses(spark, sf)
    return r.select("page_id", "last_modified_hdr", C.parse_date(F.col("last_modified_hdr")).alias("last_modified"))


def q_r5_forms(spark, sf):
    """Seven date forms that pages use, each made from a time of the page's own."""
    t = F.expr("TIMESTAMP_NTZ '2001-01-01 00:00:00' + make_dt_interval(0, 0, 0, page_id * 86461 + page_id % 7 * 3600)")
    forms = ["yyyy-MM-dd'T'HH:mm", "EEE, d MMM yyyy HH:mm:ss 'EST'", "d MMM yyyy hh:mm a", "MMMM yyyy", "yyyy-M-d", "MMM d, yyyy",
             "yyyy/MM/dd HH:mm:ss '-0700'"]
    texts = F.array(*[F.date_format(t, f) for f in forms])
    p = FX.pages(spark, sf).select("page_id", F.posexplode(texts).alias("form", "text"))
    return p.select("page_id", F.col("form").cast("int").alias("form"), "text", C.parse_date(F.col("text")).alias("last_modified"))


def q_r6(spark, sf):
    p = FX.pages(spark, sf)
    return p.select("page_id", C.content_hash(F.col("html").cast("binary")).alias("hash"))


def q_r7(spark, sf):
    p = FX.pages(spark, sf)
    return p.select("page_id", C.decode_text(F.col("html").cast("binary")).alias("text"))


def q_r8(spark, sf):
    r = FX.responses(spark, sf).select("request_url", "content_type")
    s = FX.sitemaps(spark, sf).select("request_url", "content_type")
    both = r.unionByName(s)
    ct = C.parse_content_type(F.col("content_type"))
    mime = guess_mime(ct["media_type"], F.col("request_url"))
    return both.select("request_url", asset_kind(mime, F.col("request_url")).alias("kind"))


def q_s5(spark, sf):
    from sitelens.session import scratch_dir
    from sitelens.sources.responses import read_responses, write_responses
    path = scratch_dir(spark, "responses")
    write_responses(FX.responses(spark, sf).drop("page_id"), path)
    r = read_responses(spark, path)
    return r.select("snapshot_id", "ord", "request_url", "status", "content_type",
                    C.content_hash(F.col("body")).alias("hash"))


# --- URL functions -----------------------------------------------------------

def _urls(spark, sf):
    """Page urls plus every anchor resolved against its page (reference form)."""
    p = FX.pages(spark, sf)
    page_urls = p.select(F.col("url").alias("u"))
    refs = p.select(F.regexp_extract("url", FX.ORIGIN_RX, 1).alias("o"),
                    F.explode(F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"'), 1)).alias("h"))
    return page_urls.unionByName(refs.select(U.pct_encode_nonascii(F.concat("o", "h")).alias("u")))


def q_u1(spark, sf):
    return U.with_report_key(_urls(spark, sf), "u", "report_key")


def q_u2(spark, sf):
    return _urls(spark, sf).select("u", U.strip_fragment(F.col("u")).alias("v"))


def q_u3(spark, sf):
    return _urls(spark, sf).select("u", U.url_host(F.col("u")).alias("v"))


def q_u4(spark, sf):
    return _urls(spark, sf).select("u", U.url_path(F.col("u")).alias("v"))


def q_u5(spark, sf):
    return _urls(spark, sf).select("u", M.mime_for_path(U.url_path(F.col("u"))).alias("v"))


# --- extraction --------------------------------------------------------------

def _page_refs(spark, sf):
    p = FX.pages(spark, sf).select("page_id", F.split_part("url", F.lit("#"), F.lit(1)).alias("url"), "html")
    return p.select("page_id", "url", E.html_raw_references(F.col("html")).alias("raw"))


def q_e1(spark, sf):
    r = _page_refs(spark, sf)
    return r.select("page_id", F.size("raw").cast("int").alias("n_refs"), _joined(F.col("raw")).alias("refs"))


def q_e2(spark, sf):
    r = E.with_references(_page_refs(spark, sf), "raw", "url", "references")
    return r.select("page_id", F.size("references").cast("int").alias("n_refs"),
                    _joined(F.col("references")).alias("refs"))


def q_e1_wild(spark, sf):
    r = FX.wild_pages(spark, sf).select("page_id", E.html_raw_references(F.col("html")).alias("raw"))
    return r.select("page_id", F.size("raw").cast("int").alias("n_refs"), _joined(F.col("raw")).alias("refs"))


def q_e2_wild(spark, sf):
    r = FX.wild_pages(spark, sf).select("page_id", "url", E.html_raw_references(F.col("html")).alias("raw"))
    r = E.with_references(r, "raw", "url", "references")
    return r.select("page_id", F.size("references").cast("int").alias("n_refs"), _joined(F.col("references")).alias("refs"))


def q_p1_wild(spark, sf):
    r = FX.wild_pages(spark, sf).select(
        "page_id", F.col("url").alias("final_url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"),
        F.lit(None).cast("string").alias("last_modified_hdr"), F.col("html").cast("binary").alias("body"))
    a = build_assets(r, keep=["page_id"])
    return a.select("page_id", "url", "data_mime", F.size("references").cast("int").alias("n_refs"),
                    _joined(F.col("references")).alias("refs"))


def q_e4_prologues(spark, sf):
    s = FX.wild_sitemaps(spark, sf)
    s = s.select("request_url", E.sitemap_raw_locs(C.decode_text(F.col("body"))).alias("raw"))
    r = E.with_references(s, "raw", "request_url", "references", unescape=False)
    return r.select("request_url", F.size("references").cast("int").alias("n_refs"), _joined(F.col("references")).alias("refs"))


def q_e3(spark, sf):
    p = FX.meta_pages(spark, sf)
    return p.select("page_id", E.html_meta_dates(F.col("html")).alias("last_modified"))


def q_e4(spark, sf):
    s = FX.sitemaps(spark, sf)
    s = s.select("request_url", E.sitemap_raw_locs(C.decode_text(F.col("body"))).alias("raw"))
    r = E.with_references(s, "raw", "request_url", "references", unescape=False)
    return r.select("request_url", F.size("references").cast("int").alias("n_refs"),
                    _joined(F.col("references")).alias("refs"))


def q_e5(spark, sf):
    r = E.with_references(_page_refs(spark, sf), "raw", "url", "references")
    e = E.link_edges(r, "url", "references", keep=["page_id"])
    return e.select("page_id", "src", F.col("pos").cast("int").alias("pos"), "dst", "dst_key")


def _assets(spark, sf, persist: bool = False):
    """P1 over the FX1 responses. ``persist`` stands for the canonical assets
    table: consumers read the checkpointed slim rows instead of re-planning
    the extraction inside their own joins."""
    r = FX.responses(spark, sf).withColumn("final_url", F.col("request_url"))
    a = build_assets(r, keep=["ord"])
    return a.checkpoint(eager=True) if persist else a


def q_p1(spark, sf):
    a = _assets(spark, sf)
    return a.select("ord", "url", "last_modified", "data_mime", "charset", "hash",
                    F.size("references").cast("int").alias("n_refs"), _joined(F.col("references")).alias("refs"),
                    "kind")


# --- frontier ------------------------------------------------------------------

def _cands(spark, sf):
    g = FX.link_graph(spark, sf).select("host", "src", "dst", "pos")
    return g.unionByName(FX.offhost_links(spark, sf))


def q_f1(spark, sf):
    return FR.filter_url_mime(_cands(spark, sf), "dst", URL_MIMES).select("src", "dst")


def q_f2(spark, sf):
    return FR.filter_same_host(_cands(spark, sf), "dst", "host").select("src", "dst")


def q_f3(spark, sf):
    return FR.filter_include(_cands(spark, sf), "dst", INCLUDE_RX).select("src", "dst")


def q_f4(spark, sf):
    return FR.filter_exclude(_cands(spark, sf), "dst", EXCLUDE_RX).select("src", "dst")


def q_f5(spark, sf):
    d = FR.enqueue_decisions(_cands(spark, sf), "dst", "host", ["application/pdf"], INCLUDE_RX, EXCLUDE_RX)
    return d.select("src", "dst", "keep", "skip_reason")


def _level_cands(spark, sf):
    g = FX.link_graph(spark, sf)
    return g.select(F.col("host").alias("crawl_id"), F.col("dst").alias("url"),
                    F.col("src_rn").cast("long").alias("parent_rank"), "pos")


def _seen(spark, sf):
    """A crawl that is half through: the first half of every host's pages has been seen."""
    h = FX.hosted_pages(spark, sf)
    n = h.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return h.join(n, "host").where(F.col("rn") * 2 <= F.col("n")).select(F.col("host").alias("crawl_id"), "url")


def q_f6(spark, sf):
    return FR.new_frontier(_level_cands(spark, sf), _seen(spark, sf)).select(
        "crawl_id", "url", "parent_rank", F.col("pos").cast("int").alias("pos"))


def q_f7(spark, sf):
    g = FX.link_graph(spark, sf).select(F.col("host").alias("crawl_id"), F.col("dst").alias("url"))
    return FR.block_urls(_seen(spark, sf), g)


def q_f8(spark, sf):
    nf = FR.new_frontier(_level_cands(spark, sf), _seen(spark, sf))
    return FR.fifo_rank(nf).select("crawl_id", "url", "rank")


def _closure(spark, sf, **kw):
    fetched = CR.fetched_table(FX.crawl_responses(spark, sf))
    seeds = FX.seeds(spark, sf).select(F.col("seed").alias("crawl_id"), "seed")
    log, state, finished = CR.crawl_closure(fetched, seeds, **kw)
    return log, fetched, state


def q_f9(spark, sf):
    log, _, _ = _closure(spark, sf)
    return log.select("crawl_id", "url", F.col("depth").cast("int").alias("depth"))


def q_f10(spark, sf):
    return FR.filter_asset_mime(_assets(spark, sf, True), REPORT_MIMES).select("ord", "url", "data_mime")


def q_f11(spark, sf):
    log, _, _ = _closure(spark, sf)
    return FR.crawl_progress(log).select("crawl_id", F.col("depth").cast("int").alias("depth"),
                                         "processed", "total")


# --- robots ------------------------------------------------------------------------

def q_b1(spark, sf):
    return FX.pages(spark, sf).select("page_id", B.robots_url(F.col("url")).alias("robots_url"))


def q_b2(spark, sf):
    r = FX.robots(spark, sf)
    return r.select("page_id", _joined(B.robots_allowed(F.col("content"))).alias("allowed"))


def q_b3(spark, sf):
    r = FX.robots(spark, sf)
    return r.select("page_id", B.robots_min_delay(F.col("content")).alias("min_crawl_delay"))


def q_b4(spark, sf):
    r = FX.robots(spark, sf)
    return r.select("page_id", _joined(B.robots_sitemaps(F.col("content"))).alias("sitemaps"))


def q_b5(spark, sf):
    seeds = FX.seeds(spark, sf).select(F.col("seed").alias("crawl_id"), F.col("seed").alias("url"))
    rb = FX.robots(spark, sf).join(
        FX.hosted_pages(spark, sf).where(F.col("rn") == 1).select("page_id", F.col("url").alias("crawl_id")),
        "page_id")
    return B.seed_frontier(seeds, rb.select("crawl_id", "content")).select("crawl_id", "url", "rank")


# --- report, state, resume, streaming, store, lookup -----------------------------

def q_p2(spark, sf):
    fetched = CR.fetched_table(FX.crawl_responses(spark, sf))
    seeds = FX.seeds(spark, sf).select(F.col("seed").alias("crawl_id"), "seed")
    _, state, _ = CR.crawl_closure(fetched, seeds, max_levels=2)
    return CR.crawl_state(spark, state).select("crawl_id", "finished", "n_queue", "n_seen")


STARTED = "2024-01-01T00:00:00.000Z"


def _stored_seeds(spark, sf, settings=None):
    """One crawl per host with what a stored report says of it."""
    s = FX.seeds(spark, sf).select(F.col("crawl_id").alias("host"), "seed")
    default = F.create_map(F.lit("delay"), F.lit("500"))
    return s.select(F.col("seed").alias("crawl_id"), "seed", "host", F.lit(STARTED).alias("started"),
                    (default if settings is None else settings).alias("settings"))


def q_f8_log(spark, sf):
    """The FIFO rank of every url of whole crawls."""
    log, _, _ = _closure(spark, sf)
    return CR.ranked_log(log).select("crawl_id", "url", F.col("depth").cast("int").alias("depth"), "rank")


def q_p3(spark, sf):
    """Crawls cut after two levels, reported, stored, read back and resumed: the merged reports of those that were unfinished."""
    from sitelens.session import scratch_dir
    from sitelens.sources.report import read_report, write_report
    fetched = CR.fetched_table(FX.crawl_responses(spark, sf))
    _, state, _ = CR.crawl_closure(fetched, _stored_seeds(spark, sf), max_levels=2)
    cut, path = CR.crawl_report(spark, state, fetched), scratch_dir(spark, "report")
    write_report(cut.assets, path, cut.meta, cut.queue, cut.processed)
    meta, assets, queue, processed = read_report(spark, path)
    whole, _ = CR.resume_reports(CR.Report(meta, assets, queue, processed), fetched)
    about = whole.meta.where("finished is not null").select(
        "crawl_id", "started", F.col("url").alias("target"), F.array_join(F.transform(
            F.map_entries("settings"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), NL).alias("settings"))
    return whole.assets.join(about, "crawl_id").select("crawl_id", "ord", "url", "started", "target", "settings")


def _settings_reports(spark, sf):
    """Stored report documents, one per host, whose settings differ by host; read back as meta rows."""
    from sitelens.session import scratch_dir
    from sitelens.sources.report import read_report
    k = F.length("host") % 4
    settings = F.map_filter(F.create_map(
        F.lit("delay"), (F.length("host") * 100).cast("string"), F.lit("excludeUrls"), F.when(k == 0, EXCLUDE_RX),
        F.lit("includeUrls"), F.when(k == 1, INCLUDE_RX), F.lit("mimeFilter"), F.when(k == 2, ", ".join(REPORT_MIMES))),
        lambda _, v: v.isNotNull())
    docs = _stored_seeds(spark, sf, settings).select(F.array().cast("array<string>").alias("assets"), F.struct(
        F.col("seed").alias("url"), "started", "settings").alias("meta"))
    path = scratch_dir(spark, "settings-reports")
    docs.write.json(path)
    return read_report(spark, path, layout="documents")[0]


def _merged(meta):
    """The settings that each stored report is resumed under; reports of some hosts are overridden."""
    current = F.create_map(F.lit("delay"), F.lit("750"), F.lit("autosave"), F.lit("60"), F.lit("mimeFilter"), F.lit(""))
    override = F.ascii(F.right(U.url_host(F.col("url")), F.lit(1))) % 5 == 0
    return CR.merge_settings(F.col("settings"), current, override)


def q_p4(spark, sf):
    meta = _settings_reports(spark, sf)
    flat = F.array_join(F.transform(F.array_sort(F.map_entries(_merged(meta))),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), NL)
    return meta.select("crawl_id", flat.alias("settings"))


def q_p4_closure(spark, sf):
    """All crawls in one closure, each under the filters of its merged settings."""
    meta = _settings_reports(spark, sf)
    seeds = meta.select("crawl_id", F.col("url").alias("seed"), "started", _merged(meta).alias("settings"))
    fetched = CR.fetched_table(FX.crawl_responses(spark, sf))
    log, _, _ = CR.crawl_closure(fetched, seeds)
    return CR.ranked_log(log).select("crawl_id", "url", F.col("depth").cast("int").alias("depth"), "rank")


def q_t1(spark, sf):
    from sitelens.streaming.assets_stream import run_assets_stream_on
    out = run_assets_stream_on(spark, FX.responses(spark, sf).drop("page_id"))
    return out.select("ord", "url", "data_mime", "charset", "hash",
                      F.size("references").cast("int").alias("n_refs"))


def q_t1_crawl(spark, sf):
    """Crawls of all hosts over responses that arrive in three batches, in no order of their links."""
    from sitelens.session import scratch_dir
    from sitelens.sources.responses import write_responses
    from sitelens.streaming.crawl_stream import stream_crawl
    base, responses = scratch_dir(spark, "crawl-stream"), FX.crawl_responses(spark, sf).checkpoint(eager=True)
    seeds = FX.seeds(spark, sf).select(F.col("seed").alias("crawl_id"), "seed")
    arrival = F.pmod(F.xxhash64("request_url"), F.lit(3))       # answers of one url arrive together
    for i in (2, 0, 1):
        write_responses(responses.where(arrival == i), f"{base}/in")
        crawl = stream_crawl(spark, f"{base}/in", f"{base}/state", f"{base}/checkpoint", seeds)
    part = lambda df, name, url="url": df.select("crawl_id", F.lit(name).alias("part"), F.col(url).alias("url"))     # noqa: E731
    return part(crawl.seen(), "seen").unionByName(part(crawl.frontier(), "frontier")) \
        .unionByName(part(crawl.report_assets(), "asset", "request_url"))


def q_s1(spark, sf):
    from sitelens.session import scratch_dir
    from sitelens.sources.report import read_report, write_report
    a = _assets(spark, sf, True).withColumn("crawl_id", F.lit("snapshot-1"))
    path = scratch_dir(spark, "report-lines")
    write_report(a.select("crawl_id", "ord", "url", "last_modified", "data_mime", "charset", "hash",
                          "references"), path)
    _, assets, _, _ = read_report(spark, path)
    return assets.select("ord", "url", "last_modified", "data_mime", "charset", "hash",
                         F.size("references").cast("int").alias("n_refs"))


def _report_documents(spark, sf):
    """One report document per host as the reference writes them: an asset per page in page order, null hashes,
    an empty reference list; every second report unfinished, with a queue."""
    h = FX.hosted_pages(spark, sf)
    asset = F.struct(F.col("url"), F.lit(None).cast("string").alias("last_modified"), F.lit("text/html").alias("data_mime"),
                     F.lit(None).cast("string").alias("charset"),
                     F.when(F.col("rn") % 3 != 0, F.sha2(F.col("html").cast("binary"), 256)).alias("hash"),
                     F.array().cast("array<string>").alias("references"))
    docs = h.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rn", asset.alias("a")))).alias("l"))
    part = F.length("host") % 2 == 0
    urls = F.transform("l", lambda x: x["a"]["url"])
    meta = F.struct(F.concat(F.lit("https://"), "host").alias("url"), F.lit("2024-01-01T00:00:00.000Z").alias("started"),
                    F.when(~part, F.lit("2024-01-02T00:00:00.000Z")).alias("finished"),
                    F.when(part, F.slice(urls, 1, 2)).alias("queue"), F.when(part, urls).alias("processed"),
                    F.lit("1").alias("version"), F.create_map(F.lit("delay"), F.lit("500")).alias("settings"))
    return docs.select(F.transform("l", lambda x: x["a"]).alias("assets"), meta.alias("meta"))


def q_s1_damaged(spark, sf):
    """Report documents of which some are cut off or hold no assets: sound ones are read, the others are set apart."""
    from sitelens.session import scratch_dir
    from sitelens.sources.report import damaged_documents, read_report
    path, k = scratch_dir(spark, "report-damaged"), F.length(F.regexp_extract("meta.url", FX.HOST_RX, 1)) % 3
    docs = _report_documents(spark, sf)
    whole = F.to_json(F.struct("assets", "meta"))
    cut = F.expr("left(whole, cast(length(whole) / 2 as int))")
    text = docs.withColumn("whole", whole).select(
        F.when(k == 1, cut).when(k == 2, F.to_json(F.struct("meta"))).otherwise(F.col("whole")).alias("value"))
    text.write.text(path)
    meta, assets, _, _ = read_report(spark, path, layout="documents")
    sound = meta.agg(F.count(F.lit(1)).alias("n_documents")).crossJoin(assets.agg(F.count(F.lit(1)).alias("n_assets"))) \
        .select(F.lit("sound").alias("state"), "n_documents", "n_assets")
    lost = damaged_documents(spark, path).groupBy(F.col("reason").alias("state")).agg(
        F.count(F.lit(1)).alias("n_documents"), F.lit(0).cast("long").alias("n_assets"))
    return sound.unionByName(lost)


def q_s2_write(spark, sf):
    """Reports of crawls cut after two levels, exported as one JSON document a crawl and read back."""
    from sitelens.session import scratch_dir
    from sitelens.sources.report import export_report_documents, read_report
    fetched = CR.fetched_table(FX.crawl_responses(spark, sf))
    _, state, _ = CR.crawl_closure(fetched, _stored_seeds(spark, sf), max_levels=2)
    path = scratch_dir(spark, "report-documents")
    export_report_documents(CR.crawl_report(spark, state, fetched), path)
    meta, assets, queue, processed = read_report(spark, path, layout="documents", multi_line=True)
    zero = F.lit(0).cast("long").alias("place")
    return (assets.select("crawl_id", F.lit("asset").alias("part"), F.col("ord").alias("place"), "url")
            .unionByName(queue.select("crawl_id", F.lit("queue").alias("part"), F.col("rank").alias("place"), "url"))
            .unionByName(processed.select("crawl_id", F.lit("processed").alias("part"), zero, "url"))
            .unionByName(meta.where(F.col("started") == STARTED).select(
                "crawl_id", F.when(F.col("finished").isNull(), "open").otherwise("finished").alias("part"), zero, "url")))


def q_s2(spark, sf):
    """Pretty-printed report documents, one per file, read back as multi-line JSON: assets in array order."""
    from sitelens.session import scratch_dir
    from sitelens.sources.report import read_report
    path = scratch_dir(spark, "report-docs")
    docs = _report_documents(spark, sf)
    text = docs.select(F.to_json(F.struct("assets", "meta"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))
    text.withColumn("k", F.xxhash64("value")).repartition("k").write.partitionBy("k").text(path)
    _, assets, queue, _ = read_report(spark, f"{path}/*/*.txt", layout="documents", multi_line=True)
    queued = queue.select("crawl_id", "url", F.col("rank").alias("queue_rank"))
    return assets.join(queued, ["crawl_id", "url"], "left").select("crawl_id", "ord", "url", "hash", "queue_rank")


def q_c1(spark, sf):
    """Two crawls (the second with an exclude filter, over partly changed bodies), written as reports, read and diffed."""
    from sitelens.session import scratch_dir
    from sitelens.sources.report import read_report, write_report
    sides = []
    for snap, (rows, kw) in enumerate([(FX.crawl_responses(spark, sf), {}), (FX.changed_responses(spark, sf), {"exclude": EXCLUDE_RX})]):
        fetched = CR.fetched_table(rows)
        seeds = FX.seeds(spark, sf).select(F.col("seed").alias("crawl_id"), "seed")
        log, _, _ = CR.crawl_closure(fetched, seeds, **kw)
        path = scratch_dir(spark, f"report-{snap}")
        write_report(CR.crawl_assets(log, fetched, snapshot_id=snap), path, fmt="parquet")
        sides.append(read_report(spark, path, fmt="parquet")[1])
    d = D.diff_snapshots(*[s.select("crawl_id", "ord", "url", "hash", "last_modified") for s in sides], by=["crawl_id"])
    return d.select("crawl_id", "change_type", "url")


def q_s3(spark, sf):
    from sitelens.session import scratch_dir
    from sitelens.sources.store import save_content
    a, b = FX.snapshots(spark, sf)
    store = scratch_dir(spark, "store")
    to_resp = lambda s: s.select(F.lit(200).alias("status"), F.col("body").cast("binary").alias("body"))
    save_content(to_resp(a), store)
    added = save_content(to_resp(b), store)
    return added.select("hash", F.length("body").cast("long").alias("n_bytes"))


def q_s4(spark, sf):
    from sitelens.session import scratch_dir
    from sitelens.sources.store import load_content, save_content
    a, b = FX.snapshots(spark, sf)
    store = scratch_dir(spark, "store")
    save_content(a.select(F.lit(200).alias("status"), F.col("body").cast("binary").alias("body")), store)
    keys = b.select("url", "hash")
    got = load_content(keys, store)
    return got.select("url", "hash", F.col("body").isNotNull().alias("found"),
                      F.length("body").cast("long").alias("n_bytes"))


def _lookup_requests(spark, sf):
    p = FX.pages(spark, sf)
    paths = p.select(U.url_path(F.split_part("url", F.lit("#"), F.lit(1))).alias("path"))
    hrefs = p.select(F.explode(F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"'), 1)).alias("path"))
    return paths.unionByName(hrefs).distinct()


def q_v1(spark, sf):
    from sitelens.operators.lookup import path_index
    return path_index(_assets(spark, sf, True)).select("path", "hash", "data_mime")


def q_v2(spark, sf):
    from sitelens.operators.lookup import resolve_requests
    a, b = FX.snapshots(spark, sf)
    content = a.select("hash", F.col("body").cast("binary").alias("body")).dropDuplicates(["hash"])
    assets = _assets(spark, sf, True)
    return resolve_requests(_lookup_requests(spark, sf), assets, content).select(
        "path", "status", "content_type", "hash")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "d1_last_by_url": q_d1,
    "d2_added": _only("added"),
    "d3_modified": _only("modified"),
    "d4_removed": _only("removed"),
    "d5_diff_snapshots": q_d5,
    "d6_change_listing": q_d6,
    "d7_change_summary": q_d7,
    "d9_line_changes": q_d9,
    "r1_resolve_redirects": q_r1,
    "r1_redirect_limits": q_r1_limits,
    "r2_ok_responses": q_r2,
    "r3_content_type": q_r3,
    "r4_guess_mime": q_r4,
    "r5_http_date": q_r5,
    "r5_date_forms": q_r5_forms,
    "r6_content_hash": q_r6,
    "r7_decode_text": q_r7,
    "r8_asset_kind": q_r8,
    "s1_read_report": q_s1,
    "s1_damaged_reports": q_s1_damaged,
    "s2_read_documents": q_s2,
    "s2_write_report": q_s2_write,
    "c1_crawl_report_diff": q_c1,
    "s3_save_content": q_s3,
    "s4_load_content": q_s4,
    "s5_read_responses": q_s5,
    "u1_report_key": q_u1,
    "u2_strip_fragment": q_u2,
    "u3_url_host": q_u3,
    "u4_url_path": q_u4,
    "u5_mime_for_path": q_u5,
    "e1_html_references": q_e1,
    "e2_resolve_references": q_e2,
    "e1_html_references_wild": q_e1_wild,
    "e2_resolve_references_wild": q_e2_wild,
    "e4_sitemap_prologues": q_e4_prologues,
    "p1_build_assets_wild": q_p1_wild,
    "e3_html_last_modified": q_e3,
    "e4_sitemap_references": q_e4,
    "e5_link_edges": q_e5,
    "p1_build_assets": q_p1,
    "f1_filter_url_mime": q_f1,
    "f2_filter_same_host": q_f2,
    "f3_filter_include": q_f3,
    "f4_filter_exclude": q_f4,
    "f5_enqueue_decisions": q_f5,
    "f6_new_frontier": q_f6,
    "f7_block_urls": q_f7,
    "f8_fifo_rank": q_f8,
    "f9_crawl_closure": q_f9,
    "f10_filter_asset_mime": q_f10,
    "f11_crawl_progress": q_f11,
    "b1_robots_url": q_b1,
    "b2_robots_allowed": q_b2,
    "b3_robots_min_delay": q_b3,
    "b4_robots_sitemaps": q_b4,
    "b5_seed_frontier": q_b5,
    "p2_crawl_state": q_p2,
    "p3_resume_crawl": q_p3,
    "p4_merge_settings": q_p4,
    "p4_settings_closure": q_p4_closure,
    "f8_log_rank": q_f8_log,
    "t1_stream_assets": q_t1,
    "t1_stream_crawl": q_t1_crawl,
    "v1_path_index": q_v1,
    "v2_resolve_requests": q_v2,
}
