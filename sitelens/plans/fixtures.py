"""Inputs derived by Spark from the driver's ``pages`` table (see FIXTURES.md).

The reference works on fetched responses and reports; the driver supplies raw
pages. These derivations turn every page into the shapes the operators take
(responses, two snapshots, a link graph, robots files, sitemaps, redirect
chains), so every registered query reads the whole ``pages`` table and its
work grows with it. Each derivation has a SQL twin in ``oracle_sql``.
The ``page_id`` modulo rules below only decide which variant a page becomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators.ranking import ordinal_within
from sitelens.session import spread

ORIGIN_RX = r"^(https?://[^/?#]+)"
HOST_RX = r"^https?://([^/?#]+)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _noframe(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def _pid() -> Column:
    return F.col("page_id")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX1: one 200 response per page, five Content-Type variants, three header variants."""
    p = pages(spark, sf_dir)
    m5 = _pid() % 5
    ct = (F.when(m5 == 0, F.lit("text/html; charset=utf-8"))
          .when(m5 == 1, F.lit("text/html;Charset=ISO-8859-1"))
          .when(m5 == 2, F.lit("application/xhtml+xml"))
          .when(m5 == 3, F.lit("image/png"))
          .otherwise(F.lit(None).cast("string")))
    m3 = _pid() % 3
    ts = F.timestamp_seconds(F.lit(1577836800) + _pid() * 3607)
    utc = F.to_utc_timestamp(ts, F.current_timezone())   # UTC wall clock whatever the session zone
    hdr = (F.when(m3 == 0, F.concat(F.date_format(utc, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
           .when(m3 == 2, F.lit("not a date")))
    return p.select(
        "page_id", F.lit(1).alias("snapshot_id"), _pid().alias("ord"),
        _noframe(F.col("url")).alias("request_url"), F.lit(200).alias("status"),
        F.lit(None).cast("string").alias("location"), ct.alias("content_type"),
        hdr.alias("last_modified_hdr"), F.col("html").cast("binary").alias("body"))


def _snap_lm() -> Column:
    return F.when(_pid() % 4 == 0, F.concat(
        F.lit("2024-05-"), F.lpad((_pid() % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00.000Z")))


_SNAPS: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """FX2: two snapshots with removed, added, modified and duplicate urls.

    Snapshots stand for stored reports, so they are materialized once per
    session and folder (checkpointed with their hash) and shared by the diff
    queries instead of being re-derived in every branch of every plan.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SNAPS:
        a, b = _derive_snapshots(spark, sf_dir)
        _SNAPS[key] = (a.checkpoint(eager=True), b.checkpoint(eager=True))
    return _SNAPS[key]


def _derive_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = pages(spark, sf_dir).select("page_id", _noframe(F.col("url")).alias("url"), "html")
    a = p.where(_pid() % 11 != 4).select(_pid().alias("ord"), "url", F.col("html").alias("body"),
                                         _snap_lm().alias("last_modified"))
    a_dup = p.where(_pid() % 50 == 0).select(
        (_pid() + 1000000).alias("ord"), "url", F.concat("html", F.lit("<!-- dup -->")).alias("body"),
        F.lit(None).cast("string").alias("last_modified"))
    body_b = F.when(_pid() % 7 == 0, F.concat("html", F.lit("<!-- v2 -->"))).otherwise(F.col("html"))
    b = p.where(_pid() % 10 != 3).select(_pid().alias("ord"), "url", body_b.alias("body"),
                                         _snap_lm().alias("last_modified"))
    b_dup = p.where(_pid() % 60 == 0).select(
        (_pid() + 1000000).alias("ord"), "url", F.col("html").alias("body"),
        F.lit(None).cast("string").alias("last_modified"))

    def hashed(df):
        return df.withColumn("hash", F.sha2(F.col("body").cast("binary"), 256))
    return hashed(a.unionByName(a_dup)), hashed(b.unionByName(b_dup))


_HOSTED: dict[tuple[str, str], DataFrame] = {}


def hosted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with host and their 1-based rank inside the host (by page_id).

    The ranked table is checkpointed by ``ordinal_within``; it is kept per
    session and folder so the derivations below share one computation.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _HOSTED:
        p = pages(spark, sf_dir).select(
            "page_id", _noframe(F.col("url")).alias("url"), "html",
            F.regexp_extract("url", HOST_RX, 1).alias("host"))
        _HOSTED[key] = ordinal_within(p, ["host"], ["page_id"], out="rn").checkpoint(eager=True)
    return _HOSTED[key]


def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX3: host, src, dst, pos: heap tree (children 2r, 2r+1) plus back link r-1.

    Expressed as three equi-joins on (host, rank) instead of one OR join.
    """
    h = hosted_pages(spark, sf_dir).select("host", "rn", "url")
    parts = []
    for pos, rel in enumerate([F.col("rn") * 2, F.col("rn") * 2 + 1, F.col("rn") - 1]):
        src = h.select("host", F.col("url").alias("src"), rel.alias("crn"), F.col("rn").alias("src_rn"))
        dst = h.select("host", F.col("rn").alias("crn"), F.col("url").alias("dst"))
        parts.append(src.join(dst, ["host", "crn"]).select(
            "host", "src", "dst", F.lit(pos).alias("pos"), "src_rn"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def offhost_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One link per page to the next page by page_id in another host (exercises F2)."""
    h = hosted_pages(spark, sf_dir).select("page_id", "host", "url")
    nxt = h.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("dst"),
                   F.col("host").alias("dst_host"))
    return (h.join(nxt, "page_id").where(F.col("host") != F.col("dst_host"))
            .select("host", F.col("url").alias("src"), "dst", F.lit(3).alias("pos")))


def crawl_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX3 end to end: each page's html gets one anchor per graph edge plus its off-host link."""
    g = link_graph(spark, sf_dir).select("src", "dst", "pos").unionByName(
        offhost_links(spark, sf_dir).select("src", "dst", "pos"))
    anchors = (g.groupBy("src").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "dst"))),
        lambda s: F.concat(F.lit('<a href="'), s["dst"], F.lit('">l</a>'))), "").alias("extra")))
    p = hosted_pages(spark, sf_dir)
    body = F.concat(F.col("html"), F.coalesce(F.col("extra"), F.lit("")))
    return (p.join(anchors, p.url == anchors.src, "left")
            .select(F.lit(1).alias("snapshot_id"), F.col("page_id").alias("ord"),
                    F.col("url").alias("request_url"), F.lit(200).alias("status"),
                    F.lit(None).cast("string").alias("location"),
                    F.lit("text/html; charset=utf-8").alias("content_type"),
                    F.lit(None).cast("string").alias("last_modified_hdr"),
                    body.cast("binary").alias("body")))


def changed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl's responses at a later date: bodies of pages with page_id % 7 = 0 have changed."""
    r = crawl_responses(spark, sf_dir)
    return r.withColumn("body", F.when(F.col("ord") % 7 == 0, F.concat("body", F.lit("<!-- v2 -->").cast("binary")))
                        .otherwise(F.col("body")))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One crawl per host, seeded with the host's first page."""
    h = hosted_pages(spark, sf_dir)
    return h.where(F.col("rn") == 1).select(F.col("host").alias("crawl_id"), F.col("url").alias("seed"))


def redirect_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX4 from pages: inside a host, page r answers 301 -> page r-1 except at ranks
    1, 13, 25, ... (chains of up to 11 requests, so both sides of the limit occur);
    rank 2 of hosts starting with ``m.`` points back to rank 3 (a cycle that
    hits the limit), pages with page_id % 17 = 5 answer 404, % 19 = 7 a 301
    without Location, % 23 = 11 a relative Location."""
    h = hosted_pages(spark, sf_dir)
    prev = h.select("host", (F.col("rn") + 1).alias("rn"), F.col("url").alias("prev_url"))
    nxt = h.select("host", (F.col("rn") - 1).alias("rn"), F.col("url").alias("next_url"))
    j = h.join(prev, ["host", "rn"], "left").join(nxt, ["host", "rn"], "left")
    cyc = F.col("host").startswith("m.") & (F.col("rn") == 2) & F.col("next_url").isNotNull()
    status = (F.when(_pid() % 17 == 5, F.lit(404))
              .when(_pid() % 19 == 7, F.lit(301))
              .when(_pid() % 23 == 11, F.lit(301))
              .when(cyc, F.lit(301))
              .when((F.col("rn") % 12 != 1) & F.col("prev_url").isNotNull(), F.lit(301))
              .otherwise(F.lit(200)))
    loc = (F.when(_pid() % 17 == 5, F.lit(None))
           .when(_pid() % 19 == 7, F.lit(None))
           .when(_pid() % 23 == 11, F.concat(F.lit("/moved/"), _pid().cast("string")))
           .when(cyc, F.col("next_url"))
           .when(F.col("rn") % 12 != 1, F.col("prev_url")))
    return j.select(F.lit(1).alias("snapshot_id"), _pid().alias("ord"), F.col("url").alias("request_url"),
                    status.alias("status"), loc.cast("string").alias("location"),
                    F.lit("text/html").alias("content_type"),
                    F.lit(None).cast("string").alias("last_modified_hdr"),
                    F.col("html").cast("binary").alias("body"))


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX6: one robots.txt per page, built from the page's own links.

    Variants by page_id % 4: 0 two Crawl-delays and a duplicated Sitemap,
    1 a fractional delay and an empty ``Allow:`` line, 2 a ``Disallow:`` and a
    Sitemap inside a comment, 3 no directives besides Allow.
    """
    p = pages(spark, sf_dir)
    origin = F.regexp_extract("url", ORIGIN_RX, 1)
    hrefs = F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"'), 1)
    allow = F.array_join(F.transform(hrefs, lambda h: F.concat(F.lit("Allow: "), h)), "\n")
    sm = F.concat(F.lit("Sitemap: "), origin, F.lit("/sitemap.xml"))
    m4 = _pid() % 4
    d = (_pid() % 9 + 1).cast("string")
    extra = (F.when(m4 == 0, F.concat(F.lit("Crawl-delay: "), d, F.lit("\nCrawl-delay: 3\n"), sm,
                                      F.lit("\n"), sm, F.lit("\n")))
             .when(m4 == 1, F.concat(F.lit("Crawl-delay: 2.5\nAllow:\n"), sm, F.lit("\n")))
             .when(m4 == 2, F.concat(F.lit("Disallow: /private\n# Sitemap: "), origin, F.lit("/old.xml\n")))
             .otherwise(F.lit("")))
    content = F.concat(F.lit("User-agent: *\n"), allow, F.lit("\n"), extra)
    return p.select("page_id", F.concat(origin, F.lit("/robots.txt")).alias("robots_url"),
                    content.alias("content"))


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX6 sitemaps: one per page listing origin + each of its hrefs.

    page_id % 6: 0 plain urlset, 1 namespaced, 2 url not ending in sitemap.xml,
    3 truncated (malformed), 4 sitemap index, 5 namespaced with lastmod.
    """
    p = pages(spark, sf_dir)
    origin = F.regexp_extract("url", ORIGIN_RX, 1)
    hrefs = F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"'), 1)
    m6 = _pid() % 6
    entries = F.array_join(F.transform(hrefs, lambda h: F.concat(
        F.lit("<url><loc>"), origin, h, F.lit("</loc>"),
        F.when(m6 == 5, F.lit("<lastmod>2024-01-01</lastmod>")).otherwise(F.lit("")),
        F.lit("</url>"))), "")
    open_tag = F.when((m6 == 1) | (m6 == 5), F.lit(
        '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">')).otherwise(F.lit("<urlset>"))
    body = (F.when(m6 == 3, F.concat(F.lit('<?xml version="1.0"?>'), open_tag, entries, F.lit("<url><loc>")))
            .when(m6 == 4, F.concat(F.lit('<?xml version="1.0"?><sitemapindex><sitemap><loc>'), origin,
                                    F.lit("/a-sitemap.xml</loc></sitemap></sitemapindex>")))
            .otherwise(F.concat(F.lit('<?xml version="1.0"?>'), open_tag, entries, F.lit("</urlset>"))))
    name = F.when(m6 == 2, F.lit("/feed.xml")).otherwise(F.lit("/sitemap.xml"))
    return p.select("page_id", F.concat(origin, F.lit("/"), _pid().cast("string"), name).alias("request_url"),
                    F.lit("application/xml").alias("content_type"), body.cast("binary").alias("body"))


def meta_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX5 (dates): a meta date injected after <head> by page_id % 5.

    0 name=last-modified, 1 article:modified_time and a published_time,
    2 article:published_time only, 3 an unparsable last-modified before a valid
    modified_time (stays null: chosen by presence), 4 none.
    """
    p = pages(spark, sf_dir)
    day = F.lpad((_pid() % 28 + 1).cast("string"), 2, "0")
    iso = F.concat(F.lit("2023-02-"), day, F.lit("T10:20:30Z"))
    m5 = _pid() % 5
    meta = (F.when(m5 == 0, F.concat(F.lit('<meta name="last-modified" content="'), iso, F.lit('">')))
            .when(m5 == 1, F.concat(F.lit('<meta property="article:published_time" content="2020-01-01">'
                                          '<meta property="article:modified_time" content="'), iso, F.lit('">')))
            .when(m5 == 2, F.concat(F.lit('<meta property="article:published_time" content="2023-03-'), day,
                                    F.lit('">')))
            .when(m5 == 3, F.concat(F.lit('<meta name="last-modified" content="yesterday">'
                                          '<meta property="article:modified_time" content="'), iso, F.lit('">')))
            .otherwise(F.lit("")))
    html = F.regexp_replace("html", "<head>", F.concat(F.lit("<head>"), meta))
    return p.select("page_id", _noframe(F.col("url")).alias("url"), html.alias("html"))


def wild_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX7: every page with a block of hostile markup and of the link forms real pages hold.

    Comment openers in a script and in an attribute, tags inside attribute
    values, script and image references, parent, network-path, opaque-scheme
    and query-only links, unescaped ``&section=`` and escaped ``&amp;``.
    """
    p = pages(spark, sf_dir)
    pid = _pid().cast("string")
    parts = ['<script src="/s', pid, '.js"></script><script>var s="<!--";</script>',
             "<div data-t=\"<a href='/ghost", pid, "'>\">x</div><!-- <a href=\"/no", pid, '"> -->',
             '<img alt="a > b" src=/i', pid, '.png><a title="<!--" href="/t', pid, '">t</a>',
             '<A HREF="../up', pid, '?a=1&section=2&copy=3&region=4" href="/dup">u</A>',
             '<a href="//cdn.example.org/x/../', pid, '">c</a><a href="mailto:u', pid, '@example.com">m</a>',
             "<a href='tel:+1555", pid, "'>p</a><a href=\"javascript:void(0)\">j</a>",
             '<a href="/q?x=1&amp;y=', pid, '">q</a><a\nhref = "./d/./e', pid, '#f">d</a><a href="?n=', pid, '">n</a>',
             "<textarea><a href='/no'></textarea><title><a href='/no'></title>"]
    block = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    anchors = F.array_join(F.transform(F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"'), 1),
                                       lambda h: F.concat(F.lit('<a href="'), h, F.lit('">x</a>'))), "\n")
    return p.select("page_id", _noframe(F.col("url")).alias("url"),
                    F.concat(F.lit("<html><body>"), block, anchors, F.lit("</body></html>")).alias("html"))


def wild_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX7 sitemaps: style-sheet instruction, comments over several lines, a document type, CDATA, truncated ends (page_id % 5)."""
    p = pages(spark, sf_dir)
    origin, m5 = F.regexp_extract("url", ORIGIN_RX, 1), _pid() % 5
    hrefs = F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"'), 1)
    entries = F.array_join(F.transform(hrefs, lambda h: F.concat(
        F.lit("<url>\n<loc>"), F.when(m5 == 3, F.concat(F.lit("<![CDATA["), origin, h, F.lit("]]>"))).otherwise(F.concat(origin, h)),
        F.lit("</loc>\n<image:image><image:loc>/no</image:loc></image:image></url>"))), "")
    head = (F.when(m5 == 0, F.lit('<?xml-stylesheet type="text/xsl" href="/s.xsl"?>\n'))
            .when(m5 == 1, F.lit("<!-- made by\n hand -->\n")).when(m5 == 2, F.lit("<!DOCTYPE urlset>\n")).otherwise(F.lit("")))
    tail = F.when(m5 == 4, F.lit("<url><loc>/cut")).otherwise(F.lit("</urlset>"))
    body = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), head,
                    F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), entries, tail)
    return p.select("page_id", F.concat(origin, F.lit("/"), _pid().cast("string"), F.lit("/sitemap.xml")).alias("request_url"),
                    body.cast("binary").alias("body"))
