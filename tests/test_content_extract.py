"""R3, R5-R8, E1, E3, E4 unit cases."""

from pyspark.sql import functions as F

from sitelens.functions import content as C
from sitelens.operators import extract as E
from sitelens.operators.assets import build_assets


def test_content_type(spark):
    rows = [("text/html; charset=utf-8",), ("text/html;Charset=ISO-8859-1",), (";charset=x",),
            ('text/html; charset="a=b"; charset=z',), ("text/html; charset = x",), ("text/html; charset=",),
            (None,), ("",)]
    got = spark.createDataFrame(rows, "ct string").select(C.parse_content_type(F.col("ct")).alias("p")).collect()
    vals = [(g.p.media_type, g.p.charset) if g.p else None for g in got]
    assert vals == [("text/html", "utf-8"), ("text/html", "ISO-8859-1"), ("", "x"), ("text/html", '"a'),
                    ("text/html", None), ("text/html", None), None, None]


def test_dates(spark):
    rows = ["Sun, 06 Nov 1994 08:49:37 GMT", "Sunday, 06-Nov-94 08:49:37 GMT", "2024-01-02",
            "2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05.5Z", "garbage", None]
    got = spark.createDataFrame([(r,) for r in rows], "d string").select(C.parse_date("d").alias("x")).collect()
    assert [g.x for g in got] == ["1994-11-06T08:49:37.000Z", "1994-11-06T08:49:37.000Z",
                                  "2024-01-02T00:00:00.000Z", "2024-01-02T01:04:05.000Z",
                                  "2024-01-02T03:04:05.500Z", None, None]


def test_date_forms_of_the_js_parser(spark):
    cases = {"Sun Nov  6 08:49:37 1994": "1994-11-06T08:49:37.000Z", "May 5, 2024": "2024-05-05T00:00:00.000Z",
             "2024-05": "2024-05-01T00:00:00.000Z", "2024": "2024-01-01T00:00:00.000Z", "06 Nov 1994": "1994-11-06T00:00:00.000Z",
             "2024/05/06": "2024-05-06T00:00:00.000Z", "Sun Nov 06 1994 08:49:37 GMT+0000": "1994-11-06T08:49:37.000Z",
             "Sun Nov 06 1994 08:49:37 GMT+0200 (Central European Time)": "1994-11-06T06:49:37.000Z", "5/6/2024 7:08": "2024-05-06T07:08:00.000Z",
             "6 November 1994 08:49 +0100": "1994-11-06T07:49:00.000Z", "Thu, 31 Feb 2020 00:00:00 GMT": None, "Nov 1994 x": None, "May": None,
             "2024-13": None, "Mon, 06 Nov 49 08:49:37 UTC": "2049-11-06T08:49:37.000Z",
             "2024-05-06T10:00": "2024-05-06T10:00:00.000Z", "2024-05-06T10:00+02:00": "2024-05-06T08:00:00.000Z", "2024-05-06 10:00Z": "2024-05-06T10:00:00.000Z",
             "Tue, 6 May 2024 10:00:00 EST": "2024-05-06T15:00:00.000Z", "6 May 2024 10:00 PDT": "2024-05-06T17:00:00.000Z",
             "6 May 2024 10:00 PM": "2024-05-06T22:00:00.000Z", "6 May 2024 12:30:05 am": "2024-05-06T00:30:05.000Z", "6 May 2024 12:30 PM GMT": "2024-05-06T12:30:00.000Z",
             "6 May 2024 13:00 PM": None, "May 2024": "2024-05-01T00:00:00.000Z", "2024-5-6": "2024-05-06T00:00:00.000Z", "2024-5-6 7:08": "2024-05-06T07:08:00.000Z"}
    got = spark.createDataFrame([(r,) for r in cases], "d string").select("d", C.parse_date("d").alias("x")).collect()
    assert {g.d: g.x for g in got} == cases


def test_hash_and_decode(spark):
    df = spark.createDataFrame([(b"",), (b"\xef\xbb\xbfhi",), (b"a\xffb",), (None,)], "b binary")
    got = df.select(C.content_hash("b").alias("h"), C.decode_text("b").alias("t")).collect()
    assert got[0].h == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert got[1].t == "hi" and got[2].t == "a�b" and got[3].h is None


HTML = """<html><head><script src="/s.js"></script><script>var a="<a href='/no'>";</script>
<meta name="last-modified" content="2024-01-02T03:04:05Z"></head>
<body><!-- <a href="/commented"> --><a HREF='/b?x=1&amp;y=2' href="/dup">x</a><img src=/i.png>
<a href="">e</a><a title="href=/t" href="/real">r</a><a href="mailto:x@y">m</a>
<title><a href="/intitle"></title><textarea><a href="/intext"></textarea></body></html>"""


def test_html_references_traps(spark):
    df = spark.createDataFrame([(HTML,)], "h string")
    raw = df.select(E.html_raw_references(F.col("h")).alias("r")).first().r
    # scripts first, then images, then anchors; none from comments/script/title/textarea
    assert raw == ["/s.js", "/i.png", "/b?x=1&amp;y=2", "/real", "mailto:x@y"]


def test_meta_precedence_by_presence(spark):
    docs = [
        '<meta name="last-modified" content="yesterday"><meta property="article:modified_time" content="2020-01-01">',
        '<meta property="article:published_time" content="2020-01-01"><meta property="article:modified_time" content="2021-02-03T04:05:06Z">',
        '<meta property="article:published_time" content="2022-05-06">',
        '<meta name="last-modified">',
        "<p>none</p>",
    ]
    got = spark.createDataFrame([(d,) for d in docs], "h string").select(
        E.html_meta_dates(F.col("h")).alias("d")).collect()
    assert [g.d for g in got] == [None, "2021-02-03T04:05:06.000Z", "2022-05-06T00:00:00.000Z", None, None]


def test_sitemaps(spark):
    docs = [
        '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://h/a</loc></url><url><loc> https://h/b?x=1&amp;y=2 </loc></url></urlset>',
        "<urlset><url><loc>https://h/only</loc></url></urlset>",
        "<urlset><url><loc>https://h/a</loc></url><url><loc>",
        "<sitemapindex><sitemap><loc>https://h/s.xml</loc></sitemap></sitemapindex>",
        "",
    ]
    got = spark.createDataFrame([(d,) for d in docs], "t string").select(
        E.sitemap_raw_locs(F.col("t")).alias("l")).collect()
    # the reference's parser does not validate: complete entries of a truncated document count
    assert [g.l for g in got] == [["https://h/a", "https://h/b?x=1&y=2"], ["https://h/only"], ["https://h/a"], [], []]


def test_sitemap_prologues(spark):
    body = "<urlset xmlns='x'><!-- <url><loc>https://h/no</loc></url> -->\n<url>\n <loc>https://h/a</loc><image:image><image:loc>https://h/i</image:loc></image:image></url><url><loc><![CDATA[https://h/b?x=1&y=2]]></loc></url></urlset>"
    docs = ['<?xml version="1.0"?>\n<?xml-stylesheet type="text/xsl" href="/s.xsl"?>\n' + body,
            '<?xml version="1.0"?><!-- a\nb -->\n<!DOCTYPE urlset>' + body, "\n" + body, "<p>" + body, None]
    got = spark.createDataFrame([(d,) for d in docs], "t string").select(E.sitemap_raw_locs(F.col("t")).alias("l")).collect()
    want = ["https://h/a", "https://h/b?x=1&y=2"]
    assert [g.l for g in got] == [want, want, want, [], None]


def test_the_first_construct_in_document_order_wins(spark):
    docs = {
        '<script>var s="<!--";</script><a href="/a">x</a><a href="/b">y</a>': ["/a", "/b"],
        '<a title="<!--" href="/a">x</a><a href="/b">y</a>': ["/a", "/b"],
        "<div data-t=\"<a href='/ghost'>\"><a href='/a'>": ["/a"],
        "<p title='a > b'><a href=/a>1</a></p title=\"<a href=/ghost>\">": ["/a"],
        "<!--> <a href='/a'> <!-- <a href='/no'> --!> <a href='/b'>": ["/a", "/b"],
        "<iframe><a href='/no'></iframe><style><a href='/no'></style ><a\nhref\n=\n'/a'>": ["/a"],
        "a < b <a href='/a' href='/dup' HREF='/dup2'><a data-href='/no'><a href><a href=''>": ["/a"],
        "<SCRIPT SRC='/s.js'></SCRIPT><img/src='/i.png'/><a href='/x'": ["/s.js", "/i.png"],
        "<abbr href='/no'><article href='/no'><a href='/a'>": ["/a"],
    }
    got = spark.createDataFrame([(d,) for d in docs], "h string").select("h", E.html_raw_references(F.col("h")).alias("r")).collect()
    assert {g.h: g.r for g in got} == docs


def test_entities_follow_the_attribute_rule(spark):
    cases = {"/x?a=1&section=2&copy=3&region=4": "/x?a=1&section=2&copy=3&region=4", "/x?a=1&amp;b=2": "/x?a=1&b=2",
             "/x?a&copy;b": "/x?a©b", "/x?a&copy": "/x?a©", "/x?a&copyb": "/x?a&copyb", "/x?a&notit;": "/x?a&notit;",
             "/x&#47;y": "/x/y", "/x&#x2f;y": "/x/y", "/x?&&=&1": "/x?&&=&1", "/x?q=&quot;a&quot;": '/x?q="a"', "/&eacute;&eacute=": "/é&eacute="}
    assert {k: E.unescape_attribute(k) for k in cases} == cases
    df = spark.createDataFrame([(list(cases), "https://h.com/d/p.html")], "raw array<string>, base string")
    got = E.with_references(df, "raw", "base", "references").first().references
    from sitelens.functions import whatwg
    want = list(dict.fromkeys(whatwg.resolve(v, "https://h.com/d/p.html") for v in cases.values()))
    assert got == want


WILD = ["mailto:x@y.z", "tel:+1555", "javascript:void(0)", "JavaScript:alert('x')", "//cdn.example.org/a/../b", "../up?x=1#f", "./here", "a/b/../c", "..", ".",
        "../../..", "/a/./b/%2e%2E/c", "?q", "#f", "/x y", " /trim ", "HTTP://EXAMPLE.com/A/../B", "https://h.com:8080/x", "http://1.2.3.4/x", "//[::1]/x",
        "/caf\u00e9?q=\u00fc", "data:text/plain,hi", "/q?a='b'", "\\\\evil", "x:y/../z", "mailto:a@b?subject=x%20y", "//h.com", "https://xn--bcher-kva.ch/",
        "http://", "///x", "https:/one", "https:rel", "/a//b/..//c", "a\tb", "", "x/%zz"]


def test_native_resolution_equals_the_full_algorithm(spark):
    from sitelens.functions import urls as U
    from sitelens.functions import whatwg
    bases = ["https://h.com/d/p.html?q=1", "http://h.com/", "https://h.com", "https://h.com:8443/a/b", "http://H.com/", "https://h.com/x/../y", "https://münchen.de/"]
    df = spark.createDataFrame([(r, b) for r in WILD for b in bases], "r string, b string")
    got = df.select("r", "b", U.native_resolvable(F.col("r"), F.col("b")).alias("ok"), U.resolve_native(F.col("r"), F.col("b")).alias("v")).collect()
    assert {(g.r, g.b): g.v for g in got if g.ok} == {(g.r, g.b): whatwg.resolve(g.r, g.b) for g in got if g.ok}
    assert sum(g.ok for g in got if g.b == bases[0]) >= 22      # ordinary links stay on the JVM


def test_few_rows_of_an_ordinary_page_reach_python(spark):
    """Routing is per reference: a page of ordinary links needs no Python, and one odd link does not take the others along."""
    ordinary = ["/a", "b.html", "../c", "//cdn.example.org/x.js", "mailto:a@b.c", "tel:1", "javascript:void(0)", "/x?a=1&amp;b=2&section=3", "https://o.org/z#f"]
    df = spark.createDataFrame([(ordinary, "https://h.com/d/p.html"), (ordinary + ["/odd path"], "https://h.com/d/p.html")], "raw array<string>, base string")
    rest = df.select(E.rest_of(E.prepared_references(F.col("raw"), F.col("base"), F.lit(True))).alias("x")).collect()
    assert [r.x for r in rest] == [None, ["/odd path"]]
    out = E.with_references(df, "raw", "base", "references", bad_refs="bad").collect()
    assert out[1].references == out[0].references + ["https://h.com/odd%20path"] and out[0].bad == 0


def test_build_assets_rows(spark):
    rows = [
        ("https://h.com/a", 200, "text/html; charset=utf-8", "Sun, 06 Nov 1994 08:49:37 GMT", HTML.encode()),
        ("https://h.com/b.html", 200, None, None, b'<a href="../x">x</a><a href="/x#f">y</a>'),
        ("https://h.com/c", 200, "image/png", "bad date", b"\x89PNG"),
        ("https://h.com/sitemap.xml", 200, "application/xml", None,
         b"<urlset><url><loc>/rel</loc></url><url><loc>https://o.org/z</loc></url></urlset>"),
        ("https://h.com/dead", 404, "text/html", None, b"x"),
        ("https://H.com/%7Euser/./p", 200, "text/html", None, b'<a href="q">q</a>'),
    ]
    df = spark.createDataFrame(rows, "final_url string, status int, content_type string, last_modified_hdr string, body binary")
    got = {r.url: r for r in build_assets(df).collect()}
    assert set(got) == {"https://h.com/a", "https://h.com/b.html", "https://h.com/c", "https://h.com/sitemap.xml",
                        "https://h.com/~user/p"}
    a = got["https://h.com/a"]
    assert a.references == ["https://h.com/s.js", "https://h.com/i.png", "https://h.com/b?x=1&y=2",
                            "https://h.com/real", "mailto:x@y"]
    assert a.last_modified == "1994-11-06T08:49:37.000Z" and a.charset == "utf-8"   # header beats meta
    b = got["https://h.com/b.html"]
    assert b.data_mime == "text/html" and b.references == ["https://h.com/x", "https://h.com/x#f"]
    c = got["https://h.com/c"]
    assert c.references == [] and c.last_modified is None and c.kind == "other"
    s = got["https://h.com/sitemap.xml"]
    assert s.kind == "sitemap" and s.references == ["https://h.com/rel", "https://o.org/z"]
    assert got["https://h.com/~user/p"].references == ["https://h.com/~user/q"]   # decodeURI(%7E) = ~


def test_dates_ignore_session_time_zone(spark):
    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        rows = ["2024-01-02", "2024-01-02T03:04:05", "2024-01-02T03:04:05+02:00", "Sun, 06 Nov 1994 08:49:37 GMT"]
        got = spark.createDataFrame([(r,) for r in rows], "d string").select(C.parse_date("d").alias("x")).collect()
        assert [g.x for g in got] == ["2024-01-02T00:00:00.000Z", "2024-01-02T03:04:05.000Z",
                                      "2024-01-02T01:04:05.000Z", "1994-11-06T08:49:37.000Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)


def test_one_extension_table_for_native_and_slow_rows(spark):
    """An extension added on the driver counts for rows whose url needs the full parser, too."""
    from sitelens.functions import mime as M
    from sitelens.operators.assets import build_assets
    before = dict(M.EXTENSION_MIME)
    M.EXTENSION_MIME["own9"] = "application/x-own9"
    try:
        rows = [(u, 200, None, None, b"x") for u in ("https://h.com/a.own9", "https://h.com:8443/a.own9", "https://b\u00fccher.de/a.own9", "https://h.com/a.own8")]
        df = spark.createDataFrame(rows, "final_url string, status int, content_type string, last_modified_hdr string, body binary")
        got = [r.data_mime for r in build_assets(df, keep=["final_url"]).collect()]
        assert got == ["application/x-own9"] * 3 + [M.DEFAULT_MIME]
    finally:
        M.EXTENSION_MIME.clear()
        M.EXTENSION_MIME.update(before)
