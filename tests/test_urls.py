"""URL rules, native path vs the full parser."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens.functions import urls as U
from sitelens.functions import whatwg

BASE = "https://blog.x.example.net/es/533/?a=1#top"


def test_resolve_cases():
    cases = {
        "/èê": "https://blog.x.example.net/%C3%A8%C3%AA",
        "x/../y": "https://blog.x.example.net/es/533/y",
        "../a": "https://blog.x.example.net/es/a",
        "?q=1": "https://blog.x.example.net/es/533/?q=1",
        "#f": "https://blog.x.example.net/es/533/?a=1#f",
        "//Other.COM:443/p": "https://other.com/p",
        "HTTP://A.com": "http://a.com/",
        "mailto:x@y": "mailto:x@y",
        "/a b": "https://blog.x.example.net/a%20b",
        "/%2e%2e/x": "https://blog.x.example.net/x",
        "\\foo\\bar": "https://blog.x.example.net/foo/bar",
        "http://a.com:80/": "http://a.com/",
        "http://[::1": None,
    }
    for ref, want in cases.items():
        assert whatwg.resolve(ref, BASE) == want, ref


def test_decode_uri_keeps_reserved_and_rejects_bad():
    assert whatwg.decode_uri("/%C3%A8%2F%2f+x%20") == "/è%2F%2f+x "
    assert whatwg.decode_uri("%E0%A4%A") is None
    assert whatwg.decode_uri("%FF") is None
    assert whatwg.report_key("https://h/%C3%A8?x#y") == "https://h/è?x#y"


def test_native_decode_matches_python(spark):
    vals = ["/%C3%A8%2F%2f+x%20", "%E0%A4%A", "%FF", "a%3Fb", "plain", "%C3%A8%C3", "%EF%BF%BD", "�%41", None]
    rows = U.with_decoded(spark.createDataFrame([(v,) for v in vals], "h string"), "h", "d").collect()
    for r in rows:
        assert r.d == whatwg.decode_uri(r.h), r.h


def test_url_columns(spark):
    df = spark.createDataFrame([("https://M.Example.com:8080/a/b.HTML?x=1#f",), ("mailto:x@y",), ("https://h.com",)], "u string")
    got = df.select(U.url_host("u").alias("h"), U.url_path("u").alias("p"), U.strip_fragment("u").alias("s")).collect()
    assert got[0].h == "m.example.com" and got[0].p == "/a/b.HTML" and got[0].s == "https://M.Example.com:8080/a/b.HTML?x=1"
    assert got[1].h is None and got[1].p == "x@y"
    assert got[2].p == "/"


_seg = st.text(alphabet="abcxyz-_.~!$()*,;=:@é漢", min_size=0, max_size=6)
_ref = st.one_of(
    st.builds(lambda s: "/" + "/".join(s), st.lists(_seg, min_size=1, max_size=4)),
    st.builds(lambda s: "/".join(s), st.lists(_seg.filter(lambda x: x and ":" not in x), min_size=1, max_size=3)),
    st.builds(lambda a, b: f"/{a}?{b}", _seg, _seg),
    st.builds(lambda a, b: f"{a}#{b}", _seg, _seg),
)


@settings(max_examples=60, deadline=None)
@given(st.lists(_ref, min_size=1, max_size=25))
def test_native_resolution_equals_parser(spark, refs):
    df = spark.createDataFrame([(r, BASE) for r in refs], "ref string, base string")
    rows = U.with_resolved(df, "ref", "base", "abs").collect()
    for r in rows:
        assert r.abs == whatwg.resolve(r.ref, r.base), (r.ref, r.abs)


def test_report_key_native_and_slow_paths(spark):
    urls = ["https://h.com/a/è?q#f", "https://H.com/%41", "http://h.com:80", "https://h.com/./a/../b"]
    rows = U.with_report_key(spark.createDataFrame([(u,) for u in urls], "u string"), "u", "k").collect()
    for r in rows:
        assert r.k == whatwg.report_key(r.u), r.u
