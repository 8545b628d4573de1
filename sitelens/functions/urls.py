"""URL column functions (U1-U4, and the E2 resolver).

Native expressions cover URLs whose canonical form needs no parsing beyond
splitting and encoding non-ASCII text (the overwhelming share of real links:
root-relative paths, plain relative paths, clean absolute http(s) URLs).
Everything else goes through an Arrow-batched pandas UDF around
``sitelens.functions.whatwg``. Spark evaluates a Python UDF on every row of
its projection, even inside ``when(cond, udf(x))``, so the routing feeds the
UDF ``when(~cond, x)``: rows on the native path reach Python as nulls and
cost nothing there, and the upstream plan runs once (a filter + union split
would evaluate it once per branch).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions import whatwg

_SCHEME_RX = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
# Characters the native path leaves alone in every component: no controls,
# space, quotes, angle brackets, backtick, braces, backslash.
_SAFE_RX = r"^[^\x00-\x20\"'<>`{}\\]*$"
_DOT_SEGMENT_RX = r"(?i)(^|/)(\.|%2e){1,2}(/|$|\?|#)|%2e"
# A host that canonicalisation leaves alone: ASCII labels, no number last (an IPv4 address), no punycode.
_HOST = (r"(?!(?:[a-z0-9\-]+\.)*(?:[0-9]+|0x[0-9a-f]*)(?:[/?#:]|$))(?!(?:[a-z0-9\-]+\.)*xn--)"
         r"[a-z0-9\-]+(?:\.[a-z0-9\-]+)*")
_CLEAN_ABS_RX = rf"^https?://{_HOST}(?=[/?#]|$)"
_ABS_RX = rf"(?i)^https?://{_HOST}(?=[/?#]|$)"
_NET_PATH_RX = rf"(?i)^//{_HOST}(?=[/?#]|$)"
_BASE_RX = rf"^(?:http://{_HOST}(?::(?!80(?:[/?#]|$))[1-9][0-9]{{0,3}})?|https://{_HOST}(?::(?!443(?:[/?#]|$))[1-9][0-9]{{0,3}})?)(?=[/?#]|$)"
# Schemes without an authority keep their rest; only controls and non-ASCII text would be encoded there.
_OPAQUE_RX = r"(?i)^(?!(?:https?|ftp|wss?|file):)[a-z][a-z0-9+.\-]*:(?!/)[^\x00-\x20\x7f?#]*$"
_OPAQUE_QUERY_RX = r"(?i)^(?!(?:https?|ftp|wss?|file):)[a-z][a-z0-9+.\-]*:(?!/)[^\x00-\x20\x7f\"'<>`{}\\]*$"
_OUTER_SPACE_RX = r"^[\x00-\x20]+|[\x00-\x20]+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct_encode_nonascii(s: Column) -> Column:
    """Percent-encode (UTF-8, upper-case hex) every non-ASCII run of ``s``."""
    s = _c(s)
    runs = F.regexp_extract_all(s, F.lit(r"[\x00-\x7f]+|[^\x00-\x7f]+"), 0)
    enc = F.transform(runs, lambda r: F.when(
        r.rlike(r"^[\x00-\x7f]"), r).otherwise(
        F.regexp_replace(F.hex(F.encode(r, "UTF-8")), r"(..)", "%$1")))
    return F.when(s.isNull(), F.lit(None).cast("string")).otherwise(F.array_join(enc, ""))


def strip_fragment(url: Column) -> Column:
    """Drop ``#`` and everything after it."""
    url = _c(url)
    return F.regexp_replace(url, r"(?s)#.*$", "")


def url_host(url: Column) -> Column:
    """Lower-cased hostname of an absolute URL; null when there is none."""
    url = _c(url)
    h = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)", 1)
    return F.when(h == "", F.lit(None).cast("string")).otherwise(F.lower(h))


def url_origin(url: Column) -> Column:
    """scheme://[userinfo@]host[:port] of an absolute URL with an authority."""
    url = _c(url)
    o = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    return F.when(o == "", F.lit(None).cast("string")).otherwise(o)


def url_path(url: Column) -> Column:
    """U4: pathname of a canonical URL; ``/`` for an empty path under an authority."""
    url = _c(url)
    m = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/?#]*)?([^?#]*)", 2)
    has_auth = url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    return (F.when(url.isNull() | ~url.rlike(_SCHEME_RX), F.lit(None).cast("string"))
            .when(has_auth & (m == ""), F.lit("/")).otherwise(m))


# --- resolution -----------------------------------------------------------

def native_resolvable(ref: Column, base: Column) -> Column:
    """True where :func:`resolve_native` equals the full algorithm."""
    ref = F.regexp_replace(ref, _OUTER_SPACE_RX, "")
    opaque = ref.rlike(_OPAQUE_RX) | ref.rlike(_OPAQUE_QUERY_RX)
    absolute = ref.rlike(_ABS_RX)
    base_ok = base.rlike(_BASE_RX) & base.rlike(_SAFE_RX) & ~base.rlike(_DOT_SEGMENT_RX)
    relative = ~ref.rlike(_SCHEME_RX) & (ref != "") & (~ref.startswith("//") | ref.rlike(_NET_PATH_RX))
    return F.coalesce(opaque | (ref.rlike(_SAFE_RX) & (absolute | (relative & base_ok))), F.lit(False))


def _fold_dots(path: Column) -> Column:
    """A path without its dot segments (``.``, ``..`` and their escapes)."""
    closed = F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}$"), F.concat(path, F.lit("/"))).otherwise(path)
    kept = F.aggregate(
        F.split(F.substring(closed, 2, 1 << 30), "/", -1), F.array().cast("array<string>"),
        lambda acc, x: F.when(x.rlike(r"(?i)^(?:\.|%2e){2}$"), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(x.rlike(r"(?i)^(?:\.|%2e)$"), acc).otherwise(F.concat(acc, F.array(x))))
    return F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def resolve_native(ref: Column, base: Column) -> Column:
    """``new URL(ref, base).href`` for values where :func:`native_resolvable` holds."""
    ref = F.regexp_replace(ref, _OUTER_SPACE_RX, "")
    origin = url_origin(base)
    base_path = F.regexp_extract(base, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    base_pq = F.regexp_extract(base, r"^[^:]+://[^/?#]*([^#]*)", 1)
    base_dir = F.regexp_replace(base_path, r"[^/]*$", "")
    base_dir = F.when(base_dir == "", F.lit("/")).otherwise(base_dir)
    base_path = F.when(base_path == "", F.lit("/")).otherwise(base_path)
    base_pq = F.when(base_pq.startswith("/"), base_pq).otherwise(F.concat(F.lit("/"), base_pq))
    full = (F.when(ref.rlike(_SCHEME_RX), ref)
            .when(ref.startswith("//"), F.concat(F.regexp_extract(base, r"^[a-z]+:", 0), ref))
            .when(ref.startswith("/"), F.concat(origin, ref))
            .when(ref.startswith("?"), F.concat(origin, base_path, ref))
            .when(ref.startswith("#"), F.concat(origin, base_pq, ref))
            .otherwise(F.concat(origin, base_dir, ref)))
    head = F.lower(F.regexp_extract(full, r"(?i)^https?://[^/?#]*", 0))
    path = F.regexp_extract(full, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    tail = F.regexp_extract(full, r"^[^?#]*(.*)$", 1)
    opaque = F.concat(F.lower(F.regexp_extract(ref, _SCHEME_RX, 0)), F.regexp_replace(ref, _SCHEME_RX, ""))
    return pct_encode_nonascii(F.when(head == "", opaque).otherwise(F.concat(head, _fold_dots(path), tail)))


@F.pandas_udf(T.StringType())
def resolve_udf(ref: pd.Series, base: pd.Series) -> pd.Series:
    """Slow path of E2: full resolution per (ref, base)."""
    return pd.Series([whatwg.resolve(r, b) if r is not None else None for r, b in zip(ref, base)],
                     dtype=object)


@F.pandas_udf(T.StringType())
def report_key_udf(url: pd.Series) -> pd.Series:
    """Slow path of U1."""
    return pd.Series([whatwg.report_key(u) for u in url], dtype=object)


def report_key_native_ok(url: Column) -> Column:
    """True where :func:`report_key_native` equals the full algorithm."""
    # Non-ASCII path/query text is encoded by the parser and decoded again by
    # decodeURI, so it round-trips without an escape; a non-ASCII host does not.
    return F.coalesce(url.rlike(_CLEAN_ABS_RX) & url.rlike(_SAFE_RX) & ~url.rlike(_DOT_SEGMENT_RX), F.lit(False))


def report_key_native(url: Column) -> Column:
    host = F.regexp_extract(url, _CLEAN_ABS_RX, 0)
    rest = F.substring(url, F.length(host) + 1, 1 << 30)
    href = F.concat(host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))
    return F.when(url.contains("%"), decode_uri(pct_encode_nonascii(href))).otherwise(href)


def report_key(url) -> Column:
    """``decodeURI(new URL(url).href)``; null where the URL does not parse."""
    url = _c(url)
    ok = report_key_native_ok(url)
    return F.when(ok, report_key_native(url)).otherwise(report_key_udf(F.when(~ok, url)))


def resolve(ref, base) -> Column:
    """E2 for one reference: ``new URL(ref, base).href``; null where it throws."""
    ref, base = _c(ref), _c(base)
    ok = native_resolvable(ref, base)
    return F.when(ok, resolve_native(ref, base)).otherwise(resolve_udf(F.when(~ok, ref), F.when(~ok, base)))


def _routed(df, flag, fast, slow_udf, slow_args, out_col):
    """Add ``out_col``: ``fast`` where ``flag``, else the UDF (fed nulls on fast rows)."""
    nat = F.col("_native")
    args = [F.when(~nat, a) for a in slow_args]
    return (df.withColumn("_native", flag)
            .withColumn(out_col, F.when(nat, fast).otherwise(slow_udf(*args)))
            .drop("_native"))


def with_report_key(df, url_col: str, out_col: str):
    url = F.col(url_col)
    return _routed(df, report_key_native_ok(url), report_key_native(url), report_key_udf, [url], out_col)


def with_resolved(df, ref_col: str, base_col: str, out_col: str):
    ref, base = F.col(ref_col), F.col(base_col)
    return _routed(df, native_resolvable(ref, base), resolve_native(ref, base), resolve_udf, [ref, base],
                   out_col)


_RESERVED_ESC_RX = r"%(2[346BCFbcf]|3[ABDFabdf]|40)"


def _count(s: Column, sub: str) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(sub), F.lit("")))) / len(sub)


def decode_uri(href) -> Column:
    """ECMAScript decodeURI, natively: escapes of reserved characters stay encoded
    (case kept), ``+`` stays ``+``, a malformed escape or invalid UTF-8 gives null.

    The JVM decoder replaces invalid UTF-8 with U+FFFD, so invalid input is
    recognised by the output holding more U+FFFD than the input had, literal
    or as the escape ``%EF%BF%BD``.
    """
    href = _c(href)
    t = F.regexp_replace(href, _RESERVED_ESC_RX, "%25$1")
    t = F.regexp_replace(t, r"\+", "%2B")
    d = F.try_url_decode(t)
    expected = _count(href, "\ufffd") + _count(F.upper(href), "%EF%BF%BD")
    return (F.when(~href.contains("%"), href)
            .when(_count(d, "\ufffd") > expected, F.lit(None).cast("string"))
            .otherwise(d))


def with_decoded(df, href_col: str, out_col: str):
    return df.withColumn(out_col, decode_uri(href_col))
