"""Response-content column functions: R3 content type, R5 dates, R6 hash, R7 text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ECMAScript String.prototype.trim whitespace (ASCII part plus NBSP and BOM).
_WS = r"[\s\x{00A0}\x{FEFF}\x{2028}\x{2029}]"
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_WS}+|{_WS}+$", "")


def parse_content_type(header: Column) -> Column:
    """STRUCT<media_type, charset> of a Content-Type header.

    media_type is the trimmed text before the first ``;`` (may be empty);
    charset comes from the first later part whose trimmed, lower-cased text
    starts with ``charset=``: the text between its first and second ``=``,
    trimmed, quotes kept; empty counts as absent. A null header gives null.
    """
    header = _c(header)
    parts = F.split(header, ";", -1)
    media = js_trim(parts.getItem(0))
    cands = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))),
                     lambda p: F.lower(js_trim(p)).startswith("charset="))
    first = F.try_element_at(cands, F.lit(1))
    cs = js_trim(F.try_element_at(F.split(first, "=", -1), F.lit(2)))
    cs = F.when(cs == "", F.lit(None).cast("string")).otherwise(cs)
    return F.when(header.isNull() | (header == ""), F.lit(None)).otherwise(
        F.struct(media.alias("media_type"), cs.alias("charset")))


def _iso(ts: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), ISO_MILLIS)


_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MON = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_TIME = r"(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?: ?[ap]m)?)"
# Zone names of mail headers and their offsets.
_ZONES = {"est": "-05:00", "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00", "mst": "-07:00", "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00"}
_ZONE = rf"(z|(?:gmt|utc|ut)(?:[+-]\d{{2}}:?\d{{2}})?|[+-]\d{{2}}:?\d{{2}}|{'|'.join(_ZONES)})"
# Forms of a date text after the weekday, rewritten to year|month|day|time|zone.
_DATE_FORMS = [
    (rf"^(\d{{1,2}})[ -]{_MON}[ -](\d{{4}}|\d{{2}})(?: {_TIME})?(?: ?{_ZONE})?$", "$3|$2|$1|$4|$5"),   # 06 Nov 1994 08:49:37 GMT
    (rf"^{_MON} (\d{{1,2}}) {_TIME} (\d{{4}})$", "$4|$1|$2|$3|"),                                       # Nov 6 08:49:37 1994
    (rf"^{_MON} (\d{{1,2}}) (\d{{4}})(?: {_TIME})?(?: ?{_ZONE})?$", "$3|$1|$2|$4|$5"),                  # Nov 06 1994 08:49:37 GMT+0000
    (rf"^{_MON} (\d{{4}})$", "$2|$1|1||"),                                                             # May 2024
    (rf"^(\d{{4}})[/-](\d{{1,2}})[/-](\d{{1,2}})(?: {_TIME})?(?: ?{_ZONE})?$", "$1|$2|$3|$4|$5"),        # 2024/05/06, 2024-5-6
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?: {_TIME})?(?: ?{_ZONE})?$", "$3|$1|$2|$4|$5"),              # 5/6/2024
]


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used (a lambda variable)."""
    return F.transform(F.array(value), use)[0]


def _canonical_date(s: Column) -> Column:
    """ISO text of the first form that matches, else null."""
    s = F.regexp_replace(s, r"(?i)^(?:sun|mon|tue|wed|thu|fri|sat)[a-z]*\.?,?\s+", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\s*\([^)]*\)\s*$", ""), r",", " ")
    s = F.lower(F.regexp_replace(s, r"\s+", " "))
    for pattern, parts in _DATE_FORMS:
        s = F.regexp_replace(s, pattern, parts)     # a text that has been rewritten matches no later form

    def build(p):
        year, month, day, time = p[0], p[1], p[2], p[3]
        zone = F.regexp_replace(p[4], "^(?:gmt|utc|ut|z)", "")
        # two-digit years: 50-99 -> 19xx, 00-49 -> 20xx (as the JS parser does)
        year = F.when(F.length(year) == 2, F.concat(F.when(year >= "50", F.lit("19")).otherwise(F.lit("20")), year)).otherwise(year)
        named = ((F.instr(F.lit(_MONTHS), F.substring(month, 1, 3)) + 2) / 3).cast("int").cast("string")
        month = F.when(month.rlike("^[0-9]"), month).otherwise(named)
        half, rest = F.regexp_extract(time, "([ap])m$", 1), F.regexp_replace(time, " ?[ap]m$", "")
        hour = F.regexp_extract(rest, r"^(\d+)", 1)
        twelve = hour.try_cast("int") % 12 + F.when(half == "p", 12).otherwise(0)
        hour = F.when(half == "", hour).when(hour.try_cast("int") <= 12, twelve.cast("string"))     # 13:00 pm is no time
        time = F.when(time == "", F.lit("00:00:00")).otherwise(F.concat(
            F.lpad(hour, 2, "0"), F.regexp_extract(rest, r"^\d+(:.*)$", 1),
            F.when(rest.rlike(r"^\d+:\d+$"), F.lit(":00")).otherwise(F.lit(""))))
        named_zone = F.create_map(*[F.lit(x) for pair in _ZONES.items() for x in pair])
        zone = F.coalesce(F.try_element_at(named_zone, p[4]), F.when(zone == "", F.lit("Z")).otherwise(
            F.regexp_replace(zone, r"^([+-]\d{2}):?(\d{2})$", "$1:$2")))
        return F.when(F.size(p) == 5, F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"),
                                               F.lit("T"), time, zone))

    return _once(F.split(s, r"\|", -1), build)


def parse_date(text: Column) -> Column:
    """A date string as ``new Date(s).toISOString()`` writes it, else null.

    Accepted: the three HTTP date forms, JS date strings, month-name dates
    (``May 5, 2024``, ``May 2024``), slash and loose dashed dates (``2024-5-6``), times of twelve hours, the zone names
    of mail headers, and ISO-8601 dates (also year or year and
    month alone) and date-times. A text without a zone is read as UTC
    (documented narrowing of the JS parser, which reads some forms as local time).
    """
    def iso(s):
        s = F.regexp_replace(s, r"(?i)([t ]\d{2}:\d{2})(z|[+-]\d{2}:?\d{2})?$", "$1:00$2")     # hours and minutes alone
        v = F.regexp_replace(s, r"(:\d{2}(?:\.\d+)?[+-]\d{2})(\d{2})$", "$1:$2")
        # zone-less input is made explicitly UTC, so the session time zone never matters
        return (F.when(F.length(s) == 4, F.concat(s, F.lit("-01-01T00:00:00Z")))
                .when(F.length(s) == 7, F.concat(s, F.lit("-01T00:00:00Z")))
                .when(F.length(s) == 10, F.concat(s, F.lit("T00:00:00Z")))
                .when(s.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), v).otherwise(F.concat(s, F.lit("Z"))))

    iso_rx = r"^\d{4}(-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?)?)?$"
    return _once(js_trim(_c(text)), lambda s: _iso(F.try_to_timestamp(
        F.when(s.rlike(iso_rx), iso(s)).otherwise(_canonical_date(s)))))


def content_hash(body: Column) -> Column:
    """Lower-case hex SHA-256 of the raw bytes; null body gives null."""
    return F.sha2(_c(body), 256)


def decode_text(body: Column) -> Column:
    """Bytes as UTF-8, invalid sequences replaced, a leading BOM removed.

    The declared charset is deliberately not used (reference behaviour).
    Accepts BINARY or STRING columns.
    """
    txt = F.make_valid_utf8(_c(body).cast("string"))
    return F.regexp_replace(txt, r"^\x{FEFF}", "")


# SURVEY §2 name for R5 (the same parser serves HTTP headers and HTML metas)
parse_http_date = parse_date
