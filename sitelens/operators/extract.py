"""Reference extraction (E1-E5) as column expressions.

HTML is tokenized with one JVM regular expression in document order, not a
DOM: comments, raw-text elements, tags with quoted attributes and
declarations are alternatives of one pattern, so whichever starts first wins;
attributes are split in order, so the first of a duplicated attribute wins.
All of it stays in JVM expressions; Python sees only single references that
need other entities or the full URL algorithm (see ``with_references``).
"""

from __future__ import annotations

import html as _html
import re
from functools import lru_cache
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions import urls as U
from sitelens.functions import whatwg
from sitelens.functions.content import parse_date

# One attribute: a name, and a value in double quotes, in single quotes or bare.
_ATTR_RX = r"[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+"
_ATTRS_RX = rf"(?:[\s/]++|{_ATTR_RX})*+"
# Elements whose content is text: their content is no markup.
_RAWTEXT = "script|style|title|textarea|xmp|iframe|noembed|noframes"
# Constructs in document order, the first one that starts wins: comment, raw-text element (its start tag and content),
# any other start tag with its attributes, end tag, declaration.
_TOKEN_RX = (r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))"
             rf"|<({_RAWTEXT})(?=[\s/>]){_ATTRS_RX}>.*?(?:</\1(?=[\s/>])|\z)"
             rf"|<[a-z][^\s/>]*+{_ATTRS_RX}>"
             r"|</?[a-z!?][^>]*+>")
_WANTED_RX = r"(?i)^<(?:script|img|a|meta)(?=[\s/>])"
_START_TAG_RX = rf"(?is)^<[a-z][^\s/>]*+{_ATTRS_RX}>"
_TAG_PARTS_RX = r"(?s)^<[A-Za-z][^\s/>]*+(.*)>$"


def html_tags(text: Column) -> Column:
    """ARRAY<STRUCT<name, attrs>> of the script, img, a and meta start tags, in document order.

    One pass over the markup; later steps only look at the (short) tag texts. ``attrs`` holds the
    attributes in order, one text each.
    """
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN_RX), 0)
    tags = F.transform(F.filter(tokens, lambda t: t.rlike(_WANTED_RX)), lambda t: F.regexp_extract(t, _START_TAG_RX, 0))
    return F.transform(F.filter(tags, lambda t: t != ""), lambda t: F.struct(
        F.lower(F.regexp_extract(t, r"^<([A-Za-z]+)", 1)).alias("name"),
        F.regexp_extract_all(F.regexp_extract(t, _TAG_PARTS_RX, 1), F.lit(_ATTR_RX), 0).alias("attrs")))


def _attr_value(attrs: Column, name: str) -> Column:
    """Value of the first attribute called ``name`` (case-insensitive), else null."""
    own = F.filter(attrs, lambda a: a.rlike(rf"(?i)^{name}\s*(?:=|$)"))
    first = F.try_element_at(own, F.lit(1))
    value = F.regexp_extract(first, r"(?s)^[^=]*=\s*(.*)$", 1)
    return F.when(value.rlike(r"(?s)^\".*\"$|^'.*'$") & (F.length(value) > 1),
                  F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def _values(tags: Column, tag: str, attr: str) -> Column:
    return F.transform(F.filter(tags, lambda t: t["name"] == tag), lambda t: _attr_value(t["attrs"], attr))


def references_from_tags(tags: Column) -> Column:
    """E1 on tokenized tags: script[src], then img[src], then a[href]; empty values skipped."""
    allv = F.concat(_values(tags, "script", "src"), _values(tags, "img", "src"), _values(tags, "a", "href"))
    return F.filter(allv, lambda v: v.isNotNull() & (v != ""))


def html_raw_references(text: Column) -> Column:
    """``script[src]`` values, then ``img[src]``, then ``a[href]``; empty ones skipped.

    Values are raw attribute text (entities not yet decoded).
    """
    return references_from_tags(html_tags(text))


def meta_metas(tags: Column) -> Column:
    """ARRAY<STRUCT<name, property, content>> of the meta tags."""
    return F.transform(F.filter(tags, lambda t: t["name"] == "meta"), lambda t: F.struct(
        _attr_value(t["attrs"], "name").alias("name"), _attr_value(t["attrs"], "property").alias("property"),
        _attr_value(t["attrs"], "content").alias("content")))


def meta_date_content(metas: Column) -> Column:
    """E3 choice by presence: content of meta[name=last-modified], else
    meta[property=article:modified_time], else meta[property=article:published_time]."""
    def first(pred):
        return F.try_element_at(F.filter(metas, pred), F.lit(1))
    chosen = F.coalesce(first(lambda m: m["name"] == "last-modified"),
                        first(lambda m: m["property"] == "article:modified_time"),
                        first(lambda m: m["property"] == "article:published_time"))
    return chosen["content"]


def parse_meta_date(content: Column) -> Column:
    """E3 parse of the chosen content; empty or unparsable gives null (no fall-through)."""
    return F.when(content != "", parse_date(_unescape_native(content)))


def with_meta_date(df: DataFrame, tags_col: str, out_col: str) -> DataFrame:
    """E3 on a DataFrame; the heavy pieces are materialized once as columns."""
    return (df.withColumn("_metas", meta_metas(F.col(tags_col)))
            .withColumn("_meta_content", meta_date_content(F.col("_metas")))
            .withColumn(out_col, parse_meta_date(F.col("_meta_content")))
            .drop("_metas", "_meta_content"))


def html_meta_dates(text: Column) -> Column:
    """Last-modified from HTML meta, chosen by presence, then parsed.

    ``meta[name=last-modified]`` first, else ``meta[property=article:modified_time]``,
    else ``meta[property=article:published_time]``; an unparsable or empty content
    of the chosen element gives null without falling through. (Column form; on
    large inputs prefer :func:`with_meta_date`, which computes each piece once.)
    """
    return parse_meta_date(meta_date_content(meta_metas(html_tags(text))))


_PLAIN_ENTITY_RX = r"&(?:amp|lt|gt|quot|apos|#0*39|#[xX]0*27);"
# An ampersand that the attribute rule may change: a numeric reference, or a name not followed by "=" (a name without
# ";" stays as it is before "=" or a letter or digit).
_OTHER_ENTITY_RX = r"&(?:#|[A-Za-z][A-Za-z0-9]*+(?!=))"


def _unescape_native(v: Column) -> Column:
    """Decode the five markup entities natively (values with others use Python)."""
    v = F.regexp_replace(v, "&lt;", "<")
    v = F.regexp_replace(v, "&gt;", ">")
    v = F.regexp_replace(v, "&quot;", "\"")
    v = F.regexp_replace(v, "&(?:#0*39|#[xX]0*27|apos);", "'")
    return F.regexp_replace(v, "&amp;", "&")


def _entities_native(v: Column) -> Column:
    """True where :func:`_unescape_native` equals the attribute rule."""
    return ~v.contains("&") | ~F.regexp_replace(v, _PLAIN_ENTITY_RX, " ").rlike(_OTHER_ENTITY_RX)


_ENTITY = re.compile(r"&(?:#([0-9]+);?|#[xX]([0-9a-fA-F]+);?|([A-Za-z][A-Za-z0-9]*;?))")


def unescape_attribute(value: str) -> str:
    """Character references of an attribute value: a name without ``;`` that is followed by ``=``, a letter or a digit
    stays as it is."""
    def one(m: re.Match) -> str:
        if m[3] is None:
            return _html.unescape(m[0] if m[0].endswith(";") else m[0] + ";")
        name = m[3]
        if name.endswith(";") and name in html5:
            return html5[name]
        for end in range(len(name.rstrip(";")), 0, -1):     # the longest name that is known without ";"
            if name[:end] in html5:
                after = name[end:end + 1] or value[m.end():m.end() + 1]
                if after == "=" or after.isalnum() and after.isascii():
                    return m[0]
                return html5[name[:end]] + name[end:]
        return m[0]
    return _ENTITY.sub(one, value)


_SITEMAP_ROOT_RX = (r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>\[]*(?:\[.*?\]\s*)?>\s*)*+"
                    r"<urlset(?=[\s/>])")


def sitemap_raw_locs(text: Column) -> Column:
    """``urlset/url/loc`` values of a sitemap document (entities and CDATA decoded).

    Instructions, comments and a document type may stand before the root; a document whose root is not ``urlset``
    yields none. Complete ``url`` entries of a truncated document are kept (the first ``loc`` of each).
    """
    body = F.regexp_replace(text, r"(?s)<!--.*?(?:-->|\z)", "")
    entries = F.regexp_extract_all(body, F.lit(r"(?s)<url(?:\s[^>]*)?>(.*?)</url\s*>"), 1)
    locs = F.transform(entries, lambda e: F.regexp_extract(e, r"(?s)<loc(?:\s[^>]*)?>(.*?)</loc\s*>", 1))
    locs = F.transform(locs, lambda v: js_trim_loc(F.when(
        v.rlike(r"(?s)^\s*<!\[CDATA\["), F.regexp_replace(v, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))
        .otherwise(_unescape_native(v))))
    return F.when(text.rlike(_SITEMAP_ROOT_RX), F.filter(locs, lambda v: v != "")).otherwise(
        F.when(text.isNotNull(), F.array().cast("array<string>")))


def js_trim_loc(v: Column) -> Column:
    return F.regexp_replace(v, r"^\s+|\s+$", "")


# --- resolution of raw references (E2) --------------------------------------

@F.pandas_udf(T.ArrayType(T.StringType()))
def _resolve_rest_udf(rest: pd.Series, base: pd.Series, unescape: pd.Series) -> pd.Series:
    """Resolved values of the references the native path does not cover, in their order."""
    out = []
    for refs, b, un in zip(rest, base, unescape):
        out.append(None if refs is None else [whatwg.resolve(unescape_attribute(r) if un else r, b) for r in refs])
    return pd.Series(out, dtype=object)


def prepared_references(raw: Column, base: Column, unescape: Column) -> Column:
    """ARRAY<STRUCT<r, v>>: each raw reference with its natively resolved value, null where the full algorithm is needed."""
    def one(r):
        v = F.when(unescape, _unescape_native(r)).otherwise(r)
        ok = (~unescape | _entities_native(r)) & U.native_resolvable(v, base)
        return F.struct(r.alias("r"), F.when(ok, U.resolve_native(v, base)).alias("v"))
    return F.transform(raw, one)


def rest_of(prepared: Column) -> Column:
    """Distinct raw references left for the full algorithm; null if there are none (the usual case)."""
    rest = F.array_distinct(F.transform(F.filter(prepared, lambda x: x["v"].isNull()), lambda x: x["r"]))
    return F.when(F.size(rest) > 0, rest)


def merged_references(prepared: Column, rest: Column, resolved: Column) -> Column:
    """Resolved references in document order, distinct, first position kept; unresolvable ones are skipped."""
    values = F.transform(prepared, lambda x: F.coalesce(
        x["v"], F.try_element_at(resolved, F.array_position(rest, x["r"]).cast("int"))))
    return F.array_distinct(F.filter(F.when(rest.isNull(), F.transform(prepared, lambda x: x["v"])).otherwise(values),
                                     lambda v: v.isNotNull()))


def with_references(df: DataFrame, raw_col: str, base_col: str, out_col: str,
                    unescape: Column | bool = True, bad_refs: str | None = None) -> DataFrame:
    """Resolve a row's raw references against its url; distinct, first position kept.

    Routing is per reference: each one that needs no more than splitting, dot-segment folding and encoding is resolved by
    a JVM ``transform``; only the remaining ones (and nulls for rows without any) reach one Arrow-batched UDF.
    References that cannot be resolved are skipped; ``bad_refs`` names a column for their number.
    """
    if isinstance(unescape, Column):
        prep, slow = _resolution_exprs(raw_col, base_col, unescape)
    else:
        prep, slow = _cached_resolution_exprs(raw_col, base_col, bool(unescape))
    out = (df.withColumn("_prep", prep).withColumn("_rest", rest_of(F.col("_prep"))).withColumn("_res", slow)
           .withColumn(out_col, merged_references(F.col("_prep"), F.col("_rest"), F.col("_res"))))
    if bad_refs:
        out = out.withColumn(bad_refs, F.coalesce(F.size(F.filter("_res", lambda v: v.isNull())), F.lit(0)))
    return out.drop("_prep", "_rest", "_res")


def _resolution_exprs(raw_col: str, base_col: str, unescape: Column):
    raw, base, rest = F.col(raw_col), F.col(base_col), F.col("_rest")
    has = rest.isNotNull()
    return prepared_references(raw, base, unescape), _resolve_rest_udf(rest, F.when(has, base), F.when(has, unescape))


@lru_cache(maxsize=64)
def _cached_resolution_exprs(raw_col: str, base_col: str, unescape: bool):
    """Column expressions depend only on the column names: built once per process."""
    return _resolution_exprs(raw_col, base_col, F.lit(unescape))


def link_edges(assets: DataFrame, src_col: str = "url", refs_col: str = "references",
               keep: list[str] | None = None) -> DataFrame:
    """E5: one row per (asset, reference) with the reference's 0-based position.

    ``dst`` is the reference form (encoded, fragment kept), ``dst_queue`` the
    queue key (fragment cleared) and ``dst_key`` the report key (decoded).
    """
    keep = keep or []
    # posexplode_outer + filter: a plain generator makes Spark infer
    # size(refs) > 0 and push it below the projection that computes refs,
    # which would evaluate the whole reference extraction a second time.
    e = assets.select(*keep, F.col(src_col).alias("src"),
                      F.posexplode_outer(F.col(refs_col)).alias("pos", "dst")).where(F.col("dst").isNotNull())
    e = e.withColumn("dst_queue", U.strip_fragment(F.col("dst")))
    return U.with_decoded(e, "dst_queue", "dst_key")


# --- DataFrame-level names of SURVEY §2 ------------------------------------------

def extract_references(df: DataFrame, text_col: str = "text", out_col: str = "raw_refs") -> DataFrame:
    """E1 on a DataFrame: adds the raw references of an HTML text column."""
    return df.withColumn(out_col, html_raw_references(F.col(text_col)))


def resolve_references(df: DataFrame, raw_col: str = "raw_refs", base_col: str = "url",
                       out_col: str = "references") -> DataFrame:
    """E2 on a DataFrame (see :func:`with_references`)."""
    return with_references(df, raw_col, base_col, out_col)


def html_last_modified(df: DataFrame, text_col: str = "text", out_col: str = "last_modified") -> DataFrame:
    """E3 on a DataFrame: tokenizes once, then picks and parses the meta date."""
    return with_meta_date(df.withColumn("_tags", html_tags(F.col(text_col))), "_tags", out_col).drop("_tags")


def sitemap_references(df: DataFrame, text_col: str = "text", base_col: str = "url",
                       out_col: str = "references") -> DataFrame:
    """E4 on a DataFrame: sitemap locs resolved against the sitemap's url."""
    d = df.withColumn("_locs", sitemap_raw_locs(F.col(text_col)))
    return with_references(d, "_locs", base_col, out_col, unescape=False).drop("_locs")
