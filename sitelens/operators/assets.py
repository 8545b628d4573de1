"""Asset rows from fetched responses (one narrow stage; body dropped at the end).

Everything is computed with native expressions where the url needs no more
than splitting and encoding (``_url_ok``), and so is each single reference
that does not. The rest (whole rows with other urls, single references
elsewhere) goes through one Arrow-batched UDF fed from natively extracted
inputs, null wherever there is nothing to do.
Keeping a single Python stage matters: when two Python stages follow each
other, Spark inlines every projection between them into the second stage,
which would repeat the HTML tokenizing several times per row.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions import content as C
from sitelens.functions import mime as M
from sitelens.functions import urls as U
from sitelens.functions import whatwg
from sitelens.operators import extract as E
from sitelens.operators.responses import asset_kind, guess_mime, ok_responses

_SLOW = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("data_mime", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("references", T.ArrayType(T.StringType())),
])


def _py_mime_for_path(path: str | None, table: dict[str, str]) -> str | None:
    if path is None:
        return None
    p = path.strip(" ").lower()
    key = p if "." not in p else p.rsplit(".", 1)[1]
    return table.get(key)


def _py_kind(mime: str, url: str) -> str:
    if mime.startswith("text/html") or mime.startswith("application/xhtml+xml"):
        return "html"
    if mime.endswith("xml") and url.endswith("sitemap.xml"):
        return "sitemap"
    return "other"


def _slow_rows_udf(table: dict[str, str]):
    """The slow path, with the driver's extension table sent along: workers may have another one."""
    @F.pandas_udf(_SLOW)
    def _finish_slow_rows(final_url: pd.Series, media: pd.Series, html_refs: pd.Series, sitemap_refs: pd.Series,
                          rest: pd.Series, base: pd.Series, unescape: pd.Series) -> pd.DataFrame:
        """Rows whose url needs the full parser are finished here (first four arguments); of the others only the single
        references that do (last three), answered in their order. All arguments are null where nothing is to be done."""
        urls, mimes, kinds, refs = [], [], [], []
        for fu, med, hr, sr, rs, b, un in zip(final_url, media, html_refs, sitemap_refs, rest, base, unescape):
            if fu is None:
                urls.append(None), mimes.append(None), kinds.append(None)
                refs.append(None if rs is None else [whatwg.resolve(E.unescape_attribute(r) if un else r, b) for r in rs])
                continue
            url = whatwg.report_key(fu)
            href = whatwg.resolve(fu)
            mime = med if med else (_py_mime_for_path(whatwg.pathname(href), table) or M.DEFAULT_MIME)
            kind = _py_kind(mime, url) if url is not None else "other"
            raw = list(hr) if kind == "html" and hr is not None else \
                list(sr) if kind == "sitemap" and sr is not None else []
            out, seen = [], set()
            if url is not None:
                for r in raw:
                    v = whatwg.resolve(E.unescape_attribute(r) if kind == "html" else r, url)
                    if v is not None and v not in seen:
                        seen.add(v)
                        out.append(v)
            urls.append(url), mimes.append(mime), kinds.append(kind), refs.append(out)
        return pd.DataFrame({"url": urls, "data_mime": mimes, "kind": kinds, "references": refs})

    return _finish_slow_rows


def build_assets(responses: DataFrame, url_col: str = "final_url", keep: list[str] | None = None,
                 keep_body: bool = False) -> DataFrame:
    """Asset rows (url, last_modified, data_mime, charset, hash, references) for 2xx responses.

    ``responses`` needs ``url_col`` (the url the body was served from), status,
    content_type, last_modified_hdr and body. ``keep`` columns are carried
    (e.g. snapshot_id, ord). Adds ``kind`` (R8). References that cannot be
    resolved are skipped instead of dropping the page.
    """
    keep = keep or []
    x = _exprs(frozenset(M.EXTENSION_MIME.items()))
    ok = ok_responses(responses)
    # stage 1: response columns and the natively canonical url
    a = ok.select(*keep, F.col(url_col).alias("_fu"), "body", "last_modified_hdr", x["ct"], x["hash"])
    a = a.select(*keep, "_fu", "body", "last_modified_hdr", "hash", x["media"], x["charset"], x["url_ok"])
    a = a.select("*", x["url"])
    a = a.select("*", x["mime"])
    # stage 2: parser routing; rows whose url needs the full parser are parsed both ways
    a = a.select("*", x["kind"])
    a = a.select(*[c for c in a.columns if c != "body"], x["text"], *(["body"] if keep_body else []))
    a = a.select("*", x["tags"])
    a = a.select(*[c for c in a.columns if c not in ("_text", "_tags")], x["html_refs"], x["sm_refs"], x["metas"])
    a = a.select(*[c for c in a.columns if c != "_metas"], x["meta_content"])
    a = a.select(*[c for c in a.columns if c != "_meta_content"], x["meta_date"], x["raw"])
    # stage 3: references natively where possible, one UDF stage for the rest
    a = a.select("*", x["prep"])
    a = a.select("*", x["rest"])
    a = a.select("*", x["slow"])
    return a.select(*keep, *x["final"], *(["body"] if keep_body else []))


@lru_cache(maxsize=1)
def _exprs(table: frozenset) -> dict:
    """The pipeline's column expressions under an extension table. They refer only to the pipeline's own
    column names, so they are built once per process and table: building them costs
    thousands of calls into the JVM, analysing them costs nothing extra."""
    x = {}
    fu = F.col("_fu")
    x["ct"] = C.parse_content_type(F.col("content_type")).alias("_ct")
    x["hash"] = C.content_hash(F.col("body")).alias("hash")
    x["media"] = F.col("_ct.media_type").alias("_media")
    x["charset"] = F.col("_ct.charset").alias("charset")
    x["url_ok"] = U.report_key_native_ok(fu).alias("_url_ok")
    x["url"] = F.when(F.col("_url_ok"), U.report_key_native(fu)).alias("_url")
    x["mime"] = guess_mime(F.col("_media"), F.col("_url")).alias("_mime")
    x["kind"] = asset_kind(F.col("_mime"), F.col("_url")).alias("_kind")
    html = (F.col("_kind") == "html") | ~F.col("_url_ok")
    sitemap = (F.col("_kind") == "sitemap") | ~F.col("_url_ok")
    x["text"] = F.when(html | sitemap, C.decode_text(F.col("body"))).alias("_text")
    x["tags"] = F.when(html, E.html_tags(F.col("_text"))).alias("_tags")
    x["html_refs"] = F.when(html, E.references_from_tags(F.col("_tags"))).alias("_html_refs")
    x["sm_refs"] = F.when(sitemap, E.sitemap_raw_locs(F.col("_text"))).alias("_sm_refs")
    x["metas"] = F.when(html, E.meta_metas(F.col("_tags"))).alias("_metas")
    x["meta_content"] = E.meta_date_content(F.col("_metas")).alias("_meta_content")
    x["meta_date"] = E.parse_meta_date(F.col("_meta_content")).alias("_meta_date")
    x["raw"] = (F.when(F.col("_kind") == "html", F.col("_html_refs"))
                .when(F.col("_kind") == "sitemap", F.col("_sm_refs"))
                .otherwise(F.array().cast("array<string>"))).alias("_raw")
    base, is_html, nat = F.col("_url"), F.col("_kind") == "html", F.col("_url_ok")
    x["prep"] = F.when(nat, E.prepared_references(F.col("_raw"), base, is_html)).alias("_prep")
    x["rest"] = E.rest_of(F.col("_prep")).alias("_rest")
    has = F.col("_rest").isNotNull()
    x["slow"] = _slow_rows_udf(dict(table))(F.when(~nat, fu), F.when(~nat, F.col("_media")), F.when(~nat, F.col("_html_refs")),
                                  F.when(~nat, F.col("_sm_refs")), F.col("_rest"), F.when(has, base),
                                  F.when(has, is_html)).alias("_slow")
    fast_refs = E.merged_references(F.col("_prep"), F.col("_rest"), F.col("_slow.references"))
    kind = F.when(nat, F.col("_kind")).otherwise(F.col("_slow.kind"))
    x["final"] = [
        F.when(nat, F.col("_url")).otherwise(F.col("_slow.url")).alias("url"),
        F.coalesce(C.parse_date(F.col("last_modified_hdr")),
                   F.when(kind == "html", F.col("_meta_date"))).alias("last_modified"),
        F.when(nat, F.col("_mime")).otherwise(F.col("_slow.data_mime")).alias("data_mime"),
        F.col("charset"), F.col("hash"),
        F.when(nat, fast_refs).otherwise(F.col("_slow.references")).alias("references"),
        kind.alias("kind"),
    ]
    return x
