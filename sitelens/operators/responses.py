"""Response processing: R1 redirects, R2 success filter, R4 MIME guess, R8 routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import mime as M
from sitelens.functions import urls as U

REDIRECT_LIMIT = 10  # requests per asset, so 9 redirects still succeed


def ok_responses(df: DataFrame, status_col: str = "status") -> DataFrame:
    """R2: keep 200 <= status < 300."""
    return df.where(F.col(status_col).between(200, 299))


def guess_mime(media_type: Column, url: Column) -> Column:
    """The header's media type, else the path-extension guess, else octet-stream."""
    given = F.when(media_type != "", media_type)
    return F.coalesce(given, M.mime_for_path(U.url_path(url)), F.lit(M.DEFAULT_MIME))


def asset_kind(mime: Column, url: Column) -> Column:
    """R8: 'html', 'sitemap' or 'other' (what the parser does with the body)."""
    return (F.when(mime.startswith("text/html") | mime.startswith("application/xhtml+xml"), F.lit("html"))
            .when(mime.endswith("xml") & url.endswith("sitemap.xml"), F.lit("sitemap"))
            .otherwise(F.lit("other")))


def _last_by_request(responses: DataFrame) -> DataFrame:
    """Slim view: one (status, location) per request url, the latest ``ord`` winning.

    Only these four small columns are shuffled; bodies stay where they are.
    """
    return (responses.groupBy("request_url")
            .agg(F.max_by(F.struct("ord", "status", "location"), F.col("ord")).alias("r"))
            .select("request_url", "r.*"))


ABSOLUTE_RX = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _jumps(redirects: DataFrame, most: int, checkpoint: bool) -> list[tuple[int, DataFrame]]:
    """[(2**i, table at -> to)]: where exactly 2**i redirects lead, as far as ``most`` needs it and such chains are there.

    Each table is the one before, joined with itself: a chain of any allowed length takes log2 joins, not one a hop. A
    relative Location is where a chain ends, so nothing is joined behind it.
    """
    out, size, table = [], 1, redirects
    while True:
        if checkpoint:
            table = table.checkpoint(eager=True)
            if table.isEmpty():
                return out
        out.append((size, table))
        if 2 * size > most:
            return out
        second = table.where(F.col("at").rlike(ABSOLUTE_RX)).select(F.col("at").alias("to"), F.col("to").alias("end"))
        table, size = table.join(second, "to").select("at", F.col("end").alias("to")), 2 * size


def resolve_redirects(responses: DataFrame, requests: DataFrame | None = None,
                      limit: int | str = REDIRECT_LIMIT, statuses: tuple[int, ...] = (301,),
                      checkpoint: bool = True, relative: bool = False) -> DataFrame:
    """Follow redirects for every request, at most ``limit`` requests each.

    ``requests`` (default: every request url of ``responses``) has ``request_url``; other columns are carried. ``limit`` may name
    one of them, a limit for each request. Works on slim columns only, by path doubling: tables of where 1, 2, 4, 8, ...
    redirects lead are joined to the requests, the longest first, wherever the hops so far leave room for it. So the
    hop count is exact at the limit, and a limit of 10 takes 4 rounds. A relative Location is requested as
    is and fails (``bad_location``); with ``relative`` it is resolved against the url that sent it. After ``limit``
    requests the chain ends without data (``redirect_limit``), whatever the last Location says.

    Output: request columns + final_url (raw value of the last Location
    followed), hops, outcome in {ok, status, redirect_limit, bad_location,
    missing}, status and ``response_ord`` of the final response. Bodies are
    attached by joining ``response_ord``/``final_url`` where needed (see
    ``sitelens.plans.crawl.fetched_table``).
    """
    resp = _last_by_request(responses)
    is_redirect = F.col("status").isin(*statuses) & F.col("location").isNotNull() & (F.col("location") != "")
    if checkpoint:
        # materialized once: otherwise every round would re-scan and re-shuffle the log
        resp = resp.checkpoint(eager=True)
    redirects = resp.where(is_redirect).select(F.col("request_url").alias("at"), F.col("location").alias("to"))
    if relative:
        redirects = U.with_resolved(redirects, "to", "at", "_to").select("at", F.coalesce("_to", "to").alias("to"))
    known = F.coalesce(is_redirect, F.lit(False))
    if requests is None:
        # a request's own response says whether it redirects: only redirecting ones are joined
        requests = resp.select("request_url")
        first = resp.where(~known).select("request_url", F.col("request_url").alias("at"), F.lit(0).alias("hops"),
                                          F.col("ord").alias("response_ord"), "status")
        step = resp.where(known).select("request_url", F.col("request_url").alias("at"), F.lit(0).alias("hops"))
    else:
        first = None
        step = requests.withColumns({"at": F.col("request_url"), "hops": F.lit(0)})
    by_row = isinstance(limit, str)
    most = int(requests.agg(F.max(limit)).first()[0] or 0) if by_row else limit
    cap = F.col(limit) if by_row else F.lit(limit)
    for size, table in reversed(_jumps(redirects, most, checkpoint)):
        step = step.join(table, "at", "left")
        go = F.col("to").isNotNull() & (F.col("hops") + size <= cap)
        if size < most:     # after the first jump, a chain goes on from an absolute Location only
            go = go & ((F.col("hops") == 0) | F.col("at").rlike(ABSOLUTE_RX))
        step = step.withColumns({"at": F.when(go, F.col("to")).otherwise(F.col("at")), "hops": F.when(go, F.col("hops") + size).otherwise(F.col("hops"))}).drop("to")
    flag = (F.when((F.col("hops") > 0) & (F.col("hops") >= cap), "redirect_limit")
            .when((F.col("hops") > 0) & ~F.col("at").rlike(ABSOLUTE_RX), "bad_location"))
    final_resp = resp.select(F.col("request_url").alias("at"), F.col("ord").alias("response_ord"), "status")
    out = step.withColumn("flag", flag).join(final_resp, "at", "left")
    if first is not None:
        out = out.unionByName(first.withColumn("flag", F.lit(None).cast("string")))
    outcome = (F.when(F.col("flag").isNotNull(), F.col("flag"))
               .when(F.col("status").isNull(), F.lit("missing"))
               .when(F.col("status").between(200, 299), F.lit("ok"))
               .otherwise(F.lit("status")))
    keep_resp = F.col("flag").isNull()
    return out.select(
        *requests.columns,
        F.col("at").alias("final_url"), F.col("hops").cast("int").alias("hops"), outcome.alias("outcome"),
        F.when(keep_resp, F.col("status")).alias("status"),
        F.when(keep_resp, F.col("response_ord")).alias("response_ord"))
