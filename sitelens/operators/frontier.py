"""Frontier operators (F1-F8, F10, F11): filters, dedup, seen-set, FIFO rank, progress.

Frontier rows carry ``crawl_id`` so many independent crawls (one per target
site) advance together in the same jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import mime as M
from sitelens.functions import urls as U
from sitelens.operators.ranking import ordinal_within


def url_mime_rejected(url: Column, mimes: Sequence[str]) -> Column:
    """rejected only when the path's MIME is known and not listed (no list: never)."""
    if not mimes:
        return F.lit(False)
    m = M.mime_for_path(U.url_path(url))
    return F.coalesce(m.isNotNull() & ~m.isin(*mimes), F.lit(False))


def filter_url_mime(df: DataFrame, url_col: str, mimes: Sequence[str]) -> DataFrame:
    return df.where(~url_mime_rejected(F.col(url_col), mimes))


def filter_same_host(df: DataFrame, url_col: str, host_col: str) -> DataFrame:
    """hostname equality (scheme and port ignored, subdomains differ)."""
    return df.where(U.url_host(F.col(url_col)) == F.col(host_col))


def filter_include(df: DataFrame, url_col: str, rx: str | None) -> DataFrame:
    """keep urls the (unanchored) pattern matches."""
    return df if not rx else df.where(F.col(url_col).rlike(rx))


def filter_exclude(df: DataFrame, url_col: str, rx: str | None) -> DataFrame:
    """drop urls the (unanchored) pattern matches."""
    return df if not rx else df.where(~F.col(url_col).rlike(rx))


def skip_reason(url: Column, target_host: Column, mimes: Sequence[str] = (),
                include: str | None = None, exclude: str | None = None) -> Column:
    """first failing test in the order mime, host, include, exclude; null = enqueue."""
    r = F.when(url_mime_rejected(url, mimes), F.lit("mime"))
    r = r.when(F.coalesce(U.url_host(url) != target_host, F.lit(True)), F.lit("host"))
    if include:
        r = r.when(~url.rlike(include), F.lit("include"))
    if exclude:
        r = r.when(url.rlike(exclude), F.lit("exclude"))
    return r


def skip_reason_by(url: Column, target_host: Column, mimes: Column, include: Column, exclude: Column) -> Column:
    """F5 with filters from columns: ``mimes`` an array (null or empty: all), the patterns strings (null or empty: none)."""
    m = M.mime_for_path(U.url_path(url))
    given = lambda c: F.coalesce(c != "", F.lit(False))     # noqa: E731
    return (F.when(F.coalesce((F.size(mimes) > 0) & m.isNotNull() & ~F.array_contains(mimes, m), F.lit(False)), F.lit("mime"))
            .when(F.coalesce(U.url_host(url) != target_host, F.lit(True)), F.lit("host"))
            .when(given(include) & ~F.rlike(url, include), F.lit("include"))
            .when(given(exclude) & F.rlike(url, exclude), F.lit("exclude")))


def filter_asset_mime_by(assets: DataFrame, mimes: Column) -> DataFrame:
    """F10 with the list from a column (null or empty: all)."""
    return assets.where(F.coalesce((F.size(mimes) <= 0) | F.col("data_mime").isNull() | F.array_contains(mimes, F.col("data_mime")), F.lit(True)))


def enqueue_decisions(edges: DataFrame, url_col: str, host_col: str, mimes: Sequence[str] = (),
                      include: str | None = None, exclude: str | None = None) -> DataFrame:
    """F5 on a table: adds ``skip_reason`` and ``keep``."""
    reason = skip_reason(F.col(url_col), F.col(host_col), mimes, include, exclude)
    return edges.withColumn("skip_reason", reason).withColumn("keep", F.col("skip_reason").isNull())


def new_frontier(cands: DataFrame, seen: DataFrame | None) -> DataFrame:
    """one row per (crawl_id, url) with the earliest (parent_rank, pos); never-seen only.

    The min is a partial aggregate, so a url linked from every page costs one
    row per task before the shuffle.
    """
    first = (cands.groupBy("crawl_id", "url")
             .agg(F.min(F.struct("parent_rank", "pos")).alias("k"))
             .select("crawl_id", "url", "k.parent_rank", "k.pos"))
    if seen is None:
        return first
    return first.join(seen.select("crawl_id", "url"), ["crawl_id", "url"], "left_anti")


def block_urls(seen: DataFrame, urls: DataFrame) -> DataFrame:
    """add urls to the seen-set without queueing them."""
    return seen.select("crawl_id", "url").unionByName(urls.select("crawl_id", "url")).distinct()


def fifo_rank(frontier: DataFrame) -> DataFrame:
    """F8: dense 1-based processing order within a crawl level by (parent_rank, pos, url)."""
    return ordinal_within(frontier, ["crawl_id"], ["parent_rank", "pos", "url"], out="rank")


def filter_asset_mime(assets: DataFrame, mimes: Sequence[str]) -> DataFrame:
    """report an asset when there is no list, its MIME is null, or listed exactly."""
    if not mimes:
        return assets
    return assets.where(F.col("data_mime").isNull() | F.col("data_mime").isin(*[m.strip() for m in mimes]))


def crawl_progress(frontier_log: DataFrame) -> DataFrame:
    """per crawl and depth: urls processed at that depth and running total.

    The window runs over the already aggregated (crawl, depth) rows, a handful
    per crawl.
    """
    per = frontier_log.groupBy("crawl_id", "depth").agg(F.count(F.lit(1)).cast("long").alias("processed"))
    w = Window.partitionBy("crawl_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("total", F.sum("processed").over(w).cast("long"))
