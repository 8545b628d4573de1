"""robots.txt as a table job (B1-B5). Input rows carry the file text in ``content``.

Directives are extracted with the same unanchored, case-sensitive patterns as
the reference: ``\\s*`` may cross a newline, comments are not stripped, and
Allow/Crawl-delay are reported, not enforced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import urls as U

# The directive patterns.
ALLOW_RX = r"Allow:\s*(\S+)"
SITEMAP_RX = r"Sitemap:\s*(\S+)"
CRAWL_DELAY_RX = r"Crawl-delay:\s*(\d+)"


def robots_url(seed: Column) -> Column:
    """B1: origin of the seed + ``/robots.txt``."""
    return F.concat(U.url_origin(seed), F.lit("/robots.txt"))


def robots_allowed(content: Column) -> Column:
    """B2: distinct Allow values in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(ALLOW_RX), 1))


def robots_sitemaps(content: Column) -> Column:
    """Distinct Sitemap values in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(SITEMAP_RX), 1))


def robots_min_delay(content: Column) -> Column:
    """Smallest Crawl-delay (integer prefix), null when there is none."""
    vals = F.transform(F.regexp_extract_all(content, F.lit(CRAWL_DELAY_RX), 1),
                       lambda v: v.try_cast("long"))
    return F.array_min(vals)


def parse_robots(df: DataFrame, content_col: str = "content") -> DataFrame:
    c = F.col(content_col)
    return df.withColumns({"allowed": robots_allowed(c), "sitemaps": robots_sitemaps(c),
                           "min_crawl_delay": robots_min_delay(c)})


def seed_frontier(seeds: DataFrame, robots: DataFrame | None = None) -> DataFrame:
    """Level-0 frontier: the seed, then its robots sitemaps (no filters applied).

    ``seeds``: crawl_id, url. ``robots``: crawl_id, content. Duplicates keep
    their first position (F6); ranks are 1-based.
    """
    s = seeds.select("crawl_id", "url", F.lit(0).alias("pos"))
    if robots is not None:
        sm = robots.select("crawl_id", F.posexplode(robots_sitemaps(F.col("content"))).alias("pos", "url"))
        s = s.unionByName(sm.select("crawl_id", "url", (F.col("pos") + 1).alias("pos")))
    from sitelens.operators.frontier import fifo_rank, new_frontier
    first = new_frontier(s.withColumn("parent_rank", F.lit(0).cast("long")), None)
    return fifo_rank(first).withColumn("depth", F.lit(0))
