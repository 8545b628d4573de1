"""sitelens: website snapshot and change analytics as Spark DataFrame jobs.

Input is a fetch log (``responses``); outputs are asset rows, the link graph,
crawl closures, robots/sitemap extracts, a content-addressed body store,
change sets between snapshots and archive lookups.
"""

from sitelens.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
