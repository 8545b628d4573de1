"""Crawl closure (F9), its state (P2), resume (P3) and settings of each crawl.

Every response is processed once, up front, in one narrow stage (redirects,
asset columns, references; the body is dropped), giving a slim ``fetched``
table and an ``edges`` table keyed by request url. The crawl is then a
level-synchronous loop over slim bucketed tables: frontier ⋈ edges → enqueue
filters of the row's own crawl → least FIFO key → anti join with the seen-set
→ the next level, written once (and counted while it is written). Many crawls
(one per ``crawl_id``) advance together.

State folder: ``crawls`` (one row per crawl: target, start time, settings and
the filters they say), ``levels/level=n`` (bucketed by crawl and url; a level
counts once its write is committed) and ``seen`` (merged runs of them).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import urls as U
from sitelens.operators.assets import build_assets
from sitelens.operators.extract import link_edges
from sitelens.operators.frontier import filter_asset_mime, filter_asset_mime_by, skip_reason_by
from sitelens.operators.ranking import ordinal_within
from sitelens.operators.responses import resolve_redirects
from sitelens.session import list_folders, modified_at, path_exists, scratch_dir, shuffle_partitions
from sitelens.sources.bucketed import SeenSet, buckets_for, open_bucketed, write_bucketed

VERSION = "sitelens-0.1"


def fetched_table(responses: DataFrame, persist: bool = True) -> DataFrame:
    """Per request url: redirect outcome plus the asset columns of its final response.

    Every 2xx response is parsed once (``build_assets`` on its own url); the
    redirect chains (slim) then point each request at its final response, so
    bodies never move through a shuffle. Two requests ending at one response
    share its asset row (reference behaviour). ``persist`` checkpoints the slim
    result, which the crawl loop reads once per level.
    """
    chains = resolve_redirects(responses)
    src = responses.withColumns({"final_url": F.col("request_url"), "_src_url": F.col("request_url"),
                                 "_src_ord": F.col("ord")})
    assets = build_assets(src, keep=["_src_url", "_src_ord"])
    ok = chains.where(F.col("outcome") == "ok")
    fetched_ok = ok.join(assets, (ok.final_url == assets._src_url) & (ok.response_ord == assets._src_ord)) \
        .drop("_src_url", "_src_ord", "status", "response_ord")
    failed = chains.where(F.col("outcome") != "ok").select(
        "request_url", "final_url", "hops", "outcome",
        *[F.lit(None).cast(t).alias(c) for c, t in (
            ("url", "string"), ("last_modified", "string"), ("data_mime", "string"),
            ("charset", "string"), ("hash", "string"), ("references", "array<string>"),
            ("kind", "string"))])
    out = fetched_ok.unionByName(failed)
    return out.checkpoint(eager=True) if persist else out


def _buckets_of(fetched: DataFrame) -> int:
    """Buckets of a crawl's tables, by the number of its links."""
    links = fetched.where(F.col("outcome") == "ok").agg(F.sum(F.size("references"))).first()[0]
    return buckets_for(fetched.sparkSession, links or 0)


def fetched_edges(fetched: DataFrame, persist: bool = True, buckets: int | None = None) -> DataFrame:
    """request_url, pos, dst_queue for every reference of every fetched asset.

    ``persist`` writes them bucketed by ``request_url``, the key that every level
    joins on: a level exchanges only its own (small) frontier, or broadcasts it.
    """
    spark = fetched.sparkSession
    e = link_edges(fetched.where(F.col("outcome") == "ok"), src_col="url", keep=["request_url"])
    e = e.select("request_url", "pos", "dst_queue")
    if not persist:
        return e
    n = buckets or _buckets_of(fetched)
    return write_bucketed(e.repartition(n, "request_url"), scratch_dir(spark, "edges"), ["request_url"], n)[0]


def canonical_seeds(seeds: DataFrame) -> DataFrame:
    """crawl_id, url (queue key of the seed), target_host."""
    s = U.with_resolved(seeds.withColumn("_b", F.col("seed")), "seed", "_b", "_href")
    return s.select("crawl_id", U.strip_fragment(F.col("_href")).alias("url"),
                    U.url_host(F.col("_href")).alias("target_host"))


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _now() -> str:
    return _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


# --- crawls and their settings -------------------------------------------------------------------------------------

def setting(settings, name: str):
    """A setting of a map column; empty counts as unset."""
    return F.nullif(F.get(F.map_values(F.map_filter(settings, lambda k, v: k == F.lit(name))), F.lit(0)), F.lit(""))


def settings_filters(settings) -> dict:
    """The filters that a settings map names: mimes (array), include, exclude."""
    listed = F.transform(F.split(setting(settings, "mimeFilter"), ","), lambda m: F.trim(m))
    return {"mimes": F.coalesce(listed, F.array().cast("array<string>")),
            "include": setting(settings, "includeUrls"), "exclude": setting(settings, "excludeUrls")}


def _crawls(seeds: DataFrame, mimes: Sequence[str], include: str | None, exclude: str | None) -> DataFrame:
    """One row per crawl. ``seeds`` may have ``settings`` (map) and ``started``; what a crawl's settings leave open, the
    literals say."""
    s = canonical_seeds(seeds).withColumnRenamed("url", "target_url")
    own = seeds.select("crawl_id", F.col("seed").alias("url"),
                       (F.col("started") if "started" in seeds.columns else F.lit(_now())).alias("started"),
                       (F.col("settings") if "settings" in seeds.columns else F.create_map().cast("map<string,string>")).alias("settings"))
    f = settings_filters(F.col("settings"))
    default = F.array(*[F.lit(m) for m in mimes]).cast("array<string>")
    return own.join(s, "crawl_id").select(
        "crawl_id", "url", "target_url", "target_host", "started", "settings",
        F.when(F.size(f["mimes"]) > 0, f["mimes"]).otherwise(default).alias("mimes"),
        F.coalesce(f["include"], F.lit(include)).alias("include"), F.coalesce(f["exclude"], F.lit(exclude)).alias("exclude"))


def crawls_of(spark: SparkSession, state: str) -> DataFrame:
    return spark.read.parquet(f"{state}/crawls")


def merge_settings(stored, current, override=None):
    """Stored settings win over current ones unless ``override``; keys missing
    from the stored map keep the current value (map columns)."""
    if override is None:
        override = F.lit(False)
    kept = F.map_filter(current, lambda k, v: ~F.array_contains(F.map_keys(stored), k))
    return F.when(override, current).otherwise(F.map_concat(kept, stored))


# --- levels ----------------------------------------------------------------------------------------------------------

KEYS = ["crawl_id", "url"]
LEVEL = "crawl_id string, url string, parent_rank long, pos int"
ROWS_A_TASK = 100_000
BLOCKED = -1        # the level of urls that are seen but never processed (resume)


def _write_level(df: DataFrame, state: str, level: int, buckets: int) -> tuple[DataFrame, int]:
    return write_bucketed(df.select(*KEYS, F.col("parent_rank").cast("long"), F.col("pos").cast("int")), f"{state}/levels/level={level}",
                          KEYS, buckets)


def _committed(spark: SparkSession, state: str) -> list[int]:
    found = [int(n.split("=")[1]) for n in list_folders(spark, f"{state}/levels") if n.startswith("level=")]
    return sorted(n for n in found if path_exists(spark, f"{state}/levels/level={n}/_SUCCESS"))


def last_level(spark: SparkSession, state: str) -> int:
    """The last level whose write was committed: what a crawl goes on from, also after its driver was killed."""
    return _committed(spark, state)[-1]


def _levels(spark: SparkSession, state: str) -> DataFrame:
    """The rows of all committed levels, with ``level``."""
    paths = [f"{state}/levels/level={n}" for n in _committed(spark, state)]
    return spark.read.schema(f"{LEVEL}, level int").option("basePath", f"{state}/levels").parquet(*paths)


def _first_discovery(cand: DataFrame) -> DataFrame:
    """F6 with FIFO keys: one row per (crawl_id, url), the smallest (rank of its discoverer, position there) wins.

    The aggregate is partial before its shuffle, so a url linked from every page
    costs one row per task.
    """
    return (cand.groupBy(*KEYS).agg(F.min(F.struct("parent_rank", "pos")).alias("k"))
            .select(*KEYS, F.col("k.parent_rank").alias("parent_rank"), F.col("k.pos").alias("pos")))


def _with_rank(level: DataFrame, rows: int) -> DataFrame:
    """A level's rows (``rows`` of them) with ``rank``, a long that orders them as a FIFO queue would.

    Rows are range-partitioned on (crawl, key) and numbered in place, so a crawl that holds most of a level is spread over
    many tasks. Ranks are not dense, but ordered, and only compared within the next level, which one job writes.
    """
    n = min(_partitions(level.sparkSession), 1 + rows // ROWS_A_TASK)      # a small level is sorted by one task, without sampling
    order = ["crawl_id", "parent_rank", "pos", "url"]
    return (level.repartitionByRange(n, *order).sortWithinPartitions(*order)
            .withColumn("rank", F.monotonically_increasing_id()))


def next_frontier(level: DataFrame, rows: int, edges: DataFrame, crawls: DataFrame) -> DataFrame:
    """What the urls of ``level`` discover: crawl_id, url, parent_rank, pos of each url that passes its crawl's filters."""
    cand = (_with_rank(level, rows).select("crawl_id", F.col("url").alias("request_url"), "rank").join(edges, "request_url")
            .select("crawl_id", F.col("dst_queue").alias("url"), F.col("rank").alias("parent_rank"), "pos"))
    # the filters are those of the row's crawl; the hosts of a level are few rows against its links
    rules = crawls.select("crawl_id", "target_host", "mimes", "include", "exclude")
    cand = cand.join(rules, "crawl_id")
    reason = skip_reason_by(F.col("url"), F.col("target_host"), F.col("mimes"), F.col("include"), F.col("exclude"))
    return _first_discovery(cand.where(reason.isNull()))


def run_levels(spark: SparkSession, edges: DataFrame, state: str, start_level: int, max_levels: int | None = None) -> bool:
    """Advance the crawls stored under ``state`` from ``start_level``; True when finished.

    A level is one job: its result is written bucketed, counted on the way, and is at once the log, the next frontier
    and a part of the seen-set. The seen-set is only read; the work per level is proportional to the new frontier.
    """
    n = _buckets(spark, state)
    with shuffle_partitions(spark, n):      # exchanges then meet the buckets, and a small level starts no more tasks than a table has
        return _advance(spark, edges, state, start_level, max_levels, n)


def _advance(spark: SparkSession, edges: DataFrame, state: str, start_level: int, max_levels: int | None, n: int) -> bool:
    crawls = crawls_of(spark, state)
    seen = SeenSet(spark, f"{state}/seen", KEYS, n)
    level = start_level
    cur = open_bucketed(spark, f"{state}/levels/level={level}", LEVEL, KEYS, n)
    if len(_committed(spark, state)) > 1:
        seen.load(_levels(spark, state).where(F.col("level") <= level))
    else:
        seen.add(cur, cur.count())
    count = sum(r.rows for r in seen.runs)      # at least the rows of this level
    while max_levels is None or level - start_level < max_levels:
        found = seen.without(next_frontier(cur, count, edges, crawls))
        cur, count = _write_level(found, state, level + 1, n)
        level += 1
        if count == 0:
            return True
        seen.add(cur, count)
    return False


def _buckets(spark: SparkSession, state: str) -> int:
    return int(spark.read.parquet(f"{state}/layout").first()["buckets"])


def _start(spark: SparkSession, state: str, n: int, crawls: DataFrame, level0: DataFrame, blocked: DataFrame | None = None) -> None:
    """Write a state folder: the layout (``n`` buckets), the crawls, level 0 and what is blocked."""
    spark.createDataFrame([(n,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{state}/layout")
    crawls.write.mode("overwrite").parquet(f"{state}/crawls")
    with shuffle_partitions(spark, n):
        if blocked is not None:
            _write_level(blocked.withColumns({"parent_rank": F.lit(0), "pos": F.lit(0)}), state, BLOCKED, n)
        _write_level(level0, state, 0, n)


def crawl_closure(fetched: DataFrame, seeds: DataFrame, mimes: Sequence[str] = (),
                  include: str | None = None, exclude: str | None = None,
                  robots: DataFrame | None = None, max_levels: int | None = None,
                  state: str | None = None) -> tuple[DataFrame, str, bool]:
    """BFS closure per crawl. Returns (frontier_log, state folder, finished).

    ``seeds``: crawl_id, seed, and optionally ``settings`` (a map: mimeFilter, includeUrls and excludeUrls hold for that crawl
    alone) and ``started``. ``mimes``, ``include`` and ``exclude`` hold for crawls whose settings say nothing. ``robots``
    (optional): crawl_id, content; its sitemaps join level 0 without filters (B5). ``frontier_log`` has crawl_id, url
    (queue key), depth, parent_rank, pos (FIFO order within the depth).
    """
    spark = fetched.sparkSession
    state = state or scratch_dir(spark, "crawl")
    crawls = _crawls(seeds, mimes, include, exclude).checkpoint(eager=True)
    n = _buckets_of(fetched)
    _start(spark, state, n, crawls, _first_discovery(_entry_points(crawls, robots)))
    finished = run_levels(spark, fetched_edges(fetched, buckets=n), state, 0, max_levels)
    return frontier_log(spark, state), state, finished


def _entry_points(crawls: DataFrame, robots: DataFrame | None) -> DataFrame:
    """Seeds, and the sitemaps that robots files name, in their order."""
    out = crawls.select("crawl_id", F.col("target_url").alias("url"), F.lit(0).cast("long").alias("parent_rank"), F.lit(0).alias("pos"))
    if robots is None:
        return out
    from sitelens.operators.robots import robots_sitemaps
    sm = robots.select("crawl_id", F.posexplode(robots_sitemaps(F.col("content"))).alias("p", "url"))
    sm = sm.join(crawls.select("crawl_id"), "crawl_id")
    return out.unionByName(sm.select("crawl_id", "url", F.lit(0).cast("long").alias("parent_rank"), (F.col("p") + 1).cast("int").alias("pos")))


def continue_crawl(spark: SparkSession, state: str, fetched: DataFrame, max_levels: int | None = None) -> tuple[DataFrame, bool]:
    """Go on from a state folder (of a run that was stopped, or whose driver died) at its last committed level, under the
    settings stored there."""
    finished = run_levels(spark, fetched_edges(fetched, buckets=_buckets(spark, state)), state, last_level(spark, state), max_levels)
    return frontier_log(spark, state), finished


def frontier_log(spark: SparkSession, state: str) -> DataFrame:
    """All urls queued so far, in committed levels: crawl_id, url, depth, parent_rank, pos."""
    return _levels(spark, state).where(F.col("level") > BLOCKED).select(*KEYS, F.col("level").alias("depth"), "parent_rank", "pos")


def ranked_log(log: DataFrame) -> DataFrame:
    """F8 over a whole crawl log: dense 1-based ``rank`` per (crawl, depth) in FIFO order."""
    return ordinal_within(log, ["crawl_id", "depth"], ["parent_rank", "pos", "url"], out="rank")


def crawl_assets(frontier: DataFrame, fetched: DataFrame, report_mimes: Sequence[str] = (),
                 through_depth: int | None = None, snapshot_id: int | None = None, crawls: DataFrame | None = None) -> DataFrame:
    """Report rows of processed urls (ok fetches passing F10), ordered by (depth, parent_rank, pos).

    F10 takes ``report_mimes``, or with ``crawls`` each crawl's own list; a crawl whose settings say ``reportOnly`` stores no
    bodies, so urls that ran into the redirect limit are reported too, without hash. With ``snapshot_id`` or ``crawls`` the rows also get
    ``ord``, their 0-based place in that order within the crawl: what ``write_report``, the diff and the archive lookup take.
    """
    f = frontier if through_depth is None else frontier.where(F.col("depth") <= through_depth)
    a = f.join(fetched.where(F.col("outcome") == "ok"), f.url == fetched.request_url).drop("request_url")
    a = a.select("crawl_id", "depth", "parent_rank", "pos", fetched.url.alias("url"), "last_modified", "data_mime",
                 "charset", "hash", "references")
    if crawls is not None:
        only = crawls.where(setting(F.col("settings"), "reportOnly") == "true").select("crawl_id")
        limited = f.join(only, "crawl_id", "left_semi").join(fetched.where(F.col("outcome") == "redirect_limit"), f.url == fetched.request_url)
        limited = U.with_report_key(limited.select("crawl_id", "depth", "parent_rank", "pos", "final_url"), "final_url", "url")
        none = {c: F.lit(None).cast("string") for c in ("last_modified", "data_mime", "charset", "hash")}
        a = a.unionByName(limited.withColumns({**none, "references": F.array().cast("array<string>")}).select(*a.columns))
    a = filter_asset_mime(a, report_mimes)
    if crawls is not None:
        a = filter_asset_mime_by(a.join(crawls.select("crawl_id", "mimes"), "crawl_id"), F.col("mimes")).drop("mimes")
    if snapshot_id is None and crawls is None:
        return a
    ranked = ordinal_within(a, ["crawl_id"], ["depth", "parent_rank", "pos", "url"], out="_rank")
    ranked = ranked.withColumn("ord", F.col("_rank").cast("long") - 1).drop("_rank")
    return ranked if snapshot_id is None else ranked.withColumn("snapshot_id", F.lit(snapshot_id))


def crawl_state(spark: SparkSession, state: str) -> DataFrame:
    """Per crawl: finished flag, queued urls (pending level) and seen urls.

    Levels up to the last one are processed; the last written level is the
    queue (empty when the crawl finished).
    """
    last = last_level(spark, state)
    lv = _levels(spark, state).where(F.col("level") > BLOCKED)
    return (lv.groupBy("crawl_id").agg(
        F.sum(F.when(F.col("level") == F.lit(last), 1).otherwise(0)).cast("long").alias("n_queue"),
        F.count(F.lit(1)).cast("long").alias("n_seen"))
        .withColumn("finished", F.col("n_queue") == 0))


# --- reports -----------------------------------------------------------------------------------------------------------

@dataclass
class Report:
    """A report as tables (``sources.report.write_report`` stores them): meta, assets (with ``ord``), queue (``rank``), processed
    (``rank``). ``refused`` (crawl_id, reason) are crawls that were not resumed."""
    meta: DataFrame
    assets: DataFrame
    queue: DataFrame
    processed: DataFrame
    refused: DataFrame | None = None


def crawl_report(spark: SparkSession, state: str, fetched: DataFrame) -> Report:
    """The report of every crawl in a state folder: each under its own settings, with the time it was started at and, if it
    is through, the time when its last level was. An unfinished one has a queue and all urls seen, in order."""
    last = last_level(spark, state)
    crawls, log = crawls_of(spark, state), frontier_log(spark, state)
    assets = crawl_assets(log, fetched, through_depth=last - 1, crawls=crawls)
    depths = log.groupBy("crawl_id").agg(F.max("depth").alias("deepest"))
    done_at = [modified_at(spark, f"{state}/levels/level={n}/_SUCCESS") for n in range(last + 1)]
    times = F.array(*[F.lit(_dt.datetime.fromtimestamp(t / 1000, _dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z") for t in done_at])
    meta = crawls.join(depths, "crawl_id", "left").select(
        "crawl_id", "url", "started", F.when(F.col("deepest") < last, F.get(times, F.col("deepest") + 1)).alias("finished"),
        F.lit(None).cast("array<string>").alias("queue"), F.lit(None).cast("array<string>").alias("processed"), F.lit(VERSION).alias("version"),
        "settings")
    open_ = meta.where("finished is null").select("crawl_id")
    waiting = log.where(F.col("depth") == last)
    queue = ordinal_within(waiting, ["crawl_id"], ["parent_rank", "pos", "url"], out="rank").select(*KEYS, "rank")
    seen = ordinal_within(log.join(open_, "crawl_id", "left_semi"), ["crawl_id"], ["depth", "parent_rank", "pos", "url"], out="rank")
    blocked = _levels(spark, state).where(F.col("level") == BLOCKED).join(open_, "crawl_id", "left_semi")
    processed = seen.select(*KEYS, "rank").unionByName(blocked.select(*KEYS, F.lit(0).cast("long").alias("rank")))
    return Report(meta, assets, queue, processed)


def resume_reports(report: Report, fetched: DataFrame, settings: DataFrame | None = None, robots: DataFrame | None = None,
                   max_levels: int | None = None, state: str | None = None) -> tuple[Report, str]:
    """Go on with every unfinished report and return the merged ones (and the state folder).

    A crawl is refused, alone, if its report has no target url, is finished or has no queue. ``settings`` (crawl_id, current map,
    override boolean; optional) is merged with the stored settings (P4); the filters that result hold for that crawl. The queue
    becomes level 0 in its order, ``processed`` only blocks urls (F7). Stored assets keep their ordinals; new ones follow
    them, in the order in which an uninterrupted crawl would have added them: the queue's order is that crawl's, and a FIFO
    queue processes it before anything it discovers. Target url and start time are the stored ones. ``robots`` as in
    ``crawl_closure``: sitemaps that were seen are not queued again.
    """
    spark = fetched.sparkSession
    state = state or scratch_dir(spark, "resume")
    queued = report.queue.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("n"))
    why = (F.when(F.coalesce(F.col("url") == "", F.lit(True)), "no target url").when(F.col("finished").isNotNull(), "finished")
           .when(F.col("n").isNull(), "empty queue"))
    meta = report.meta.join(queued, "crawl_id", "left").withColumn("reason", why).drop("n").checkpoint(eager=True)
    refused = meta.where("reason is not null").select("crawl_id", "reason")
    go = meta.where("reason is null").drop("reason")
    stored = F.coalesce(F.col("settings"), F.create_map().cast("map<string,string>"))
    if settings is not None:
        empty = F.create_map().cast("map<string,string>")
        go = go.join(settings.select("crawl_id", "current", "override"), "crawl_id", "left").withColumn(
            "settings", merge_settings(stored, F.coalesce("current", empty), F.coalesce("override", F.lit(False)))).drop("current", "override")
    else:
        go = go.withColumn("settings", stored)
    seeds = go.select("crawl_id", F.col("url").alias("seed"), "started", "settings")
    crawls = _crawls(seeds, (), None, None).checkpoint(eager=True)
    ids = crawls.select("crawl_id")
    level0 = report.queue.join(ids, "crawl_id", "left_semi").select(*KEYS, F.col("rank").cast("long").alias("parent_rank"), F.lit(0).alias("pos"))
    if robots is not None:
        after = F.lit(1 << 62)       # robots are read after the queue was filled
        named = _entry_points(crawls, robots).where("pos > 0").withColumn("parent_rank", after)
        named = named.join(report.processed.select(*KEYS), KEYS, "left_anti")
        level0 = level0.unionByName(named)
    blocked = report.processed.select(*KEYS).join(ids, "crawl_id", "left_semi").distinct().join(
        report.queue.select(*KEYS), KEYS, "left_anti")
    buckets = _buckets_of(fetched)
    _start(spark, state, buckets, crawls, _first_discovery(level0), blocked)
    run_levels(spark, fetched_edges(fetched, buckets=buckets), state, 0, max_levels)
    new = crawl_report(spark, state, fetched)
    n = report.assets.groupBy("crawl_id").agg((F.max("ord") + 1).alias("n"))
    columns = ["crawl_id", "ord", "url", "last_modified", "data_mime", "charset", "hash", "references"]
    added = new.assets.join(n, "crawl_id", "left").withColumn("ord", F.col("ord") + F.coalesce("n", F.lit(0))).select(*columns)
    kept = report.assets.join(ids, "crawl_id", "left_semi").select(*columns)
    return Report(new.meta, kept.unionByName(added), new.queue, new.processed, refused), state


def save_crawl_content(responses: DataFrame, assets: DataFrame, store: str) -> DataFrame:
    """S3 for a crawl: store the bodies of reported assets (F10-passing, hashed).

    Assets are slim, so the bodies are taken from the responses by a semi join
    on the hash; assets rejected by the report MIME filter are not stored, and a
    report-only crawl simply does not call this.
    """
    from sitelens.functions.content import content_hash
    from sitelens.sources.store import save_content
    hashes = assets.where(F.col("hash").isNotNull()).select("hash").distinct()
    r = responses.withColumn("hash", content_hash(F.col("body")))
    return save_content(r.join(hashes, "hash", "left_semi"), store)
