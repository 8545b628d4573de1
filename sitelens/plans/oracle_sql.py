"""DuckDB twins of the registered queries (driver correctness gate).

Each statement reads the pre-registered ``pages`` view, derives the same
fixture as ``fixtures.py`` and computes the expected result with plain SQL
(recursive CTEs for the closures). Column names and types match the Spark
side.
"""

from __future__ import annotations

from sitelens.functions.mime import oracle_values_sql
from sitelens.plans.registry import EXCLUDE_RX, INCLUDE_RX, REPORT_MIMES, URL_MIMES

NL = "chr(10)"


def pct(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, ''), "
            f"lambda c: CASE WHEN ord(c) < 128 THEN c ELSE url_encode(c) END), '')")


def origin(u: str) -> str:
    return f"regexp_extract({u}, '^(https?://[^/?#]+)', 1)"


def host(u: str) -> str:
    return f"regexp_extract({u}, '^https?://([^/?#:]+)', 1)"


def path(u: str) -> str:
    return f"coalesce(nullif(regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/')"


def ext_key(p: str) -> str:
    return (f"CASE WHEN strpos(lower(trim({p})), '.') = 0 THEN lower(trim({p})) "
            f"ELSE regexp_extract(lower(trim({p})), '\\.([^.]*)$', 1) END")


def mime_of(p: str) -> str:
    return f"(SELECT mime FROM {oracle_values_sql()} WHERE ext = {ext_key(p)})"


def hrefs(h: str) -> str:
    return f"list_filter(regexp_extract_all({h}, '<a\\s+href=\"([^\"]*)\"', 1), lambda x: x <> '')"


def distinct_ordered(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def resolved(u: str, h: str) -> str:
    """Distinct, ordered references of a page with url ``u`` and html ``h``."""
    return distinct_ordered(f"list_transform({hrefs(h)}, lambda x: {pct(origin(u) + ' || x')})")


def in_list(vals) -> str:
    return ", ".join(f"'{v}'" for v in vals)


MEDIA = "trim(split_part(content_type, ';', 1))"
CHARSET = ("nullif(trim(split_part(list_filter(string_split(content_type, ';')[2:], "
           "lambda p: starts_with(lower(trim(p)), 'charset='))[1], '=', 2)), '')")


def guessed(url: str) -> str:
    return f"coalesce(nullif({MEDIA}, ''), {mime_of(path(url))}, 'application/octet-stream')"


def kind(m: str, url: str) -> str:
    return (f"CASE WHEN starts_with({m}, 'text/html') OR starts_with({m}, 'application/xhtml+xml') THEN 'html' "
            f"WHEN ends_with({m}, 'xml') AND ends_with({url}, 'sitemap.xml') THEN 'sitemap' ELSE 'other' END")


# --- fixtures ------------------------------------------------------------------------

RESP = f"""resp AS (
  SELECT page_id, 1 AS snapshot_id, page_id AS ord, split_part(url, '#', 1) AS request_url, 200 AS status,
    CASE page_id % 5 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'text/html;Charset=ISO-8859-1'
         WHEN 2 THEN 'application/xhtml+xml' WHEN 3 THEN 'image/png' END AS content_type,
    CASE page_id % 3 WHEN 0 THEN strftime(TIMESTAMP '2020-01-01 00:00:00' + to_seconds(page_id * 3607),
                                          '%a, %d %b %Y %H:%M:%S') || ' GMT'
         WHEN 2 THEN 'not a date' END AS last_modified_hdr,
    CASE page_id % 3 WHEN 0 THEN strftime(TIMESTAMP '2020-01-01 00:00:00' + to_seconds(page_id * 3607),
                                          '%Y-%m-%dT%H:%M:%S.000Z') END AS lm_expected,
    html AS body
  FROM pages)"""

ASSETS = RESP + f""",
assets AS (
  SELECT ord, request_url AS url, lm_expected AS last_modified, {guessed('request_url')} AS data_mime,
    {CHARSET} AS charset, sha256(body) AS hash, body, content_type
  FROM resp),
assets2 AS (
  SELECT *, {kind('data_mime', 'url')} AS kind FROM assets),
assets3 AS (
  SELECT *, CASE WHEN kind = 'html' THEN {resolved('url', 'body')} ELSE []::VARCHAR[] END AS refs_l FROM assets2)"""

_LM = ("CASE WHEN page_id % 4 = 0 THEN '2024-05-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') "
       "|| 'T00:00:00.000Z' END")
SNAPS = f"""a0 AS (
  SELECT page_id AS ord, split_part(url, '#', 1) AS url, html AS body, {_LM} AS last_modified
  FROM pages WHERE page_id % 11 <> 4
  UNION ALL
  SELECT page_id + 1000000, split_part(url, '#', 1), html || '<!-- dup -->', NULL FROM pages WHERE page_id % 50 = 0),
b0 AS (
  SELECT page_id AS ord, split_part(url, '#', 1) AS url,
    CASE WHEN page_id % 7 = 0 THEN html || '<!-- v2 -->' ELSE html END AS body, {_LM} AS last_modified
  FROM pages WHERE page_id % 10 <> 3
  UNION ALL
  SELECT page_id + 1000000, split_part(url, '#', 1), html, NULL FROM pages WHERE page_id % 60 = 0),
sa AS (SELECT *, sha256(body) AS hash FROM a0),
sb AS (SELECT *, sha256(body) AS hash FROM b0),
lo AS (SELECT url, max(ord) AS ord, arg_max(hash, ord) AS hash, arg_max(last_modified, ord) AS last_modified
       FROM sa GROUP BY url),
changes AS (
  SELECT CASE WHEN lo.ord IS NULL THEN 'added' ELSE 'modified' END AS change_type, sb.url, 0 AS section,
         sb.ord, CASE WHEN lo.ord IS NOT NULL THEN lo.url END AS old_url, lo.ord AS old_ord,
         lo.hash AS old_hash, lo.last_modified AS old_last_modified,
         sb.url AS new_url, sb.ord AS new_ord, sb.hash AS new_hash, sb.last_modified AS new_last_modified
  FROM sb LEFT JOIN lo ON sb.url IS NOT DISTINCT FROM lo.url
  WHERE lo.ord IS NULL OR sb.hash IS DISTINCT FROM lo.hash
  UNION ALL
  SELECT 'removed', sa.url, 1, sa.ord, sa.url, sa.ord, sa.hash, sa.last_modified,
         NULL, NULL, NULL, NULL
  FROM sa WHERE NOT EXISTS (SELECT 1 FROM sb WHERE sb.url IS NOT DISTINCT FROM sa.url)),
content AS (SELECT DISTINCT hash, body FROM (SELECT hash, body FROM sa UNION ALL SELECT hash, body FROM sb))"""

RANKED = """hosted AS (
  SELECT page_id, split_part(url, '#', 1) AS url, html, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host
  FROM pages),
ranked AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rn FROM hosted)"""

GRAPH = RANKED + """,
graph AS (
  SELECT p.host, p.url AS src, c.url AS dst, 0 AS pos, p.rn AS src_rn FROM ranked p JOIN ranked c
    ON c.host = p.host AND c.rn = 2 * p.rn
  UNION ALL
  SELECT p.host, p.url, c.url, 1, p.rn FROM ranked p JOIN ranked c ON c.host = p.host AND c.rn = 2 * p.rn + 1
  UNION ALL
  SELECT p.host, p.url, c.url, 2, p.rn FROM ranked p JOIN ranked c ON c.host = p.host AND c.rn = p.rn - 1),
offhost AS (
  SELECT h.host, h.url AS src, n.url AS dst, 3 AS pos FROM hosted h JOIN hosted n ON n.page_id = h.page_id + 1
  WHERE n.host <> h.host),
cands AS (SELECT host, src, dst, pos FROM graph UNION ALL SELECT host, src, dst, pos FROM offhost)"""

def _reach(name: str, extra: str = "TRUE") -> str:
    """Urls reached from the seeds with their least depth: a recursion keyed by (crawl, url) that stops when no new key appears."""
    return f"""{name} AS (WITH RECURSIVE r(crawl_id, host, url, depth) USING KEY (crawl_id, url) AS (
    SELECT crawl_id, host, crawl_id, 0 FROM seeds
    UNION
    SELECT r.crawl_id, r.host, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.url
      LEFT JOIN recurring.r AS k ON k.crawl_id = r.crawl_id AND k.url = e.dst
    WHERE {host('e.dst')} = r.host AND k.url IS NULL AND {extra})
  SELECT crawl_id, url, depth FROM r)"""


CLOSURE = GRAPH + f""",
own AS (SELECT url AS src, unnest({resolved('url', 'html')}) AS dst FROM hosted),
edges AS (SELECT src, dst FROM cands UNION ALL SELECT src, dst FROM own),
seeds AS (SELECT url AS crawl_id, host FROM ranked WHERE rn = 1),
{_reach("reach")}"""

def _fifo(name: str, extra: str = "TRUE") -> str:
    """The same closure in the order of a FIFO queue: a level's urls are numbered by (rank of the first discoverer, place of the
    link on its page)."""
    return f"""{name} AS (WITH RECURSIVE r(crawl_id, host, url, depth, rank) USING KEY (crawl_id, url) AS (
    SELECT crawl_id, host, crawl_id, 0, CAST(1 AS BIGINT) FROM seeds
    UNION
    SELECT crawl_id, host, url, depth, row_number() OVER (PARTITION BY crawl_id ORDER BY place) FROM (
      SELECT r.crawl_id, r.host, e.dst AS url, r.depth + 1 AS depth, min(r.rank * 100000000 + e.place) AS place
      FROM r JOIN placed e ON e.src = r.url
        LEFT JOIN recurring.r AS k ON k.crawl_id = r.crawl_id AND k.url = e.dst
      WHERE {host('e.dst')} = r.host AND k.url IS NULL AND {extra} GROUP BY ALL) AS d)
  SELECT crawl_id, url, depth, rank FROM r)"""


# links with their place: those of the page's own html first (of the last response for a url), then the added anchors
PLACED = GRAPH + f""",
lastpage AS (SELECT url, arg_max(html, page_id) AS html FROM hosted GROUP BY url),
owned AS (SELECT url AS src, {resolved('url', 'html')} AS l FROM lastpage),
placed AS (SELECT src, l[i] AS dst, i AS place FROM (SELECT src, l, unnest(generate_series(1, len(l))) AS i FROM owned)
           UNION ALL SELECT src, dst, 1000000 + pos FROM cands),
seeds AS (SELECT url AS crawl_id, host FROM ranked WHERE rn = 1)"""
# filters of a crawl by the length of its host, as the stored reports' settings give them
HOST_RULES = """CASE length(r.host) % 4
  WHEN 0 THEN NOT regexp_matches(e.dst, '[?]') WHEN 1 THEN regexp_matches(e.dst, '/(en|es|de)/')
  WHEN 2 THEN {mime} IS NULL OR {mime} IN ('text/html', 'image/png') ELSE TRUE END"""

ROBOTS = f"""robots AS (
  SELECT page_id, {origin('url')} || '/robots.txt' AS robots_url,
    'User-agent: *' || chr(10) ||
    array_to_string(list_transform({hrefs('html')}, lambda h: 'Allow: ' || h), chr(10)) || chr(10) ||
    CASE page_id % 4
      WHEN 0 THEN 'Crawl-delay: ' || CAST(page_id % 9 + 1 AS VARCHAR) || chr(10) || 'Crawl-delay: 3' || chr(10)
                  || 'Sitemap: ' || {origin('url')} || '/sitemap.xml' || chr(10)
                  || 'Sitemap: ' || {origin('url')} || '/sitemap.xml' || chr(10)
      WHEN 1 THEN 'Crawl-delay: 2.5' || chr(10) || 'Allow:' || chr(10) || 'Sitemap: ' || {origin('url')}
                  || '/sitemap.xml' || chr(10)
      WHEN 2 THEN 'Disallow: /private' || chr(10) || '# Sitemap: ' || {origin('url')} || '/old.xml' || chr(10)
      ELSE '' END AS content
  FROM pages)"""


def _dlist(rx: str) -> str:
    return distinct_ordered(f"regexp_extract_all(content, '{rx}', 1)")


SQL: dict[str, str] = {}

# --- diff -------------------------------------------------------------------------------
SQL["d1_last_by_url"] = f"WITH {SNAPS} SELECT url, ord, hash FROM lo"
SQL["d5_diff_snapshots"] = f"WITH {SNAPS} SELECT change_type, url, section, ord, old_hash, new_hash FROM changes"
for _k, _t in (("d2_added", "added"), ("d3_modified", "modified"), ("d4_removed", "removed")):
    SQL[_k] = f"WITH {SNAPS} SELECT url, ord, old_hash, new_hash FROM changes WHERE change_type = '{_t}'"
SQL["d6_change_listing"] = f"""WITH {SNAPS}
SELECT coalesce(CASE WHEN change_type = 'removed' THEN old_url ELSE new_url END, '') AS url, change_type,
  CASE WHEN change_type = 'removed' THEN '' ELSE coalesce(new_last_modified, '') END AS last_modified,
  section, ord FROM changes"""
SQL["d7_change_summary"] = f"""WITH {SNAPS}, c AS (SELECT change_type, count(*) AS n FROM changes GROUP BY 1)
SELECT t.change_type, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (VALUES ('added'), ('modified'), ('removed')) t(change_type) LEFT JOIN c USING (change_type)"""
SQL["d9_line_changes"] = f"""WITH {SNAPS},
m AS (SELECT url, ord, old_hash, new_hash FROM changes WHERE change_type = 'modified'),
l AS (
  SELECT m.url, m.ord, unnest(string_split(co.body, chr(10))) AS line, 1 AS o, 0 AS n
  FROM m LEFT JOIN content co ON co.hash = m.old_hash
  UNION ALL
  SELECT m.url, m.ord, unnest(string_split(cn.body, chr(10))), 0, 1
  FROM m LEFT JOIN content cn ON cn.hash = m.new_hash)
SELECT url, ord, line, CAST(sum(o) AS BIGINT) AS n_old, CAST(sum(n) AS BIGINT) AS n_new
FROM l GROUP BY url, ord, line HAVING sum(o) <> sum(n)"""

# --- responses ------------------------------------------------------------------------------
SQL["r3_content_type"] = f"WITH {RESP} SELECT page_id, {MEDIA} AS media_type, {CHARSET} AS charset FROM resp"
SQL["r4_guess_mime"] = f"WITH {RESP} SELECT page_id, {guessed('request_url')} AS data_mime FROM resp"
SQL["r5_http_date"] = (f"WITH {RESP} SELECT page_id, last_modified_hdr, strftime(try_strptime(last_modified_hdr, "
                       "'%a, %d %b %Y %H:%M:%S GMT'), '%Y-%m-%dT%H:%M:%S.000Z') AS last_modified FROM resp")
_T = "(TIMESTAMP '2001-01-01 00:00:00' + to_seconds(page_id * 86461 + page_id % 7 * 3600))"
_FORMS = [("%Y-%m-%dT%H:%M", "%Y-%m-%dT%H:%M", 0), ("%a, %-d %b %Y %H:%M:%S EST", "%a, %d %b %Y %H:%M:%S EST", 5), ("%-d %b %Y %I:%M %p", "%d %b %Y %I:%M %p", 0),
          ("%B %Y", "%B %Y", 0), ("%Y-%-m-%-d", "%Y-%m-%d", 0), ("%b %-d, %Y", "%b %d, %Y", 0), ("%Y/%m/%d %H:%M:%S -0700", "%Y/%m/%d %H:%M:%S -0700", 7)]
SQL["r5_date_forms"] = " UNION ALL ".join(
    f"SELECT page_id, {i} AS form, strftime({_T}, '{w}') AS text, strftime(try_strptime(strftime({_T}, '{w}'), '{r}') + to_hours({h}), "
    f"'%Y-%m-%dT%H:%M:%S.000Z') AS last_modified FROM pages" for i, (w, r, h) in enumerate(_FORMS))
SQL["r6_content_hash"] = "SELECT page_id, sha256(html) AS hash FROM pages"
SQL["r7_decode_text"] = "SELECT page_id, html AS text FROM pages"
SQL["r8_asset_kind"] = f"""WITH {RESP},
sm AS (SELECT {origin('url')} || '/' || CAST(page_id AS VARCHAR)
              || CASE WHEN page_id % 6 = 2 THEN '/feed.xml' ELSE '/sitemap.xml' END AS request_url,
              'application/xml' AS content_type FROM pages),
u AS (SELECT request_url, content_type FROM resp UNION ALL SELECT request_url, content_type FROM sm),
g AS (SELECT request_url, {guessed('request_url')} AS m FROM u)
SELECT request_url, {kind('m', 'request_url')} AS kind FROM g"""

REDIR = RANKED + """,
prv AS (SELECT host, rn + 1 AS rn, url AS prev_url FROM ranked),
nxt AS (SELECT host, rn - 1 AS rn, url AS next_url FROM ranked),
j AS (SELECT r.*, prv.prev_url, nxt.next_url FROM ranked r LEFT JOIN prv USING (host, rn) LEFT JOIN nxt USING (host, rn)),
rr AS (
  SELECT url AS request_url,
    CASE WHEN page_id % 17 = 5 THEN 404 WHEN page_id % 19 = 7 THEN 301 WHEN page_id % 23 = 11 THEN 301
         WHEN starts_with(host, 'm.') AND rn = 2 AND next_url IS NOT NULL THEN 301
         WHEN rn % 12 <> 1 AND prev_url IS NOT NULL THEN 301 ELSE 200 END AS status,
    CASE WHEN page_id % 17 = 5 THEN NULL WHEN page_id % 19 = 7 THEN NULL
         WHEN page_id % 23 = 11 THEN '/moved/' || CAST(page_id AS VARCHAR)
         WHEN starts_with(host, 'm.') AND rn = 2 AND next_url IS NOT NULL THEN next_url
         WHEN rn % 12 <> 1 THEN prev_url END AS location
  FROM j)"""

SQL["r2_ok_responses"] = f"WITH {REDIR} SELECT request_url, status FROM rr WHERE status BETWEEN 200 AND 299"
SQL["r1_resolve_redirects"] = f"""WITH {REDIR},
redir AS (SELECT request_url AS cur, location AS nxt FROM rr WHERE status = 301 AND location IS NOT NULL AND location <> ''),
ch AS (
  WITH RECURSIVE c(request_url, cur, hops, flag) AS (
    SELECT request_url, request_url, 0, CAST(NULL AS VARCHAR) FROM rr
    UNION ALL
    SELECT c.request_url, x.nxt, c.hops + 1,
      CASE WHEN NOT regexp_matches(x.nxt, '^[A-Za-z][A-Za-z0-9+.\\-]*:') AND c.hops + 1 < 10 THEN 'bad_location' END
    FROM c JOIN redir x ON x.cur = c.cur WHERE c.hops < 10 AND c.flag IS NULL)
  SELECT * FROM c),
fin AS (SELECT request_url, arg_max(cur, hops) AS cur, max(hops) AS hops, arg_max(flag, hops) AS flag FROM ch GROUP BY 1)
SELECT fin.request_url, fin.cur AS final_url, CAST(fin.hops AS INTEGER) AS hops,
  CASE WHEN fin.hops = 10 THEN 'redirect_limit' WHEN fin.flag IS NOT NULL THEN fin.flag
       WHEN rr.status IS NULL THEN 'missing' WHEN rr.status BETWEEN 200 AND 299 THEN 'ok' ELSE 'status' END AS outcome,
  CASE WHEN fin.hops < 10 AND fin.flag IS NULL THEN rr.status END AS status
FROM fin LEFT JOIN rr ON rr.request_url = fin.cur"""

_ABS = "'^[A-Za-z][A-Za-z0-9+.\\-]*:'"
SQL["r1_redirect_limits"] = f"""WITH {REDIR},
redir AS (SELECT request_url AS cur, location AS nxt FROM rr WHERE status = 301 AND location IS NOT NULL AND location <> ''),
ch AS (
  WITH RECURSIVE c(rel, request_url, cur, hops) AS (
    SELECT rel, request_url, request_url, 0 FROM rr, (VALUES (FALSE), (TRUE)) AS o(rel)
    UNION ALL
    SELECT c.rel, c.request_url,
      CASE WHEN c.rel AND starts_with(x.nxt, '/') THEN regexp_extract(c.cur, '^(https?://[^/?#]+)', 1) || x.nxt ELSE x.nxt END, c.hops + 1
    FROM c JOIN redir x ON x.cur = c.cur WHERE c.hops < 10 AND (c.hops = 0 OR regexp_matches(c.cur, {_ABS})))
  SELECT * FROM c),
fin AS (SELECT rel, request_url, l.most, arg_max(cur, hops) AS cur, max(hops) AS hops
        FROM ch JOIN (SELECT unnest(generate_series(1, 10)) AS most) l ON hops <= l.most GROUP BY ALL)
SELECT fin.request_url, CAST(fin.most AS INTEGER) AS most, fin.rel AS relative, fin.cur AS final_url, CAST(fin.hops AS INTEGER) AS hops,
  CASE WHEN fin.hops = fin.most THEN 'redirect_limit' WHEN fin.hops > 0 AND NOT regexp_matches(fin.cur, {_ABS}) THEN 'bad_location'
       WHEN rr.status IS NULL THEN 'missing' WHEN rr.status BETWEEN 200 AND 299 THEN 'ok' ELSE 'status' END AS outcome,
  CASE WHEN fin.hops < fin.most AND (fin.hops = 0 OR regexp_matches(fin.cur, {_ABS})) THEN rr.status END AS status
FROM fin LEFT JOIN rr ON rr.request_url = fin.cur"""
SQL["s5_read_responses"] = (f"WITH {RESP} SELECT snapshot_id, ord, request_url, status, content_type, "
                            "sha256(body) AS hash FROM resp")

# --- urls -------------------------------------------------------------------------------
URLS = f"""raw AS (
  SELECT url AS u, url AS k FROM pages
  UNION ALL
  SELECT {pct('x')} AS u, x AS k FROM (
    SELECT {origin('url')} || unnest(regexp_extract_all(html, '<a\\s+href="([^"]*)"', 1)) AS x FROM pages))"""
SQL["u1_report_key"] = f"WITH {URLS} SELECT u, k AS report_key FROM raw"
SQL["u2_strip_fragment"] = f"WITH {URLS} SELECT u, split_part(u, '#', 1) AS v FROM raw"
SQL["u3_url_host"] = f"WITH {URLS} SELECT u, lower({host('u')}) AS v FROM raw"
SQL["u4_url_path"] = f"WITH {URLS} SELECT u, {path('u')} AS v FROM raw"
SQL["u5_mime_for_path"] = f"WITH {URLS} SELECT u, {mime_of(path('u'))} AS v FROM raw"

# --- extraction ---------------------------------------------------------------------------
SQL["e1_html_references"] = (f"SELECT page_id, CAST(len({hrefs('html')}) AS INTEGER) AS n_refs, "
                             f"array_to_string({hrefs('html')}, {NL}) AS refs FROM pages")
_E2 = f"SELECT page_id, split_part(url, '#', 1) AS url, {resolved('split_part(url, chr(35), 1)', 'html')} AS r FROM pages"
SQL["e2_resolve_references"] = (f"SELECT page_id, CAST(len(r) AS INTEGER) AS n_refs, array_to_string(r, {NL}) AS refs "
                                f"FROM ({_E2})")
SQL["e3_html_last_modified"] = """SELECT page_id,
  CASE page_id % 5
    WHEN 0 THEN '2023-02-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || 'T10:20:30.000Z'
    WHEN 1 THEN '2023-02-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || 'T10:20:30.000Z'
    WHEN 2 THEN '2023-03-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00.000Z'
  END AS last_modified
FROM pages"""
SQL["e4_sitemap_references"] = f"""WITH s AS (
  SELECT page_id, {origin('url')} || '/' || CAST(page_id AS VARCHAR)
           || CASE WHEN page_id % 6 = 2 THEN '/feed.xml' ELSE '/sitemap.xml' END AS request_url,
    CASE WHEN page_id % 6 = 4 THEN []::VARCHAR[] ELSE {resolved('url', 'html')} END AS r
  FROM pages)
SELECT request_url, CAST(len(r) AS INTEGER) AS n_refs, array_to_string(r, {NL}) AS refs FROM s"""
# FX7: the page's own anchors after a block of hostile markup and ordinary link forms; expected values are built from the
# page's url by string functions, independently of the tokenizer and resolver
_DIR = "regexp_replace(regexp_extract(split_part(url, '#', 1), '^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', '')"
_WILD = f"""w AS (SELECT page_id, split_part(url, '#', 1) AS url, {origin('url')} AS o, split_part(url, ':', 1) AS sc,
    CASE WHEN {_DIR} = '' THEN '/' ELSE {_DIR} END AS dir, CAST(page_id AS VARCHAR) AS p, {hrefs('html')} AS h FROM pages),
wraw AS (SELECT *, list_concat(['/s' || p || '.js', '/i' || p || '.png', '/t' || p, '../up' || p || '?a=1&section=2&copy=3&region=4',
    '//cdn.example.org/x/../' || p, 'mailto:u' || p || '@example.com', 'tel:+1555' || p, 'javascript:void(0)', '/q?x=1&amp;y=' || p,
    './d/./e' || p || '#f', '?n=' || p], h) AS raw FROM w),
wres AS (SELECT *, list_concat([o || '/s' || p || '.js', o || '/i' || p || '.png', o || '/t' || p,
    o || CASE WHEN dir = '/' THEN '/' ELSE regexp_replace(dir, '[^/]+/$', '') END || 'up' || p || '?a=1&section=2&copy=3&region=4',
    sc || '://cdn.example.org/' || p, 'mailto:u' || p || '@example.com', 'tel:+1555' || p, 'javascript:void(0)',
    o || '/q?x=1&y=' || p, o || dir || 'd/e' || p || '#f', split_part(split_part(url, '?', 1), '#', 1)
      || CASE WHEN regexp_matches(url, '^https?://[^/?#]*/') THEN '' ELSE '/' END || '?n=' || p],
    list_transform(h, lambda x: {pct("o || x")})) AS res FROM wraw)"""
SQL["e1_html_references_wild"] = (f"WITH {_WILD} SELECT page_id, CAST(len(raw) AS INTEGER) AS n_refs, "
                                  f"array_to_string(raw, {NL}) AS refs FROM wraw")
SQL["e2_resolve_references_wild"] = (f"WITH {_WILD} SELECT page_id, CAST(len({distinct_ordered('res')}) AS INTEGER) AS n_refs, "
                                     f"array_to_string({distinct_ordered('res')}, {NL}) AS refs FROM wres")
SQL["p1_build_assets_wild"] = (f"WITH {_WILD} SELECT page_id, url, 'text/html' AS data_mime, "
                               f"CAST(len({distinct_ordered('res')}) AS INTEGER) AS n_refs, "
                               f"array_to_string({distinct_ordered('res')}, {NL}) AS refs FROM wres")
SQL["e4_sitemap_prologues"] = f"""WITH s AS (
  SELECT page_id, {origin('url')} || '/' || CAST(page_id AS VARCHAR) || '/sitemap.xml' AS request_url, {resolved('url', 'html')} AS r
  FROM pages)
SELECT request_url, CAST(len(r) AS INTEGER) AS n_refs, array_to_string(r, {NL}) AS refs FROM s"""
# dst_key is the decoded form: origin || raw href, recovered from the raw list at the same position
SQL["e5_link_edges"] = f"""WITH e AS (
  SELECT page_id, split_part(url, '#', 1) AS url,
    list_transform({hrefs('html')}, lambda x: {origin('url')} || x) AS raw_abs FROM pages),
d AS (SELECT page_id, url, {distinct_ordered(f"list_transform(raw_abs, lambda x: {pct('x')})")} AS r,
             {distinct_ordered('raw_abs')} AS k FROM e),
x AS (SELECT page_id, url, r, k, generate_subscripts(r, 1) AS i FROM d)
SELECT page_id, url AS src, CAST(i - 1 AS INTEGER) AS pos, r[i] AS dst, k[i] AS dst_key FROM x"""

SQL["p1_build_assets"] = f"""WITH {ASSETS}
SELECT ord, url, last_modified, data_mime, charset, hash, CAST(len(refs_l) AS INTEGER) AS n_refs,
  array_to_string(refs_l, {NL}) AS refs, kind FROM assets3"""

# --- frontier ----------------------------------------------------------------------------------
SQL["f1_filter_url_mime"] = (f"WITH {GRAPH} SELECT src, dst FROM cands WHERE {mime_of(path('dst'))} IS NULL "
                             f"OR {mime_of(path('dst'))} IN ({in_list(URL_MIMES)})")
SQL["f2_filter_same_host"] = f"WITH {GRAPH} SELECT src, dst FROM cands WHERE lower({host('dst')}) = host"
SQL["f3_filter_include"] = f"WITH {GRAPH} SELECT src, dst FROM cands WHERE regexp_matches(dst, '{INCLUDE_RX}')"
SQL["f4_filter_exclude"] = f"WITH {GRAPH} SELECT src, dst FROM cands WHERE NOT regexp_matches(dst, '{EXCLUDE_RX}')"
SQL["f5_enqueue_decisions"] = f"""WITH {GRAPH},
d AS (SELECT src, dst,
  CASE WHEN {mime_of(path('dst'))} IS NOT NULL AND {mime_of(path('dst'))} NOT IN ('application/pdf') THEN 'mime'
       WHEN lower({host('dst')}) <> host THEN 'host'
       WHEN NOT regexp_matches(dst, '{INCLUDE_RX}') THEN 'include'
       WHEN regexp_matches(dst, '{EXCLUDE_RX}') THEN 'exclude' END AS skip_reason FROM cands)
SELECT src, dst, skip_reason IS NULL AS keep, skip_reason FROM d"""
_FRONT = GRAPH + """,
lc AS (SELECT host AS crawl_id, dst AS url, CAST(src_rn AS BIGINT) AS parent_rank, pos FROM graph),
seen AS (SELECT host AS crawl_id, url FROM ranked QUALIFY rn * 2 <= count(*) OVER (PARTITION BY host)),
firsts AS (SELECT crawl_id, url, parent_rank, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY crawl_id, url ORDER BY parent_rank, pos) AS k FROM lc) WHERE k = 1),
nf AS (SELECT * FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.crawl_id = f.crawl_id AND s.url = f.url))"""
SQL["f6_new_frontier"] = f"WITH {_FRONT} SELECT crawl_id, url, parent_rank, CAST(pos AS INTEGER) AS pos FROM nf"
SQL["f7_block_urls"] = (f"WITH {_FRONT} SELECT DISTINCT crawl_id, url FROM "
                        "(SELECT crawl_id, url FROM seen UNION ALL SELECT host, dst FROM graph)")
SQL["f8_fifo_rank"] = (f"WITH {_FRONT} SELECT crawl_id, url, CAST(row_number() OVER (PARTITION BY crawl_id "
                       "ORDER BY parent_rank, pos, url) AS BIGINT) AS rank FROM nf")
SQL["f9_crawl_closure"] = f"WITH {CLOSURE} SELECT crawl_id, url, CAST(depth AS INTEGER) AS depth FROM reach"
SQL["f10_filter_asset_mime"] = (f"WITH {ASSETS} SELECT ord, url, data_mime FROM assets WHERE data_mime IS NULL "
                                f"OR data_mime IN ({in_list(REPORT_MIMES)})")
SQL["f11_crawl_progress"] = f"""WITH {CLOSURE},
per AS (SELECT crawl_id, depth, count(*) AS processed FROM reach GROUP BY 1, 2)
SELECT crawl_id, CAST(depth AS INTEGER) AS depth, CAST(processed AS BIGINT) AS processed,
  CAST(sum(processed) OVER (PARTITION BY crawl_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
       AS BIGINT) AS total
FROM per"""

# --- robots ---------------------------------------------------------------------------------------
SQL["b1_robots_url"] = f"SELECT page_id, {origin('url')} || '/robots.txt' AS robots_url FROM pages"
SQL["b2_robots_allowed"] = (f"WITH {ROBOTS} SELECT page_id, array_to_string({_dlist('Allow:\\s*(\\S+)')}, {NL}) "
                            "AS allowed FROM robots")
SQL["b3_robots_min_delay"] = (f"WITH {ROBOTS} SELECT page_id, list_min(list_transform(regexp_extract_all(content, "
                              "'Crawl-delay:\\s*(\\d+)', 1), lambda x: CAST(x AS BIGINT))) AS min_crawl_delay "
                              "FROM robots")
SQL["b4_robots_sitemaps"] = (f"WITH {ROBOTS} SELECT page_id, array_to_string({_dlist('Sitemap:\\s*(\\S+)')}, {NL}) "
                             "AS sitemaps FROM robots")
SQL["b5_seed_frontier"] = f"""WITH {RANKED}, {ROBOTS},
items AS (SELECT r.url AS crawl_id,
  {distinct_ordered("list_concat([r.url], regexp_extract_all(b.content, 'Sitemap:\\s*(\\S+)', 1))")} AS l
  FROM ranked r JOIN robots b ON b.page_id = r.page_id WHERE r.rn = 1),
x AS (SELECT crawl_id, l, generate_subscripts(l, 1) AS i FROM items)
SELECT crawl_id, l[i] AS url, CAST(i AS BIGINT) AS rank FROM x"""

# --- state, resume, settings, stream, report, store, lookup ---------------------------------------
SQL["p2_crawl_state"] = f"""WITH {CLOSURE},
s AS (SELECT crawl_id, CAST(sum(CASE WHEN depth = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_queue,
             CAST(count(*) AS BIGINT) AS n_seen FROM reach WHERE depth <= 2 GROUP BY 1)
SELECT crawl_id, n_queue = 0 AS finished, n_queue, n_seen FROM s"""
SQL["f8_log_rank"] = f"""WITH {PLACED}, {_fifo("fifo")}
SELECT crawl_id, url, CAST(depth AS INTEGER) AS depth, rank FROM fifo"""
_STORED = "'2024-01-01T00:00:00.000Z'"
SQL["p3_resume_crawl"] = f"""WITH {PLACED}, {_fifo("fifo")},
f AS (SELECT crawl_id, url, depth, row_number() OVER (PARTITION BY crawl_id ORDER BY depth, rank) - 1 AS ord FROM fifo
      WHERE url IN (SELECT url FROM hosted)),
deep AS (SELECT crawl_id, max(depth) AS deepest FROM fifo GROUP BY 1)
SELECT f.crawl_id, CAST(f.ord AS BIGINT) AS ord, f.url, {_STORED} AS started, f.crawl_id AS target, 'delay=500' AS settings
FROM f JOIN deep USING (crawl_id) WHERE deepest >= 2"""
_P4_SETTINGS = """CASE length(host) % 4 WHEN 0 THEN 'excludeUrls=[?]' WHEN 1 THEN 'includeUrls=/(en|es|de)/'
  WHEN 2 THEN 'mimeFilter=text/html, image/png' ELSE '' END"""
SQL["p4_merge_settings"] = f"""WITH {RANKED}, s AS (SELECT url AS crawl_id, host FROM ranked WHERE rn = 1)
SELECT crawl_id, CASE WHEN ascii(right(host, 1)) % 5 = 0 THEN 'autosave=60' || chr(10) || 'delay=750' || chr(10) || 'mimeFilter='
  ELSE 'autosave=60' || chr(10) || 'delay=' || CAST(length(host) * 100 AS VARCHAR)
    || CASE length(host) % 4 WHEN 0 THEN chr(10) || 'excludeUrls=[?]' WHEN 1 THEN chr(10) || 'includeUrls=/(en|es|de)/' ELSE '' END
    || chr(10) || 'mimeFilter=' || CASE length(host) % 4 WHEN 2 THEN 'text/html, image/png' ELSE '' END END AS settings
FROM s"""
_RULES = HOST_RULES.replace("{mime}", mime_of(path("e.dst")))
SQL["p4_settings_closure"] = f"""WITH {PLACED}, {_fifo("fifo", f"(ascii(right(r.host, 1)) % 5 = 0 OR ({_RULES}))")}
SELECT crawl_id, url, CAST(depth AS INTEGER) AS depth, rank FROM fifo"""
SQL["t1_stream_crawl"] = f"""WITH {PLACED}, {_fifo("fifo")}
SELECT crawl_id, 'seen' AS part, url FROM fifo
UNION ALL SELECT crawl_id, CASE WHEN url IN (SELECT url FROM hosted) THEN 'asset' ELSE 'frontier' END, url FROM fifo"""
SQL["s1_damaged_reports"] = f"""WITH {RANKED}, h AS (SELECT host, count(*) AS n FROM ranked GROUP BY host)
SELECT CASE length(host) % 3 WHEN 1 THEN 'not a JSON document' WHEN 2 THEN 'no assets' ELSE 'sound' END AS state,
  CAST(count(*) AS BIGINT) AS n_documents, CAST(sum(CASE WHEN length(host) % 3 = 0 THEN n ELSE 0 END) AS BIGINT) AS n_assets
FROM h GROUP BY 1"""
SQL["s2_write_report"] = f"""WITH {PLACED}, {_fifo("fifo")},
deep AS (SELECT crawl_id, max(depth) AS deepest FROM fifo GROUP BY 1),
a AS (SELECT crawl_id, url, row_number() OVER (PARTITION BY crawl_id ORDER BY depth, rank) - 1 AS place FROM fifo
      WHERE depth < 2 AND url IN (SELECT url FROM hosted)),
p AS (SELECT crawl_id, url FROM fifo JOIN deep USING (crawl_id) WHERE depth <= 2 AND deepest >= 2)
SELECT crawl_id, 'asset' AS part, CAST(place AS BIGINT) AS place, url FROM a
UNION ALL SELECT crawl_id, 'queue', rank, url FROM fifo WHERE depth = 2
UNION ALL SELECT crawl_id, 'processed', 0, url FROM p
UNION ALL SELECT crawl_id, CASE WHEN deepest >= 2 THEN 'open' ELSE 'finished' END, 0, crawl_id FROM deep"""
SQL["t1_stream_assets"] = (f"WITH {ASSETS} SELECT ord, url, data_mime, charset, hash, "
                           "CAST(len(refs_l) AS INTEGER) AS n_refs FROM assets3")
SQL["s1_read_report"] = (f"WITH {ASSETS} SELECT ord, url, last_modified, data_mime, charset, hash, "
                         "CAST(len(refs_l) AS INTEGER) AS n_refs FROM assets3")
SQL["s2_read_documents"] = f"""WITH {RANKED}
SELECT 'https://' || host AS crawl_id, CAST(rn - 1 AS BIGINT) AS ord, url,
  CASE WHEN rn % 3 <> 0 THEN sha256(html) END AS hash,
  CASE WHEN length(host) % 2 = 0 AND rn <= 2 THEN CAST(rn AS BIGINT) END AS queue_rank
FROM ranked"""
SQL["c1_crawl_report_diff"] = f"""WITH {CLOSURE},
{_reach("reach2", f"NOT regexp_matches(e.dst, '{EXCLUDE_RX}')")},
page AS (SELECT url, max(page_id) AS page_id FROM hosted GROUP BY url),
a AS (SELECT r.crawl_id, r.url, p.page_id FROM reach r JOIN page p ON p.url = r.url),
b AS (SELECT r.crawl_id, r.url, p.page_id FROM reach2 r JOIN page p ON p.url = r.url)
SELECT crawl_id, 'modified' AS change_type, url FROM b WHERE page_id % 7 = 0
UNION ALL SELECT crawl_id, 'removed', url FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.crawl_id = a.crawl_id AND b.url = a.url)"""
SQL["s3_save_content"] = f"""WITH {SNAPS}
SELECT DISTINCT hash, CAST(strlen(body) AS BIGINT) AS n_bytes FROM sb WHERE hash NOT IN (SELECT hash FROM sa)"""
SQL["s4_load_content"] = f"""WITH {SNAPS}, ha AS (SELECT DISTINCT hash, body FROM sa)
SELECT sb.url, sb.hash, ha.hash IS NOT NULL AS found, CAST(strlen(ha.body) AS BIGINT) AS n_bytes
FROM sb LEFT JOIN ha ON ha.hash = sb.hash"""


def enc_path(p: str) -> str:
    out = pct(p)
    for ch, esc in ((" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("`", "%60"), ("{", "%7B"),
                    ("}", "%7D")):
        out = f"replace({out}, '{ch}', '{esc}')"
    return out


_IDX = f"""{ASSETS},
idx AS (SELECT {enc_path(path('url'))} AS path, arg_max(hash, ord) AS hash, arg_max(data_mime, ord) AS data_mime
        FROM assets GROUP BY 1)"""
SQL["v1_path_index"] = f"WITH {_IDX} SELECT path, hash, data_mime FROM idx"
SQL["v2_resolve_requests"] = f"""WITH {_IDX}, {SNAPS},
req AS (SELECT DISTINCT path FROM (
  SELECT {path("split_part(url, '#', 1)")} AS path FROM pages
  UNION ALL SELECT unnest(regexp_extract_all(html, '<a\\s+href="([^"]*)"', 1)) FROM pages)),
st AS (SELECT DISTINCT hash FROM sa),
j AS (SELECT req.path, idx.hash, idx.data_mime, st.hash IS NOT NULL AS stored
      FROM req LEFT JOIN idx ON idx.path = {enc_path('req.path')} LEFT JOIN st ON st.hash = idx.hash),
k AS (SELECT *, CASE WHEN hash IS NULL OR hash = '' THEN 404 WHEN NOT stored THEN 500 ELSE 200 END AS status FROM j)
SELECT path, status, CASE WHEN status = 200 THEN coalesce(nullif(data_mime, ''), 'application/octet-stream') END
  AS content_type, CASE WHEN status <> 404 THEN hash END AS hash FROM k"""
