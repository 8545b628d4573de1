"""DuckDB twins of the registered queries, where SQL can express them over whole tables."""

from __future__ import annotations



def _conversation_repair() -> str:
    """Damage by CRC-32 (computed bit by bit), then a dynamic programme over the rows: a state is (cost with leading zeros and audit,
    repaired text), so the least one is the cheapest with the ASCII-least audit."""
    none = "{'k': '900000000000', 't': ''}"

    def step(state: str, cost: str, letter: str, line: str | None = None) -> str:
        text = f"{state}.t" if line is None else f"{state}.t || CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END || {line}"
        return (f"{{'k': lpad(CAST(CAST(left({state}.k, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({state}.k, 13) || '{letter}', "
                f"'t': {text}}}")

    def least(*states: str) -> str:
        return f"list_min([{', '.join(states)}])"

    def inserts(p: str) -> str:
        """Select list of states w0..w3 after any inserts."""
        two = least(f"{p}2", *[step(f"{p}{q}", "5", "I", "'user:'") for q in (0, 1, 3)])
        return f"{p}0 AS w0, {p}1 AS w1, {two} AS w2, {least(f'{p}3', step(two, '5', 'I', chr(39) + 'assistant:' + chr(39)))} AS w3"
    keep = lambda state, initial: f"CASE WHEN d.ini = '{initial}' AND d.fault < 2 THEN {step(state, '5 * d.fault', 'K', 'd.line')} ELSE {none} END"    # noqa: E731
    role = lambda state, to: f"CASE WHEN d.fault < 2 THEN {step(state, '1 + 5 * d.fault', 'R', f'{chr(39)}{to}:{chr(39)} || d.text')} ELSE {none} END"   # noqa: E731
    drop = lambda state: step(state, "2", "D")     # noqa: E731
    after = [drop("w0"), least(drop("w1"), keep("w0", "s")),
             least(drop("w2"), *[keep(f"w{q}", "u") for q in (0, 1, 3)], *[role(f"w{q}", "user") for q in (0, 1, 3)]),
             least(drop("w3"), keep("w2", "a"), role("w2", "assistant"))]
    return rf"""
        WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
                 lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
             v AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                          coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
             k AS (SELECT v.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(key) + 1),
                        lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
                   FROM v, crc),
             d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, copy,
                          CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
                   FROM k, (VALUES (0), (1)) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
             e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                          row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
                          regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS body FROM d),
             f AS (SELECT conv_id, i, turn, text, role || ':' || text AS line, left(role, 1) AS ini, lag(left(role, 1)) OVER w || left(role, 1) AS pair,
                          CASE WHEN body = '' THEN 2 WHEN again > 1 THEN 3 WHEN body NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault
                   FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
             n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                          count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
                          count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
             r(conv_id, i, s0, s1, s2, s3) AS (
               SELECT conv_id, 0, {{'k': '000000000000', 't': ''}}, {none}, {none}, {none} FROM n
               UNION ALL
               SELECT w.conv_id, d.i, {', '.join(after)}
               FROM (SELECT conv_id, i, {inserts("s")} FROM r) w JOIN f d ON d.conv_id = w.conv_id AND d.i = w.i + 1),
             z AS (SELECT conv_id, {least("w0", "w3")} AS best
                   FROM (SELECT r.conv_id, {inserts("s")} FROM r JOIN n ON n.conv_id = r.conv_id AND r.i = n.n) x)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(CAST(left(best.k, 12) AS BIGINT), 0) AS cost, coalesce(substr(best.k, 13), '') AS audit,
               sha256(coalesce(best.t, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n USING (conv_id) LEFT JOIN z USING (conv_id)"""


SQL = {
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, coalesce(text, '') AS t,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
             k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
                          count(*) OVER (PARTITION BY norm) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k""",
    "op3_relative_lz": r"""
        WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM l),
             v AS (SELECT *, CASE WHEN i <= n - 19 THEN string_agg(word, ' ') OVER (
                       PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS k FROM w),
             r AS (SELECT *, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM v),
             c AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
                   FROM r),
             g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
                   FROM c GROUP BY doc_id)
        SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256 FROM l LEFT JOIN g USING (doc_id)""",
    "op6_url_filter": r"""
        WITH r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
                                   ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
             u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
                   FROM pages),
             s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                             'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
             m AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
                   FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT s.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN m USING (page_id)""",
    "op12_norm_sorted_topk": r"""
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS y
                   FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
             s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id,
                          CAST(coalesce(list_sum(list_transform(list_zip(q.y, c.y), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
             t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM t WHERE rank <= 5""",
    "op13_conversation_repair": _conversation_repair(),
}
