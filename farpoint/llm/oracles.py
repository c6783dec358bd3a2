"""The queries of this subpackage that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

OP7_REVISIT_ASOF = r"""
WITH crawl AS (
    SELECT page_id, url, html,
           1700000000 + ((page_id * 7919) % 1000003 + 1000003) % 1000003 AS stored_at,
           3600 * (1 + (page_id % 240 + 240) % 240) AS gap,
           '"' || md5(coalesce(html, '')) || '"' AS tag
    FROM pages
), spelled AS (
    SELECT page_id, 'response' AS kind, url, stored_at AS time, tag AS etag, stored_at, strlen(html) AS html_bytes FROM crawl
    UNION ALL
    SELECT page_id, 'revisit',
           regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://([^/]*)', 'HTTP://\1:80') || '#again',
           stored_at + gap,
           CASE WHEN page_id % 5 = 4 THEN NULL WHEN page_id % 4 = 3 THEN '"stale"' ELSE 'W/' || tag END,
           NULL, NULL
    FROM crawl
), cut AS (
    SELECT *, regexp_replace(trim(url), '#.*$', '') AS address,
           '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d*)?([^?]*)(?:\?(.*))?$' AS parts
    FROM spelled
), taken_apart AS (
    SELECT *, regexp_replace(lower(regexp_extract(address, parts, 1)), '^www\d*\.|\.$', '', 'g') AS host,
           regexp_replace(regexp_extract(address, parts, 2), '^/?', '/') AS path,
           list_sort([p FOR p IN string_split(regexp_extract(address, parts, 3), '&')
                      IF p <> '' AND NOT regexp_matches(lower(p),
                         '^(utm_[^=]*|ref|fbclid|gclid|mc_cid|mc_eid|sessionid|phpsessid|jsessionid)(=|$)')]) AS query
    FROM cut
), records AS (
    SELECT page_id, kind, time, etag, stored_at, html_bytes,
           CASE WHEN regexp_matches(address, parts)
                THEN host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END
                ELSE address END AS canonical
    FROM taken_apart
), responses AS (
    SELECT * FROM records WHERE kind = 'response'
    QUALIFY row_number() OVER (PARTITION BY canonical, time ORDER BY 'r' || page_id DESC) = 1
), met AS (
    SELECT v.page_id, v.canonical, v.time, v.etag AS sent, r.page_id AS found, r.etag AS held, r.stored_at, r.html_bytes,
           CASE WHEN r.page_id IS NULL THEN 'nothing earlier'
                WHEN v.etag IS NULL THEN 'time'
                WHEN regexp_replace(v.etag, '^W/', '') = r.etag THEN 'etag'
                ELSE 'mismatch' END AS matched_by
    FROM (SELECT * FROM records WHERE kind = 'revisit') v
    ASOF LEFT JOIN responses r ON v.canonical = r.canonical AND v.time > r.time
)
SELECT 'v' || page_id AS record_id, canonical, time,
       CASE WHEN matched_by IN ('etag', 'time') THEN 'r' || found END AS response_id,
       matched_by,
       CASE WHEN matched_by IN ('etag', 'time')
            THEN concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: ' || html_bytes, 'content-type: text/html',
                           'date: ' || strftime(make_timestamp(time * 1000000), '%Y-%m-%d %H:%M:%S'),
                           'etag: ' || coalesce(sent, held),
                           'last-modified: ' || strftime(make_timestamp(stored_at * 1000000), '%Y-%m-%d %H:%M:%S'))
            ELSE concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: 0',
                           'date: ' || strftime(make_timestamp(time * 1000000), '%Y-%m-%d %H:%M:%S'),
                           'etag: ' || sent) END AS headers
FROM met
"""

OP8_CHAT_SPANS = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS control(turn, role)
), marked AS (
    SELECT *,
           CASE WHEN role IN ('user', 'assistant', 'system') THEN length(role)
                ELSE length(role) + len(regexp_extract_all(role, '[\\:#<\n]')) + (role IN ('User', 'Assistant', 'System'))::INT
           END AS name_chars,
           len(regexp_extract_all(text, '\\|</turn>'))
           + coalesce(list_sum([length(run) - 2 FOR run IN regexp_extract_all(text, '###+')]), 0) AS escapes
    FROM said
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       -- "### ", name, ": ", text, "</turn>", line end
       sum(4 + name_chars + 2 + length(text) + escapes + 8)::BIGINT AS formatted_chars,
       NULL::BIGINT AS rewritten_at
FROM marked
GROUP BY conv_id
"""

OP11_HEAVY_HITTER_DEDUP = r"""
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

ORACLES = {
    "op7_revisit_asof": OP7_REVISIT_ASOF,
    "op8_chat_spans": OP8_CHAT_SPANS,
    "op11_heavy_hitter_dedup": OP11_HEAVY_HITTER_DEDUP,
}
