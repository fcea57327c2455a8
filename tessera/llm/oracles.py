"""DuckDB SQL for the queries whose rows SQL can express, over whole tables."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Equal sets are one node; every link of two nodes comes from their shared shingles.
NGRAM_JACCARD = rf"""
WITH RECURSIVE cut AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) END AS s
    FROM cut
), keyed AS MATERIALIZED (
    SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS k, s FROM sets
), nodes AS MATERIALIZED (
    SELECT k, min(doc_id) AS node, any_value(n) AS n, any_value(s) AS s FROM keyed WHERE n > 0 GROUP BY k
), entries AS MATERIALIZED (
    SELECT node, n, unnest(s) AS g FROM nodes
), links AS MATERIALIZED (
    SELECT a.node AS x, b.node AS y FROM entries a JOIN entries b ON a.g = b.g AND a.node < b.node AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), ways AS MATERIALIZED (
    SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached(x, y) AS (
    SELECT x, x FROM ways UNION SELECT r.x, b.y FROM reached r JOIN ways b ON b.x = r.y
), least_of AS (
    SELECT x, min(y) AS y FROM reached GROUP BY x
), degree AS (
    SELECT x, count(*) AS n FROM ways GROUP BY x
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(l.y, c.node, d.doc_id) AS component_id, coalesce(g.n, 0) AS n_links
FROM keyed d LEFT JOIN nodes c ON d.k = c.k LEFT JOIN least_of l ON l.x = c.node LEFT JOIN degree g ON g.x = c.node
"""

CHAT_FORMAT = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), shown AS (
    SELECT *, '### ' || CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
            ELSE CASE WHEN role IN ('System', 'User', 'Assistant') THEN '\' || role ELSE regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g') END END
        || ': ' || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || ' </turn>' || chr(10) AS formatted
    FROM rows
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""

WARC = """
WITH digests AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), hexed AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h FROM digests
), based AS (
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS target,
        array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, (i // 8) * 10 + 1, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1) FOR i IN range(32)], '') AS payload_digest
    FROM hexed
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> target THEN target END AS refers_to
FROM based
"""

DECONTAMINATE = rf"""
WITH item AS MATERIALIZED (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS MATERIALIZED (
    SELECT DISTINCT item, least(len(w), 10) AS size, unnest([array_to_string(w[i : i + least(len(w), 10) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), 10) + 2)]) AS g FROM item WHERE len(w) > 0
), sizes AS (
    SELECT DISTINCT size FROM windows
), doc AS MATERIALIZED (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), spans AS (
    SELECT row, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes WHERE len(w) >= size
), found AS MATERIALIZED (
    SELECT row, i, s.size, item FROM (SELECT row, i, size, array_to_string(w[i : i + size - 1], ' ') AS g FROM spans) s JOIN windows v ON v.g = s.g AND v.size = s.size
), hit AS (
    SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + size)) AS p FROM found) GROUP BY row
), items AS (
    SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT row, item FROM found) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
    sha256(coalesce(items.names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (row) LEFT JOIN items USING (row)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": NGRAM_JACCARD,
    "op5_chat_format": CHAT_FORMAT,
    "op7_warc": WARC,
    "op10_decontaminate": DECONTAMINATE,
}
