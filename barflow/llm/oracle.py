"""DuckDB SQL for the queries that SQL can express on whole tables."""

OP13 = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), firsts AS (
    SELECT t, min(doc_id) AS first_id FROM texts GROUP BY t
), marked AS (
    SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
), failed AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
    FROM texts JOIN firsts USING (t) LEFT JOIN marked USING (doc_id)
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
    FROM letters a JOIN letters b ON b.l != a.l JOIN letters c ON c.l NOT IN (a.l, b.l) JOIN letters d ON d.l NOT IN (a.l, b.l, c.l)
        JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)
), steps AS (
    SELECT filter_order, unnest(range(1, 6)) AS step FROM orders
), named AS (
    SELECT filter_order, step, substr(filter_order, step, 1) AS letter, left(filter_order, step - 1) AS earlier FROM steps
), counted AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, fails
), judged AS (
    SELECT part, filter_order, step, letter, n, good, toxic, fails, contains(fails, letter) AS here,
        earlier != '' AND len(list_intersect(string_split(earlier, ''), string_split(fails, ''))) > 0 AND fails != '' AS before
    FROM named CROSS JOIN counted
), steps_of AS (
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter,
        CAST(coalesce(sum(n) FILTER (NOT here AND NOT before), 0) AS BIGINT) AS kept,
        CAST(coalesce(sum(n) FILTER (here AND NOT before), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (here AND before), 0) AS BIGINT) AS redundant,
        CAST(coalesce(sum(n) FILTER (fails = letter), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(good) FILTER (here AND NOT before), 0) AS BIGINT) AS good_lost,
        CAST(coalesce(sum(toxic) FILTER (here AND NOT before), 0) AS BIGINT) AS toxic_lost
    FROM judged GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM steps_of
"""

OP11 = """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS hex FROM pages
), grouped AS (
    SELECT page_id, strlen(p) AS payload_bytes, hex, min(page_id) OVER (PARTITION BY p) AS first_id FROM payloads
), places AS (
    SELECT hex, k, CAST('0x' || substr(hex, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4)) & 31 AS five
    FROM (SELECT DISTINCT hex, unnest(range(0, 32)) AS k FROM grouped)
), spelled AS (
    SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(five + 1 AS INTEGER), 1), '' ORDER BY k) AS payload_digest FROM places GROUP BY hex
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id != first_id THEN first_id END AS refers_to
FROM grouped JOIN spelled USING (hex)
"""

ORACLES: dict[str, str] = {"op11_warc": OP11, "op13_filter_audit": OP13}
