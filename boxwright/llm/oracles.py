"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = rf"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), iw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM iw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT rid, p, n, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, lens WHERE len(w) >= n)
), hits AS (SELECT rid, item, p, n FROM grams JOIN win USING (n, g)),
covered AS (
  SELECT rid, count(DISTINCT q) AS n_hit
  FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM hits)) GROUP BY rid
), its AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (rid) LEFT JOIN its USING (rid)
"""

# SHA-1 in hex becomes base32 through its bits, five at a time.
OP8 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(v AS INTEGER), 1), '' ORDER BY g, k) AS digest
  FROM (
    SELECT h, g, k, (n >> (5 * (3 - k))) & 31 AS v
    FROM (SELECT h, g, CAST('0x' || substr(h, 5 * g + 1, 5) AS BIGINT) AS n FROM (SELECT DISTINCT h FROM p), range(8) AS r(g)), range(4) AS s(k)
  ) GROUP BY h
), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p JOIN d USING (h) JOIN f USING (h)
"""

# Candidates share a shingle of their rarest quarter (any two linked sets do), so the check stays cheap; then exact.
OP3 = rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT DISTINCT rid, array_to_string(w[p : p + least(len(w), 5) - 1], ' ') || CASE WHEN len(w) < 5 THEN ' ' ELSE '' END AS g
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)
), n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
df AS (SELECT g, count(*) AS df FROM g GROUP BY g),
ranked AS (SELECT rid, g, row_number() OVER (PARTITION BY rid ORDER BY df, g) AS r FROM g JOIN df USING (g)),
prefix AS (SELECT rid, g FROM ranked JOIN n USING (rid) WHERE r <= n - ceil(0.75 * n) + 1),
cand AS (SELECT DISTINCT a.rid AS a, b.rid AS b FROM prefix a JOIN prefix b USING (g) WHERE a.rid < b.rid),
inter AS (SELECT c.a, c.b, count(*) AS i FROM cand c JOIN g x ON x.rid = c.a JOIN g y ON y.rid = c.b AND y.g = x.g GROUP BY c.a, c.b),
link AS (SELECT a, b FROM inter JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(rid, other) AS (SELECT rid, rid FROM w UNION SELECT r.rid, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM reach r JOIN w ON w.rid = r.rid JOIN w o ON o.rid = r.other LEFT JOIN n ON n.rid = w.rid
GROUP BY w.rid, w.doc_id, n.n
"""

ORACLE_SQL = {"op2_decontamination": OP2, "op3_jaccard_join": OP3, "op8_warc_captures": OP8}
