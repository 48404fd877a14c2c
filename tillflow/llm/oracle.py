"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

# SHA-1 in base 32: five hexadecimal digits at a time are a number of four letters.
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((n >> {shift}) & 31) + 1 AS INTEGER), 1)"
_LETTERS = " || ".join(_LETTER.format(shift=shift) for shift in (15, 10, 5, 0))

ORACLE = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT page_id, k, CAST('0x' || substr(hex, 5 * k + 1, 5) AS BIGINT) AS n FROM (SELECT page_id, hex, unnest(range(8)) AS k FROM p)),
d AS (SELECT page_id, string_agg({_LETTERS}, '' ORDER BY k) AS payload_digest FROM g GROUP BY page_id)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = min(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id > min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to
FROM p JOIN d USING (page_id) WINDOW same AS (PARTITION BY html)""",
    "op2_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
spot AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d), (SELECT DISTINCT n FROM i) WHERE p + n - 1 <= len(w)),
hit AS (SELECT doc_id, p, n, item_id FROM spot JOIN win USING (n, s)),
word AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)""",
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
