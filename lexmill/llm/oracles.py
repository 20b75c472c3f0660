"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

import string

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _base32(hexed: str) -> str:
    """Eight groups of five hex digits, four base32 digits each."""
    digits = []
    for i in range(8):
        v = f"('0x' || substr({hexed}, {1 + 5 * i}, 5))::BIGINT"
        digits += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(({v} >> {s}) & 31 AS BIGINT), 1)" for s in (15, 10, 5, 0)]
    return " || ".join(digits)


OP4 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
 SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_base32('x')} AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

OP7 = f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 win AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS gram FROM b WHERE len(w) > 0),
 lens AS (SELECT DISTINCT k FROM win), g AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS pos FROM w, lens WHERE len(w) >= k),
 h AS (SELECT g.doc_id, g.pos, g.k, win.item_id FROM g JOIN win ON win.k = g.k AND win.gram = array_to_string(g.w[g.pos:g.pos + g.k - 1], ' ')),
 c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM h) GROUP BY ALL),
 i AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY ALL)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM w LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)"""

OP9 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL), i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON r.d = e.a)
 SELECT d AS doc_id, min(m) AS class_id, coalesce(any_value(k), 0) AS n_links FROM r LEFT JOIN (SELECT a, count(*) AS k FROM e GROUP BY ALL) q ON q.a = r.d GROUP BY d"""
