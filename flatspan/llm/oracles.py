"""DuckDB SQL of the numbered operators that SQL can express."""

from __future__ import annotations

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
s AS (SELECT vec_id, x, list_dot_product(x, x) AS q FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
n AS (SELECT vec_id, list_transform(x, lambda c: c / sqrt(q)) AS u FROM s WHERE q > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n AS a JOIN n AS b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) AND list_dot_product(a.u, b.u) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.vec_id = v.vec_id"""

#: Upper-case letters, and their lower-case ones, so that no others are changed.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2.0 * any_value(docs) + 2) / (2.0 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
b AS (SELECT DISTINCT item_id, text, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
f AS (SELECT item_id, text, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score FROM b JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, text, r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM f WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50"""

#: 40 bits of a digest as eight letters, and four times that.
_LETTERS = "list_transform(range(0, 8), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v{k} >> (35 - 5 * j)) & 31) AS INTEGER) + 1, 1))"
_PARTS = ", ".join(f"CAST('0x' || substr(h, {1 + 10 * k}, 10) AS BIGINT) AS v{k}" for k in range(4))
_BASE32 = " || ".join(f"array_to_string({_LETTERS.format(k=k)}, '')" for k in range(4))

ARCHIVES = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, {_PARTS} FROM p),
r AS (SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, row_number() OVER w AS k, first_value(page_id) OVER w AS head FROM d WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN head END AS refers_to FROM r"""

ORACLES = {"op3_embedding_near_dedup": EMBEDDINGS, "op12_lexical_search": SEARCH, "op13_warc_archives": ARCHIVES}
