"""DuckDB texts for the queries that SQL can express over whole tables."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

# Five hex digits are twenty bits, which are four base-32 characters.
_DIGEST = (
    "array_to_string(list_transform(range(32), lambda i: substr('"
    + BASE32
    + "', 1 + ((('0x' || substr(sha1(h), 5 * (i // 4)::INTEGER + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), '')"
)

# Vectors that take part, as integers; a vector shorter than the other counts as filled up with zeros.
_VECTORS = """v AS (
  SELECT row_number() OVER () AS r, *, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
_PRODUCT = "coalesce(list_sum(list_transform(range(1, least(len(a.x), len(b.x)) + 1), lambda i: a.x[i] * b.x[i])), 0)::BIGINT"

ORACLE_SQL = {
    "op2_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, {_DIGEST} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)
""",
    "op7_near_dup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS s FROM w),
z AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 100 * i.n >= 75 * (a.n + b.n - i.n)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM z JOIN c ON x = doc_id
""",
    "op9_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(ws), 13) AS k,
    unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda i: array_to_string(ws[i : i + 12], ' '))) AS g
  FROM b WHERE len(ws) > 0),
k AS (SELECT DISTINCT k FROM q),
p AS (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM d, k WHERE len(ws) >= k),
g AS (SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS g FROM p),
m AS (SELECT g.doc_id, q.item_id, g.k, g.i FROM g JOIN q ON g.g = q.g AND g.k = q.k),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op11_maxscore": f"""
WITH {_VECTORS},
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, {_PRODUCT} AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM k WHERE rank <= 5
""",
    "op12_shared_terms": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
c AS (SELECT r, doc_id, len(ws)::BIGINT AS n, ws FROM d WHERE len(ws) > 0),
z AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM c),
t AS (SELECT r, unnest(ws) AS t FROM c),
f AS (SELECT r, t, count(*)::BIGINT AS tf FROM t GROUP BY r, t),
b AS (
  SELECT row_number() OVER () AS i, item_id,
    list_distinct(regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS ws FROM benchmark),
q AS (SELECT i, item_id, unnest(ws) AS t FROM b),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT t, count(*)::BIGINT AS df FROM f WHERE t IN (SELECT t FROM q) GROUP BY t), z),
s AS (SELECT q.i, q.item_id, c.r, c.doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (100 - 50 + ((50 * c.n * docs) // words)))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN f USING (t) JOIN c ON c.r = f.r, z GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 50
""",
    "op13_lemp": f"""
WITH {_VECTORS.replace("*,", "* EXCLUDE (label), CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,")
    .replace("IS NOT NULL AND", "IS NOT NULL AND label IS NOT NULL AND")},
s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS o, b.vec_id, a.label = b.label AS same, {_PRODUCT} AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s WHERE same),
n AS (SELECT p.r, p.anchor_id, p.o, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.o ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.k <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""",
}
