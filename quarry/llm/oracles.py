"""DuckDB SQL of queries that SQL can express, by the plain definitions."""

#: From relations `members(id)` and `links(a, b)` (both ways) to the least id reachable.
REACH = """
reach AS (
  SELECT id AS id, id AS other FROM members
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
"""

OP1 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), members AS (SELECT doc_id AS id FROM documents), {REACH}
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id FROM sets s JOIN least l ON s.doc_id = l.id
"""

OP10 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), fine AS (
  SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93
), members AS (SELECT vec_id AS id FROM embeddings), {REACH}
, n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, l.component_id, v.vec_id = l.component_id AS kept
FROM v JOIN least l ON v.vec_id = l.id LEFT JOIN n ON n.a = v.vec_id
"""
