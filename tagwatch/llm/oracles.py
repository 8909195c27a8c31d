"""DuckDB SQL for the operators that SQL can express."""

#: {words}: the junk words, by |.  The five rules joined by suffix of the host and prefix of the path, the longest kept.
URL_FILTER = r"""
WITH parts AS (
  SELECT row_number() OVER () AS k, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), cut AS (
  SELECT k, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM parts
), site AS (
  SELECT k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM cut
), rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
         ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'),
         ('org/es/', 'org', '/es/', 'block')
), best AS (
  SELECT s.k, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM site s JOIN rules r ON (s.host = r.rule_host OR s.host LIKE '%.' || r.rule_host) AND starts_with(s.path, r.rule_path)
  GROUP BY s.k
)
SELECT s.page_id, s.host, s.path, b.rule,
       coalesce(b.verdict, CASE WHEN regexp_matches(s.host, '(^|[^a-z0-9])({words})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM site s LEFT JOIN best b USING (k)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every window of every item joined with every window of every document.
DECONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)
), seen AS (
  SELECT k, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT d.*, s.n, unnest(range(1, len(w) - s.n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) s)
), hits AS (
  SELECT k, p, n, item FROM seen JOIN win USING (n, g)
), covered AS (
  SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT k, p, n FROM hits)) GROUP BY k
), met AS (
  SELECT k, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS items FROM hits GROUP BY k
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (k) LEFT JOIN met USING (k)
"""

#: All pairs that share a shingle, and what is reachable by links.
JACCARD_JOIN = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 75 * (s.n + t.n - c)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x
)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach r LEFT JOIN sizes USING (doc_id) GROUP BY r.doc_id
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON r.other = l.x
), c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""

ORACLES = {"op3_decontamination": DECONTAMINATION, "op6_jaccard_join": JACCARD_JOIN, "op8_embedding_dedup": EMBEDDING_DEDUP}
