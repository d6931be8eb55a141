"""SQL of the registered queries that SQL can express, for an independent engine: op1, op6 and op9. The others hash, train, tokenize or cut shards."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"

#: A window is hit if its words also start earlier; a word goes if one of the windows that cover it is hit.
SUBSTRING_DEDUP = f"""WITH words AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents)),
 spans AS MATERIALIZED (SELECT doc_id, pos, string_agg(word, ' ') OVER o AS k, count(*) OVER o AS n FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
 hits AS MATERIALIZED (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM spans WHERE n = 20) WHERE nth > 1),
 marked AS MATERIALIZED (SELECT w.doc_id, w.word, w.pos, max(CASE WHEN h.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM words w LEFT JOIN hits h ON h.doc_id = w.doc_id AND h.pos = w.pos)
 SELECT d.doc_id, coalesce(m.n_words, 0) AS n_words, coalesce(m.n_removed, 0) AS n_removed, sha256(coalesce(m.kept, '')) AS kept_sha256 FROM documents d
 LEFT JOIN (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM marked GROUP BY 1) m ON m.doc_id = d.doc_id"""

WARC = """SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
 FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages))"""

#: Equal sets count once; components are reached from class to class.
NGRAM_JOIN = f"""WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w FROM documents),
 sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)])) END AS s FROM docs),
 classes AS MATERIALIZED (SELECT min(doc_id) AS id, s, len(s) AS n, list(doc_id) AS members FROM sets WHERE len(s) > 0 GROUP BY s),
 items AS MATERIALIZED (SELECT id, n, unnest(s) AS g FROM classes),
 links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
 edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach(id, other) AS (SELECT id, id FROM classes UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other),
 roots AS MATERIALIZED (SELECT id, min(other) AS root FROM reach GROUP BY 1),
 owners AS MATERIALIZED (SELECT unnest(c.members) AS doc_id, r.root FROM classes c JOIN roots r ON r.id = c.id)
 SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(o.root, t.doc_id) AS component_id FROM sets t LEFT JOIN owners o ON o.doc_id = t.doc_id"""

SQL = {"op1_substring_dedup": SUBSTRING_DEDUP, "op6_warc": WARC, "op9_ngram_join": NGRAM_JOIN}
