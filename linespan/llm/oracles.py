"""DuckDB SQL for the rows of operators that SQL can express on whole tables."""

from __future__ import annotations

import string

from .mixing import OP6_SQL
from .search import OP13_SQL

WORD = r"[^\x20\x09-\x0D]+"
LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id) AS n_links,
       least(e.vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = e.vec_id), e.vec_id)) AS component_id,
       e.vec_id <= coalesce((SELECT min(b) FROM r WHERE r.a = e.vec_id), e.vec_id) AS kept
FROM embeddings e
"""

OP3_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) >= 5 THEN list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' '))
                                          WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id
"""

OP8_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS a FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(a) - 48)) AS i, unnest(list_transform(range(1, len(a) - 48), lambda i: md5(array_to_string(a[i:i + 49], ' ')))) AS h
      FROM w WHERE len(a) >= 50),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT doc_id, i FROM x JOIN f USING (h) WHERE first < doc_id),
o AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS j, unnest(a) AS word FROM w),
k AS (SELECT o.doc_id, j, word, max((g.i IS NOT NULL)::INT) OVER (PARTITION BY o.doc_id ORDER BY j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
      FROM o LEFT JOIN g ON g.doc_id = o.doc_id AND g.i = o.j),
t AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (gone = 0) AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, len(a)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN t USING (doc_id)
"""

ORACLE_SQL = {"op2_lattice_near_vectors": OP2_SQL, "op3_ngram_jaccard_join": OP3_SQL, "op6_mix_sources": OP6_SQL, "op8_substring_dedup": OP8_SQL, "op13_ranked_search": OP13_SQL}
