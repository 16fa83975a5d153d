"""DuckDB SQL of queries whose operators have no short plan in SQL, by plain means that suit small tables."""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, {_WORD}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS p FROM w WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reach) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.node = w.doc_id
"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
h AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM w WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS first_doc FROM h GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM h JOIN f USING (k) WHERE doc_id > first_doc),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM w),
rest AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.q) AS kept, count(*) AS n FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.q = g.q WHERE g.q IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN rest USING (doc_id)
"""

SUFFIX_DEDUP = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
h AS (
  SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS p FROM b WHERE length(x) >= 200)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nr FROM h) WHERE nr > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 100)) AS q FROM f),
c AS (SELECT doc_id, count(*) AS n_removed, sum(CASE WHEN before = q - 1 THEN 0 ELSE 1 END) AS n_spans FROM (SELECT doc_id, q, lag(q) OVER (PARTITION BY doc_id ORDER BY q) AS before FROM g) GROUP BY doc_id),
y AS (SELECT doc_id, x, unnest(range(0, length(x) // 2)) AS q FROM b WHERE doc_id IN (SELECT doc_id FROM c)),
rest AS (SELECT y.doc_id, string_agg(substr(x, 2 * y.q + 1, 2), '' ORDER BY y.q) AS kept FROM y LEFT JOIN g ON y.doc_id = g.doc_id AND y.q = g.q WHERE g.q IS NULL GROUP BY y.doc_id)
SELECT b.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN c.doc_id IS NULL THEN x ELSE coalesce(kept, '') END)) AS kept_sha256
FROM b LEFT JOIN c USING (doc_id) LEFT JOIN rest USING (doc_id)
"""

EXTRA = {"op1_ngram_jaccard_join": NGRAM_JOIN, "op3_suffix_dedup": SUFFIX_DEDUP, "op6_substring_dedup": SUBSTRING_DEDUP}
