"""SQL (DuckDB) that gives the rows of queries of this subpackage."""

REPEATS = r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
blocks AS (SELECT doc_id, b, substr(x, 1000 * b + 1, 1798) AS y FROM (SELECT doc_id, x, unnest(range(0, (len(x) // 2 - 400) // 500 + 1)) AS b FROM d WHERE len(x) >= 800)),
k AS (SELECT doc_id, 500 * b + j AS i, hash(substr(y, 2 * j + 1, 800)) AS h FROM (SELECT *, unnest(range(0, least(500, len(y) // 2 - 399))) AS j FROM blocks)),
r AS (SELECT doc_id, i FROM k SEMI JOIN (SELECT h FROM k GROUP BY 1 HAVING COUNT(*) > 1) USING (h)),
e AS (SELECT doc_id, i, coalesce(i - lag(i) OVER o > 400, true) AS starts FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, SUM(starts::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
spans AS (SELECT doc_id, run, MIN(i) AS a, MAX(i) + 400 AS b FROM g GROUP BY ALL),
kept AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS from_ FROM spans),
rest AS (SELECT doc_id, string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY run) || substr(any_value(x), 2 * MAX(b) + 1) AS x, SUM(b - a) AS removed, COUNT(*) AS n FROM kept JOIN d USING (doc_id) GROUP BY 1),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
wk AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 49)) AS i FROM w WHERE len(w) >= 51)),
wr AS (SELECT doc_id, i FROM wk SEMI JOIN (SELECT h FROM wk GROUP BY 1 HAVING COUNT(*) > 1) USING (h)),
passages AS (SELECT doc_id, SUM(starts::INT) AS n FROM (SELECT doc_id, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 51, true) AS starts FROM wr) GROUP BY 1)
SELECT d.doc_id, len(d.x) // 2 AS n_bytes, CAST(coalesce(rest.removed, 0) AS BIGINT) AS n_removed, coalesce(rest.n, 0) AS n_spans,
  sha256(from_hex(coalesce(rest.x, d.x))) AS kept_sha256, CAST(coalesce(passages.n, 0) AS BIGINT) AS n_passages
FROM d LEFT JOIN rest ON rest.doc_id = d.doc_id LEFT JOIN passages ON passages.doc_id = d.doc_id"""

NEAR = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS i FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n c ON c.doc_id = a JOIN n d ON d.doc_id = b WHERE 100 * i >= 80 * (c.n + d.n - i)),
reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id
  LEFT JOIN (SELECT a, MIN(b) AS least FROM reach GROUP BY 1) c ON c.a = w.doc_id"""
