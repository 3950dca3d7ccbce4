"""DuckDB SQL for the rows of queries whose methods only save work: windows, bytes and classes, the plain way."""

from __future__ import annotations

_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

OP2 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, unnest(list_transform(range(1, len(ws) - 18), lambda k: array_to_string(ws[k:k + 19], ' '))) AS s FROM w WHERE len(ws) >= 20),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM rep CROSS JOIN range(20) t(k)),
flat AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM flat ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

OP9 = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' ')) ELSE ['short ' || array_to_string(ws, ' ')] END) AS sh FROM w WHERE len(ws) > 0),
c AS (SELECT doc_id, sh, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN t p ON p.doc_id = x JOIN t q ON q.doc_id = y WHERE m >= 0.8 * (p.n + q.n - m)),
both AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (WITH RECURSIVE r AS (SELECT DISTINCT x AS a, x AS b FROM both UNION SELECT r.a, both.y FROM r JOIN both ON both.x = r.b) SELECT a, min(b) AS class_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(class_id, w.doc_id) AS class_id FROM w LEFT JOIN reach ON a = w.doc_id
"""
OP9 = OP9.replace("both", "edge")

OP10 = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, x, len(x) // 2 AS n FROM h),
win AS (SELECT doc_id, unnest(range(n - 49)) AS i, unnest(list_transform(range(n - 49), lambda k: substr(x, 2 * k + 1, 100))) AS s FROM b WHERE n >= 50),
first AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s HAVING count(*) > 1),
rep AS (SELECT win.doc_id, i FROM win JOIN first USING (s) WHERE d < win.doc_id),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT doc_id, i, sum(step) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT doc_id, i, CASE WHEN i - lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) > 50 THEN 1 ELSE 0 END AS step FROM rep)) GROUP BY doc_id, g),
edges AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends, sum(z - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT b.doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN starts IS NULL THEN x ELSE array_to_string(list_transform(range(len(starts) + 1), lambda k:
    substr(x, 2 * (CASE WHEN k = 0 THEN 0 ELSE ends[k] END) + 1, 2 * ((CASE WHEN k = len(starts) THEN n ELSE starts[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE ends[k] END)))), '') END)) AS kept_sha256
FROM b LEFT JOIN edges ON edges.doc_id = b.doc_id
"""
