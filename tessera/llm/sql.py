"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from tessera.llm import secrets as S

#: Links by an inverted list of the rarest shingles: a pair with the wanted overlap shares one of the
#: first n - ceil(0.85 n) + 1 in any fixed order of all shingles, so no link is lost.
NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM w
), u AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s
), e AS (SELECT id, n, unnest(s) AS x FROM u
), f AS (SELECT x, count(*) AS c FROM e GROUP BY x
), p AS (
  SELECT id, n, x FROM (
    SELECT e.id, e.n, e.x, row_number() OVER (PARTITION BY e.id ORDER BY f.c, e.x) AS k FROM e JOIN f USING (x)
  ) WHERE k <= n - CAST(ceil(85 * n / 100.0) AS BIGINT) + 1
), c AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), l AS (
  SELECT c.a, c.b FROM c JOIN u x ON x.id = c.a JOIN u y ON y.id = c.b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 85 * (x.n + y.n - len(list_intersect(x.s, y.s)))
), g AS (SELECT a, b FROM l UNION SELECT b, a FROM l
), r(node, root) AS (
  SELECT id, id FROM u
  UNION
  SELECT g.b, r.root FROM r JOIN g ON g.a = r.node AND r.root < g.b
), m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id, s.doc_id = coalesce(m.root, s.doc_id) AS kept
FROM s LEFT JOIN u ON u.s = s.s LEFT JOIN m ON m.node = u.id
"""

#: Every string of 400 bytes of every text, as hex, by place.
REPEATS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), h AS (SELECT r, doc_id, hex(b) AS h, octet_length(b) AS n FROM d
), w AS (
  SELECT r, i, hash(substr(h, 2 * i + 1, 800)) AS k, md5(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT r, h, unnest(range(0, n - 399)) AS i FROM h WHERE n >= 400)
), g AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY k, m) > 1
), e AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM g
), f AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM e
), s AS (SELECT r, run, min(i) AS a, max(i) + 400 AS z FROM f GROUP BY r, run
), k AS (
  SELECT s.r, sum(z - a) AS removed, count(*) AS spans,
         list_sort(list({'a': a, 'z': z})) AS cut FROM s GROUP BY s.r
), t AS (
  SELECT h.doc_id, h.n, coalesce(k.removed, 0) AS removed, coalesce(k.spans, 0) AS spans,
         CASE WHEN k.r IS NULL THEN h.h ELSE
           array_to_string(list_transform(range(1, len(cut) + 2), lambda j:
             substr(h.h, 2 * (CASE WHEN j = 1 THEN 0 ELSE cut[j - 1].z END) + 1,
                    2 * ((CASE WHEN j > len(cut) THEN h.n ELSE cut[j].a END) - (CASE WHEN j = 1 THEN 0 ELSE cut[j - 1].z END)))), '')
         END AS kept
  FROM h LEFT JOIN k ON k.r = h.r
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM t
"""


def _spans(ord_: int, pattern: str, test: str, group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT r, {ord_} AS ord, len(array_to_string(pieces[1:i], '')) + len(array_to_string(hits[1:i - 1], '')) AS a, len(hits[i]) AS n
  FROM (SELECT r, unnest(range(1, len(hits) + 1)) AS i, pieces, hits, tested FROM (
    SELECT r, string_split_regex(text, '{p}') AS pieces, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {group}) AS tested FROM d))
  WHERE {test.replace('@', 'tested[i]')}"""


SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), b AS ({_spans(0, S.ASSIGN, f"len(@) >= {S.ASSIGNED_LEAST}", 2)} UNION ALL {_spans(1, S.ACCESS, "true")} UNION ALL {_spans(2, S.HEX, "true")}
), k AS (
  {_spans(3, S.KEY_ID, "regexp_matches(@, '[0-9]') AND regexp_matches(@, '[A-Z]') AND NOT regexp_matches(@, '[a-z]')")} UNION ALL
  {_spans(4, S.KEY_VALUE, "regexp_matches(@, '[0-9]') AND regexp_matches(@, '[A-Z]') AND regexp_matches(@, '[a-z]')")} UNION ALL
  {_spans(5, S.ENDPOINT, "true")}
), f AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = k.r AND b.a < k.a + k.n AND k.a < b.a + b.n)
), s AS (SELECT * FROM b UNION ALL SELECT * FROM f
), p AS (
  SELECT x.r AS r, x.ord AS xo, x.a AS xa, x.n AS xn, y.ord AS yo, y.a AS ya, y.n AS yn FROM s x JOIN s y
  ON x.r = y.r AND x.ord IN (1, 3) AND y.ord IN (0, 2, 4) AND abs(x.a - y.a) <= {S.SCOPE} AND NOT (x.a < y.a + y.n AND y.a < x.a + x.n)
  WHERE x.r IN (SELECT r FROM s GROUP BY r HAVING bool_or(ord IN (3, 4)))
), l AS (
  SELECT DISTINCT r, xo AS ord, xa AS a, xn AS n FROM p UNION SELECT r, yo, ya, yn FROM p UNION
  SELECT s.r, s.ord, s.a, s.n FROM s JOIN p ON s.r = p.r AND s.ord = 5 AND abs(s.a - p.xa) <= {S.SCOPE}
), o AS (SELECT r, ord, a, n, true AS base FROM b UNION ALL SELECT r, ord, a, n, false FROM l WHERE ord > 2
), t AS (
  SELECT r, count(*) FILTER (base AND ord = 0) AS n_assign, count(*) FILTER (base AND ord = 1) AS n_access, count(*) FILTER (base AND ord = 2) AS n_hex,
         coalesce(string_agg(['assign', 'access', 'hex', 'key_id', 'key_value', 'endpoint'][ord + 1] || ':' || a || ':' || (a + n), ',' ORDER BY a, ord) FILTER (base), '') AS base,
         string_agg(['assign', 'access', 'hex', 'key_id', 'key_value', 'endpoint'][ord + 1] || ':' || a || ':' || (a + n), ',' ORDER BY a, ord) AS spans
  FROM o GROUP BY r
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t ON t.r = d.r
"""
