"""DuckDB SQL for those queries of this subpackage that SQL can express; tables are views named as their files."""

from __future__ import annotations

_OP1 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, url, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
        min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, url, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM q
"""

_RULES = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", 0, 0),
)


def _op3() -> str:
    one = """
  SELECT doc_id, {k} AS kind, '{kind}' AS name, n, CASE WHEN length(v[i]) >= {least} THEN m[i] END AS hit,
    (list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i-1]]), 0))::BIGINT AS start, length(m[i])::BIGINT AS size
  FROM (SELECT doc_id, n, m, v, g, unnest(generate_series(1, len(m))) AS i
    FROM (SELECT doc_id, n, regexp_extract_all(text, '{re}') AS m, regexp_extract_all(text, '{re}', {group}) AS v, regexp_split_to_array(text, '{re}') AS g FROM d))"""
    parts = " UNION ALL ".join(one.format(k=k, kind=kind, re=re, group=group, least=least) for k, (kind, re, group, least) in enumerate(_RULES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS n FROM documents),
s AS (SELECT n, kind, start, name || ':' || start || ':' || (start + size) AS span FROM ({parts}) WHERE hit IS NOT NULL),
t AS (SELECT n, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
  string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM s GROUP BY n)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (n)
"""


_OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS lo FROM g) WHERE lo < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM f),
x AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d),
k AS (SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS kept, count(*) AS n FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

_OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i+12], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, i, m, array_to_string(w[i:i+m-1], ' ') AS s FROM
  (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM p))),
o AS (SELECT doc_id, i, m, item_id FROM g JOIN p USING (m, s)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS q FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_OP10 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM m LEFT JOIN n USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": _OP1, "op3_secrets": _op3(), "op4_substring_dedup": _OP4, "op5_decontamination": _OP5, "op9_topk": _OP9, "op10_near_dedup": _OP10}
