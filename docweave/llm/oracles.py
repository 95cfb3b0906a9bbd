"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM p),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d CROSS JOIN lens WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, p.item_id FROM dw JOIN p ON dw.n = p.n AND dw.s = p.s),
hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

OP1 = r"""
WITH r AS (SELECT conv_id, turn, replace(replace(coalesce(role, 'unknown'), '<|', '<\|'), chr(10), '\n') AS role, replace(coalesce(text, ''), '<|', '<\|') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM r),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'),
h AS (SELECT n.*, perspective, '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN role ELSE 'user name=' || role END || chr(10) AS head
      FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, perspective ORDER BY k ROWS UNBOUNDED PRECEDING) AS hi FROM h)
SELECT conv_id, perspective, count(*) AS n_messages,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered,
       coalesce(string_agg(CAST(hi - length(text) - 11 AS VARCHAR) || '-' || CAST(hi AS VARCHAR), ',' ORDER BY k) FILTER (role = perspective), '') AS mask,
       CAST(coalesce(sum(length(text) + 11) FILTER (role = perspective), 0) AS BIGINT) AS n_masked
FROM o GROUP BY conv_id, perspective
"""

OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT s, min(doc_id) AS least FROM x GROUP BY s),
h AS (SELECT DISTINCT doc_id, k FROM (SELECT x.doc_id, unnest(generate_series(i, i + 12)) AS k FROM x JOIN m USING (s) WHERE least < x.doc_id)),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
r AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) FILTER (h.k IS NULL) AS kept, count(h.k) AS n FROM t LEFT JOIN h USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""

OP6 = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
x AS (SELECT doc_id, p, b[p:p + 99] AS s FROM (SELECT doc_id, b, unnest(generate_series(1, n - 99)) AS p FROM d WHERE n >= 100)),
m AS (SELECT s, min((doc_id, p)) AS least FROM x GROUP BY s),
h AS (SELECT x.doc_id, p FROM x JOIN m USING (s) WHERE (x.doc_id, p) > least),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM h)),
r AS (SELECT doc_id, run, min(p) AS lo, max(p) + 100 AS hi FROM g GROUP BY doc_id, run),
c AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS before FROM r),
e AS (SELECT doc_id, max(hi) AS last, sum(hi - lo) AS removed, count(*) AS spans FROM r GROUP BY doc_id),
k AS (SELECT c.doc_id, string_agg(CASE WHEN lo > before THEN hex(b[before:lo - 1]) ELSE '' END, '' ORDER BY lo) AS head FROM c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || CASE WHEN coalesce(last, 1) <= n THEN hex(b[coalesce(last, 1):n]) ELSE '' END)) AS kept_sha256
FROM d LEFT JOIN e USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def _op13(rounds: int = 4) -> str:
    """Every round as two tables: parts assigned to their nearest entry (whole numbers in doubles, exact), then entries as floored means."""
    assigned = """a{k} AS MATERIALIZED (SELECT p, r, min((d, e)) AS best FROM (SELECT x.p, x.r, b.e, x.q + b.q - 2 * list_dot_product(x.v, b.v) AS d FROM x JOIN b{k} b USING (p)) GROUP BY p, r)"""
    moved = """m{k} AS MATERIALIZED (SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, e, i, floor(sum(c) / count(*)) AS m FROM (SELECT a.p, a.best[2] AS e, unnest(x.v) AS c, generate_subscripts(x.v, 1) AS i FROM a{k} a JOIN x USING (p, r)) GROUP BY p, e, i) GROUP BY p, e),
b{n} AS MATERIALIZED (SELECT p, e, v, list_dot_product(v, v) AS q FROM (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (p, e)))"""
    steps = ",\n".join(f"{assigned.format(k=k)},\n{moved.format(k=k, n=k + 1)}" for k in range(rounds))
    return rf"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r, vec_id, label, v FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
     WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(abs(CAST(x AS DOUBLE)) < 65536, false))))),
s AS (SELECT len(v) AS n FROM k WHERE r = 0 AND len(v) % 4 = 0),
x AS MATERIALIZED (SELECT p, r, v, list_dot_product(v, v) AS q FROM (SELECT p, r, v[p * n // 4 + 1:(p + 1) * n // 4] AS v FROM k JOIN s ON len(v) = n CROSS JOIN generate_series(0, 3) g(p))),
o AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY r) - 1 AS e, v, q FROM x),
b0 AS MATERIALIZED (SELECT p, e, v, q FROM o WHERE e < 256),
{steps},
{assigned.format(k=rounds)},
h AS (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM b{rounds})),
c AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k USING (r) CROSS JOIN h
"""


OP13 = _op13()

OP11 = r"""
WITH t AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce([i] || generate_series(1, 8), lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM generate_series(0, 255) g(i))),
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS k, strlen(role) || ':' || role || text AS s, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, (xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])))) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM r) CROSS JOIN t),
b AS (SELECT c.conv_id, k.k AS pos, s, words FROM c JOIN k ON k.conv_id = c.base AND k.k <= h),
n AS (SELECT c.conv_id, h, count(b.pos) AS took FROM c LEFT JOIN b USING (conv_id) GROUP BY ALL),
p AS (SELECT * FROM b UNION ALL SELECT conv_id, k - h + took, s, words FROM k JOIN n USING (conv_id) WHERE k > h),
q AS MATERIALIZED (SELECT conv_id, pos AS depth, sha256(string_agg(strlen(s) || ':' || s, '') OVER w) AS key, coalesce(sha256(string_agg(strlen(s) || ':' || s, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 'root') AS up, words FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
      UNION ALL SELECT conv_id, 0, 'root', NULL, 0 FROM c),
l AS (SELECT conv_id, max(depth) AS depth FROM q GROUP BY 1),
e AS (SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM q JOIN l USING (conv_id, depth) GROUP BY key),
m AS (SELECT key, min(conv_id) AS conv_id, min(depth) AS depth, min(up) AS up, count(*) AS n_convs, min(words) AS words FROM q GROUP BY key),
d AS (SELECT up AS key, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY 1),
u AS (SELECT q.key, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * m.words) AS saved FROM m LEFT JOIN d USING (key) JOIN q ON q.conv_id = m.conv_id AND q.depth <= m.depth GROUP BY q.key)
SELECT m.conv_id, m.depth, pm.conv_id AS parent_conv_id, m.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM m LEFT JOIN m pm ON pm.key = m.up LEFT JOIN d ON d.key = m.key JOIN u ON u.key = m.key LEFT JOIN e ON e.key = m.key
"""
