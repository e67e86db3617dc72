"""DuckDB SQL that states the results of operators which SQL can express."""

from __future__ import annotations

# Rows are read as turns of a conversation in order; escaping doubles backslashes and breaks up "<|".
CHAT = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS escaped, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) AS named FROM r),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(12 + named + 1 + escaped + 10 + 1)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

# Links by shared shingles; components by walking links from every document.
NGRAM = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [hash(array_to_string(w, ' '))]
        ELSE list_transform(range(1, len(w) - 1), lambda i: hash(array_to_string(w[i:i + 2], ' '))) END) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
c AS (SELECT doc_id AS root, doc_id FROM documents UNION SELECT c.root, l.b FROM c JOIN l ON l.a = c.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c.doc_id) FROM c WHERE c.root = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""

# All pairs of vectors by cosine in double precision.
VECTORS = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v
      WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(e, lambda y: y * y)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.u, b.u) >= 0.95),
c AS (SELECT vec_id AS root, vec_id FROM embeddings UNION SELECT c.root, l.b FROM c JOIN l ON l.a = c.vec_id),
m AS (SELECT root, min(vec_id) AS component_id FROM c GROUP BY root), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN m ON m.root = e.vec_id LEFT JOIN k ON k.a = e.vec_id"""

# Groups of texts that are equal once white space is normalised.
COPIES = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM t"""

# Integer k-means of four parts: c0 is the first codebook, each round an assignment and floored means.
_ASSIGNED = """
a{k} AS MATERIALIZED (
  SELECT p.vec_id, p.label, p.part, p.v, arg_min(c.k, (c.v2 + p.v2 - 2 * list_dot_product(p.v, c.v)) * 256 + c.k) AS k,
         min(c.v2 + p.v2 - 2 * list_dot_product(p.v, c.v)) AS d
  FROM p JOIN c{k} c ON c.part = p.part GROUP BY ALL)"""
_MOVED = """
m{k} AS (SELECT part, k, j, floor(sum(x) / count(*)) AS x FROM (SELECT part, k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{k}) GROUP BY ALL),
c{n} AS MATERIALIZED (
  SELECT *, list_dot_product(v, v) AS v2 FROM (
    SELECT c.part, c.k, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT part, k, list(x ORDER BY j) AS v FROM m{k} GROUP BY ALL) m ON m.part = c.part AND m.k = c.k))"""
CODES = (
    """
WITH f AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (
  SELECT *, list_dot_product(v, v) AS v2 FROM (
    SELECT vec_id, label, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS v FROM f, (SELECT unnest(range(4)) AS part))),
c0 AS MATERIALIZED (SELECT part, k, v, v2 FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k FROM p) WHERE k < 256),"""
    + ",".join(_ASSIGNED.format(k=k) + "," + _MOVED.format(k=k, n=k + 1) for k in range(4))
    + ","
    + _ASSIGNED.format(k=4)
    + """,
g AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY ALL),
s AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT), ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM g, s"""
)

# Rebuilt conversations, a digest of each prefix, and sums over the prefixes of each node's smallest member.
TRIE = r"""
WITH r AS (SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(sha256(strlen(role) || ':' || role || text), 32)) AS pos
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
k AS (SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, n: xor(a >> 1, 3988292384 * (a & 1))))) % 9 AS h FROM (SELECT DISTINCT c FROM r)),
b AS (SELECT k.c, r.pos, r.role, r.text FROM k JOIN r ON r.c = k.c - k.c % 5 AND r.pos <= h UNION ALL SELECT k.c, r.pos, r.role, r.text FROM k JOIN r ON r.c = k.c AND r.pos > h),
q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, sha256(strlen(role) || ':' || role || text) AS t, strlen(text) AS size FROM b),
p AS MATERIALIZED (SELECT c, d, sha256(string_agg(t, '') OVER (PARTITION BY c ORDER BY d)) AS f, size FROM q UNION ALL SELECT c, 0, 'root', 0 FROM k),
u AS (SELECT *, lag(f) OVER (PARTITION BY c ORDER BY d) AS above, d = max(d) OVER (PARTITION BY c) AS is_end FROM p),
n AS MATERIALIZED (
  SELECT d, f, any_value(above) AS above, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (is_end), '')) AS ends FROM u GROUP BY d, f),
m AS (SELECT above, count(*) AS n_children FROM n GROUP BY above),
s AS (SELECT a.d, a.f, count(*) FILTER (m.above IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved FROM n JOIN p a ON a.c = n.conv_id AND a.d <= n.d LEFT JOIN m ON m.above = n.f GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(m.n_children, 0) AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN s ON s.f = n.f AND s.d = n.d LEFT JOIN m ON m.above = n.f LEFT JOIN n o ON o.f = n.above AND o.d = n.d - 1"""
