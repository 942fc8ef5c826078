"""DuckDB SQL for the queries of this subpackage that SQL can state on whole tables."""

OP3 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d
  FROM pages),
g AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 1000
"""

OP4 = r"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (
  SELECT page_id, arg_max({'rule': h || p, 'verdict': v}, length(h || p)) AS best
  FROM u JOIN r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)
  GROUP BY page_id)
SELECT u.page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM u LEFT JOIN f USING (page_id)
"""

OP7 = r"""
WITH c AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn, role, text) AS turns
  FROM conversations GROUP BY conv_id),
k AS (
  SELECT conv_id, turns[1:list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant'))] AS chosen,
    list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS n
  FROM c),
p AS (
  SELECT a.conv_id,
    CASE WHEN a.n IS NULL THEN [] ELSE a.chosen END AS x,
    CASE WHEN a.n IS NULL OR b.n IS NULL THEN [] ELSE list_concat(a.chosen[1:a.n - 1], [b.chosen[b.n]]) END AS y
  FROM k a LEFT JOIN k b ON b.conv_id = xor(a.conv_id, 1)),
q AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(x), len(y)) + 1),
    lambda i: x[i].role <> y[i].role OR x[i].text <> y[i].text)) - 1, least(len(x), len(y))) AS n FROM p),
w AS (SELECT conv_id, n, x[1:n] AS a, x[n + 1:len(x)] AS b, y[n + 1:len(y)] AS d FROM q),
s AS (
  SELECT conv_id, n,
    list_transform(a, lambda t: '<|' || replace(t.role, '<|', '< |') || '|>' || chr(10) || replace(t.text, '<|', '< |') || '<|end|>' || chr(10)) AS sa,
    list_transform(b, lambda t: {'h': '<|' || replace(t.role, '<|', '< |') || '|>' || chr(10), 'b': replace(t.text, '<|', '< |') || '<|end|>', 'm': t.role = 'assistant'}) AS sb,
    list_transform(d, lambda t: {'h': '<|' || replace(t.role, '<|', '< |') || '|>' || chr(10), 'b': replace(t.text, '<|', '< |') || '<|end|>', 'm': t.role = 'assistant'}) AS sd
  FROM w)
SELECT conv_id, n AS prompt_turns, coalesce(array_to_string(sa, ''), '') AS prompt,
  coalesce(array_to_string(list_transform(sb, lambda t: t.h || t.b || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(sd, lambda t: t.h || t.b || chr(10)), ''), '') AS rejected,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(sb) + 1), lambda i: sb[i].m), lambda i:
    (coalesce(list_sum(list_transform(sb[1:i - 1], lambda t: length(t.h) + length(t.b) + 1)), 0) + length(sb[i].h))::BIGINT::VARCHAR || '-' ||
    (coalesce(list_sum(list_transform(sb[1:i - 1], lambda t: length(t.h) + length(t.b) + 1)), 0) + length(sb[i].h) + length(sb[i].b))::BIGINT::VARCHAR), ','), '') AS chosen_mask,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(sd) + 1), lambda i: sd[i].m), lambda i:
    (coalesce(list_sum(list_transform(sd[1:i - 1], lambda t: length(t.h) + length(t.b) + 1)), 0) + length(sd[i].h))::BIGINT::VARCHAR || '-' ||
    (coalesce(list_sum(list_transform(sd[1:i - 1], lambda t: length(t.h) + length(t.b) + 1)), 0) + length(sd[i].h) + length(sd[i].b))::BIGINT::VARCHAR), ','), '') AS rejected_mask
FROM s
"""

OP11 = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS MATERIALIZED (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS MATERIALIZED (
  SELECT r, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
s AS (
  SELECT r, count(f.key) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL) AS kept
  FROM k LEFT JOIN f ON k.key = f.key GROUP BY r)
SELECT doc_id, len(lines) AS n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM d JOIN s USING (r)
"""

OP12 = """
WITH o AS MATERIALIZED (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
h AS MATERIALIZED (
  SELECT c, c - c % 100 AS base, xor(list_reduce(flatten(list_transform(string_split(c::VARCHAR, ''),
      lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda v, x: CASE WHEN x >= 0 THEN xor(v, x) WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, 4294967295::BIGINT),
    4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT c FROM o)),
t AS MATERIALIZED (
  SELECT h.c, 0 AS own, o.p, {'role': role, 'text': text} AS turn FROM h JOIN o ON o.c = h.base AND o.p <= h.h
  UNION ALL SELECT h.c, 1, o.p, {'role': role, 'text': text} FROM h JOIN o ON o.c = h.c AND o.p > h.h),
s AS MATERIALIZED (
  SELECT h.c, coalesce(list(turn ORDER BY own, p) FILTER (WHERE turn IS NOT NULL), []) AS turns FROM h LEFT JOIN t ON t.c = h.c GROUP BY h.c),
m AS MATERIALIZED (SELECT c, d, list_slice(turns, 1, d) AS path, len(turns) = d AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM s)),
n AS MATERIALIZED (
  SELECT d, path, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY d, path),
k AS MATERIALIZED (SELECT d - 1 AS d, list_slice(path, 1, d - 1) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
e AS MATERIALIZED (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * length(n.path[n.d].text) END AS saved
  FROM n LEFT JOIN k ON k.d = n.d AND k.path = n.path),
b AS MATERIALIZED (
  SELECT a AS d, list_slice(path, 1, a) AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM e) GROUP BY ALL)
SELECT e.conv_id, e.d AS depth, up.conv_id AS parent_conv_id, e.n_convs, e.n_children, n_leaves, saved_tokens, e.ends_sha256
FROM e JOIN b ON b.d = e.d AND b.path = e.path LEFT JOIN n up ON up.d = e.d - 1 AND up.path = list_slice(e.path, 1, e.d - 1) AND e.d > 0
"""

OP13 = """
WITH q AS MATERIALIZED (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM q a JOIN q r ON a.id % 100 = 0 AND a.id <> r.id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 10
"""

ORACLES: dict[str, str] = {
    "op3_warc": OP3,
    "op4_urls": OP4,
    "op7_chat": OP7,
    "op11_line_dedup": OP11,
    "op12_prefix_trie": OP12,
    "op13_hard_negatives": OP13,
}
