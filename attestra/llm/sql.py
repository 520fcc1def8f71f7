"""DuckDB SQL for the queries that SQL can express on small tables: all pairs and all windows, plainly.

Operators 1, 2, 5 and 10 need models or tokenizers, and operator 3 adds spans of its own; tests hold them otherwise.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_COMPONENTS = """pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), near(a, b) AS (SELECT a, b FROM pairs UNION SELECT near.a, pairs.b FROM near JOIN pairs ON near.b = pairs.a),
root AS (SELECT a, least(a, min(b)) AS component FROM near GROUP BY a)"""

NEAR_DUPLICATES = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(greatest(len(ws) - 4, 1)), lambda i: array_to_string(ws[i + 1 : i + 5], ' '))) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s), c AS (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS n FROM u p JOIN u q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c WHERE 100 * n >= 85 * (na + nb - n)), {_COMPONENTS}
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(component, s.doc_id) AS component_id, coalesce(component, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN root ON root.a = s.doc_id"""

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND p.n > 0 AND q.n > 0 AND list_dot_product(p.e, q.e) / (p.n * q.n) >= 0.9), {_COMPONENTS},
d AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN d ON d.a = vec_id LEFT JOIN root ON root.a = vec_id"""

REPEATED_WORDS = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 20], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 19, 0))) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
x AS (SELECT DISTINCT doc_id, i + j AS i FROM r, unnest(range(20)) t(j)), p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w),
k AS (SELECT p.doc_id, count(x.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.i) FILTER (x.i IS NULL), '') AS kept FROM p LEFT JOIN x ON x.doc_id = p.doc_id AND x.i = p.i GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""

_BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BENCHMARK = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_BENCH_WORD}') AS ws FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, '{_BENCH_WORD}') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, k, array_to_string(ws[i + 1 : i + k], ' ') AS gram FROM (SELECT item, ws, least(len(ws), 13) AS k, unnest(range(len(ws) - least(len(ws), 13) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i + 1 : i + k], ' ') AS gram FROM (SELECT doc_id, ws, k, unnest(range(greatest(len(ws) - k + 1, 0))) AS i FROM d, (SELECT DISTINCT k FROM bw))),
m AS (SELECT doc_id, i, dw.k, item FROM dw JOIN bw USING (k, gram)), h AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM m, unnest(range(13)) t(j) WHERE j < k GROUP BY 1),
n AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)"""

REPEATED_BYTES = """WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, i, sha256(array_slice(b, i + 1, i + 400)) AS gram FROM (SELECT doc_id, b, unnest(range(greatest(octet_length(b) - 399, 0))) AS i FROM t)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY gram) AS n FROM g) WHERE n > 1),
e AS (SELECT doc_id, i, CASE WHEN lag(i) OVER w IS NULL OR lag(i) OVER w + 400 < i THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e) GROUP BY doc_id, k),
o AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS after FROM s),
k AS (SELECT o.doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(hex(array_slice(b, before + 1, lo)) || CASE WHEN after IS NULL THEN hex(array_slice(b, hi + 1, octet_length(b))) ELSE '' END, '' ORDER BY lo) AS kept FROM o JOIN t ON t.doc_id = o.doc_id GROUP BY 1)
SELECT t.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN k.doc_id IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256 FROM t LEFT JOIN k ON k.doc_id = t.doc_id"""

EXACT = r"""WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id NULLS LAST) AS keep_id FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g USING (norm)"""


def _rounds(n: int) -> str:
    """Assignments a0..an to the centroids c0..cn."""
    out = []
    for k in range(n + 1):
        if k:
            out.append(f"""s{k} AS MATERIALIZED (SELECT num, list(f ORDER BY i) AS c FROM (SELECT num, i, (s - ((s % n) + n) % n) // n AS f FROM (SELECT a.num, i, sum(v.q[i])::HUGEINT AS s, count(*) AS n FROM a{k - 1} a JOIN v USING (r), range(1, 65) t(i) GROUP BY 1, 2)) GROUP BY num),
c{k} AS MATERIALIZED (SELECT c.num, CAST(coalesce(s.c, c.c) AS BIGINT[]) AS c FROM c{k - 1} c LEFT JOIN s{k} s USING (num))""")
        out.append(f"a{k} AS MATERIALIZED (SELECT r, min(ROW(d, num)) AS best, min(ROW(d, num))[2] AS num, min(ROW(d, num))[1] AS d FROM (SELECT v.r, c.num, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.c[i]) * (v.q[i] - c.c[i]))) AS BIGINT) AS d FROM v, c{k} c) GROUP BY r)")
    return ",\n".join(out)


CLUSTERS = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding::DOUBLE[], lambda x: CAST(floor(x * 256) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS num, q AS c FROM (SELECT q, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT 40)),
{_rounds(5)},
p AS (SELECT num, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a5 GROUP BY num)
SELECT vec_id, a.num AS cluster, a.d AS distance, cluster_inertia, CAST((SELECT sum(d) FROM a5) AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a5 a JOIN v USING (r) JOIN p USING (num) JOIN c5 c USING (num)"""

_CRC32 = """CAST(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({}, ''), lambda ch: ascii(ch)::UBIGINT)), lambda x, y: list_reduce(list_prepend(xor(x, y), list_transform(range(8), lambda b: 0::UBIGINT)), lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384::UBIGINT) ELSE p >> 1 END)) AS UBIGINT)"""
#: Row by row with the least (cost, audit) of each state: n nothing yet, s, u and a after such a turn; up to two turns put in before a row and at the end.
CONVERSATIONS = rf"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({_CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")}, 4294967295::UBIGINT) % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM d),
f AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, role[1] AS one, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth FROM o)),
put(put_from, put_to, roles, edits, price) AS (VALUES ('n', 'n', []::VARCHAR[], '', 0), ('s', 's', [], '', 0), ('u', 'u', [], '', 0), ('a', 'a', [], '', 0), ('n', 'u', ['user:'], 'I', 2), ('s', 'u', ['user:'], 'I', 2), ('a', 'u', ['user:'], 'I', 2), ('u', 'a', ['assistant:'], 'I', 2), ('n', 'a', ['user:', 'assistant:'], 'II', 4), ('s', 'a', ['user:', 'assistant:'], 'II', 4), ('u', 'u', ['assistant:', 'user:'], 'II', 4), ('a', 'a', ['user:', 'assistant:'], 'II', 4)),
step(step_from, step_to) AS (VALUES ('n', 's'), ('n', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
best AS (SELECT conv_id, 0::BIGINT AS pos, 'n' AS state, ROW(0, '', []::VARCHAR[]) AS m FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, pos, state, min(m) FROM (
    SELECT b.conv_id, f.pos, x.state, ROW(b.m[1] + price + x.cost, b.m[2] || edits || x.edit, list_concat(list_concat(b.m[3], roles), x.turn)) AS m
    FROM best b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.pos = b.pos + 1 JOIN put ON put_from = b.state,
    LATERAL (SELECT put_to AS state, 3 AS cost, 'D' AS edit, []::VARCHAR[] AS turn UNION ALL SELECT step_to, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END + CASE WHEN one = step_to THEN 0 ELSE 2 END, CASE WHEN one = step_to THEN 'K' ELSE 'R' END, [CASE WHEN one = step_to THEN role WHEN step_to = 'u' THEN 'user' ELSE 'assistant' END || ':' || text]
      FROM step WHERE step_from = put_to AND (one = step_to OR step_to <> 's') AND coalesce(fault, '') NOT IN ('blank', 'duplicate')) x) GROUP BY 1, 2, 3),
n AS (SELECT conv_id, max(pos) AS pos FROM best GROUP BY 1),
r AS (SELECT b.conv_id, min(ROW(m[1] + price, m[2] || edits, list_concat(m[3], roles))) AS m FROM best b JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.pos = b.pos JOIN put ON put_from = b.state WHERE put_to IN ('n', 'a') GROUP BY 1),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || one NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT r.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(m[1] AS BIGINT) AS cost, m[2] AS audit, sha256(array_to_string(m[3], chr(10))) AS repaired_sha256 FROM r LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM r.conv_id"""
