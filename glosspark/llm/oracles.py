"""DuckDB SQL for the queries that SQL can express."""

_BLANKS = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {
    "op5_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op7_benchmark_decontamination": r"""
WITH f AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s
      FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT m FROM p),
d AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM f, l WHERE len(w) >= m)),
h AS (SELECT d.doc_id, d.m, d.i, p.item_id FROM d JOIN p ON d.m = p.m AND d.s = p.s),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY 1)
SELECT f.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM f LEFT JOIN n ON f.doc_id = n.doc_id LEFT JOIN t ON f.doc_id = t.doc_id""",
    "op9_block_anchor_dedup": rf"""
WITH f AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANKS}') AS w FROM documents),
s AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM f WHERE len(w) >= 20)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM s WHERE k > 1),
u AS (SELECT doc_id, w[i] AS x, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM f)),
k AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.i = g.i GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT f.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM f LEFT JOIN k ON f.doc_id = k.doc_id LEFT JOIN c ON f.doc_id = c.doc_id""",
    "op10_mix_sources": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_BLANKS}'))::BIGINT AS size,
                  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, chr(0)) || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap,
             (sum(source_size) OVER ())::DOUBLE AS tot FROM s),
l AS (SELECT *, (1.5::DOUBLE * tot - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, least(cap, max(lev) OVER () * w) AS target FROM l),
u AS (SELECT d.*, source_size, target, floor(target)::BIGINT AS b, (sum(size) OVER (PARTITION BY d.source ORDER BY key))::BIGINT AS upto,
             (sum(size) OVER (PARTITION BY d.source, key))::BIGINT AS tied FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE (b // source_size) * size +
       CASE WHEN upto <= b % source_size THEN size WHEN upto - tied < b % source_size THEN size * (b % source_size - (upto - tied)) // tied ELSE 0 END END::BIGINT AS taken
FROM u""",
    "op11_spelling_variants": r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]), lambda c, k:
                CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS crc),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
o AS (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= 6 GROUP BY ALL),
b AS (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || w AS s FROM o),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hex(encode(s))) // 2 + 1), lambda i: ('0x' || substr(hex(encode(s)), 2 * i - 1, 2))::BIGINT)),
             lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM b, t),
c AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
d AS MATERIALIZED (SELECT DISTINCT word, n, i, left(word, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
      UNION SELECT d.word, d.n, v.word, v.n FROM d JOIN v ON d.less = v.word UNION SELECT v.word, v.n, d.word, d.n FROM d JOIN v ON d.less = v.word),
k AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM p GROUP BY 1),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END::BIGINT AS form_n FROM v LEFT JOIN k ON v.word = k.word),
w AS (SELECT word, word AS root FROM f UNION SELECT w.word, f.form FROM w JOIN f ON w.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM f JOIN w ON f.word = w.word JOIN f e ON w.root = e.word WHERE e.form IS NULL""",
    "op12_ngram_jaccard_join": rf"""
WITH RECURSIVE f AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANKS}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM f WHERE len(w) > 0)),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n, sum(hash(s))::VARCHAR || ' ' || bit_xor(hash(s, 1))::VARCHAR AS g FROM s GROUP BY 1),
r AS MATERIALIZED (SELECT g, min(doc_id) AS a, any_value(n) AS n FROM c GROUP BY 1),
z AS (SELECT r.a, r.n, s.s FROM r JOIN s ON r.a = s.doc_id),
l AS MATERIALIZED (SELECT x.a, y.a AS b FROM z x JOIN z y ON x.s = y.s AND x.a < y.a AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
      GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
t AS (SELECT a, a AS b FROM r UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
m AS (SELECT a, min(b) AS low FROM t GROUP BY 1)
SELECT f.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(m.low, f.doc_id) AS component_id
FROM f LEFT JOIN c ON f.doc_id = c.doc_id LEFT JOIN r ON c.g = r.g LEFT JOIN m ON r.a = m.a""",
    "op13_phrase_collocations": r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS p FROM d)),
g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS x, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, k, x, f, string_split(x, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
u AS (SELECT lang, x, f, w, unnest(range(1, k)) AS j, k FROM c),
s AS (SELECT u.lang, u.x, u.f AS a, j, l.f AS l, r.f AS r, (1000000::HUGEINT * u.f * u.f) // (l.f::HUGEINT * r.f) AS score FROM u
      JOIN g l ON l.lang = u.lang AND l.k = j AND l.x = array_to_string(w[1:j], ' ') JOIN g r ON r.lang = u.lang AND r.k = u.k - j AND r.x = array_to_string(w[j + 1:], ' ')),
q AS (SELECT *, row_number() OVER (PARTITION BY lang, x ORDER BY score, j) AS rk FROM s),
o AS (SELECT lang, array_to_string(w[1:2], ' ') AS x, f FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM c WHERE k = 3),
m AS (SELECT lang, x, max(f) AS f FROM o GROUP BY ALL),
y AS (SELECT q.*, row_number() OVER (PARTITION BY q.lang ORDER BY score DESC, a DESC, q.x) AS rank FROM q LEFT JOIN m ON q.lang = m.lang AND q.x = m.x WHERE rk = 1 AND (m.f IS NULL OR 100 * m.f < 50 * a))
SELECT y.lang, rank::BIGINT AS rank, x AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n, score::BIGINT AS score FROM y JOIN n ON y.lang = n.lang WHERE rank <= 2000""",
}
