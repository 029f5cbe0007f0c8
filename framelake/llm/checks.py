"""SQL with the same rows as the queries that SQL can express."""

SOURCE_MIXING = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
placed AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid,
    CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM per),
weighted AS (SELECT *, [3e0, 1e0, 2e0][sid % 3 + 1] AS weight FROM placed),
levelled AS (SELECT *, (1.5e0 * total - 2e0 * coalesce(CAST(sum(source_size) OVER (ORDER BY 2e0 * source_size / weight, sid
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0e0))
    / sum(weight) OVER (ORDER BY 2e0 * source_size / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
filled AS (SELECT *, level >= 2e0 * source_size / weight AS is_full FROM levelled),
targeted AS (SELECT *, CASE WHEN is_full THEN 2e0 * source_size
      ELSE weight * max(CASE WHEN NOT is_full THEN level END) OVER () END AS target,
    CAST(least(1024, greatest(1, ceil(1.5e0 * total / 262144e0))) AS BIGINT) AS block FROM filled),
cut AS (SELECT *, CAST(sum(CAST(floor(target * 1024e0) AS BIGINT)) OVER (ORDER BY sid) AS BIGINT) AS e,
    CAST(floor(target * 1024e0) AS BIGINT) AS u FROM targeted),
own AS (SELECT *, (e + 1023) // 1024 - (e - u + 1023) // 1024 AS words FROM cut),
lim AS MATERIALIZED (SELECT *, CAST(sum((words + block - 1) // block) OVER (ORDER BY sid) AS BIGINT) AS end_slot, (words + block - 1) // block AS n FROM own),
bits AS (SELECT greatest(1, length(bin(max(end_slot) - 1))) AS b FROM lim WHERE end_slot > 0),
point AS (SELECT sid, unnest(range(end_slot - n, end_slot)) AS p FROM lim),
slots AS MATERIALIZED (SELECT sid, slot, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS k FROM (
  SELECT sid, list_sum(list_transform(range(b), lambda i: ((p >> CAST(i AS BIGINT)) & 1) << CAST(b - 1 - i AS BIGINT))) AS slot FROM point, bits)),
laid AS MATERIALIZED (SELECT row_number() OVER () AS r, d.doc_id, d.size, l.sid, l.source_size, l.target, l.words, l.block,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS b
  FROM d JOIN lim l ON d.source IS NOT DISTINCT FROM l.source),
piece AS (SELECT r, sid, block, words, size, b + source_size * ep AS f, unnest(range((b + source_size * ep) // block, (least(b + source_size * ep + size, words) - 1) // block + 1)) AS k
  FROM laid, (VALUES (0), (1)) e(ep) WHERE size > 0 AND b + source_size * ep < words),
got AS (SELECT r, CAST(sum(least(f + size, words, (k + 1) * block) - greatest(f, k * block)) AS BIGINT) AS taken, min(slot) AS first_slot, count(*) AS pieces
  FROM piece JOIN slots USING (sid, k) GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, CAST(first_slot AS BIGINT) AS first_slot, coalesce(pieces, 0) AS pieces
FROM laid LEFT JOIN got USING (r)"""

URL_FILTER = r"""
WITH p AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(verdict, h, pre, list_no) AS (
  SELECT * FROM (VALUES ('allow', 'com', '/', 0), ('block', 'example.com', '/en/', 0), ('allow', 'www.example.com', '/en/', 0),
    ('block', 'net', '/es/', 0), ('block', 'net', '/fr/', 0))
  UNION ALL SELECT 'block', n || '.example.' || t, '', 1
  FROM unnest(['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) a(n), unnest(['com', 'net', 'org']) b(t)),
fits AS (SELECT p.page_id, r.*, row_number() OVER (PARTITION BY p.page_id ORDER BY r.list_no, length(r.h || r.pre) DESC) AS n
  FROM p JOIN rules r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.pre))
SELECT p.page_id, p.host, p.path, CASE WHEN f.list_no = 0 THEN f.h || f.pre END AS rule, coalesce(f.verdict, 'allow') AS verdict
FROM p LEFT JOIN fits f ON f.page_id = p.page_id AND f.n = 1"""

EXACT_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64e0 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

IMPORTANCE_RESAMPLING = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
u AS MATERIALIZED (SELECT r, unnest(w) AS f FROM d),
crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
v AS (SELECT f, list_transform(range(len(hex(f)) // 2), lambda i: CAST('0x' || substr(hex(f), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS bytes
  FROM (SELECT f FROM u UNION SELECT f FROM b)),
k AS MATERIALIZED (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, bytes),
    lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) % 10000 AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS s FROM u JOIN k USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000e0 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM s) + 10000 AS DOUBLE)
    / (CAST(s + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM u JOIN k USING (f) JOIN g USING (bucket) GROUP BY r),
e AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000e0 * ln(-ln(
    (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (r)),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS place, count(*) OVER () AS n
  FROM e WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM o
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM e WHERE n_features < 20"""

FILTER_AUDIT = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
h AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, mask),
f(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
  FROM (SELECT *, unnest(range(1, 6)) AS step FROM o))
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN mask & bit <> 0 THEN n * 120 // bit_count(mask) ELSE 0 END) AS BIGINT) AS shapley
FROM h, s GROUP BY part, filter_order, step"""
