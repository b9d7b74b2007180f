"""SQL twins of the queries, each written from the contract of its result."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY_RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), runs AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), twice AS (
  SELECT r, i FROM runs QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1
), covered AS (
  SELECT r, count(DISTINCT i + s) AS n FROM twice, (VALUES (0), (1), (2)) AS v(s) GROUP BY r
), m AS (
  SELECT w.r, doc_id, host, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (
  SELECT host, count(*)::BIGINT AS host_docs, sum(base_failed::INT)::BIGINT AS host_failures FROM f GROUP BY host
), x AS (
  SELECT *, host_docs::DOUBLE AS n, host_failures::DOUBLE AS k FROM h
), s AS (
  SELECT sum(k) / sum(n) AS pooled, count(*) FILTER (host_docs > 1) AS hosts,
    (sum(round(k / n * 1e9)::BIGINT) FILTER (host_docs > 1))::BIGINT / 1e9 / hosts AS mean,
    (sum(round(k / n * ((k - 1) / (n - 1)) * 1e9)::BIGINT) FILTER (host_docs > 1))::BIGINT / 1e9 / hosts AS square
  FROM x
), p AS (
  SELECT *, hosts > 0 AND square - mean * mean > 0 AND mean - square > 0 AS varied,
    (mean - square) / nullif(square - mean * mean, 0) AS strength FROM s
), v AS (
  SELECT host, host_docs, host_failures, round(CASE WHEN varied
      THEN (k + mean * strength) / (n + mean * strength + (1 - mean) * strength) ELSE pooled END, 6) AS host_rate
  FROM x, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_docs, host_failures,
  host_rate, host_rate < 0.5 AS host_kept, NOT base_failed AND host_rate < 0.5 AS kept
FROM f JOIN v USING (host)
"""

DECONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, w, least(len(w), 10) AS m
  FROM (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), items AS (
  SELECT DISTINCT m, item_id, w[i:i + m - 1] AS x FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM b)
), windows AS (
  SELECT r, i, m, w[i:i + m - 1] AS x
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM b))
), hits AS (
  SELECT r, i, m, item_id FROM windows JOIN items USING (m, x)
), covered AS (
  SELECT r, count(DISTINCT p)::BIGINT AS n_hit
  FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM hits)) GROUP BY r
), named AS (
  SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)
  UNION ALL SELECT doc_id, w[1], NULL FROM d WHERE len(w) = 1
), n AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i
  FROM s x JOIN s y ON x.a = y.a AND x.b IS NOT DISTINCT FROM y.b AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM edges
  UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.other = edges.a
), low AS (
  SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(low.other, d.doc_id) AS component_id,
  d.doc_id = coalesce(low.other, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""

ARCHIVES = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> head THEN head END AS refers_to
FROM f
"""

# crc32 byte by byte, from a table made by its rule
SPELLING = r"""
WITH RECURSIVE remainders AS (
  SELECT list(r ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)::BIGINT[]),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS r
    FROM (SELECT unnest(range(256))::BIGINT AS i))
), runs AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) GROUP BY ALL
), coded AS (
  SELECT w, n, hex(coalesce(doc_id::VARCHAR, '') || ':' || w) AS x FROM runs
), bytes AS (
  SELECT w, n, list_transform(range(1, length(x), 2),
    lambda i: (instr('0123456789ABCDEF', substr(x, i, 1)) * 16 + instr('0123456789ABCDEF', substr(x, i + 1, 1)) - 17)::BIGINT) AS b
  FROM coded
), hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
    lambda c, k: xor(c // 256, t[xor(c % 256, k) + 1])), 4294967295) AS h FROM bytes, remainders
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n
    FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cuts AS (
  SELECT DISTINCT word, p, substr(word, 1, p) AS a, substr(word, p + 2) AS z
  FROM (SELECT word, unnest(range(length(word))) AS p FROM words)
), near AS (
  SELECT x.word, y.word AS near FROM cuts x JOIN cuts y USING (p, a, z) WHERE x.word <> y.word
  UNION SELECT cuts.word, words.word FROM cuts JOIN words ON words.word = a || z
  UNION SELECT words.word, cuts.word FROM cuts JOIN words ON words.word = a || z
), ranked AS (
  SELECT near.word, near, words.n AS m, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY words.n DESC, near) AS place
  FROM near JOIN words ON words.word = near
), formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN m >= 2 * words.n THEN near END AS form, CASE WHEN m >= 2 * words.n THEN m END AS form_n
  FROM words LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r USING (word)
), chain AS (
  SELECT word, form AS root FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NOT NULL
), lasts AS (
  SELECT chain.word, root FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NULL
)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN lasts USING (word)
"""
