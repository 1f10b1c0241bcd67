"""What the queries return, in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP7 = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM documents),
windows AS MATERIALIZED (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM d, unnest(range(1, len(words) - 6)) AS t(i)),
covered AS (
  SELECT r, count(DISTINCT i + j) AS n FROM windows JOIN (
    SELECT r, win FROM windows GROUP BY r, win HAVING count(*) > 1) USING (r, win), range(8) AS u(j)
  GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS BIGINT) AS n_same_words,
         CAST(len(list_filter(words, lambda x: x LIKE '%!!' AND strlen(x) > 2)) AS BIGINT) AS n_shouted_words
  FROM d LEFT JOIN covered USING (r)),
b AS (
  SELECT *, CAST(CAST(n_words < 20 AS INT) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS INT)
         + 4 * CAST(10 * n_symbols > 4 * n_words AS INT) + 8 * CAST(2 * n_dup_lines > n_lines AS INT)
         + 16 * CAST(10 * n_same_words > 3 * n_words AS INT) + 32 * CAST(10 * n_shouted_words > 4 * n_words AS INT)
         + 64 * CAST(word_chars > 25 * n_words OR word_chars < 2 * n_words AS INT) AS BIGINT) AS failed_bits
  FROM m)
SELECT *, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept,
       (failed_bits & 3) = 0 AS passed_base, (failed_bits & 15) = 0 AS passed_v1, failed_bits = 0 AS passed_v2,
       CASE failed_bits WHEN 1 THEN 'too_few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines'
            WHEN 16 THEN 'word_runs' WHEN 32 THEN 'shouting' WHEN 64 THEN 'word_length' END AS only_rule,
       CASE WHEN failed_bits IN (1, 2, 4, 8, 16, 32, 64) THEN count(*) OVER (PARTITION BY failed_bits) END AS only_rule_documents
FROM b
"""

#: Smallest id that links (a, b), given both ways in ``ways``, reach from every ``doc`` of ``nodes``.
REACH = """
reach AS (
  SELECT doc AS id, doc AS c FROM nodes
  UNION SELECT ways.b, reach.c FROM reach JOIN ways ON ways.a = reach.id),
found AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)
"""

OP8 = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(words) = 1 THEN words[1] ELSE words[i] || ' ' || words[i + 1] END AS sh
  FROM d, unnest(range(1, greatest(len(words), least(len(words) + 1, 2)))) AS t(i)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
nodes AS (SELECT DISTINCT doc_id AS doc FROM documents),
{REACH}
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN found ON found.id = documents.doc_id
"""

OP2 = f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.r AS ra, b.r AS rb, a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
ways AS MATERIALIZED (SELECT DISTINCT a, b FROM links),
nodes AS (SELECT DISTINCT vec_id AS doc FROM embeddings),
{REACH},
n AS (SELECT ra, a AS vec_id, count(*) AS n FROM links GROUP BY ra, a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) JOIN found ON found.id = e.vec_id
"""

OP5 = """
WITH p AS MATERIALIZED (
  SELECT page_id, strlen(coalesce(html, '')) AS n, upper(sha1(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT h, n, min(page_id) AS first_page FROM p GROUP BY h, n)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) % 32 + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM p JOIN f USING (h, n)
"""

#: One round of clustering: every vector to the nearest centroid of ``c{k}``, then their means.
_NEAREST = """
a{k} AS MATERIALIZED (
  SELECT r, c, s FROM (
    SELECT p.r, c.c, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS s FROM p JOIN c{k} c USING (d) GROUP BY p.r, c.c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY s, c) = 1)"""
_MEANS = """
c{next} AS MATERIALIZED (
  SELECT c.c, c.d, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (
    SELECT c, d, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x
    FROM (SELECT a.c, p.d, CAST(sum(p.x) AS BIGINT) AS s, count(*) AS n FROM a{k} a JOIN p USING (r) GROUP BY a.c, p.d)) m USING (c, d))"""
_ROUNDS = ",".join(_NEAREST.format(k=k) + ("," + _MEANS.format(k=k, next=k + 1) if k < 3 else "") for k in range(4))

OP11 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT r, unnest(range(64)) AS d, unnest(v) AS x FROM v),
c0 AS MATERIALIZED (
  SELECT c, unnest(range(64)) AS d, unnest(v) AS x FROM (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM v QUALIFY c < 16)),
{_ROUNDS},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, s AS distance, CAST(sum(s) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(s) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN v USING (r) JOIN h USING (c)
"""

ORACLE = {
    "op2_embedding_dedup": OP2,
    "op5_warc": OP5,
    "op7_quality_rules": OP7,
    "op8_minhash": OP8,
    "op11_centroids": OP11,
}
