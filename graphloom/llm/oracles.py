"""The corpus queries in SQL, where SQL can say what they return."""

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

# five hex digits are twenty bits, which are four letters of base32
OP3 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i:
        substr('{_ALPHABET}', 1 + ((CAST('0x' || substr(s, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS digest,
      min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d
"""

OP5 = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings),
h AS (SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id,
        CAST(len(list_filter(range(1, 65), lambda i: q.bits[i] <> n.bits[i])) AS INTEGER) AS hamming
      FROM c q JOIN c n ON q.vec_id <> n.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hamming, neighbor_id) AS INTEGER) AS rank FROM h)
SELECT query_id, rank, neighbor_id, hamming FROM r WHERE rank <= 10
"""

OP6 = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT *, len(w) AS n, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS tri FROM w),
u AS (SELECT doc_id, source, text, tri, unnest(tri) AS x, unnest(range(1, len(w) - 1)) AS i FROM g WHERE len(w) >= 3),
k AS (SELECT doc_id, source, text, i, count(*) OVER (PARTITION BY doc_id, source, text, x) AS times FROM u),
c AS (SELECT doc_id, source, text, count(DISTINCT i + o) AS covered FROM k, (VALUES (0), (1), (2)) v(o) WHERE times > 1 GROUP BY 1, 2, 3),
f AS (SELECT g.doc_id, g.source, CAST(n AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(g.text) - length(regexp_replace(g.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words
      FROM g LEFT JOIN c ON g.doc_id IS NOT DISTINCT FROM c.doc_id AND g.source IS NOT DISTINCT FROM c.source AND g.text = c.text),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS nd, count(*) FILTER (WHERE base_failed) AS nf FROM b WHERE source IS NOT NULL GROUP BY 1),
p AS (SELECT avg(nf / nd) AS mean, coalesce(var_samp(nf / nd), 0) AS var, avg(1 / nd) AS inv, avg(nd) AS size FROM h),
s AS (SELECT mean, greatest(1.0, CASE WHEN var - mean * (1 - mean) * inv > 0 THEN mean * (1 - mean) / (var - mean * (1 - mean) * inv) - 1 ELSE size END) AS strength FROM p),
bad AS (SELECT source FROM h, s WHERE (nf + mean * strength) / (nd + strength) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM b
"""

# bytes covered by windows that occur twice are what is left by neither gap nor first window
OP4 = """
WITH t AS (SELECT row_number() OVER () AS id, doc_id, encode(coalesce(text, '')) AS raw FROM documents),
n AS (SELECT *, octet_length(raw) AS n FROM t),
w AS (SELECT id, n, unnest(range(1, n - 398)) AS i, hex(raw) AS hx FROM n WHERE n >= 400),
k AS (SELECT id, i, md5(substr(hx, CAST(2 * i - 1 AS INTEGER), 800)) AS m FROM w),
d AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY m) AS c FROM k) WHERE c > 1),
e AS (SELECT id, i, i > 400 + lag(i) OVER (PARTITION BY id ORDER BY i) OR lag(i) OVER (PARTITION BY id ORDER BY i) IS NULL AS fresh FROM d),
s AS (SELECT id, i, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS run FROM e),
r AS (SELECT id, run, min(i) AS a, max(i) + 399 AS b FROM s GROUP BY 1, 2),
g AS (SELECT id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a + 1) AS gone, count(*) AS spans FROM r GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN a IS NULL THEN raw ELSE unhex(array_to_string(list_transform(range(0, len(a) + 1), lambda j:
         substr(hex(raw), CAST(CASE WHEN j = 0 THEN 1 ELSE 2 * b[j] + 1 END AS INTEGER), CAST(CASE WHEN j = len(a) THEN 2 * n ELSE 2 * (a[j + 1] - 1) END - CASE WHEN j = 0 THEN 0 ELSE 2 * b[j] END AS INTEGER))), '')) END) AS kept_sha256
FROM n LEFT JOIN g ON n.id = g.id
"""

SQL = {"op3_warc": OP3, "op4_run_index": OP4, "op5_multi_index": OP5, "op6_host_rules": OP6}
