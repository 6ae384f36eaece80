"""DuckDB SQL for the queries that SQL can express."""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP2 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM v a JOIN v b ON a.label = b.label AND a.usable AND b.usable AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
class AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, component_id,
       component_id = v.vec_id AS kept
FROM v JOIN class ON class.a = v.vec_id
"""

OP4 = f"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(rule_host, rule_path, action) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(action, length(rule_host || rule_path)) AS action
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id),
j AS (SELECT u.*, rule, action FROM u LEFT JOIN m USING (page_id))
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN host IN (SELECT host FROM j WHERE action = 'block') THEN 'block' ELSE 'allow' END) AS verdict
FROM j
"""

# The checksum table and loop are those of the common 32-bit CRC; the generator is that of jump hashing.
OP6 = """
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) g(i))),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (
  SELECT doc_id, size,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(size - 1),
        lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM d, t),
jump(doc_id, n, k, b, j) AS (
  SELECT doc_id, n, doc_id::HUGEINT, -1::BIGINT, 0::BIGINT FROM documents, (VALUES (8), (9)) s(n)
  UNION ALL
  SELECT doc_id, n, k2, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, ((k % 4294967296) * 2862933555777941757
                   + ((k // 4294967296) * (2862933555777941757 % 4294967296) % 4294967296) * 4294967296 + 1)
                  % 18446744073709551616::HUGEINT AS k2
        FROM jump WHERE j < n)),
s AS (
  SELECT doc_id, max(b) FILTER (n = 8)::INT AS shard, max(b) FILTER (n = 9)::INT AS grown_shard
  FROM jump WHERE j >= n GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS slot, grown_shard
FROM crc JOIN s USING (doc_id)
"""

OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

OP9 = f"""
WITH l AS (
  SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{UPPER}', '{UPPER.lower()}') AS key
  FROM l),
f AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (
  SELECT k.*, f.first_doc IS NOT NULL AND k.doc_id <> f.first_doc AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP12 = f"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
g AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM tf, g GROUP BY term),
m AS (SELECT doc_id, 75 + (25 * n * n_docs) // n_terms AS m FROM n, g),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term
  FROM benchmark),
q AS (SELECT item_id, term, count(*) AS qtf FROM i GROUP BY ALL),
s AS (
  SELECT item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""

OP13 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first_page FROM h GROUP BY hex)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (('0x' || substr(hex || '0', 1 + (5 * i) // 4, 2))::INT >> (3 - (5 * i) % 4)::INT) % 32, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM h JOIN f USING (hex)
"""

ORACLES = {
    "op2_near_vectors": OP2,
    "op4_url_filter": OP4,
    "op6_sharding": OP6,
    "op8_top_k": OP8,
    "op9_line_dedup": OP9,
    "op12_lexical_search": OP12,
    "op13_warc": OP13,
}
