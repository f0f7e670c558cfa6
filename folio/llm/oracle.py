"""DuckDB SQL for the queries that SQL can express."""

OP3 = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p
), w AS (
  SELECT hex, max(page_id) AS winner FROM d GROUP BY hex
)
SELECT page_id,
       CAST(payload_bytes AS BIGINT) AS payload_bytes,
       (SELECT string_agg(
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(d.hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1), '' ORDER BY i)
        FROM range(32) r(i)) AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM winner THEN NULL ELSE winner END AS refers_to
FROM d JOIN w USING (hex)
"""

OP4 = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html,
         CASE WHEN instr(url, '://') > 0 THEN split_part(substr(url, instr(url, '://') + 3), '#', 1) ELSE '' END AS rest
  FROM pages
), named AS (
  SELECT page_id, url, html,
         translate(regexp_extract(coalesce(rest, ''), '^([^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?]*([^?]*)', 1) AS path
  FROM parts
), judged AS (
  SELECT page_id, url, html, host, path,
         CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM named
), links AS (
  SELECT DISTINCT split_part(url, '#', 1) AS a,
         split_part(regexp_extract(html, '<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1), '#', 1) AS b
  FROM judged WHERE url LIKE '%://%' AND regexp_extract(html, '<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1) LIKE '%://%'
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a AS node, a AS seen FROM both_ways
  UNION
  SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.seen = both_ways.a
), blocked AS (
  SELECT DISTINCT r.node FROM reach r JOIN judged j ON split_part(j.url, '#', 1) = r.seen
  WHERE j.rule IN ('example.com/en/', 'net/fr/', 'net/es/')
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN split_part(url, '#', 1) IN (SELECT node FROM blocked) THEN 'block'
            ELSE 'allow' END AS verdict
FROM judged
"""

#: Blocks of 10 million words, 64 at least, of 64 parts, 8 shards and the seed 7 are the defaults of plan_mix.
OP9 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s:' || source, 'n') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS rnk
  FROM documents
), n AS (
  SELECT CAST(64 * pow(2, greatest(0, ceil(log2(greatest(sum(size), 1) / 640000000.0)))) AS BIGINT) AS blocks FROM sized
), d AS (
  SELECT sized.*, CAST('0x' || substr(rnk, 1, 8) AS BIGINT) % blocks AS block, (CAST('0x' || substr(rnk, 1, 8) AS BIGINT) // blocks) % 64 AS part, row_number() OVER () AS row FROM sized, n
), s0 AS (
  SELECT skey, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL
), s1 AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM s0
), s2 AS (
  SELECT *,
         sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0) AS remaining,
         sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS free
  FROM s1 WINDOW earlier AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (
  SELECT *, cap * free <= remaining * weight AS capped FROM s2
), s4 AS (
  SELECT *, CASE WHEN capped THEN CAST(cap AS DOUBLE)
                 ELSE CAST((SELECT arg_max(remaining, free) FROM s3 WHERE NOT capped) * weight AS DOUBLE) / (SELECT max(free) FROM s3 WHERE NOT capped) END AS target
  FROM s3
), t AS (
  SELECT skey, source_size, target, passes, target - passes * source_size AS rest
  FROM (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM s4)
), b0 AS (
  SELECT skey, block, sum(size) AS block_size FROM d GROUP BY ALL
), b AS (
  SELECT *, sum(block_size) OVER (PARTITION BY skey ORDER BY md5('7:' || skey || ':' || CAST(block AS VARCHAR)) ROWS UNBOUNDED PRECEDING) AS upto FROM b0
), placed AS (
  SELECT b.skey, block, source_size, target, passes, rest - (upto - block_size) AS room,
         upto <= rest AND rest > 0 AS whole, upto - block_size < rest AND upto > rest AS cut
  FROM b JOIN t USING (skey)
), draws AS (
  SELECT skey, block, unnest(range(passes + CASE WHEN whole OR cut THEN 1 ELSE 0 END)) AS pass FROM placed
), l1 AS (
  SELECT *, CASE WHEN 2 * row_number() OVER (ORDER BY md5('7:0:' || skey || ':' || block || ':' || pass)) > count(*) OVER () + 1 THEN 1 ELSE 0 END AS shard FROM draws
), l2 AS (
  SELECT * EXCLUDE (shard), 2 * shard + CASE WHEN 2 * row_number() OVER (PARTITION BY shard ORDER BY md5('7:1:' || skey || ':' || block || ':' || pass)) > count(*) OVER (PARTITION BY shard) + 1 THEN 1 ELSE 0 END AS shard FROM l1
), l3 AS (
  SELECT * EXCLUDE (shard), 2 * shard + CASE WHEN 2 * row_number() OVER (PARTITION BY shard ORDER BY md5('7:2:' || skey || ':' || block || ':' || pass)) > count(*) OVER (PARTITION BY shard) + 1 THEN 1 ELSE 0 END AS shard FROM l2
), quotas AS (
  SELECT skey, shard, sum(count(*)) OVER (PARTITION BY skey ORDER BY shard) AS upto FROM l3 GROUP BY skey, shard
), in_order AS (
  SELECT *, row_number() OVER (PARTITION BY skey ORDER BY md5('7:draw:' || skey || ':' || block || ':' || pass)) AS place FROM draws
), leaves AS (
  SELECT i.skey, i.block, i.pass, min(q.shard) AS shard FROM in_order i JOIN quotas q ON i.skey = q.skey AND q.upto >= i.place GROUP BY ALL
), drawn AS (
  SELECT skey, block, list(shard ORDER BY pass) AS shards, list(pass ORDER BY pass) AS drawn_passes FROM leaves GROUP BY ALL
), parts AS (
  SELECT c.skey, c.block, c.part, room, part_size, sum(part_size) OVER (PARTITION BY c.skey ORDER BY c.part ROWS UNBOUNDED PRECEDING) AS part_upto
  FROM (SELECT skey, block, part, sum(size) AS part_size FROM d GROUP BY ALL) c JOIN placed p ON p.cut AND c.skey = p.skey AND c.block = p.block
), r AS (
  SELECT d.*, placed.* EXCLUDE (skey, block), drawn.shards, room2, part_whole,
         sum(size) OVER (PARTITION BY d.skey, d.block, d.part ORDER BY rnk, doc_id, size, row ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN placed ON d.skey = placed.skey AND d.block = placed.block
  LEFT JOIN drawn ON d.skey = drawn.skey AND d.block = drawn.block
  LEFT JOIN (SELECT skey, block, part, room - part_upto + part_size AS room2, part_upto <= room AS part_whole FROM parts) x ON d.skey = x.skey AND d.block = x.block AND d.part = x.part
), r2 AS (
  SELECT *, cut AND (part_whole OR room2 > 0 AND upto <= room2) AS fits FROM r
), m AS (
  SELECT skey, any_value(room) - coalesce(sum(size) FILTER (WHERE fits), 0) AS missing, any_value(shards[-1]) AS last_shard FROM r2 WHERE cut GROUP BY skey
), best AS (
  SELECT row, last_shard FROM (
    SELECT r2.row, last_shard, row_number() OVER (PARTITION BY r2.skey ORDER BY abs(missing - size), rnk, doc_id, r2.row) AS nth
    FROM r2 JOIN m USING (skey) WHERE NOT whole AND NOT fits AND abs(missing - size) < missing
  ) WHERE nth = 1
), taken AS (
  SELECT r2.*, CASE WHEN whole OR fits THEN coalesce(shards, []) ELSE coalesce(shards, [])[1:passes] END || CASE WHEN best.row IS NULL THEN [] ELSE [best.last_shard] END AS own
  FROM r2 LEFT JOIN best ON r2.row = best.row
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * len(own) AS BIGINT) AS taken, block, array_to_string(own, ',') AS shards
FROM taken
"""

OP6 = r"""
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.uid AS q_uid, q.vec_id AS query_id, x.uid, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.uid <> x.uid WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q_uid ORDER BY score DESC, vec_id NULLS LAST, uid) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP2 = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS node, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT node, doc_id,
         CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
              ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
  FROM w
), e AS (
  SELECT node, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), p AS (
  SELECT a.node AS x, b.node AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS shared
  FROM e a JOIN e b ON a.shingle = b.shingle AND a.node < b.node GROUP BY ALL
), links AS (
  SELECT x, y FROM p WHERE 100 * shared >= 80 * (nx + ny - shared)
  UNION SELECT y, x FROM p WHERE 100 * shared >= 80 * (nx + ny - shared)
), reach AS (
  SELECT node, node AS seen FROM s
  UNION
  SELECT reach.node, links.y FROM reach JOIN links ON reach.seen = links.x
)
SELECT s.doc_id, CAST(len(any_value(s.shingles)) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM reach r JOIN s ON s.node = r.node JOIN s o ON o.node = r.seen GROUP BY s.node, s.doc_id
"""

OP11 = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM (SELECT lang, source, row, unnest(words) AS term FROM d) GROUP BY ALL
), k AS (
  SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 30
), v AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), gn AS (
  SELECT lang, source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN (SELECT c.* FROM c SEMI JOIN k USING (lang, term)) c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (gn.total + 5 * v.v) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (k.n + 5) // (v.total + 5 * v.v) AS q
  FROM gn JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

#: crc32 takes a byte by eight steps of one bit, of which the first also takes the byte in.
OP13 = r"""
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS row, doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS tree, text,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
           || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS front,
         list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(coalesce(CAST(doc_id AS VARCHAR), '')) + 1), lambda i: [ord(substr(CAST(doc_id AS VARCHAR), i, 1)), 0, 0, 0, 0, 0, 0, 0]))),
           lambda x, b: xor(xor(x, CAST(b AS BIGINT)) >> 1, CASE WHEN xor(x, CAST(b AS BIGINT)) & 1 = 1 THEN 3988292384 ELSE 0 END)) AS crc
  FROM documents
), h AS (
  SELECT row, doc_id, tree, sha256(front || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 2 = 0 AND text IS NOT NULL THEN sha256(front || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')) END AS tampered
  FROM f
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM h
), nodes AS (
  SELECT tree, 0 AS level, place, leaf AS node, size FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), (size + 2) // 3 FROM nodes WHERE size > 1 GROUP BY tree, level, place // 3, size
), subroots AS (
  SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM nodes WHERE size = 1
), above AS (
  SELECT 0 AS level, place, node, size FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), (size + 2) // 3 FROM above WHERE size > 1 GROUP BY level, place // 3, size
), runs AS (
  SELECT tree, level, place // 3 AS run, list(node ORDER BY place) AS own FROM nodes WHERE size > 1 GROUP BY ALL
), runs_above AS (
  SELECT level, place // 3 AS run, list(node ORDER BY place) AS own FROM above WHERE size > 1 GROUP BY ALL
), fold AS (
  SELECT row, tree, 0 AS level, place, coalesce(tampered, leaf) AS node, '' AS sib FROM placed
  UNION ALL
  SELECT row, fold.tree, fold.level + 1, place // 3, sha256(array_to_string(own[1:place % 3], '') || node || array_to_string(own[place % 3 + 2:], '')),
         sib || array_to_string(own[1:place % 3], '') || array_to_string(own[place % 3 + 2:], '')
  FROM fold JOIN runs ON fold.tree = runs.tree AND fold.level = runs.level AND run = place // 3
), fold_above AS (
  SELECT t.row, 0 AS level, s.place, t.node, t.sib
  FROM (SELECT row, tree, arg_max(node, level) AS node, arg_max(sib, level) AS sib FROM fold GROUP BY ALL) t JOIN subroots s USING (tree)
  UNION ALL
  SELECT row, x.level + 1, place // 3, sha256(array_to_string(own[1:place % 3], '') || node || array_to_string(own[place % 3 + 2:], '')),
         sib || array_to_string(own[1:place % 3], '') || array_to_string(own[place % 3 + 2:], '')
  FROM fold_above x JOIN runs_above r ON x.level = r.level AND run = place // 3
), done AS (
  SELECT row, arg_max(node, level) AS folded_root, arg_max(sib, level) AS sib FROM fold_above GROUP BY row
)
SELECT doc_id, leaf, s.node AS subroot, a.node AS root, sha256(sib) AS proof_sha256, folded_root, folded_root = a.node AS verified
FROM placed JOIN done USING (row) JOIN subroots s USING (tree) JOIN above a ON a.size = 1
"""
