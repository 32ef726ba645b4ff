"""SQL (DuckDB) that gives the rows of the queries that SQL can express."""

from __future__ import annotations

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM words WHERE len(w) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS g FROM placed),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
pairs AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links), degree AS (SELECT x, count(*) AS n FROM pairs GROUP BY x),
reach(x, y) AS (SELECT x, y FROM pairs UNION SELECT r.x, b.y FROM reach r JOIN pairs b ON b.x = r.y)
SELECT d.doc_id, CAST(coalesce(max(s.n), 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS BIGINT) AS component_id, CAST(coalesce(max(g.n), 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN reach r ON r.x = d.doc_id LEFT JOIN degree g ON g.x = d.doc_id GROUP BY d.doc_id"""

OP8 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), m AS (SELECT *, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM m"""

_PATTERN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP10 = rf"""WITH words AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_PATTERN}) AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_FOLDED}, {_PATTERN}) AS w FROM benchmark),
starts AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM starts),
sizes AS (SELECT DISTINCT k FROM windows),
placed AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes WHERE len(w) >= k),
hits AS (SELECT p.doc_id, p.i, p.k, x.item_id FROM placed p JOIN windows x ON x.k = p.k AND x.g = array_to_string(p.w[p.i : p.i + p.k - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n, 0) AS BIGINT) AS n_items, sha256(coalesce(found.ids, '')) AS items_sha256,
coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""

#: CRC-32 is a fold over the bytes with a table that its polynomial gives; the shards are cut at equal shares of the bytes in the order of a hash and the id.
OP6 = """WITH RECURSIVE bits(i, k, c) AS (SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
bytes AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, CASE WHEN text IS NULL THEN -1 ELSE CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) END AS h,
  list_prepend(4294967295, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: CAST('0x' || x AS BIGINT))) AS b FROM documents),
summed AS (SELECT doc_id, size, h, xor(list_reduce(b, lambda acc, x: xor(acc >> 8, tab[(xor(acc, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, crc),
placed AS (SELECT *, sum(size) OVER w - size AS start, row_number() OVER w AS nth FROM summed WINDOW w AS (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING)),
total AS (SELECT sum(size) AS n FROM summed), even AS (SELECT k, n, (n * k + 7) // 8 AS cut FROM total, range(1, 8) t(k)),
equal AS (SELECT min(start) AS lo, max(start + size) AS hi FROM placed GROUP BY h),
cuts AS (SELECT coalesce(max(CASE WHEN cut - lo <= hi - cut THEN lo ELSE hi END), cut) AS cut FROM even LEFT JOIN equal ON lo < cut AND cut < hi AND hi - lo <= CAST(0.02 AS DOUBLE) * n / 8 GROUP BY k, cut),
sharded AS (SELECT *, (SELECT count(*) FROM cuts c WHERE p.start >= c.cut) AS shard FROM placed p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, CAST(nth - min(nth) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM sharded"""

_DRAW = "CAST('0x' || substr(x, {0}, 8) AS BIGINT)"
OP11 = rf"""WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || CAST(doc_id AS VARCHAR)) AS x FROM documents),
drawn AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, {_DRAW.format(1)} % (len(u) + 1) AS p, {_DRAW.format(9)} % (len(u) + 1) AS q, {_DRAW.format(17)} % 100 AS c, {_DRAW.format(25)} % 100 AS d FROM cut),
formed AS (SELECT doc_id, n, text, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 50 THEN 'plain' WHEN d < 80 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1 : least(p, q)], '') AS a, array_to_string(u[least(p, q) + 1 : greatest(p, q)], '') AS b, array_to_string(u[greatest(p, q) + 1 :], '') AS z FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256 FROM formed"""

OP13 = """WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positive JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10"""

ORACLES = {"op2_jaccard": OP2, "op6_sharding": OP6, "op8_warc": OP8, "op10_decontamination": OP10, "op11_fill_in_middle": OP11, "op13_hard_negatives": OP13}
