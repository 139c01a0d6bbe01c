"""SQL counterparts of the queries of this subpackage, where SQL can express them."""

from __future__ import annotations

WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

#: The table of CRC-32 by its rule, and the checksum of an ASCII text by that table.
CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(range(8),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc"""


def crc32(text: str) -> str:
    return f"""xor(list_reduce(list_transform(range(1, 1 + length({text})), lambda j: CAST(ascii(substr({text}, j, 1)) AS BIGINT)),
    lambda v, b: xor(v >> 8, crc[1 + (xor(v, b) & 255)]), 4294967295), 4294967295)"""


ORACLES = {
    "op1_length_buckets": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS n FROM documents),
u AS (SELECT doc_id, n, unnest(range(0, greatest(n - 1, 0) // 2048 + 1)) AS piece FROM d),
p AS (SELECT doc_id, piece, piece * 2048 AS start_token, least(2048, n - piece * 2048) AS n_tokens FROM u),
h AS (SELECT n_tokens AS len, count(*) AS c FROM p GROUP BY 1),
cum AS (
  SELECT row_number() OVER (ORDER BY len) AS i, len,
    CAST(sum(c) OVER (ORDER BY len) AS BIGINT) AS rows_, CAST(sum(c * len) OVER (ORDER BY len) AS BIGINT) AS toks
  FROM h UNION ALL SELECT 0, 0, 0, 0),
k AS (SELECT least(8, max(i)) AS k FROM cum),
dp AS (
  SELECT 0 AS k, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS packed
  UNION ALL
  SELECT dp.k + 1, e.i,
    min((dp.packed // 10000 + e.len * (e.rows_ - b.rows_) - (e.toks - b.toks)) * 10000 + b.i)
  FROM dp JOIN cum b ON b.i = dp.i JOIN cum e ON e.i > dp.i
  WHERE dp.k < (SELECT k FROM k) GROUP BY dp.k + 1, e.i),
path AS (
  SELECT dp.k, dp.i, dp.packed % 10000 AS came FROM dp
  WHERE dp.k = (SELECT k FROM k) AND dp.i = (SELECT max(i) FROM cum)
  UNION ALL
  SELECT dp.k, dp.i, dp.packed % 10000 FROM path JOIN dp ON dp.k = path.k - 1 AND dp.i = path.came WHERE path.k > 1),
bounds AS (SELECT list(len ORDER BY len) AS b FROM path JOIN cum USING (i)),
placed AS (
  SELECT p.*, len(list_filter(b, lambda x: x < n_tokens)) AS bucket,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT
      % greatest(1, CAST(ceil((SELECT count(*) FROM p) / 20000.0) AS BIGINT)) AS slice, b
  FROM p, bounds),
numbered AS (
  SELECT *, b[bucket + 1] AS bucket_tokens,
    row_number() OVER (PARTITION BY bucket ORDER BY slice, doc_id NULLS FIRST, piece, n_tokens) - 1 AS place FROM placed)
SELECT doc_id, CAST(piece AS BIGINT) AS piece, CAST(start_token AS BIGINT) AS start_token,
  CAST(n_tokens AS BIGINT) AS n_tokens, CAST(bucket AS INTEGER) AS bucket,
  CAST(bucket_tokens AS BIGINT) AS bucket_tokens,
  CAST(place // greatest(1, 65536 // greatest(bucket_tokens, 1)) AS BIGINT) AS batch,
  CAST(place % greatest(1, 65536 // greatest(bucket_tokens, 1)) AS BIGINT) AS slot
FROM numbered""",
    "op3_vantage_points": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(
      list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op5_warc_transactions": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages WHERE page_id IS NOT NULL),
h AS (SELECT page_id, strlen(body) AS n, upper(sha1(body)) AS hex, max(page_id) OVER (PARTITION BY body) AS holder FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(1 + ((('0x' || substr(hex, 1 + (i // 8) * 10, 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT), 1)), '')
    AS payload_digest,
  CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN holder <> page_id THEN holder END AS refers_to,
  true AS is_complete
FROM h""",
    "op6_jaccard_classes": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
c AS (
  SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT c.node, l.b FROM c JOIN l ON l.a = c.seen),
g AS (SELECT node, min(seen) AS component_id FROM c GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN g ON g.node = w.doc_id""",
    "op9_token_rollup": rf"""
WITH d AS (
  SELECT coalesce(doc_id, 0) AS k, source, lang, {WORDS} AS words,
    coalesce(len(regexp_extract_all(text, '\p{{L}}+|\p{{N}}{{1,3}}|[^\p{{L}}\p{{N}}\x20\x09-\x0D]+')), 0) AS pieces
  FROM documents),
r AS (
  SELECT source, lang, CASE WHEN k % 3 = 0 THEN 'pieces-2' ELSE 'words-1' END AS tokenizer,
    CASE WHEN k % 3 = 0 THEN pieces ELSE words END AS n FROM d WHERE k % 10 <> 0)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM r GROUP BY source, lang, tokenizer""",
    "op10_preference_pairs": r"""
WITH last AS (
  SELECT conv_id, max({'turn': turn, 'text': text}) AS last FROM conversations
  WHERE role = 'assistant' AND conv_id IS NOT NULL GROUP BY 1),
sides AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM conversations SEMI JOIN last USING (conv_id)
  UNION ALL
  SELECT c.conv_id, 'rejected', turn, role,
    CASE WHEN turn = l.last.turn THEN coalesce(o.last.text, '') ELSE text END
  FROM conversations c JOIN last l USING (conv_id) LEFT JOIN last o ON o.conv_id = c.conv_id + 1
  WHERE turn < l.last.turn OR turn = l.last.turn AND role = 'assistant' OR turn IS NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place,
    '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') || chr(10) AS body FROM sides),
differ AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.place, b.place) AS place,
    a.pair_id IS NULL OR b.pair_id IS NULL OR a.head <> b.head OR a.body <> b.body AS differs
  FROM (SELECT * FROM placed WHERE side = 'chosen') a
  FULL JOIN (SELECT * FROM placed WHERE side = 'rejected') b ON a.pair_id = b.pair_id AND a.place = b.place),
prompt AS (
  SELECT pair_id, coalesce(min(CASE WHEN differs THEN place END), max(place) + 1) AS n, bool_or(differs) AS other
  FROM differ GROUP BY 1),
spans AS (
  SELECT x.*, n, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, side, place >= n ORDER BY place) AS upto
  FROM placed x JOIN prompt USING (pair_id) WHERE other)
SELECT pair_id, CAST(any_value(n) AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(CASE WHEN side = 'chosen' AND place < n THEN head || body END, '' ORDER BY place), '') AS prompt,
  coalesce(string_agg(CASE WHEN side = 'chosen' AND place >= n THEN head || body END, '' ORDER BY place), '') AS chosen,
  coalesce(string_agg(CASE WHEN side = 'rejected' AND place >= n THEN head || body END, '' ORDER BY place), '') AS rejected,
  CAST(count(CASE WHEN side = 'chosen' AND place >= n THEN 1 END) AS BIGINT) AS n_chosen_turns,
  CAST(count(CASE WHEN side = 'rejected' AND place >= n THEN 1 END) AS BIGINT) AS n_rejected_turns,
  coalesce(string_agg(CASE WHEN side = 'chosen' AND place >= n AND role = 'assistant'
    THEN CAST(upto - length(body) AS BIGINT) || '-' || CAST(upto AS BIGINT) END, ',' ORDER BY place), '') AS chosen_mask,
  coalesce(string_agg(CASE WHEN side = 'rejected' AND place >= n AND role = 'assistant'
    THEN CAST(upto - length(body) AS BIGINT) || '-' || CAST(upto AS BIGINT) END, ',' ORDER BY place), '') AS rejected_mask
FROM spans GROUP BY pair_id""",
    "op11_url_digests": r"""
WITH r AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM r),
u AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM h),
f AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM f""",
    "op12_tiled_runs": rf"""
WITH t AS ({CRC_TABLE}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    {crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents, t),
e AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
w AS (
  SELECT rid, n, i, ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS w FROM f, unnest(range(0, n)) AS u(i)),
g AS (
  SELECT *, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
m AS (
  SELECT a.rid, b.i - a.i AS p, a.i AS x FROM g a JOIN g b
  ON a.rid = b.rid AND a.w = b.w AND a.w1 = b.w1 AND a.w2 = b.w2 AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS (
  SELECT rid, p, min(x) AS x, count(*) + 2 + p AS l
  FROM (SELECT *, x - row_number() OVER (PARTITION BY rid, p ORDER BY x) AS island FROM m) GROUP BY rid, p, island),
r AS (SELECT rid, x, l, min(p) AS p FROM s WHERE l >= greatest(6, 4 * p) GROUP BY rid, x, l),
k AS (SELECT DISTINCT rid, unnest(range(x + p, x + l)) AS i FROM r),
c AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS text FROM w ANTI JOIN k USING (rid, i) GROUP BY rid),
q AS (
  SELECT rid, count(*) AS n, string_agg(x || ',' || l || ',' || p || chr(10), '' ORDER BY x, p) AS runs,
    min({{'l': -l, 'x': x, 'p': p}}) AS top FROM r GROUP BY rid)
SELECT doc_id, coalesce(q.n, 0) AS n_runs, top.x AS start, CAST(-top.l AS BIGINT) AS length, top.p AS period,
  CAST(1000 * -top.l // top.p AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
  sha256(coalesce(c.text, '')) AS collapsed_sha256
FROM d LEFT JOIN q USING (rid) LEFT JOIN c USING (rid)""",
    # Forward over the rows of a conversation: per state the least (cost, edits).
    "op13_conversation_repair": rf"""
WITH RECURSIVE t AS ({CRC_TABLE}),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS h
  FROM conversations, t),
d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM k, unnest(range(CASE WHEN h = 0 THEN 0 WHEN h = 3 THEN 2 ELSE 1 END)) WHERE h <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (
  SELECT *, substr(role, 1, 1) AS c, CASE
      WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM o),
g AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
v AS (
  SELECT conv_id, n, 0 AS i, {{'c': 0, 'a': ''}} AS z, {{'c': 1000000000, 'a': ''}} AS s,
    {{'c': 5, 'a': 'I'}} AS u, {{'c': 10, 'a': 'II'}} AS x FROM g
  UNION ALL
  SELECT conv_id, n, i, z, s, u, list_min([x, {{'c': u.c + 5, 'a': u.a || 'I'}}]) AS x FROM (
    SELECT conv_id, n, i, z, s, x, list_min([u, {{'c': z.c + 5, 'a': z.a || 'I'}}, {{'c': s.c + 5, 'a': s.a || 'I'}},
      {{'c': x.c + 5, 'a': x.a || 'I'}}]) AS u FROM (
      SELECT conv_id, n, i, {{'c': z.c + 2, 'a': z.a || 'D'}} AS z,
        list_min([{{'c': s.c + 2, 'a': s.a || 'D'}}, {{'c': z.c + no_s, 'a': z.a || 'K'}}]) AS s,
        list_min([{{'c': u.c + 2, 'a': u.a || 'D'}}, {{'c': z.c + to_u, 'a': z.a || eu}}, {{'c': s.c + to_u, 'a': s.a || eu}},
          {{'c': x.c + to_u, 'a': x.a || eu}}]) AS u,
        list_min([{{'c': x.c + 2, 'a': x.a || 'D'}}, {{'c': u.c + to_a, 'a': u.a || ea}}]) AS x
      FROM (
        SELECT v.conv_id, v.n, f.i, z, s, u, x, forced + more + CASE WHEN c = 's' THEN 0 ELSE 1000000000 END AS no_s,
          forced + more + CASE WHEN c = 'u' THEN 0 ELSE 1 END AS to_u, CASE WHEN c = 'u' THEN 'K' ELSE 'R' END AS eu,
          forced + more + CASE WHEN c = 'a' THEN 0 ELSE 1 END AS to_a, CASE WHEN c = 'a' THEN 'K' ELSE 'R' END AS ea
        FROM v JOIN (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 ELSE 0 END AS forced,
          CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM f) f
        ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i + 1)))),
b AS (SELECT conv_id, list_min([z, x]) AS best FROM v WHERE i = n),
e AS (
  SELECT conv_id, j, substr(best.a, j, 1) AS edit, sum(CASE WHEN substr(best.a, j, 1) <> 'I' THEN 1 ELSE 0 END)
    OVER (PARTITION BY conv_id ORDER BY j) AS i FROM b, unnest(range(1, 1 + length(best.a))) AS u(j)),
l AS (
  SELECT e.conv_id, j, edit, role, c, text, row_number() OVER (PARTITION BY e.conv_id ORDER BY j) AS place,
    first_value(edit = 'K' AND c = 's') OVER (PARTITION BY e.conv_id ORDER BY j) AS opens
  FROM e JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = greatest(e.i, 1) WHERE edit <> 'D'),
r AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - CASE WHEN opens THEN 1 ELSE 0 END) % 2 = 1
    THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS repaired
  FROM l GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id""",
}
