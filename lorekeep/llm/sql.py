"""DuckDB SQL for the queries in ``registry``."""

OP10 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), f AS (
  SELECT doc_id, t,
         regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT doc_id, t, w, len(w) AS n,
         length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         length(regexp_replace(t, '\P{L}', '', 'g')) AS n_letters,
         length(regexp_replace(t, '\P{Lu}', '', 'g')) AS n_capitals,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter
  FROM f
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x
  FROM g, unnest(range(1, n - 6)) AS u(i) WHERE n >= 8
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, unnest(range(0, 8)) AS u(k) WHERE c > 1 GROUP BY doc_id
), h AS (
  SELECT g.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM g LEFT JOIN covered USING (doc_id)
), b AS (
  SELECT *, (n < 20 OR 100 * n_repeat_words > 30 * n) AS base_failed FROM h
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       (NOT base_failed AND NOT (100 * n_symbols > 10 * n) AND NOT (100 * n_dup_lines > 50 * n_lines)
        AND NOT (word_chars < 2 * n OR word_chars > 15 * n) AND NOT (100 * n_capitals > 50 * n_letters)
        AND NOT (100 * n_stutter > 20 * n)) AS kept
FROM b
"""

OP1 = r"""
WITH p AS (
  SELECT coalesce(page_id, -1) AS k, coalesce(url, '') AS u, coalesce(html, '') AS h, left(sha256(coalesce(html, '')), 2) AS tag FROM pages
), b0 AS (
  SELECT k, u, CASE WHEN tag = '00' THEN left(h, length(h) - 1) || chr(0) ELSE h END AS h FROM p WHERE tag <> '01'
  UNION ALL SELECT k + 1099511627776, u, h FROM p WHERE tag = '02'
), both_sides AS (
  SELECT 'a' AS side, k, u, h FROM p UNION ALL SELECT 'b', k, u, h FROM b0
), r AS (
  SELECT side, k, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(h) || chr(13) || chr(10) || chr(13) || chr(10)
         || h || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM both_sides
), d AS (
  SELECT side, k, strlen(rec) AS n, sha256(rec) AS digest FROM r
), a AS (
  SELECT k, n, digest, k // 4096 AS f,
         coalesce(sum(n) OVER (PARTITION BY k // 4096 ORDER BY k, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
  FROM d WHERE side = 'a'
), b AS (SELECT k, digest FROM d WHERE side = 'b')
SELECT coalesce(a.k, b.k) AS page_id,
       CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' ELSE 'corrupt' END AS status,
       CAST(coalesce(a.k, b.k) // 4096 AS BIGINT) AS file_id, CAST(o AS BIGINT) AS record_offset, CAST(n AS BIGINT) AS length,
       a.digest AS digest_a, b.digest AS digest_b
FROM a FULL JOIN b ON a.k = b.k WHERE a.digest IS DISTINCT FROM b.digest
"""

OP4 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
    replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '</s>', '<\/s>'), '<s>', '<\s>'),
      '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>') AS escaped
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(length(learned)) AS BIGINT) AS loss_chars,
       sha256(string_agg(learned, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(length(role) + length(escaped) + 18) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS n_attachments
FROM e GROUP BY conv_id
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), e AS (
  SELECT doc_id, t, length(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d
), f AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM e
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
                        WHEN 'spm' THEN '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a)
                        ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""

OP12 = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
  -- CRC-32 of the decimal id: each byte is xored in (steps from 0 on), then eight bits are shifted out (steps of -1)
  SELECT c, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps
  FROM (SELECT DISTINCT conv_id AS c FROM t)
), h AS (
  SELECT c, c - c % 5 AS base,
         xor(list_reduce(steps, lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 9 AS h
  FROM bits
), seq AS (
  SELECT c, pos, r, x FROM h JOIN t ON t.conv_id = h.base AND pos <= h
  UNION ALL SELECT c, pos, r, x FROM h JOIN t ON t.conv_id = h.c AND pos > h
), n AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, strlen(x) AS bytes, sha256(length(r) || ':' || r || x) AS label FROM seq
), path AS (
  SELECT c, d, bytes, sha256(string_agg(label, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM n
  UNION ALL SELECT c, 0, 0, 'root' FROM h
), node AS (
  SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM path GROUP BY key, d
), ends AS (
  SELECT key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS e
  FROM path JOIN (SELECT c, max(d) AS d FROM path GROUP BY c) USING (c, d) GROUP BY key
), edge AS (
  SELECT node.key, p.key AS parent FROM node JOIN path p ON p.c = node.conv_id AND p.d = node.d - 1
), child AS (
  SELECT parent AS key, count(*) AS n_children FROM edge GROUP BY parent
), sub AS (
  SELECT p.key, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * node.bytes) AS saved
  FROM node JOIN path p ON p.c = node.conv_id AND p.d <= node.d LEFT JOIN child ON child.key = node.key GROUP BY p.key
)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(node.n_convs AS BIGINT) AS n_convs,
       CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       coalesce(e, sha256('')) AS ends_sha256
FROM node LEFT JOIN edge ON edge.key = node.key LEFT JOIN node up ON up.key = edge.parent LEFT JOIN child ON child.key = node.key
JOIN sub ON sub.key = node.key LEFT JOIN ends ON ends.key = node.key
"""
