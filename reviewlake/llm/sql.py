"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
              unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
lw AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM ls),
lf AS (
  SELECT doc_id, pos, line, ws, len(ws) AS n,
         length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS sym,
         length(regexp_replace(line, '[^!?]', '', 'g')) AS marks,
         length(regexp_replace(line, '[^\p{Lu}]', '', 'g')) AS up,
         length(regexp_replace(line, '[^\p{Ll}]', '', 'g')) AS lo,
         len(list_filter(ws, lambda x: x IN ('|', '>', '»', '•', '·'))) AS sep,
         len(list_distinct(ws)) AS n_distinct,
         length(array_to_string(ws, '')) AS chars,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS dup
  FROM lw WHERE len(ws) > 0),
lv AS (
  SELECT *, (sym > 0.25 * n OR marks > 0.5 * n OR (n >= 5 AND up > 0.7 * (up + lo))
             OR (sep >= 3 AND 4 * sep >= n) OR (n >= 10 AND n_distinct < 0.3 * n)
             OR (n <= 20 AND regexp_matches(lower(line), 'all rights reserved|cookie policy|cookies to|privacy policy|terms of use|terms of service|sign in|log in|subscribe to|click here|read more|share this|follow us|back to top|enable javascript|lorem ipsum|skip to content|licensed under|copyright \(c\)|©|spdx-license-identifier'))
            ) AS bad FROM lf),
la AS (SELECT doc_id, sum(n) AS n_words, sum(chars) AS word_chars, count(*) FILTER (dup) AS n_dup_lines,
              count(*) AS n_lines, count(*) FILTER (bad) AS n_failed_lines,
              coalesce(sum(chars) FILTER (bad), 0) AS lost_chars FROM lv GROUP BY doc_id),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos
      FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT doc_id, pos, CASE WHEN lead(pos, 4) OVER o IS NOT NULL THEN
        [word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] END AS gram
      FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM g),
c AS (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
      AS covered FROM r),
rep AS (SELECT doc_id, count(*) FILTER (covered) AS n_repeat_words FROM c GROUP BY doc_id),
j AS (
  SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines,
         coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM d LEFT JOIN la USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_chars <= 0.5 * word_chars AS kept,
       n_lines, n_failed_lines, lost_chars
FROM j
"""

OP9 = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                   (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
p AS (SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\1\\|', 'g'))
           + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 11)::BIGINT AS formatted_chars,
       bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'),
                                   ('user', 'assistant'), ('assistant', 'user'))) AS valid_order
FROM p GROUP BY conv_id
"""

OP10 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS d FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM h)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0) x),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS whole FROM g GROUP BY doc_id),
c AS (SELECT doc_id, n, count(*) OVER (PARTITION BY whole) AS copies FROM n),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT p.x, p.y FROM p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y
      WHERE 5 * p.both >= 4 * (a.n + b.n - p.both)),
r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other),
k AS (SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id)
SELECT k.doc_id, k.class_id, (SELECT count(*) FROM l WHERE l.x = k.doc_id) AS n_links, coalesce(c.copies, 1) AS n_copies
FROM k LEFT JOIN c ON c.doc_id = k.doc_id
"""

OP7 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, j, CASE WHEN j + 50 <= n THEN hash(substr(h, 2 * j + 1, 100)) END AS s
      FROM (SELECT doc_id, h, n, unnest(range(n)) AS j FROM d) b),
f AS (SELECT doc_id, j, s IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY s) AS again FROM s),
g AS (SELECT doc_id, j, bool_or(again) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
      FROM f),
t AS (SELECT doc_id, j, gone FROM (SELECT *, lag(gone) OVER (PARTITION BY doc_id ORDER BY j) AS before FROM g) x
      WHERE gone IS DISTINCT FROM before),
r AS (SELECT t.doc_id, t.j, t.gone, coalesce(lead(t.j) OVER (PARTITION BY t.doc_id ORDER BY t.j), d.n) - t.j AS len, d.h
      FROM t JOIN d ON d.doc_id = t.doc_id),
a AS (SELECT doc_id, sum(len) FILTER (gone) AS n_removed, count(*) FILTER (gone) AS n_spans,
             string_agg(substr(h, 2 * j + 1, 2 * len), '' ORDER BY j) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(a.n_removed, 0)::BIGINT AS n_removed, coalesce(a.n_spans, 0) AS n_spans,
       sha256(from_hex(coalesce(a.kept, ''))) AS kept_sha256
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""

OP13 = r"""
WITH RECURSIVE
t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b:
        CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations, t),
h AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, b: xor(a >> 8, crc[xor(a & 255, b) + 1]))) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE kind <> 0),
o AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS later,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
             lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before FROM d),
r AS (SELECT *, role[1] AS initial, CASE WHEN trimmed = '' THEN 'b' WHEN later THEN 'd'
             WHEN trimmed[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault FROM o),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
         count(*) AS n FROM r GROUP BY conv_id),
ins(s, i, s2) AS (VALUES ('0', 0, '0'), ('0', 1, 'u'), ('0', 2, 'a'), ('s', 0, 's'), ('s', 1, 'u'), ('s', 2, 'a'),
                         ('u', 0, 'u'), ('u', 1, 'a'), ('u', 2, 'u'), ('a', 0, 'a'), ('a', 1, 'u'), ('a', 2, 'a')),
paths AS (
  SELECT conv_id, 0::BIGINT AS pos, '0' AS s, 0::BIGINT AS cost, '' AS audit FROM counts
  UNION ALL
  SELECT conv_id, pos, s, b.cost, b.audit FROM (
    SELECT conv_id, pos, s, min({cost: cost, audit: audit}) AS b FROM (
      SELECT p.conv_id, p.pos + 1 AS pos, e.s, p.cost + 5 * ins.i + e.cost AS cost,
             p.audit || repeat('I', ins.i) || e.edit AS audit
      FROM paths p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.pos = p.pos + 1
      JOIN ins ON ins.s = p.s,
      LATERAL (SELECT unnest([
        {edit: 'D', cost: 2, s: ins.s, ok: true},
        {edit: 'K', cost: CASE fault WHEN 't' THEN 5 ELSE 0 END, s: initial, ok: fault IN ('t', '.') AND (
          initial = 'a' AND ins.s = 'u' OR initial = 'u' AND ins.s <> 'u' OR initial = 's' AND ins.s = '0')},
        {edit: 'R', cost: CASE fault WHEN 't' THEN 6 ELSE 1 END, s: CASE ins.s WHEN 'u' THEN 'a' ELSE 'u' END,
         ok: fault IN ('t', '.')}], recursive := true)) e(edit, cost, s, ok)
      WHERE e.ok) GROUP BY conv_id, pos, s)),
best AS (
  SELECT p.conv_id, min({cost: p.cost + 5 * ins.i, audit: p.audit || repeat('I', ins.i)}) AS b
  FROM paths p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.pos
  JOIN ins ON ins.s = p.s AND ins.s2 IN ('0', 'a') GROUP BY p.conv_id),
edits AS (SELECT conv_id, unnest(string_split(b.audit, '')) AS edit,
                 unnest(range(length(b.audit))) AS j FROM best WHERE b.audit <> ''),
placed AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS pos, count(*) FILTER (edit <> 'D') OVER w AS nth,
                  count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id) % 2 AS system FROM edits
           WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
lines AS (SELECT p.conv_id, j, CASE edit WHEN 'K' THEN r.role ELSE
                 CASE (nth - system) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' ||
                 CASE edit WHEN 'I' THEN '' ELSE r.text END AS line
          FROM placed p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.pos = p.pos WHERE edit <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY j) AS repaired FROM lines GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit,
       sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM a.conv_id
"""

OP11 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3)) v(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws, k AS width, unnest(range(1, k)) AS k FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, c.width, min({score: (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f), k: c.k, l: x.f, r: y.f}) AS cut
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.k], ' ')
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1:], ' ') GROUP BY ALL),
inside AS (SELECT lang, a AS f, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase
           FROM c WHERE width = 3 AND k = 1),
kept AS (SELECT * FROM s WHERE NOT EXISTS (
           SELECT 1 FROM inside i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.f >= 50 * s.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a, cut.l AS l, cut.r AS r, n, cut.score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op6_ngram_join": OP6, "op7_suffix_dedup": OP7, "op8_quality_rules": OP8, "op9_chat_format": OP9, "op10_warc": OP10,
    "op11_collocations": OP11, "op13_conversation_repair": OP13,
}
