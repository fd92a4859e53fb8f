"""DuckDB SQL for the embedding, conversation repair and spelling queries, written over whole tables without buckets, segments or tries."""

from __future__ import annotations

#: The table of CRC-32 (polynomial 0xEDB88320, reflected), and the checksum of a text's UTF-8 bytes.
CRC_TABLE = "crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS tab FROM range(256) t(i))"


def crc32(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


CONVERSATIONS = rf"""
WITH RECURSIVE {CRC_TABLE},
marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS m FROM conversations, crc
), hurt AS (
  SELECT coalesce(conv_id::VARCHAR, 'none') AS c, turn, CASE m WHEN 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM marked, range(2) t(copy) WHERE m <> 0 AND (copy = 0 OR m = 3)
), placed AS (
  SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt
), judged AS (
  SELECT *, lag(initial) OVER (PARTITION BY c ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN i > min(i) OVER (PARTITION BY c, role, text) THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), inserts(state, after, cost, letters) AS (
  VALUES ('', '', 0, ''), ('', 'u', 2, 'I'), ('', 'a', 4, 'II'), ('s', 's', 0, ''), ('s', 'u', 2, 'I'), ('s', 'a', 4, 'II'), ('u', 'u', 0, ''), ('u', 'a', 2, 'I'), ('a', 'a', 0, ''), ('a', 'u', 2, 'I')
), edits(state, letter, initial, after, cost) AS (
  VALUES ('', 'K', 's', 's', 0), ('', 'K', 'u', 'u', 0), ('s', 'K', 'u', 'u', 0), ('u', 'K', 'a', 'a', 0), ('a', 'K', 'u', 'u', 0),
         ('', 'R', NULL, 'u', 2), ('s', 'R', NULL, 'u', 2), ('u', 'R', NULL, 'a', 2), ('a', 'R', NULL, 'u', 2), ('', 'D', NULL, '', 3), ('s', 'D', NULL, 's', 3), ('u', 'D', NULL, 'u', 3), ('a', 'D', NULL, 'a', 3)
), walk(c, i, state, best) AS (
  SELECT DISTINCT c, 0::BIGINT, '', {{'cost': 0, 'audit': ''}} FROM hurt
  UNION ALL
  SELECT w.c, w.i + 1, e.after, min({{'cost': w.best.cost + n.cost + e.cost + CASE WHEN j.fault = 'truncated' AND e.letter <> 'D' THEN 1 ELSE 0 END, 'audit': w.best.audit || n.letters || e.letter}})
  FROM walk w JOIN judged j ON j.c = w.c AND j.i = w.i + 1 JOIN inserts n ON n.state = w.state JOIN edits e ON e.state = n.after AND (e.letter = 'D' OR j.fault NOT IN ('blank', 'duplicate')) AND (e.letter <> 'K' OR e.initial = j.initial)
  GROUP BY w.c, w.i, e.after
), found AS (
  SELECT w.c, min({{'cost': w.best.cost + n.cost, 'audit': w.best.audit || n.letters}}) AS best
  FROM walk w JOIN (SELECT c, max(i) AS i FROM judged GROUP BY c) l ON l.c = w.c AND l.i = w.i JOIN inserts n ON n.state = w.state AND n.after IN ('', 'a') GROUP BY w.c
), letters AS (
  SELECT c, unnest(string_split(best.audit, '')) AS letter, unnest(range(length(best.audit))) AS p FROM found
), counted AS (
  SELECT *, sum((letter <> 'I')::INT) OVER (PARTITION BY c ORDER BY p) AS i, sum((letter <> 'D')::INT) OVER (PARTITION BY c ORDER BY p) AS place FROM letters
), said AS (
  SELECT k.c, k.letter, k.p, k.place - max((k.letter = 'K' AND j.initial = 's')::INT) OVER (PARTITION BY k.c) AS nth, j.role, j.text FROM counted k LEFT JOIN judged j ON k.letter <> 'I' AND j.c = k.c AND j.i = k.i
), repaired AS (
  SELECT c, sha256(coalesce(string_agg(CASE WHEN letter = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p) FILTER (letter <> 'D'), '')) AS repaired_sha256 FROM said GROUP BY c
), faults AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY c
)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'none') AS c FROM conversations) g LEFT JOIN faults USING (c) LEFT JOIN found USING (c) LEFT JOIN repaired USING (c)
"""

SPELLING = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), hashed AS (
  SELECT run, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc WHERE length(run) >= 7
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, count(*) AS n FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND count(*) >= 2
), holes AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS pre, substr(word, i + 1) AS post FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS times FROM holes a JOIN holes b ON a.i = b.i AND a.pre = b.pre AND a.post = b.post AND a.word <> b.word
  UNION SELECT h.word, h.n, w.word, w.n FROM holes h JOIN words w ON w.word = h.pre || h.post
  UNION SELECT w.word, w.n, h.word, h.n FROM holes h JOIN words w ON w.word = h.pre || h.post
), best AS (
  SELECT word, count(*) AS n_near, min({{'less': -times, 'form': other}}) AS best FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.best.less >= 10 * w.n THEN b.best.form END AS form, CASE WHEN -b.best.less >= 10 * w.n THEN -b.best.less END AS form_n FROM words w LEFT JOIN best b USING (word)
), chain(word, now) AS (
  SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.now WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.now AS root, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM forms f JOIN chain c USING (word) JOIN forms e ON e.word = c.now AND e.form IS NULL
"""

#: All pairs; the operator may miss some, with the chance that its docstring gives.
EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
), usable AS (
  SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT r AS a, r AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), labels AS (
  SELECT reach.a AS r, min(o.vec_id) AS component_id FROM reach JOIN v o ON o.r = reach.b GROUP BY 1
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.r) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN labels USING (r)
"""
