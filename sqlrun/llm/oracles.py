"""DuckDB SQL for the queries that SQL can express."""

MIX_SOURCES = r"""
WITH sized AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 9) AS BIGINT) AS h
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight,
         source_size * 3 AS cap
  FROM sources),
levels AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
         (CAST(sum(source_size) OVER () AS DOUBLE)
          - CAST(coalesce(sum(cap) OVER before, 0) AS DOUBLE))
         / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
  FROM weighed
  WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, source ASC NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shared AS (SELECT level FROM levels WHERE ratio >= level ORDER BY ratio, level LIMIT 1),
targets AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM shared) * weight, CAST(cap AS DOUBLE))) AS target
  FROM levels),
copies AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole
  FROM targets),
by_hash AS (SELECT source, h, sum(size) AS words FROM sized GROUP BY source, h),
running AS (
  SELECT b.source, b.h, b.words, c.whole, c.target - c.whole * c.source_size AS rest,
         sum(b.words) OVER (PARTITION BY b.source ORDER BY b.h) AS total
  FROM by_hash b JOIN copies c ON b.source IS NOT DISTINCT FROM c.source),
cuts AS (
  SELECT source, min_by(CASE WHEN (rest - (total - words)) * 2 >= words THEN h + 1 ELSE h END, h) AS cut
  FROM running WHERE total >= rest GROUP BY source)
SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, c.source_size, c.target,
       CAST(s.size * (c.whole + CASE WHEN c.whole < 3 AND s.h < k.cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s
JOIN copies c ON s.source IS NOT DISTINCT FROM c.source
LEFT JOIN cuts k ON s.source IS NOT DISTINCT FROM k.source
"""

NGRAM_JOIN = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
shingled AS (
  SELECT r, doc_id, list_sort(list_distinct(
    CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
  FROM docs),
keyed AS (SELECT r, doc_id, s, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, '|')) END AS k FROM shingled),
sets AS (SELECT k, any_value(s) AS s, CAST(count(*) AS BIGINT) AS n_copies, min(doc_id) AS least
         FROM keyed WHERE k IS NOT NULL GROUP BY k),
tokens AS (SELECT k, len(s) AS size, unnest(s) AS t FROM sets),
links AS (
  SELECT a.k AS x, b.k AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.k <> b.k
  GROUP BY a.k, b.k, a.size, b.size HAVING count(*) * 5 >= 4 * (a.size + b.size - count(*))),
reach AS (
  SELECT x AS k, x AS other FROM links UNION SELECT r.k, l.y FROM reach r JOIN links l ON r.other = l.x),
roots AS (SELECT k, min(other) AS root FROM reach GROUP BY k),
rooted AS (SELECT s.k, coalesce(r.root, s.k) AS root, s.least, s.n_copies,
                  CAST((SELECT count(*) FROM links l WHERE l.x = s.k) AS BIGINT) AS n_links
           FROM sets s LEFT JOIN roots r ON s.k = r.k),
classes AS (SELECT root, min(least) AS class_id FROM rooted GROUP BY root)
SELECT d.doc_id, CASE WHEN d.k IS NULL THEN d.doc_id ELSE c.class_id END AS class_id,
       coalesce(s.n_links, 0) AS n_links, coalesce(s.n_copies, 1) AS n_copies
FROM keyed d LEFT JOIN rooted s ON d.k = s.k LEFT JOIN classes c ON s.root = c.root
"""

# Limits as in line_quality: 3 documents, 1 % of the host's, 50 words, 0.3 of the words.
LINE_QUALITY = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY r),
lines AS (
  SELECT r, source, line, array_to_string(regexp_extract_all(
           translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS x
  FROM (SELECT r, source, unnest(string_split(t, chr(10))) AS line FROM docs)),
held AS (SELECT r, source, line, x FROM lines WHERE x <> ''),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM held GROUP BY r),
hosts AS (SELECT source, count(*) AS n FROM docs GROUP BY source),
often AS (
  SELECT h.source, h.x FROM held h JOIN hosts o ON h.source IS NOT DISTINCT FROM o.source
  GROUP BY h.source, h.x, o.n HAVING count(DISTINCT r) > 3 AND count(DISTINCT r) > CAST(0.01 AS DOUBLE) * o.n),
gone AS (
  SELECT h.r, count(DISTINCT h.x) AS n, sum(len(string_split(h.x, ' '))) AS words
  FROM held h JOIN often o ON h.source IS NOT DISTINCT FROM o.source AND h.x = o.x GROUP BY h.r),
counted AS (
  SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(d.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(g.n, 0) AS BIGINT) AS lines_removed,
         CAST(len(d.w) - coalesce(g.words, 0) AS BIGINT) AS words_left
  FROM docs d LEFT JOIN covered c ON d.r = c.r LEFT JOIN dups u ON d.r = u.r LEFT JOIN gone g ON d.r = g.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_left >= 50
         AND words_left >= n_words * CAST(0.3 AS DOUBLE) AS kept, lines_removed, words_left
FROM counted
"""

# All orders of five letters, step by step; counts by combination of failures.
FILTER_AUDIT = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
least AS (SELECT t, min(doc_id) AS m FROM docs GROUP BY t),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
failed AS (
  SELECT d.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 2 * length(d.t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN l.m < d.doc_id THEN 'E' ELSE '' END AS f
  FROM docs d JOIN least l ON d.t = l.t LEFT JOIN marks m ON d.doc_id = m.doc_id),
counted AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
  JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i] AS own, filter_order[1:i - 1] AS before
  FROM orders CROSS JOIN range(1, 6) r(i)),
rows_of AS (
  SELECT s.filter_order, s.step, s.own, c.part, c.f, c.n, c.good, c.toxic,
         contains(c.f, s.own) AS fails, translate(c.f, s.before, '') <> c.f AS early
  FROM steps s CROSS JOIN counted c),
summed AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (WHERE NOT fails AND NOT early), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE fails AND NOT early), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE fails AND early), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE f = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE fails AND NOT early), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE fails AND NOT early), 0) AS toxic_lost
  FROM rows_of GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed
"""

SOURCE_DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
found AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (
  SELECT f.lang, f.source, f.term, CAST(count(*) AS HUGEINT) AS n
  FROM found f JOIN kept k ON f.lang = k.lang AND f.term = k.term GROUP BY f.lang, f.source, f.term),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * l.v) AS p,
         1 + 1000000000 * (k.n + 2) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN totals t ON g.lang = t.lang AND g.source = t.source
  LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON a.lang = s.lang AND a.source = s.source AND b.source = s.item),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
  FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

# An example for each reply, and one for all turns where the last is no reply;
# a turn's marks and role take 24 characters more than its texts.
CHAT_FORMAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
written AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 24
            + length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A')) AS chars
  FROM turns),
placed AS (
  SELECT *, sum(chars) OVER before AS so_far, row_number() OVER before AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM written
  WINDOW before AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(sum(so_far) FILTER (WHERE role = 'assistant' OR i = n), 0) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
