"""DuckDB SQL for the queries that SQL can express."""

from faultline.llm import quality

_SPACE = "[ \\t\\n\\x0b\\f\\r]+"

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '{_SPACE}'), lambda x: x <> '') AS ws FROM d),
wins AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS p, ws FROM w WHERE len(ws) >= 5),
grams AS (SELECT doc_id, p, array_to_string(ws[p:p + 4], ' ') AS g FROM wins),
twice AS (SELECT doc_id, p FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p + j) AS n FROM twice, range(0, 5) AS r(j) GROUP BY doc_id),
raw AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
l AS (SELECT doc_id, host, i, line, regexp_matches(line, '[^ \\t\\n\\x0b\\f\\r]') AS worded,
  trim(lower(regexp_replace(line, '[ \\t\\x0b\\f\\r]+', ' ', 'g'))) AS norm FROM raw),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE worded GROUP BY doc_id),
c AS (SELECT doc_id, host, norm FROM l),
whole AS (SELECT doc_id, string_agg(norm, chr(10) ORDER BY i) AS a FROM l GROUP BY doc_id),
sizes AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
counted AS (SELECT host, norm, count(*) AS n FROM (SELECT DISTINCT host, norm, a FROM c JOIN whole USING (doc_id) WHERE norm <> '') GROUP BY host, norm),
boiler AS (SELECT host, norm FROM counted JOIN sizes USING (host) WHERE n > {quality.LINE_DOCS} AND n > {quality.LINE_SHARE} * docs),
cut AS (SELECT doc_id, count(*) AS lines, sum(length(norm)) AS chars FROM c JOIN boiler USING (host, norm) GROUP BY doc_id),
total AS (SELECT doc_id, sum(length(norm)) AS chars FROM c GROUP BY doc_id),
b AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < {quality.FEWEST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM b)
SELECT f.*, CAST(coalesce(cut.lines, 0) AS BIGINT) AS n_lines_cut,
  CAST(total.chars - coalesce(cut.chars, 0) AS BIGINT) AS chars_left,
  NOT base_failed AND total.chars - coalesce(cut.chars, 0) >= {quality.LEAST_LEFT} * total.chars AS kept
FROM f JOIN total USING (doc_id) LEFT JOIN cut USING (doc_id)
"""

_NOT_SPACE = "list_filter(regexp_split_to_array(t, '" + _SPACE + "'), lambda x: x <> '')"

AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_NOT_SPACE} AS ws FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT w.doc_id, part, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
  + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
  + 16 * CAST(coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS INT) AS m FROM w),
g AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a, x b, x c, x d, x e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before
  FROM o, unnest(range(1, 6)) AS r(step)),
r AS (SELECT part, filter_order, step, own,
  sum(n) FILTER (m & (before | own) = 0) AS kept, sum(n) FILTER (m & before = 0 AND m & own > 0) AS removed,
  sum(n) FILTER (m & before > 0 AND m & own > 0) AS redundant, sum(n) FILTER (m = own) AS unique_fails,
  sum(good) FILTER (m & before = 0 AND m & own > 0) AS good_lost, sum(bad) FILTER (m & before = 0 AND m & own > 0) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM r
"""

COLLOCATIONS = """
WITH d AS (SELECT row_number() OVER () AS i, coalesce(CAST(lang AS VARCHAR), 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT i, lang, unnest(regexp_split_to_array(t, '[.,;:!?\\n\\x0b\\f\\r]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, ws[j:j + m - 1] AS words FROM (SELECT lang, m, ws, unnest(range(1, len(ws) - m + 2)) AS j
  FROM w, unnest(range(1, 5)) AS r(m))),
f AS (SELECT lang, m, words, array_to_string(words, ' ') AS phrase, count(*) AS f FROM g GROUP BY lang, m, words HAVING count(*) >= 30),
inner_of AS (SELECT lang, array_to_string(words[k:k + len - 1], ' ') AS phrase, max(f) AS longer
  FROM f, unnest(range(1, 4)) AS a(k), unnest(range(2, 4)) AS b(len) WHERE len < m AND k + len - 1 <= m GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN inner_of USING (lang, phrase) WHERE m > 1 AND (longer IS NULL OR 100 * longer < 80 * f)),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.f // (l.f + r.f) AS BIGINT) AS score
  FROM c, unnest(range(1, 4)) AS x(k), f AS l, f AS r WHERE k < c.m AND l.lang = c.lang AND r.lang = c.lang
  AND l.phrase = array_to_string(c.words[1:k], ' ') AND r.phrase = array_to_string(c.words[k + 1:c.m], ' ')),
b AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
