"""DuckDB SQL for the rows of those queries that SQL can express."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"[^\x20\x09-\x0D]+"

OP2 = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, source, text, string_split(text, chr(10)) AS w FROM documents),
lines AS (SELECT r, i, w[i] AS line, coalesce('s' || source, 'n') AS site FROM docs, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
boiler AS (SELECT line FROM lines WHERE regexp_matches(line, '{_WORDS}') GROUP BY line HAVING count(DISTINCT site) >= 8),
clean AS (SELECT r, sum((b.line IS NOT NULL)::INT)::BIGINT AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL), '') AS t
  FROM lines l LEFT JOIN boiler b USING (line) GROUP BY r)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, length(t)::BIGINT AS n_chars, sha256(t) AS text_sha256
FROM docs LEFT JOIN clean USING (r)
"""

OP3 = f"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, coalesce({_ALNUM.format(_LOWER)}, []) AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM items, LATERAL (SELECT unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i) WHERE len(w) > 0),
docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_ALNUM.format(_LOWER)}, []) AS w FROM documents),
firsts AS (SELECT DISTINCT split_part(s, ' ', 1) AS f FROM wins),
places AS (SELECT r, i, w[i] AS f FROM docs, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
found AS (SELECT DISTINCT p.r, p.i, x.n, x.item FROM places p JOIN firsts USING (f) JOIN docs d ON d.r = p.r
  JOIN (SELECT *, split_part(s, ' ', 1) AS f FROM wins) x ON x.f = p.f
  WHERE p.i + x.n - 1 <= len(d.w) AND array_to_string(d.w[p.i:p.i + x.n - 1], ' ') = x.s),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM found, LATERAL (SELECT unnest(range(i, i + n)) AS k) GROUP BY r),
ids AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN ids USING (r)
"""

OP5 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_WORDS}'), []) AS w FROM documents),
texts AS (SELECT w, row_number() OVER () AS t, min(doc_id) AS id FROM docs WHERE len(w) > 0 GROUP BY w),
sets AS MATERIALIZED (SELECT DISTINCT t, array_to_string(w[i:i + 4], ' ') AS s FROM texts, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i)),
sizes AS MATERIALIZED (SELECT t, count(*)::BIGINT AS n FROM sets GROUP BY t),
met AS (SELECT a.t AS u, b.t AS v, count(*) AS m FROM sets a JOIN sets b ON a.s = b.s AND a.t < b.t GROUP BY ALL),
links AS MATERIALIZED (SELECT u, v FROM met JOIN sizes a ON a.t = u JOIN sizes b ON b.t = v WHERE 100 * m >= 75 * (a.n + b.n - m)),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(t, z) AS (SELECT t, t FROM sizes UNION SELECT v, z FROM reach JOIN ways ON reach.t = u),
components AS (SELECT r.t, min(id) AS least FROM reach r JOIN texts ON z = texts.t GROUP BY r.t),
found AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, doc_id) AS component_id
  FROM docs LEFT JOIN texts USING (w) LEFT JOIN sizes USING (t) LEFT JOIN components USING (t))
SELECT *, component_id IS NOT DISTINCT FROM doc_id AS kept FROM found
"""

OP9 = f"""
WITH sized AS (SELECT doc_id, source, md5('9:' || coalesce(doc_id::VARCHAR, '')) AS key,
  coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
  (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS budget FROM totals),
leveled AS (SELECT *, (budget - 2 * coalesce((sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))
  / (sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM weighed),
targets AS (SELECT source, source_size, budget, CASE WHEN 2 * source_size < level * weight THEN (2 * source_size)::DOUBLE
  ELSE weight * min(CASE WHEN NOT 2 * source_size < level * weight THEN level END) OVER () END AS target FROM leveled),
queued AS (SELECT s.*, source_size, budget, target, (sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
finished AS (SELECT *, CASE WHEN target > 0 THEN upto / target ELSE 0 END AS finish FROM queued),
copies AS (SELECT *, finish + e * source_size / target AS vt FROM finished, (VALUES (0), (1)) v(e) WHERE size > 0),
cut AS (SELECT doc_id, key, source, e, size, (sum(size) OVER (ORDER BY vt, source NULLS LAST, e, key, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT <= budget AS taken FROM copies),
taken AS (SELECT doc_id, key, source, sum(CASE WHEN taken THEN size ELSE 0 END)::BIGINT AS taken FROM cut GROUP BY ALL)
SELECT f.doc_id, f.size, f.source_size, f.target, coalesce(t.taken, 0)::BIGINT AS taken, f.finish
FROM finished f LEFT JOIN taken t ON f.key = t.key AND f.doc_id IS NOT DISTINCT FROM t.doc_id AND f.source IS NOT DISTINCT FROM t.source
"""

OP11 = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, unnest(regexp_extract_all(t, '{_WORDS}')) AS word FROM texts),
totals AS (SELECT r, count(*) AS n, count(DISTINCT word) AS d FROM words GROUP BY r),
marks AS (SELECT doc_id, max(quality) FILTER (WHERE quality = 1) AS good, max(toxic) FILTER (WHERE toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  [coalesce(n, 0) < 200, 100 * coalesce(d, 0) < 50 * coalesce(n, 0), 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t),
   regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f
  FROM texts LEFT JOIN totals USING (r) LEFT JOIN marks USING (doc_id)),
sets AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, f),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
orders AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, array_to_string([substr('ABCDE', i::INT, 1) FOR i IN o], '') AS filter_order, step, o[step] AS here, o[1:step - 1] AS before FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
counted AS (SELECT part, filter_order, step, here, n, good, toxic, f[here] AS fails, len([i FOR i IN before IF f[i]]) > 0 AS gone, len([x FOR x IN f IF x]) AS k FROM steps, sets),
report AS (SELECT part, filter_order, step, here,
  sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails AND k = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counted GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, here))::BIGINT AS shapley FROM report
"""

_TERMS = f"coalesce({_ALNUM.format(_LOWER)}, [])"
OP13 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
sizes AS (SELECT sum((len(w) > 0)::INT)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM docs),
asked AS (SELECT q, item_id, term, count(*) AS c FROM (SELECT q, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark)) GROUP BY ALL),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, sizes GROUP BY term, n_docs),
norms AS (SELECT r, 75 + (25 * len(w)::BIGINT * n_docs) // n_terms AS m FROM docs, sizes WHERE len(w) > 0),
scores AS (SELECT q, item_id, r, sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN norms USING (r) GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scores JOIN docs USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

SQL = {"op2_line_dedup": OP2, "op3_decontamination": OP3, "op5_near_duplicates": OP5, "op9_mixing": OP9, "op11_filter_audit": OP11, "op13_ranked_search": OP13}
