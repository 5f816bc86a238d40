"""DuckDB statements for the operators that SQL can express."""

URL_RULES = """
WITH rules(r_host, r_path, r_verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
fits AS (
  SELECT n, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM named JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM named LEFT JOIN fits USING (n)
"""

SOURCE_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('mix:', coalesce(doc_id::VARCHAR, ''), ':', coalesce(md5(text), ''))) AS ord
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 3.0::DOUBLE * source_size AS top,
         (sum(source_size) OVER ()::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM sources
  WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(top, coalesce((arg_min(level, top / weight) FILTER (top > level * weight) OVER ()) * weight, top)) AS target FROM levels),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY p.source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * least(epochs + CASE WHEN start + size / 2.0 <= rest THEN 1 ELSE 0 END, 3))::BIGINT AS taken FROM placed
"""

BENCHMARK_CONTAMINATION = r"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM items, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT n, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM docs, sizes, unnest(generate_series(1, len(w) - size + 1)) AS t(i) WHERE len(w) >= size),
found AS (SELECT n, p.size, i, item_id FROM places p JOIN windows USING (size, win)),
covered AS (SELECT n, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT n, i, size FROM found), unnest(generate_series(0, size - 1)) AS t(j) GROUP BY n),
named AS (SELECT n, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT n, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (n) LEFT JOIN named USING (n)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS s
  FROM docs, unnest(generate_series(1, len(w) - least(4, len(w)) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY x, y),
links AS (
  SELECT x, y FROM pairs JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id WHERE 100 * common >= 80 * (a.n + b.n - common)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reached AS (
  SELECT x, y FROM both_ways
  UNION
  SELECT r.x, b.y FROM reached r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(y), d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(min(y), d.doc_id)) AS kept
FROM docs d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN reached r ON r.x = d.doc_id
GROUP BY d.doc_id
"""

PHRASE_COLLOCATIONS = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM docs, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS u(piece)),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM pieces, unnest(generate_series(1, len(w))) AS a(i), unnest(generate_series(1, 4)) AS b(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
words AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
frequent AS (SELECT lang, k AS size, string_split(phrase, ' ') AS w, phrase, f FROM grams WHERE f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.f) // (x.f + y.f))::BIGINT AS score
  FROM frequent c, unnest(generate_series(1, c.size - 1)) AS t(k)
  JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.size], ' ')
  WHERE c.size > 1),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer
  FROM frequent, unnest(generate_series(2, size - 1)) AS a(m), unnest(generate_series(1, 3)) AS b(i) WHERE size > 2 AND i + m - 1 <= size GROUP BY ALL),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN around USING (lang, phrase) WHERE NOT coalesce(100::HUGEINT * longer >= 80::HUGEINT * a, FALSE))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN words USING (lang) QUALIFY rank <= 2000
"""

RANKED_SEARCH = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
sizes AS (SELECT d, doc_id, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0),
whole AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
wanted AS (SELECT i, item_id, t, count(*) AS q FROM (SELECT i, item_id, unnest(w) AS t FROM items) GROUP BY ALL),
tfs AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM wanted) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::BIGINT AS weight FROM (SELECT t, count(*) AS df FROM tfs GROUP BY t), whole),
scores AS (
  SELECT i, item_id, doc_id, d, sum(q * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM wanted JOIN weights USING (t) JOIN tfs USING (t) JOIN sizes USING (d), whole GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""

REPEATED_PASSAGES = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT d, i, array_to_string(w[i:i + 34], ' ') AS win FROM docs, unnest(generate_series(1, len(w) - 34)) AS t(i) WHERE len(w) >= 35),
repeated AS (SELECT d, i FROM windows QUALIFY count(*) OVER (PARTITION BY win) > 1),
gone AS (SELECT DISTINCT d, i + j AS place FROM repeated, unnest(generate_series(0, 34)) AS t(j)),
removed AS (SELECT d, count(*) AS n FROM gone GROUP BY d),
words AS (SELECT d, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM docs),
stay AS (SELECT d, string_agg(word, ' ' ORDER BY place) AS text FROM words ANTI JOIN gone USING (d, place) GROUP BY d)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(s.text, '')) AS kept_sha256
FROM docs LEFT JOIN removed r USING (d) LEFT JOIN stay s USING (d)
"""

STATEMENTS = {"op13_repeated_passages": REPEATED_PASSAGES, "op12_ranked_search": RANKED_SEARCH, "op11_phrase_collocations": PHRASE_COLLOCATIONS, "op1_near_duplicates": NEAR_DUPLICATES, "op6_benchmark_contamination": BENCHMARK_CONTAMINATION, "op5_url_rules": URL_RULES, "op10_source_mix": SOURCE_MIX}
