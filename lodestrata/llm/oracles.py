"""DuckDB SQL for the queries, or the columns of queries, that SQL can express on whole tables."""

NEAR_DEDUP = r"""WITH RECURSIVE words AS (
    SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS g FROM words WHERE len(w) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * same >= 85 * (x.n + y.n - same)
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT b, low FROM reach JOIN both_ways ON node = a WHERE low < b
), components AS (
    SELECT node, min(low) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN components ON node = doc_id"""

_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"

PII_COUNTS = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (
    SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
        [{_DIGITS} FOR x IN regexp_extract_all(t, '[0-9]([ -]?[0-9])+')] AS card, [{_DIGITS} FOR x IN regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]')] AS phone FROM d
)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email,
    CAST(len([x FOR x IN ip IF len([p FOR p IN string_split(x, '.') IF length(ltrim(p, '0')) > 3 OR CAST('0' || left(ltrim(p, '0'), 4) AS INTEGER) > 255]) = 0]) AS BIGINT) AS n_ip,
    CAST(len([x FOR x IN card IF length(x) BETWEEN 12 AND 19 AND list_sum([CASE WHEN (length(x) - i) % 2 = 0 THEN CAST(x[i] AS INTEGER) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(x[i] AS INTEGER) + 1] END FOR i IN range(1, length(x) + 1)]) % 10 = 0]) AS BIGINT) AS n_card,
    CAST(len([x FOR x IN phone IF length(x) BETWEEN 9 AND 15]) AS BIGINT) AS n_phone FROM m"""

QUALITY_COUNTS = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents), words AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d
), windows AS (
    SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), twice AS (
    SELECT r, s FROM windows GROUP BY ALL HAVING count(*) > 1
), covered AS (
    SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows JOIN twice USING (r, s)) GROUP BY r
), again AS (
    SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), counts AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(again.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words FROM words LEFT JOIN again USING (r) LEFT JOIN covered USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts"""


def _places(phrase: str) -> str:
    words = phrase.split()
    there = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    return f"[i - 1 FOR i IN range(1, len(w) - {len(words) - 2}) IF {there}]"


LICENSE_PLACES = rf"""WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), found AS (
    SELECT doc_id, len(w) AS n, {_places("apache license")} AS apache, {_places("cc by")} AS cc, {_places("gnu general public license")} AS gpl, {_places("mit license")} AS mit FROM words
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(apache) + len(cc) + len(gpl) + len(mit) AS BIGINT) AS n_base,
    CAST(least(list_min(apache), list_min(cc), list_min(gpl), list_min(mit)) AS BIGINT) AS first_word, CAST(greatest(list_max(apache), list_max(cc), list_max(gpl), list_max(mit)) AS BIGINT) AS last_word,
    concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels FROM found"""

MIXING = r"""WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS h FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source
), filled AS (
    SELECT *, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights, sum(3 * source_size) OVER o - 3 * source_size AS capped, sum(weight) OVER o - weight AS lighter
    FROM sources WINDOW o AS (ORDER BY source_size * 6 // weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), targets AS (
    SELECT source, source_size, least((SELECT max(CAST(words - capped AS DOUBLE) / CAST(weights - lighter AS DOUBLE)) FROM filled) * weight, CAST(3 * source_size AS DOUBLE)) AS target FROM filled
), streams AS (
    SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS words, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
    FROM d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, CAST(list_sum([greatest(0, least(words, p * source_size + start + size) - p * source_size - start) FOR p IN [0, 1, 2]]) AS BIGINT) AS taken FROM streams"""

HARD_NEGATIVES = r"""WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER o <= 5"""

# crc32 by its table, made of its polynomial; the near words by what is left without one character, or with any in its place
SPELLING = r"""WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), runs AS (
    SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL
), hashed AS (
    SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), ord(c) - 64] END))),
        lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS INTEGER) + 1])), CAST(4294967295 AS BIGINT)) AS h FROM runs, crc
), words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), holes AS (
    SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS kept, left(word, i) || substr(word, i + 2) AS without FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.kept = b.kept AND a.word <> b.word
    UNION SELECT w.word, h.word, h.n FROM words w JOIN holes h ON w.word = h.without UNION SELECT h.word, w.word, w.n FROM words w JOIN holes h ON w.word = h.without
), top AS (
    SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word
), formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN (SELECT min(other) FROM near x WHERE x.word = words.word AND x.m = top.m) END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM words LEFT JOIN top USING (word)
), chain AS (
    SELECT word, word AS place, form AS onward FROM formed UNION ALL SELECT chain.word, formed.word, formed.form FROM chain JOIN formed ON chain.onward = formed.word
)
SELECT word, form, place AS root, n, n_near, form_n FROM formed JOIN chain USING (word) WHERE onward IS NULL"""

ORACLES = {"op7_near_dedup": NEAR_DEDUP, "op11_mixing": MIXING, "op12_hard_negatives": HARD_NEGATIVES, "op13_spelling": SPELLING, "pii_counts": PII_COUNTS, "quality_counts": QUALITY_COUNTS, "license_places": LICENSE_PLACES}
