"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLE: dict[str, str] = {}

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE["op3_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, p, list_slice(w, p, p + 34) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)
),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM win JOIN rep USING (s)),
gone AS (SELECT doc_id, list(i) AS g FROM hit GROUP BY doc_id),
x AS (
  SELECT d.doc_id, w, coalesce(g, []) AS g FROM d LEFT JOIN gone USING (doc_id)
),
k AS (
  SELECT doc_id, len(w) AS n, len(g) AS r,
    list_filter(w, lambda v, i: NOT list_contains(g, i)) AS kept FROM x
)
SELECT doc_id, n AS n_words, r AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

# Links by an exact prefix-free join on shared shingles, components by repeated least labels.
ORACLE["op6_minhash_near_dedup"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
    ELSE list_transform(range(1, len(w) - 2), lambda p: list_slice(w, p, p + 3)) END) AS s FROM d
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

ORACLE["op8_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

# The given pages keep their text in one article element of h1 and p blocks.
ORACLE["op4_html_extraction"] = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1),
    '\s+', ' ', 'g'), '</?(p|h1)>', chr(10), 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM pages
),
b AS (
  SELECT page_id, url, list_filter(list_transform(string_split(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;', '"', 'g'), '&lt;', '<', 'g'), '&gt;', '>', 'g'), '&amp;?', '&', 'g'),
    chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> '') AS l FROM a
)
SELECT page_id, url, array_to_string(l, chr(10)) AS text, length(array_to_string(l, chr(10))) AS n_chars FROM b
"""

# Counts by one row for each run of words; sums and products in 128 bits.
ORACLE["op11_phrase_mining"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
),
q AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
f AS (
  SELECT lang, g, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(range(1, len(w) - m + 2), lambda i: list_slice(w, i, i + m - 1))) AS g
    FROM (SELECT lang, w, unnest(range(1, 6)) AS m FROM q) WHERE len(w) >= m
  ) GROUP BY lang, g
),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM q GROUP BY lang),
c AS (SELECT lang, g, f AS a FROM f WHERE len(g) >= 2 AND f >= 100),
k AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM c),
s AS (
  SELECT k.lang, k.g, a, k, x.f AS l, y.f AS r, n, (CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM k JOIN n USING (lang) JOIN f x ON x.lang = k.lang AND x.g = list_slice(k.g, 1, k) JOIN f y ON y.lang = k.lang AND y.g = list_slice(k.g, k + 1, len(k.g))
),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT b.lang, b.g FROM c JOIN (SELECT 1) ON true, unnest(range(2, len(c.g))) t(m), unnest(range(1, len(c.g) - m + 2)) u(i)
  JOIN c b ON b.lang = c.lang AND b.g = list_slice(c.g, i, i + m - 1) AND c.a >= b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
  array_to_string(g, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best ANTI JOIN inside USING (lang, g)
QUALIFY rank <= 2000
"""
