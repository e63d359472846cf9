"""The same questions as SQL for DuckDB, where SQL can express them."""

from contrastmill.llm.license_scan import TEMPLATES, THRESHOLD

SQL: dict[str, str] = {}

SQL["op3_mixing"] = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), turns AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM sizes
), weighted AS (
  SELECT *, [5, 2, 1][turn % 3 + 1] AS weight, 3 * source_size AS most, sum(source_size) OVER () AS everything FROM turns
), ordered AS (
  SELECT *, coalesce(sum(most) OVER w, 0)::BIGINT AS used,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weights_left
  FROM weighted
  WINDOW w AS (ORDER BY most / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, most * weights_left <= (everything - used) * weight AS full_up FROM ordered
), share AS (
  SELECT (everything - used)::BIGINT AS words_left, weights_left FROM levels WHERE NOT full_up ORDER BY most / weight, turn LIMIT 1
), targets AS (
  SELECT source, source_size, turn,
         CASE WHEN full_up THEN most::DOUBLE ELSE (words_left * weight)::DOUBLE / share.weights_left END AS target
  FROM levels LEFT JOIN share ON true
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.turn,
         coalesce(sum(d.size) OVER (PARTITION BY t.turn ORDER BY md5(d.doc_id::VARCHAR), d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), epochs AS (
  SELECT *, floor(target)::BIGINT AS goal, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS n FROM placed
), taken AS (
  SELECT *, n * size + greatest(0, least(size, goal - n * source_size - ahead)) AS taken, least(ahead / greatest(target, 1.0), 1.0) AS share
  FROM epochs
)
SELECT doc_id, size::BIGINT AS size, source_size, target, taken::BIGINT AS taken,
  CASE WHEN taken = 0 THEN NULL
       WHEN turn % 3 = 0 THEN CASE WHEN share > 0 THEN least(2 * share / (1.5 + sqrt(greatest(2.25 - 2 * share, 0))), 1.0) ELSE 0.0 END
       WHEN turn % 3 = 1 THEN share
       WHEN share < 0.375 THEN CASE WHEN share > 0 THEN 2 * share / (0.5 + sqrt(0.25 + 2 * share)) ELSE 0.0 END
       ELSE least(0.5 + CASE WHEN share > 0.375 THEN 2 * (share - 0.375) / (1 + sqrt(1 + 2 * (share - 0.375))) ELSE 0.0 END, 1.0)
  END AS position
FROM taken
"""

_SEARCH = """
WITH v AS (
  SELECT vec_id, {vector} AS e FROM embeddings
  WHERE len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0{more}
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e){cast} AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % {every} = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= {k}
"""

SQL["op4_top_k_search"] = _SEARCH.format(
    vector="list_transform(embedding, lambda x: floor(256 * x::DOUBLE))", more="", cast="::BIGINT", every=50, k=5
)
SQL["op9_nearest_neighbours"] = _SEARCH.format(
    vector="embedding::DOUBLE[]", more=" AND len(list_filter(embedding, lambda x: x <> 0)) > 0", cast="", every=20, k=20
)


def _license_sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEMPLATES.items()))
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    words = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"""
WITH templates AS (
  SELECT license, {pairs} AS b FROM (SELECT license, {words.format("body")} AS w FROM (VALUES {quoted}) t(license, body))
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number FROM documents
), split AS (
  SELECT doc_id, text, string_split_regex(text, '\\n[ \\t\\r]*\\n\\s*') AS ps FROM documents
), units AS (
  SELECT doc_id, 'line' AS unit, number, part FROM lines
  UNION ALL
  SELECT doc_id, 'paragraph', number, part
  FROM (SELECT doc_id, unnest(ps) AS part, generate_subscripts(ps, 1) - 1 AS number FROM split) WHERE contains(part, chr(10))
  UNION ALL
  SELECT doc_id, 'document', 0, text FROM split WHERE len(ps) > 1
), sets AS (
  SELECT doc_id, unit, number, {pairs} AS b FROM (SELECT doc_id, unit, number, {words.format("part")} AS w FROM units)
), scored AS (
  SELECT s.doc_id, s.unit, s.number, t.license, 2.0::DOUBLE * len(list_intersect(s.b, t.b)) / (len(s.b) + len(t.b)) AS dice, len(s.b) AS n_bigrams
  FROM sets s JOIN templates t ON 2 * least(len(s.b), len(t.b)) >= {THRESHOLD} * (len(s.b) + len(t.b)) AND len(s.b) > 0
)
SELECT doc_id, unit, number::BIGINT AS number, license, dice, n_bigrams::INTEGER AS n_bigrams
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, unit, number ORDER BY dice DESC, license) AS place FROM scored)
WHERE place = 1 AND dice >= {THRESHOLD}
"""


SQL["op10_license_scan"] = _license_sql()

SQL["op6_ngram_jaccard"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN ['short ' || array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), rows AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets
), shared AS (
  SELECT token FROM rows GROUP BY token HAVING count(*) > 1
), common_tokens AS (
  SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS common
  FROM rows a JOIN shared USING (token) JOIN rows b USING (token)
  WHERE a.doc_id <> b.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY ALL
), links AS (
  SELECT u, v FROM common_tokens WHERE 100 * common >= 80 * (m + n - common)
), reached AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, l.v FROM reached r JOIN links l ON r.other = l.u
), smallest AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN smallest USING (doc_id)
"""

SQL["op13_spelling_variants"] = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL HAVING len(run) > 6
), bytes AS (
  SELECT run, n, flatten(list_transform(string_split(concat(doc_id::VARCHAR, ':', run), ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END)) AS b
  FROM counted
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM bytes, crc
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING sum(n) > 1 AND len(word) > 6
), gaps AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
  FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION
  SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.head || g.tail = w.word
  UNION
  SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.head || g.tail = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 10 * w.n THEN b.most END AS form_n,
         (SELECT min(x.other) FROM near x WHERE x.word = w.word AND x.n = b.most AND b.most >= 10 * w.n) AS form
  FROM words w LEFT JOIN best b USING (word)
), chain AS (
  WITH RECURSIVE step AS (
    SELECT word, word AS root, form AS next FROM forms
    UNION ALL
    SELECT s.word, f.word, f.form FROM step s JOIN forms f ON s.next = f.word
  )
  SELECT word, root FROM step WHERE next IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chain USING (word)
"""

SQL["op11_lexical_search"] = r"""
WITH folded AS (
  SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), split AS (
  SELECT row, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM folded
), totals AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM split WHERE len(terms) > 0
), item_terms AS (
  SELECT item, item_id, term, count(*) AS repeats
  FROM (SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS item, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)))
  GROUP BY ALL
), occurrences AS (
  SELECT row, doc_id, n, term, count(*) AS tf
  FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM split)
  WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM occurrences, totals GROUP BY term, n_docs
), impacts AS (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))) AS impact
  FROM occurrences JOIN weights USING (term), totals
), scores AS (
  SELECT item, item_id, row, doc_id, sum(repeats * impact)::BIGINT AS score FROM item_terms JOIN impacts USING (term) GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""
