"""DuckDB SQL that gives the same rows as registered queries of this subpackage."""

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST({WORDS} AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS tie
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM (SELECT *, 2 * source_size::DOUBLE AS most, 2 * source_size::DOUBLE / weight AS full_at, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget FROM totals)
), targets AS (
  SELECT source, source_size, weight, budget,
         CASE WHEN level >= full_at THEN most
              ELSE weight * (budget - coalesce(sum(CASE WHEN level >= full_at THEN most END) OVER (), 0.0)) / sum(CASE WHEN level < full_at THEN weight END) OVER () END AS target
  FROM filled
), queued AS (
  SELECT s.*, t.source_size, t.weight, t.target, t.budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY tie, doc_id, s.size ROWS UNBOUNDED PRECEDING)::BIGINT AS done
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), items AS (
  SELECT doc_id, source, size, tie, e, budget, (e * source_size + done - size / 2) / weight AS moment
  FROM queued, (VALUES (0), (1)) v(e) WHERE size > 0
), served AS (
  SELECT *, sum(size) OVER (ORDER BY moment, tie, e ROWS UNBOUNDED PRECEDING) AS so_far FROM items
), kept AS (
  SELECT doc_id, source, sum(size)::BIGINT AS taken FROM served WHERE so_far <= budget GROUP BY doc_id, source
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken, q.source
FROM queued q LEFT JOIN kept k ON q.doc_id = k.doc_id AND q.source IS NOT DISTINCT FROM k.source
"""

NEAR_DUPLICATE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), listed AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words
), sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM listed),
shingles AS MATERIALIZED (SELECT doc_id, unnest(s) AS s FROM listed),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 85 * ((SELECT n FROM sized WHERE doc_id = a.doc_id) + (SELECT n FROM sized WHERE doc_id = b.doc_id) - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sized
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, s.n AS n_shingles, component_id, s.doc_id = component_id AS kept FROM sized s JOIN least USING (doc_id)
"""

PHRASE_SQL = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM lowered),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM listed GROUP BY lang),
grams AS (
  SELECT lang, s, unnest([array_to_string(w[i:i + s - 1], ' ') FOR i IN range(1, len(w) - s + 2)]) AS phrase
  FROM listed, (VALUES (1), (2), (3), (4)) v(s) WHERE len(w) >= s
), f AS (SELECT lang, s, phrase, count(*) AS n FROM grams GROUP BY lang, s, phrase HAVING count(*) >= 30),
candidates AS (SELECT lang, s, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE s > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:s], ' ') AS rp
  FROM candidates c, (VALUES (1), (2), (3)) v(k) WHERE k < s
), scored AS (
  SELECT u.lang, u.phrase, u.a, u.k, l.n AS l, r.n AS r, CAST((2000000::HUGEINT * u.a) // (l.n + r.n) AS BIGINT) AS score
  FROM cuts u JOIN f l ON l.lang = u.lang AND l.phrase = u.lp JOIN f r ON r.lang = u.lang AND r.phrase = u.rp
), worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS first FROM scored) WHERE first = 1),
inner_parts AS (
  SELECT c.lang, array_to_string(w[i:i + t - 1], ' ') AS phrase, c.a AS longer
  FROM candidates c, (VALUES (1), (2), (3)) p(i), (VALUES (2), (3)) q(t) WHERE t < s AND i + t - 1 <= s
), around AS (SELECT lang, phrase, max(longer) AS most FROM inner_parts GROUP BY lang, phrase),
kept AS (SELECT w.* FROM worst w LEFT JOIN around o USING (lang, phrase) WHERE o.most IS NULL OR 100::HUGEINT * o.most < 80::HUGEINT * w.a)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang)
) WHERE rank <= 2000
"""

HARD_NEGATIVE_SQL = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM sound a JOIN sound b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
