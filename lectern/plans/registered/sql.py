"""SQL fragments the registered checks share."""

INDEX_TOKEN = r"[\p{L}\p{N}]+"
QUERY_TOKEN = r"[\p{L}\p{N}]+(?:[_''’\-][\p{L}\p{N}]+)*"
FEATURE_TOKEN = r"[\p{L}\p{N}_]+(?:[-+][\p{L}\p{N}_]+)*"
COUNT_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def fold(x):
    return f"translate(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def strip(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def index_tokens(x):
    return f"regexp_extract_all(strip_accents(lower({x})), '{INDEX_TOKEN}')"


def feature_tokens(x):
    return f"regexp_extract_all({fold(x)}, '{FEATURE_TOKEN}')"


def count_tokens(x):
    return f"len(regexp_extract_all({x}, '{COUNT_TOKEN}'))"


def squeeze(x):
    return rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"


def math(x):
    value = f"translate({x}, '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789')"
    value = rf"regexp_replace({value}, '\b([CG])\s*\^\s*\{{?([0-9])\}}?\b', '\1\2', 'gi')"
    value = rf"regexp_replace({value}, '\b([CG])\s+([0-9])\b', '\1\2', 'gi')"
    return squeeze(value)


def idf(n, df):
    v = f"ln(({n} - {df} + 0.5::DOUBLE) / ({df} + 0.5::DOUBLE))"
    return f"CASE WHEN {v} <= 0 THEN 1e-6::DOUBLE ELSE {v} END"


def saturation(tf, dl, avgdl):
    return f"{tf} * 2.2::DOUBLE / ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {dl} / {avgdl}))"


# Canonical documents as papers.
PAPERS = rf"""
src AS (SELECT doc_id, source, lang, text, source || '/' || doc_id || '.md' AS source_path FROM documents),
canon AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY lower(source_path), source_path) AS rn FROM src) WHERE rn = 1),
named AS (SELECT *, regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g') AS first_line FROM canon),
papers AS (
  SELECT 'doc-' || doc_id AS paper_id, source AS author, source_path, text AS abstract,
    CASE WHEN first_line <> '' AND len(regexp_extract_all(first_line, '\S+')) <= 5 THEN first_line ELSE 'Document ' || doc_id END AS title
  FROM named)"""

# Postings of the papers, their lengths and the level's statistics.
POSTINGS = f"""
tokens AS (SELECT paper_id, unnest(list_concat(list_concat({index_tokens('title')}, {index_tokens('author')}), {index_tokens('abstract')})) AS term FROM papers),
post AS (SELECT paper_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
lengths AS (SELECT p.paper_id, count(t.term) AS dl FROM papers p LEFT JOIN tokens t USING (paper_id) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY ALL)"""

# Loose queries of all benchmark items, ranked by BM25.
LEXICAL = f"""
words AS (SELECT CAST(item_id AS VARCHAR) AS query_id, unnest(list_distinct(regexp_extract_all({fold(math('text'))}, '{QUERY_TOKEN}'))) AS word FROM benchmark),
asked AS (SELECT query_id, strip_accents(word) AS term FROM words),
scored AS (
  SELECT a.query_id, p.paper_id, round(sum(({idf('s.n', 'f.df')}) * {saturation('p.tf', 'l.dl', 's.avgdl')}), 9) AS score
  FROM asked a JOIN freq f USING (term) JOIN post p USING (term) JOIN lengths l USING (paper_id) CROSS JOIN stats s GROUP BY ALL),
lexical AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'paper:' || paper_id) AS rank FROM scored) WHERE rank <= 60)"""

# Papers that quote a whole benchmark item.
PADDED = "' ' || array_to_string({}, '  ') || ' '"
LINKS = f"""
quotes AS (SELECT CAST(item_id AS VARCHAR) AS entry_id, text, {PADDED.format(index_tokens('text'))} AS needle FROM benchmark),
fields AS (SELECT paper_id, title, abstract, author, {PADDED.format(index_tokens('title'))} AS t, {PADDED.format(index_tokens('author'))} AS a, {PADDED.format(index_tokens('abstract'))} AS b FROM papers),
links AS (SELECT DISTINCT entry_id, paper_id FROM quotes, fields WHERE contains(t, needle) OR contains(a, needle) OR contains(b, needle))"""


def with_(*parts, select):
    return "WITH RECURSIVE " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n" + select
