"""Registered queries: parsing, hierarchy, identity, catalog and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.config import ChunkSettings
from lectern.functions import folds
from lectern.functions import text as tx
from lectern.operators import catalog, entities, hierarchy, identity, metadata
from lectern.operators.sections import chunk_sections, number_chunks, parse_sections
from lectern.plans.corpus_data import open_corpus
from lectern.plans.registered import sql as q
from lectern.session import computed_once, settle, spread
from lectern.sources import tables


def _documents(spark, folder):
    return spread(tables.table(spark, folder, "documents"))


def token_counts(spark, folder):
    return _documents(spark, folder).select("doc_id", tx.token_count(F.col("text")).cast("bigint").alias("tokens"))


def math_normalize(spark, folder):
    return _documents(spark, folder).select("doc_id", F.md5(tx.normalize_math(F.col("text"))).alias("normalized"))


def index_folding(spark, folder):
    """Index tokens of every page, as a count and a digest of their sequence."""
    tokens = tx.index_tokens(F.col("html"))
    return spread(tables.table(spark, folder, "pages")).select("page_id", F.size(tokens).cast("bigint").alias("tokens"), F.md5(F.array_join(tokens, " ")).alias("digest"))


# Markdown rendition of the canonical documents, line by line, as SQL.
LINES_SQL = rf"""
raw_lines AS (SELECT paper_id, title, i - 1 AS pos, parts[i] AS line, len(regexp_extract_all(parts[i], '\S+')) AS words FROM (
  SELECT paper_id, title, string_split(abstract, chr(10)) AS parts, unnest(range(1, len(string_split(abstract, chr(10))) + 1)) AS i FROM papers)),
bodies AS (SELECT paper_id, title, pos, CASE WHEN words = 0 THEN '' WHEN words <= 5 THEN
    CASE WHEN pos = 0 THEN '# ' WHEN words <= 2 THEN '## ' ELSE '### ' END || {q.strip('line')} ELSE line END AS body FROM raw_lines),
md AS (
  SELECT paper_id, title, pos * 3 AS n, '<!-- page: ' || (pos // 10 + 1) || ' -->' AS line, pos // 10 + 1 AS page FROM bodies WHERE pos % 10 = 0
  UNION ALL SELECT paper_id, title, pos * 3 + 1, body, NULL FROM bodies
  UNION ALL SELECT paper_id, title, pos * 3 + 2, '', NULL FROM bodies),
coded AS (SELECT paper_id, title, row_number() OVER (PARTITION BY paper_id ORDER BY n) AS n, line, page,
  regexp_extract(line, '^ {{0,3}}(#{{1,6}})[ \t]+(.+?)[ \t]*#*[ \t]*$', 1) AS marks, regexp_extract(line, '^ {{0,3}}(#{{1,6}})[ \t]+(.+?)[ \t]*#*[ \t]*$', 2) AS name,
  len(regexp_extract_all(line, '\$\$')) % 2 = 1 AS odd FROM md),
state AS (
  SELECT paper_id, 1 AS n, false AS inside FROM coded WHERE n = 1
  UNION ALL
  SELECT s.paper_id, s.n + 1, CASE WHEN c.page IS NOT NULL OR (c.marks <> '' AND NOT s.inside) THEN s.inside ELSE s.inside <> c.odd END
  FROM state s JOIN coded c ON c.paper_id = s.paper_id AND c.n = s.n),
flagged AS (SELECT c.*, s.inside, c.marks <> '' AND NOT s.inside AS is_head, trim(line) = '' AS blank,
  max(page) OVER (PARTITION BY c.paper_id ORDER BY c.n) AS cur_page FROM coded c JOIN state s ON s.paper_id = c.paper_id AND s.n = c.n),
owned AS (SELECT *, count_if(is_head) OVER (PARTITION BY paper_id ORDER BY n) AS head_no,
  min(CASE WHEN NOT blank AND page IS NULL THEN n END) OVER (PARTITION BY paper_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_n,
  max(CASE WHEN NOT blank THEN n END) OVER (PARTITION BY paper_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_n,
  count_if(is_head) OVER (PARTITION BY paper_id) AS heads FROM flagged)"""
SECTIONS_SQL = LINES_SQL + r""",
placed AS (SELECT o.paper_id, o.title, o.n, o.line, o.page, o.cur_page, o.blank, o.is_head, o.heads, o.inside, o.marks, o.name,
  CASE WHEN o.heads = 0 THEN NULL
    WHEN o.page IS NOT NULL AND NOT o.inside AND h.is_head THEN o.head_no + 1 ELSE o.head_no END AS part,
  o.blank AND prev.page IS NOT NULL AND NOT prev.inside AS dropped
  FROM owned o LEFT JOIN flagged h ON h.paper_id = o.paper_id AND h.n = o.next_n LEFT JOIN flagged prev ON prev.paper_id = o.paper_id AND prev.n = o.last_n),
fallback AS (SELECT *, count_if(page IS NOT NULL AND NOT inside) OVER (PARTITION BY paper_id ORDER BY n) AS seg FROM placed WHERE heads = 0),
rows_ AS (
  SELECT paper_id, title, part, n, line, cur_page, blank, page IS NOT NULL AS is_page, is_head, marks, name FROM placed WHERE heads > 0 AND NOT dropped
  UNION ALL SELECT paper_id, title, seg, n, line, CASE WHEN page IS NOT NULL THEN page END, blank, page IS NOT NULL, false, '', '' FROM fallback),
grouped AS (SELECT paper_id, any_value(title) AS title, part, bool_or(is_head) AS headed,
  max(CASE WHEN is_head THEN len(marks) END) AS level, max(CASE WHEN is_head THEN name END) AS name,
  string_agg(CASE WHEN NOT is_head THEN line END, chr(10) ORDER BY n) AS body,
  coalesce(min(CASE WHEN NOT is_head THEN cur_page END), min(cur_page)) AS lo, coalesce(max(CASE WHEN NOT is_head THEN cur_page END), max(cur_page)) AS hi,
  bool_or(NOT is_head AND NOT blank AND NOT is_page) AS has_text, any_value(f.heads) AS heads
  FROM rows_ JOIN (SELECT paper_id, any_value(heads) AS heads FROM placed GROUP BY ALL) f USING (paper_id) GROUP BY paper_id, part),
kept AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY part) - 1 AS section_order FROM grouped WHERE headed OR has_text OR heads = 0),
cleaned AS (SELECT *, CASE WHEN headed THEN name WHEN heads > 0 THEN title WHEN lo = hi THEN 'Page ' || lo ELSE 'Pages ' || lo || '–' || hi END AS heading,
  CASE WHEN headed THEN level ELSE 1 END AS lvl FROM kept),
tree AS (SELECT c.paper_id, c.section_order, max(p.section_order) AS parent_order FROM cleaned c
  LEFT JOIN cleaned p ON p.paper_id = c.paper_id AND p.section_order < c.section_order AND p.lvl < c.lvl AND p.headed AND c.headed GROUP BY ALL),
full_ AS (SELECT c.*, t.parent_order FROM cleaned c JOIN tree t USING (paper_id, section_order)),
walk AS (
  SELECT paper_id, section_order, parent_order AS up, heading AS path, [section_order] AS trail FROM full_
  UNION ALL SELECT w.paper_id, w.section_order, f.parent_order, f.heading || ' > ' || w.path, list_append(w.trail, f.section_order) FROM walk w JOIN full_ f ON f.paper_id = w.paper_id AND f.section_order = w.up),
paths AS (SELECT paper_id, section_order, path, trail FROM walk WHERE up IS NULL),
spans AS (SELECT p.paper_id, t.anc AS section_order, min(f.lo) AS page_start, max(f.hi) AS page_end
  FROM (SELECT paper_id, section_order, unnest(trail) AS anc FROM paths) t JOIN paths p USING (paper_id, section_order) JOIN full_ f USING (paper_id, section_order) GROUP BY ALL),
sections AS (SELECT f.paper_id, f.section_order, f.parent_order, f.lvl AS level, f.heading, p.path AS heading_path, s.page_start, s.page_end,
  regexp_replace(coalesce(f.body, ''), '^\s+|\s+$', '', 'g') AS text
  FROM full_ f JOIN paths p USING (paper_id, section_order) JOIN spans s USING (paper_id, section_order))"""


def markdown_sections(spark, folder):
    """Heading tree of every canonical document rendered as Markdown."""
    papers = tables.paper_rows(identity.deduplicate(tables.markdown_files(spark, folder)))
    parsed = parse_sections(papers.select("paper_id", "title", "markdown"))
    return parsed.select("paper_id", "section_order", "parent_order", "level", "heading", "heading_path", "page_start", "page_end", F.md5("text").alias("text_digest"))


MARKDOWN_SQL = q.with_(q.PAPERS, SECTIONS_SQL, select="""
SELECT paper_id, CAST(section_order AS INT) AS section_order, CAST(parent_order AS INT) AS parent_order, CAST(level AS INT) AS level, heading, heading_path,
  CAST(page_start AS INT) AS page_start, CAST(page_end AS INT) AS page_end, md5(text) AS text_digest FROM sections""")


def outline_counts(spark, folder):
    """Sections per paper and level of the written snapshot."""
    index = open_corpus(spark, folder)
    rows = hierarchy.outline(index.papers, index.sections)
    return rows.groupBy("paper_id", "level").agg(F.count("*").alias("sections"), F.count("parent_order").alias("children"), F.max(F.length("heading_path")).cast("bigint").alias("longest_path"))


OUTLINE_SQL = q.with_(q.PAPERS, SECTIONS_SQL, select="""
SELECT paper_id, CAST(level AS INT) AS level, count(*) AS sections, count(parent_order) AS children, CAST(max(length(heading_path)) AS BIGINT) AS longest_path FROM sections GROUP BY paper_id, level""")


def math_aware_chunks(spark, folder):
    index = open_corpus(spark, folder)
    return index.chunks.select("paper_id", "chunk_index", "section_order", "heading_path", "token_count", "page_start", "page_end", "text")


UNMARKED = r"regexp_replace(text, '<!--\s*page\s*:\s*\d+\s*-->', '', 'gi')"


def chunk_token_totals(spark, folder):
    """Chunking loses no token: totals of each section against its text."""
    index = open_corpus(spark, folder)
    return index.chunks.groupBy("paper_id", "section_order").agg(F.sum("token_count").alias("tokens"))


CHUNK_TOTALS_SQL = q.with_(q.PAPERS, SECTIONS_SQL, select=rf"""
SELECT paper_id, CAST(section_order AS INT) AS section_order, tokens FROM (SELECT paper_id, section_order, CAST({q.count_tokens(UNMARKED)} AS BIGINT) AS tokens FROM sections) WHERE tokens > 0""")


def paragraph_packing(spark, folder):
    """Lines of every document packed to groups of 30 to 80 tokens, with the short tail joined."""
    rows = _documents(spark, folder).select("doc_id", F.transform(F.split("text", "\n"), tx.token_count).alias("counts"))
    packed = rows.withColumn("groups", folds.packer(60, 80, 30)("counts"))
    lines = packed.select("doc_id", F.inline(F.arrays_zip("counts", "groups")))
    return lines.groupBy("doc_id", "groups").agg(F.count("*").alias("lines"), F.sum("counts").alias("tokens")).withColumnRenamed("groups", "group_no").withColumn("group_no", F.col("group_no").cast("bigint"))


PACKING_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, i, {q.count_tokens('parts[i]')} AS t FROM (
  SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
p AS (
  SELECT doc_id, i, t, CAST(0 AS BIGINT) AS g, t AS total FROM l WHERE i = 1
  UNION ALL
  SELECT l.doc_id, l.i, l.t, CASE WHEN p.total >= 60 OR p.total + l.t > 80 THEN p.g + 1 ELSE p.g END, CASE WHEN p.total >= 60 OR p.total + l.t > 80 THEN l.t ELSE p.total + l.t END
  FROM p JOIN l ON l.doc_id = p.doc_id AND l.i = p.i + 1),
s AS (SELECT doc_id, g, count(*) AS lines, CAST(sum(t) AS BIGINT) AS tokens FROM p GROUP BY ALL),
m AS (SELECT *, max(g) OVER (PARTITION BY doc_id) AS last_g, lead(tokens) OVER (PARTITION BY doc_id ORDER BY g) AS next_tokens, lag(tokens) OVER (PARTITION BY doc_id ORDER BY g) AS prev_tokens FROM s)
SELECT doc_id, CASE WHEN g > 0 AND g = last_g AND tokens < 30 AND prev_tokens + tokens <= 80 THEN g - 1 ELSE g END AS group_no, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(tokens) AS BIGINT) AS tokens FROM m GROUP BY ALL"""


# Conversations as trees: replies under the turn before them.
def _conversation_tree(spark, folder):
    return settle(hierarchy.attach_parents(tables.conversation_sections(spark, folder)))


TREE_SQL = """
turns AS (SELECT 'conv-' || conv_id AS paper_id, turn AS section_order, CASE WHEN role = 'assistant' THEN 2 ELSE 1 END AS level, role || ' ' || turn AS heading, text FROM conversations),
tree AS (SELECT *, CASE WHEN level = 2 THEN max(CASE WHEN level = 1 THEN section_order END) OVER (PARTITION BY paper_id ORDER BY section_order) END AS parent_order FROM turns)"""


def conversation_outline(spark, folder):
    tree = hierarchy.attach_parents(tables.conversation_sections(spark, folder))
    return tree.select("paper_id", F.col("section_order").cast("bigint").alias("section_order"), F.col("parent_order").cast("bigint").alias("parent_order"), "level", "heading")


CONVERSATION_SQL = q.with_(TREE_SQL, select="SELECT paper_id, section_order, parent_order, level, heading FROM tree")


def section_descendants(spark, folder):
    """Every top-level turn with the turns below it."""
    tree = _conversation_tree(spark, folder)
    requests = tree.where("level = 1").select(F.concat_ws("#", "paper_id", F.col("section_order").cast("string")).alias("request_id"), "paper_id", F.col("section_order").alias("target_order"))
    return hierarchy.descendants(requests, tree).select("request_id", F.col("section_order").cast("bigint").alias("section_order"))


DESCENDANTS_SQL = q.with_(TREE_SQL, select="""
SELECT paper_id || '#' || coalesce(parent_order, section_order) AS request_id, section_order FROM tree WHERE level = 1 OR parent_order IS NOT NULL""")


def read_section_pages(spark, folder):
    """All pages of 60 tokens of every top-level turn with its replies."""
    tree = _conversation_tree(spark, folder).withColumn("page_start", F.lit(None).cast("int")).withColumn("page_end", F.lit(None).cast("int"))
    requests = tree.where("level = 1").select(
        F.concat_ws("#", "paper_id", F.col("section_order").cast("string")).alias("request_id"), "paper_id", F.col("section_order").alias("target_order")
    )
    pages = hierarchy.read_all_pages(requests, tree, 60)
    return pages.select("request_id", "offset", "total_tokens", "next_offset", F.col("returned_tokens").cast("bigint").alias("returned_tokens"), "included_sections", "text")


READ_SQL = q.with_(TREE_SQL, f"""
parts AS (SELECT paper_id || '#' || coalesce(parent_order, section_order) AS request_id, section_order,
  CASE WHEN level = 1 THEN {q.strip('text')} ELSE {q.strip("'## ' || heading || chr(10) || chr(10) || text")} END AS part FROM tree WHERE level = 1 OR parent_order IS NOT NULL),
whole AS (SELECT request_id, string_agg(part, chr(10) || chr(10) ORDER BY section_order) AS txt, count(*) AS included_sections FROM parts GROUP BY ALL),
cut AS (SELECT *, regexp_extract_all(txt, '(?:{q.COUNT_TOKEN})\\s*') AS spans FROM whole)""".replace("\\\\s", "\\s"), select=f"""
SELECT request_id, from_token AS offset, CAST(len(spans) AS BIGINT) AS total_tokens, CASE WHEN len(spans) > from_token + 60 THEN CAST(from_token + 60 AS BIGINT) END AS next_offset, CAST(least(60, len(spans) - from_token) AS BIGINT) AS returned_tokens,
  included_sections, {q.strip("array_to_string(spans[from_token + 1:from_token + 60], '')")} AS text FROM (SELECT *, unnest(range(0, greatest(len(spans), 1), 60)) AS from_token FROM cut)""")


def logical_parent(spark, folder):
    """Section to show around every section of the snapshot."""
    index = open_corpus(spark, folder)
    return hierarchy.logical_parents(index.sections)


MAJOR = r"^(?:\*{0,2})\s*(?:\d+\.?\s+|abstract\b|introduction\b|background\b|related\s+work\b|methods?(?:ology)?\b|results?\b|discussion\b|conclusions?\b|references\b)"
LOGICAL_SQL = q.with_(q.PAPERS, SECTIONS_SQL, rf"""
marked AS (SELECT paper_id, section_order, parent_order, level, regexp_matches(trim(heading), '{MAJOR}', 'i') AS major, regexp_matches(trim(heading), '^(?:\*{{0,2}})\s*\d+(?:\.\d+)+\.?\s+', 'i') AS dotted FROM sections),
climb AS (SELECT paper_id, section_order, parent_order AS up, 1 AS dist FROM marked WHERE parent_order IS NOT NULL
  UNION ALL SELECT c.paper_id, c.section_order, m.parent_order, c.dist + 1 FROM climb c JOIN marked m ON m.paper_id = c.paper_id AND m.section_order = c.up WHERE m.parent_order IS NOT NULL),
ups AS (SELECT c.paper_id, c.section_order, arg_min(c.up, c.dist) FILTER (m.level <= 2 OR m.major) AS stop_order, arg_max(c.up, c.dist) AS top_order, bool_or(c.dist = 1 AND m.major) AS major_parent
  FROM climb c JOIN marked m ON m.paper_id = c.paper_id AND m.section_order = c.up GROUP BY ALL)""", select="""
SELECT m.paper_id, CAST(m.section_order AS INT) AS section_order, CAST(CASE WHEN m.major OR m.level <= 1 OR (m.level = 2 AND NOT m.dotted AND NOT coalesce(u.major_parent, false)) THEN m.section_order
  ELSE coalesce(u.stop_order, u.top_order, m.section_order) END AS INT) AS logical_order FROM marked m LEFT JOIN ups u USING (paper_id, section_order)""")


def page_roll_up(spark, folder):
    """Page spans over descendants recomputed from the stored tree; they equal the stored spans."""
    index = open_corpus(spark, folder)
    return hierarchy.page_roll_up(index.sections)


ROLL_UP_SQL = q.with_(q.PAPERS, SECTIONS_SQL, select="SELECT paper_id, CAST(section_order AS INT) AS section_order, CAST(page_start AS INT) AS page_start, CAST(page_end AS INT) AS page_end FROM sections")


# Identity.
def exact_dedup(spark, folder):
    return identity.canonical_paths(tables.markdown_files(spark, folder))


DEDUP_SQL = """
SELECT sha256(text) AS content_hash, arg_min(source || '/' || doc_id || '.md', lower(source || '/' || doc_id || '.md')) AS canonical_path, count(*) AS copies FROM documents GROUP BY text"""


def alias_map(spark, folder):
    return identity.alias_rows(tables.markdown_files(spark, folder)).select("source_path", "canonical_path")


ALIAS_SQL = """
WITH s AS (SELECT source || '/' || doc_id || '.md' AS source_path, text FROM documents)
SELECT source_path, canonical_path FROM (SELECT source_path, first_value(source_path) OVER (PARTITION BY text ORDER BY lower(source_path)) AS canonical_path FROM s) WHERE source_path <> canonical_path"""


def entity_resolution(spark, folder):
    """A catalog with one row for each labelled document, which names its file and that of the next number."""
    files = tables.markdown_files(spark, folder).select("source_path", "content_hash", F.expr("cast(substring(catalog_id, 5) as bigint)").alias("doc_id"))
    following = files.select((F.col("doc_id") - 1).alias("doc_id"), F.col("source_path").alias("next_path"))
    rows = tables.table(spark, folder, "labels").select("doc_id").join(files, "doc_id").join(following, "doc_id", "left")
    entries = rows.select(
        F.lit("catalog").alias("catalog_id"), F.col("doc_id").alias("line_no"), F.concat(F.lit("record-"), "doc_id").alias("record_id"), F.array_compact(F.array("source_path", "next_path")).alias("artifacts")
    )
    return entities.resolve(entries, files)


RESOLUTION_SQL = """
WITH f AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path, sha256(text) AS h FROM documents),
r AS (SELECT l.doc_id, f.h AS one, g.h AS two FROM labels l JOIN f USING (doc_id) LEFT JOIN f g ON g.doc_id = l.doc_id + 1),
named AS (SELECT one AS h FROM r UNION SELECT two FROM r WHERE two IS NOT NULL),
records AS (SELECT one AS h, arg_min('record-' || doc_id, doc_id) AS record_id FROM r WHERE two IS NULL OR one = two GROUP BY one),
first AS (SELECT h, arg_min(doc_id, (lower(path), path)) AS doc_id FROM f GROUP BY h)
SELECT path AS source_path, 'hash:' || h AS component, coalesce(record_id, CAST(first.doc_id AS VARCHAR)) AS paper_id
FROM f JOIN named USING (h) JOIN first USING (h) LEFT JOIN records USING (h)"""


def _line_title():
    return F.get(F.split("text", "\n"), 0)


def stable_ids(spark, folder):
    """Ids of all document files: stems are numbers, so metadata decides, and collisions get a suffix."""
    files = tables.markdown_files(spark, folder)
    wanted = identity.stable_id(F.col("source_path"), F.lit(None).cast("string"), _line_title(), F.col("authors"), F.lit(None).cast("int"), F.col("content_hash"))
    candidates = settle(files.select("source_path", "content_hash", wanted.alias("candidate_id")))
    return identity.unique_ids(candidates).select("source_path", "paper_id")


def second_run(spark, folder):
    """A first run over all files, then revised copies of the labelled ones under equal names.

    The ids of the first run stay taken, so each revised file gets an id of its own.
    """
    def wanted(files):
        return files.select("source_path", "content_hash", identity.stable_id(
            F.col("source_path"), F.lit(None).cast("string"), _line_title(), F.col("authors"), F.lit(None).cast("int"), F.col("content_hash")).alias("candidate_id"))

    first = settle(identity.unique_ids(wanted(tables.markdown_files(spark, folder))).select("source_path", "paper_id"))
    labelled = tables.table(spark, folder, "labels").join(tables.table(spark, folder, "documents"), "doc_id")
    revised = labelled.withColumn("text", F.concat("text", F.lit("\nrevised"))).select(
        F.concat(F.lit("second/"), "doc_id", F.lit(".md")).alias("source_path"), F.sha2("text", 256).alias("content_hash"), F.array("source").alias("authors"), "text"
    )
    return first.unionByName(identity.unique_ids(wanted(revised), first.select("paper_id")).select("source_path", "paper_id"))


def slug_sql(x, n):
    ascii_ = f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"
    return rf"regexp_replace(substr(regexp_replace(regexp_replace(lower({ascii_}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, {n}), '-+$', '')"


IDS_SQL = f"""
WITH f AS (SELECT source || '/' || doc_id || '.md' AS source_path, source, sha256(text) AS h, {slug_sql("string_split(text, chr(10))[1]", 64)} AS t FROM documents),
c AS (SELECT source_path, h, CASE WHEN t <> '' THEN {slug_sql("source || '-' || t", 96)} ELSE 'paper-' || substr(h, 1, 12) END AS candidate FROM f),
k AS (SELECT candidate, arg_min(h, source_path) AS keeper FROM c GROUP BY ALL)
SELECT source_path, CASE WHEN h = keeper THEN candidate ELSE candidate || '-' || substr(h, 1, 8) END AS paper_id FROM c JOIN k USING (candidate)"""


SECOND_RUN_SQL = f"""
WITH f AS (SELECT 1 AS run, source || '/' || doc_id || '.md' AS source_path, source, sha256(text) AS h, {slug_sql("string_split(text, chr(10))[1]", 64)} AS t FROM documents
  UNION ALL SELECT 2, 'second/' || doc_id || '.md', source, sha256(text || chr(10) || 'revised'), {slug_sql("string_split(text, chr(10))[1]", 64)} FROM documents JOIN labels USING (doc_id)),
c AS (SELECT run, source_path, h, CASE WHEN t <> '' THEN {slug_sql("source || '-' || t", 96)} ELSE 'paper-' || substr(h, 1, 12) END AS candidate FROM f),
k AS (SELECT run, candidate, arg_min(h, source_path) AS keeper FROM c GROUP BY ALL),
one AS (SELECT source_path, CASE WHEN h = keeper THEN candidate ELSE candidate || '-' || substr(h, 1, 8) END AS paper_id FROM c JOIN k USING (run, candidate) WHERE run = 1)
SELECT source_path, paper_id FROM one
UNION ALL SELECT source_path, CASE WHEN h = keeper AND candidate NOT IN (SELECT paper_id FROM one) THEN candidate ELSE candidate || '-' || substr(h, 1, 8) END
FROM c JOIN k USING (run, candidate) WHERE run = 2"""


# Catalogs: one per source, with a table of the labelled documents and the notes as bullets.
def _catalog_lines(spark, folder):
    labels = tables.table(spark, folder, "labels").join(tables.table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    sources = labels.select(F.concat(F.lit("catalog-"), "source").alias("catalog_id")).distinct()
    head = F.array(F.lit("# Catalog"), F.lit(""), F.lit("## Labelled"), F.lit("| Name | Quality | Toxic | File |"), F.lit("| --- | :---: | ---: | --- |"))
    top = sources.select("catalog_id", F.posexplode(head).alias("line_no", "line"))
    rows = labels.select(
        F.concat(F.lit("catalog-"), "source").alias("catalog_id"), (F.col("doc_id") + 5).alias("line_no"),
        F.concat(F.lit("| Doc "), "doc_id", F.lit(" | "), "quality", F.lit(" | "), "toxic", F.lit(" | `"), "source", F.lit("/"), "doc_id", F.lit(".md` |")).alias("line"),
    )
    notes = tables.table(spark, folder, "benchmark").select(
        F.lit("catalog-notes").alias("catalog_id"), F.posexplode(F.split("text", "\n")).alias("at", "part"), "item_id"
    ).select("catalog_id", (F.col("item_id") * 1000 + F.col("at")).alias("line_no"), F.concat(F.when(F.col("at") == 0, "- ").otherwise("  "), "part").alias("line"))
    return top.select("catalog_id", F.col("line_no").cast("bigint").alias("line_no"), "line").unionByName(rows).unionByName(notes)


def catalog_parse(spark, folder):
    parsed = catalog.parse_catalog(_catalog_lines(spark, folder))
    return parsed.select("catalog_id", "line_no", "heading_path", "entry_type", F.coalesce("record_id", F.lit("")).alias("record_id"), F.array_join("artifacts", ";").alias("artifacts"), "text")


CATALOG_SQL = rf"""
SELECT 'catalog-' || source AS catalog_id, doc_id + 5 AS line_no, 'Catalog > Labelled' AS heading_path, 'table_row' AS entry_type, 'doc-' || doc_id AS record_id, source || '/' || doc_id || '.md' AS artifacts,
  'doc-' || doc_id || chr(10) || 'name: Doc ' || doc_id || chr(10) || 'quality: ' || quality || chr(10) || 'toxic: ' || toxic || chr(10) || 'file: ' || source || '/' || doc_id || '.md' || chr(10) || 'artifacts: ' || source || '/' || doc_id || '.md' AS text
FROM labels JOIN documents USING (doc_id)
UNION ALL
SELECT 'catalog-notes', item_id * 1000, '', 'bullet', '', '', {q.squeeze("regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> ''), ' '), '[`*~]', '', 'g')")} FROM benchmark"""


def artifact_link(spark, folder):
    """Catalog names against all document files; every file path with its paper id and link source."""
    entries = settle(catalog.parse_catalog(_catalog_lines(spark, folder)))
    ids = catalog.artifact_ids(entries)
    known = tables.markdown_files(spark, folder).select("source_path")
    matched = catalog.match_artifacts(ids, known)
    aliases = catalog.publish_aliases(ids, known)
    return aliases.join(matched.withColumnRenamed("source_path", "alias"), "alias", "left").select("alias", "paper_id", F.coalesce("artifact", F.lit("")).alias("artifact"))


LINK_SQL = """
WITH f AS (SELECT source || '/' || doc_id || '.md' AS alias, doc_id FROM documents), n AS (SELECT doc_id, count(*) AS files FROM documents GROUP BY ALL),
l AS (SELECT doc_id, 'doc-' || doc_id AS paper_id FROM labels)
SELECT alias, coalesce(l.paper_id, CAST(doc_id AS VARCHAR)) AS paper_id, CASE WHEN l.paper_id IS NULL THEN '' ELSE alias END AS artifact FROM f LEFT JOIN l USING (doc_id)
UNION ALL SELECT doc_id || '.md', coalesce(l.paper_id, CAST(doc_id AS VARCHAR)), '' FROM f LEFT JOIN l USING (doc_id)"""


def entry_links(spark, folder):
    entries = settle(catalog.parse_catalog(_catalog_lines(spark, folder)))
    aliases = catalog.publish_aliases(catalog.artifact_ids(entries), tables.markdown_files(spark, folder).select("source_path"))
    return catalog.link_entries(entries, aliases)


ENTRY_LINKS_SQL = "SELECT 'catalog-' || source AS catalog_id, doc_id + 5 AS line_no, 'doc-' || doc_id AS paper_id FROM labels JOIN documents USING (doc_id)"


# Metadata.
def text_metadata(spark, folder):
    files = tables.markdown_files(spark, folder)
    read = computed_once(files.select("source_path", "text"), markdown=tx.clean_markdown(tables.render_markdown(F.col("text")))).select("source_path", "markdown")
    meta = computed_once(read, meta=metadata.text_metadata(F.col("markdown"))).select("source_path", "meta")
    return meta.select("source_path", "meta.title", F.coalesce("meta.doi", F.lit("")).alias("doi"), F.array_join("meta.authors", ";").alias("authors"), "meta.year")


METADATA_SQL = rf"""
WITH r AS (SELECT source || '/' || doc_id || '.md' AS source_path, string_split(text, chr(10)) AS ls, regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g') AS first FROM documents),
b AS (SELECT source_path, first, ls, list_transform(range(1, len(ls) + 1), lambda i: (CASE WHEN (i - 1) % 10 = 0 THEN '<!-- page: ' || ((i - 1) // 10 + 1) || ' -->' || chr(10) ELSE '' END)
  || CASE WHEN len(regexp_extract_all(ls[i], '\S+')) BETWEEN 1 AND 5 THEN (CASE WHEN i = 1 THEN '# ' WHEN len(regexp_extract_all(ls[i], '\S+')) <= 2 THEN '## ' ELSE '### ' END) || regexp_replace(ls[i], '^\s+|\s+$', '', 'g') ELSE ls[i] END) AS parts FROM r),
m AS (SELECT source_path, first, regexp_replace(array_to_string(parts, chr(10) || chr(10)), '^\s+|\s+$', '', 'g') || chr(10) AS md, len(regexp_extract_all(first, '\S+')) AS w FROM b),
y AS (SELECT *, regexp_extract(' ' || md || ' ', '[^\p{{L}}\p{{N}}_]((?:19|20)\d{{2}})[^\p{{L}}\p{{N}}_]', 1) AS yr FROM m)
SELECT source_path, CASE WHEN w BETWEEN 1 AND 5 THEN first ELSE '' END AS title, '' AS doi, '' AS authors, CASE WHEN yr <> '' THEN CAST(yr AS INT) END AS year FROM y"""


def title_checks(spark, folder):
    """Which first lines can serve as titles, and the fallback title of the rest."""
    files = tables.markdown_files(spark, folder)
    good = metadata.usable_title(_line_title(), F.col("source_path"))
    return files.select("source_path", good.alias("usable"), F.when(good, _line_title()).otherwise(metadata.fallback_title(F.col("source_path"))).alias("title"), metadata.usable_authors(F.col("authors")).alias("authors_usable"))


TITLE_SQL = rf"""
WITH r AS (SELECT source || '/' || doc_id || '.md' AS source_path, doc_id, source, string_split(text, chr(10))[1] AS l FROM documents),
n AS (SELECT *, {q.squeeze(q.fold('l'))} AS s FROM r),
u AS (SELECT *, s NOT IN ('', 'untitled', 'document', 'article', 'paper', 'full text', 'microsoft word') AND length(s) >= 4 AND s <> CAST(doc_id AS VARCHAR) AND NOT starts_with(s, 'microsoft word') AND len(regexp_extract_all(l, '\p{{L}}{{2,}}')) >= 3 AS usable FROM n)
SELECT source_path, usable, CASE WHEN usable THEN l ELSE CAST(doc_id AS VARCHAR) END AS title, NOT (length(regexp_replace(source, '[^\p{{L}}]', '', 'g')) < 4 OR (source = lower(source) AND NOT contains(source, ' '))) AS authors_usable FROM u"""


def infer_topics(spark, folder):
    texts = _documents(spark, folder).select(F.col("doc_id").alias("paper_id"), "text")
    return metadata.topics(texts).select(F.col("paper_id").alias("doc_id"), F.col("rank").cast("bigint").alias("rank"), "topic", "uses")


TOPICS_SQL = f"""
WITH w AS (SELECT doc_id, unnest(ws) AS topic, generate_subscripts(ws, 1) AS place FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+^-]{{2,}}'), lambda x: lower(x)) AS ws FROM documents)),
c AS (SELECT doc_id, topic, count(*) AS uses, min(place) AS place FROM w WHERE topic NOT IN ({', '.join(f"'{s}'" for s in metadata.STOP_WORDS)}) GROUP BY ALL)
SELECT doc_id, rank, topic, uses FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY uses DESC, place) AS rank FROM c) WHERE rank <= 16"""


def research_cards(spark, folder):
    """Routing card of every paper: headings, notes and topics as counts and text."""
    from lectern.operators.cards import research_cards as build

    index = open_corpus(spark, folder)
    return build(index.papers, index.sections, index.notes, index.links)


LONG_LINE = r"list_filter(string_split(abstract, chr(10)), lambda s: len(regexp_extract_all(s, '\S+')) > 5)[1]"
CARDS_SQL = q.with_(q.PAPERS, SECTIONS_SQL, rf"""
base AS (SELECT paper_id, title, author, source_path, coalesce({q.strip(LONG_LINE)}, '') AS abstract FROM papers),
heads AS (SELECT paper_id, section_order, heading_path FROM sections WHERE heading <> ''),
listed AS (SELECT paper_id, CAST(to_json(list(heading_path ORDER BY section_order)) AS VARCHAR) AS section_headings FROM heads GROUP BY ALL),
quotes AS (SELECT item_id, text, {q.PADDED.format(q.index_tokens('text'))} AS needle FROM benchmark),
fields AS (SELECT paper_id, {q.PADDED.format(q.index_tokens('heading_path'))} AS h, {q.PADDED.format(q.index_tokens('text'))} AS b FROM sections),
noted AS (SELECT paper_id, trim(text) AS text, min(item_id) AS n FROM (SELECT DISTINCT paper_id, item_id, text FROM quotes, fields WHERE contains(h, needle) OR contains(b, needle)) WHERE trim(text) <> '' GROUP BY ALL),
counts AS (SELECT paper_id, count(*) AS notes FROM noted GROUP BY ALL),
parts AS (SELECT paper_id, 0 AS part, 0 AS n, title || chr(10) || abstract AS text FROM base UNION ALL SELECT paper_id, 1, section_order, heading_path FROM heads UNION ALL SELECT paper_id, 2, n, text FROM noted),
words AS (SELECT paper_id, part, n, unnest(ws) AS topic, generate_subscripts(ws, 1) AS place FROM (SELECT paper_id, part, n, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+^-]{{2,}}'), lambda x: lower(x)) AS ws FROM parts)),
used AS (SELECT paper_id, topic, count(*) AS uses, min({{'a': part, 'b': n, 'c': place}}) AS place FROM words WHERE topic NOT IN ({', '.join(f"'{s}'" for s in metadata.STOP_WORDS)}) GROUP BY ALL),
best AS (SELECT paper_id, CAST(to_json(list(topic ORDER BY uses DESC, place)) AS VARCHAR) AS topics FROM (
  SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY uses DESC, place) AS rank FROM used) WHERE rank <= 16 GROUP BY ALL)""", select="""
SELECT b.paper_id, b.title, b.author AS authors, CAST(NULL AS INT) AS year, b.abstract, 'markdown_reference' AS source_kind, coalesce(section_headings, '[]') AS section_headings,
  coalesce(notes, 0) AS notes, coalesce(topics, '[]') AS topics FROM base b LEFT JOIN listed USING (paper_id) LEFT JOIN counts USING (paper_id) LEFT JOIN best USING (paper_id)""")


QUERIES = {
    "token_counts": (token_counts, f"SELECT doc_id, CAST({q.count_tokens('text')} AS BIGINT) AS tokens FROM documents"),
    "math_normalize": (math_normalize, f"SELECT doc_id, md5({q.math('text')}) AS normalized FROM documents"),
    "index_folding": (index_folding, f"SELECT page_id, CAST(len(t) AS BIGINT) AS tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT page_id, {q.index_tokens('html')} AS t FROM pages)"),
    "markdown_sections": (markdown_sections, MARKDOWN_SQL),
    "outline_counts": (outline_counts, OUTLINE_SQL),
    "math_aware_chunks": (math_aware_chunks, None),
    "chunk_token_totals": (chunk_token_totals, CHUNK_TOTALS_SQL),
    "paragraph_packing": (paragraph_packing, PACKING_SQL),
    "conversation_outline": (conversation_outline, CONVERSATION_SQL),
    "section_descendants": (section_descendants, DESCENDANTS_SQL),
    "read_section_pages": (read_section_pages, READ_SQL),
    "logical_parent": (logical_parent, LOGICAL_SQL),
    "page_roll_up": (page_roll_up, ROLL_UP_SQL),
    "exact_dedup": (exact_dedup, DEDUP_SQL),
    "entity_resolution": (entity_resolution, RESOLUTION_SQL),
    "alias_map": (alias_map, ALIAS_SQL),
    "stable_ids": (stable_ids, IDS_SQL),
    "second_run": (second_run, SECOND_RUN_SQL),
    "catalog_parse": (catalog_parse, CATALOG_SQL),
    "artifact_link": (artifact_link, LINK_SQL),
    "entry_links": (entry_links, ENTRY_LINKS_SQL),
    "text_metadata": (text_metadata, METADATA_SQL),
    "title_checks": (title_checks, TITLE_SQL),
    "infer_topics": (infer_topics, TOPICS_SQL),
    "research_cards": (research_cards, CARDS_SQL),
}
