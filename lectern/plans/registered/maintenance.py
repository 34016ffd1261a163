"""Registered queries: incremental runs, integrity checks and repairs.

Earlier states are derived from the tables: the labelled documents count as stored
before, those labelled toxic with other bytes, and all pages as files now gone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import catalog, dense, identity, incremental, notes, quality
from lectern.plans.corpus_data import open_corpus
from lectern.plans.registered import sql as q
from lectern.plans.registered.documents import SECTIONS_SQL, UNMARKED
from lectern.sources import files as file_source
from lectern.sources import tables


def _listing(spark, folder):
    return tables.markdown_files(spark, folder).select("source_path", "source_kind", "content_hash")


def _stored(spark, folder):
    labels = tables.table(spark, folder, "labels")
    documents = tables.table(spark, folder, "documents").join(labels, "doc_id").select(
        F.concat_ws("/", "source", F.concat("doc_id", F.lit(".md"))).alias("source_path"), F.lit("markdown_reference").alias("source_kind"),
        F.sha2(F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"),
    )
    pages = tables.table(spark, folder, "pages").select(
        F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("source_path"), F.lit("pdf").alias("source_kind"), F.sha2("html", 256).alias("content_hash")
    )
    return documents.unionByName(pages)


STATES = """
listing AS (SELECT source || '/' || doc_id || '.md' AS source_path, 'markdown_reference' AS source_kind, sha256(text) AS content_hash FROM documents),
stored AS (SELECT source || '/' || doc_id || '.md' AS source_path, 'markdown_reference' AS source_kind, sha256(CASE WHEN toxic = 1 THEN text || '!' ELSE text END) AS content_hash FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT 'pages/' || page_id || '.html', 'pdf', sha256(html) FROM pages)"""


def changed_sources(spark, folder):
    return incremental.classify_sources(_listing(spark, folder), _stored(spark, folder)).select("source_path", "state")


def incomplete_scan(spark, folder):
    """The same after a scan with errors: nothing is retired."""
    states = incremental.classify_sources(_listing(spark, folder), _stored(spark, folder), complete=False)
    return states.groupBy("state").agg(F.count("*").alias("paths"))


def _state_sql(gone, select):
    return q.with_(STATES, f"""
states AS (SELECT coalesce(l.source_path, s.source_path) AS source_path, CASE WHEN l.content_hash IS NULL THEN '{gone}' WHEN l.content_hash = s.content_hash THEN 'unchanged'
  WHEN l.content_hash IN (SELECT content_hash FROM stored) THEN 'copy' WHEN s.content_hash IS NULL THEN 'new' ELSE 'changed' END AS state FROM listing l FULL JOIN stored s USING (source_path))""", select=select)


def manifest_drift(spark, folder):
    return incremental.manifest_drift(incremental.manifest(_stored(spark, folder)), incremental.manifest(_listing(spark, folder)))


DRIFT_SQL = q.with_(STATES, select="""
SELECT source_path AS path, source_kind AS kind, content_hash AS sha256, 'stored only' AS change FROM (SELECT * FROM stored EXCEPT ALL SELECT * FROM listing)
UNION ALL SELECT source_path, source_kind, content_hash, 'current only' FROM (SELECT * FROM listing EXCEPT ALL SELECT * FROM stored)""")


def retired_sources(spark, folder):
    """Canonical papers after all files labelled toxic are gone: stay, move to a copy, or retire."""
    files = tables.markdown_files(spark, folder)
    papers = identity.deduplicate(files).select(F.col("catalog_id").alias("paper_id"), "source_path", "content_hash")
    owners = papers.select("paper_id", F.col("content_hash").alias("h"))
    aliases = files.select("source_path", F.col("content_hash").alias("h")).join(owners, "h").select("paper_id", "source_path")
    toxic = tables.table(spark, folder, "labels").where("toxic = 1").select(F.concat(F.lit("doc-"), "doc_id").alias("catalog_id"))
    live = files.join(toxic, "catalog_id", "left_anti")
    return incremental.reconcile_owners(papers, aliases, live).select("paper_id", "action", F.coalesce("new_path", F.lit("")).alias("new_path"))


RETIRED_SQL = """
WITH s AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path, text, coalesce(l.toxic, 0) AS toxic FROM documents LEFT JOIN labels l USING (doc_id)),
g AS (SELECT text, arg_min(doc_id, lower(path)) AS owner, arg_min(toxic, lower(path)) AS gone, min(lower(path)) AS own_path, min(CASE WHEN toxic = 0 THEN path END) AS live FROM s GROUP BY ALL)
SELECT 'doc-' || owner AS paper_id, CASE WHEN gone = 0 THEN 'stay' WHEN live IS NOT NULL THEN 'repoint' ELSE 'retire' END AS action, CASE WHEN gone = 0 THEN own_path ELSE coalesce(live, '') END AS new_path FROM g"""


def upsert_merge(spark, folder):
    """All documents written over the labels; a stored quality stays."""
    stored = tables.table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    incoming = tables.table(spark, folder, "documents").select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic"))
    return incremental.upsert(stored, incoming, ["doc_id"], keep=("quality",))


UPSERT_SQL = """
SELECT d.doc_id, coalesce(l.quality, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END) AS quality, 0 AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""


def failure_log(spark, folder):
    """Events as a failure log: newest entry per user and type."""
    events = tables.table(spark, folder, "events")
    log = events.select(F.concat(F.lit("user/"), "user_id").alias("source_path"), F.col("event_type").alias("stage"), F.col("props").alias("error"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    return incremental.latest_failures(log)


FAILURE_SQL = """
SELECT 'user/' || user_id AS source_path, event_type AS stage, arg_max(props, (ts, props)) AS error, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY ALL"""


def layout_changes(spark, folder):
    """Conversations whose chunk layout changes when system turns are dropped."""
    turns = tables.conversation_sections(spark, folder).select(
        "paper_id", "section_order", F.col("section_order").alias("chunk_index"), tx.token_count(F.col("text")).alias("token_count"), "text", "heading"
    )
    changed = incremental.layout_changes(turns, turns.where(~F.col("heading").startswith("system")))
    return changed.select("paper_id", "old_chunks", F.coalesce("new_chunks", F.lit(0)).alias("new_chunks"))


LAYOUT_SQL = """
SELECT 'conv-' || conv_id AS paper_id, count(*) AS old_chunks, CAST(count_if(role <> 'system') AS BIGINT) AS new_chunks FROM conversations GROUP BY conv_id HAVING count_if(role = 'system') > 0"""


def reindex_compact(spark, folder):
    """Lines as chunks, lines of one or two words as empty ones: the rest is renumbered."""
    lines = tables.table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    chunks = lines.select(F.concat(F.lit("doc-"), "doc_id").alias("paper_id"), F.col("line_no").alias("chunk_index"), "line_no",
                          F.when(F.regexp_count("line", F.lit(r"\S+")) > 2, tx.token_count(F.col("line"))).otherwise(0).alias("token_count"))
    compacted = quality.compact_chunks(chunks)
    return compacted.select("paper_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("line_no").cast("bigint").alias("line_no"), F.col("token_count").cast("bigint").alias("token_count"))


COMPACT_SQL = rf"""
WITH l AS (SELECT doc_id, i - 1 AS line_no, parts[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
SELECT 'doc-' || doc_id AS paper_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS chunk_index, line_no, CAST({q.count_tokens('line')} AS BIGINT) AS token_count
FROM l WHERE len(regexp_extract_all(line, '\S+')) > 2"""


def hierarchy_check(spark, folder):
    """Conversations as chains; a system turn hangs under turn 1, which makes a cycle.

    Assistant turns are the chunks, each belonging to the turn after it, so that a
    closing reply is an orphan.
    """
    turns = tables.conversation_sections(spark, folder)
    parent = F.when(F.col("heading").startswith("system"), F.lit(1)).when(F.col("section_order") > 0, F.col("section_order") - 1)
    sections = turns.withColumn("parent_order", parent.cast("int"))
    chunks = turns.where("level = 2").select("paper_id", (F.col("section_order") + 1).alias("section_order"))
    return quality.hierarchy_report(turns.select("paper_id").distinct(), sections, chunks)


HIERARCHY_SQL = """
WITH t AS (SELECT 'conv-' || conv_id AS paper_id, turn, role, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations),
c AS (SELECT paper_id, count(*) AS sections, CAST(count_if(role = 'assistant') AS BIGINT) AS chunks, CAST(count_if(role = 'assistant' AND turn = last_turn) AS BIGINT) AS orphan_chunks,
  CASE WHEN count_if(role = 'system') > 0 THEN count(*) ELSE 0 END AS broken_parents FROM t GROUP BY ALL)
SELECT *, sections > 0 AND chunks > 0 AND orphan_chunks = 0 AND broken_parents = 0 AS complete FROM c"""


def _level_rows(spark, folder):
    documents = tables.table(spark, folder, "documents")
    paper_id = F.concat(F.lit("doc-"), "doc_id")
    papers = documents.select(F.lit("paper").alias("kind"), paper_id.alias("entity_id"), paper_id.alias("paper_id"), "doc_id")
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    sections = lines.select(F.lit("section").alias("kind"), F.concat(paper_id, F.lit("#s"), "n").alias("entity_id"), paper_id.alias("paper_id"), "doc_id")
    chunks = documents.select(F.lit("chunk").alias("kind"), F.concat(paper_id, F.lit("#c0")).alias("entity_id"), paper_id.alias("paper_id"), "doc_id")
    return papers.unionByName(sections).unionByName(chunks)


def coverage_check(spark, folder):
    """Lines as sections: labelled documents have all vectors but the chunk's where quality is 0."""
    rows = _level_rows(spark, folder)
    labels = tables.table(spark, folder, "labels")
    vectors = rows.join(labels, "doc_id").where("kind <> 'chunk' OR quality = 1").withColumn("model_fingerprint", F.lit("set-0"))
    report = quality.vector_coverage(rows, vectors)
    return report.select("paper_id", "sections", "paper_vectors", "section_vectors", "chunk_vectors", "complete")


COVERAGE_SQL = """
SELECT 'doc-' || doc_id AS paper_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS sections, CAST(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS paper_vectors,
  CAST(CASE WHEN l.doc_id IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS section_vectors, CAST(coalesce(l.quality, 0) AS BIGINT) AS chunk_vectors, coalesce(l.quality = 1, false) AS complete
FROM documents d LEFT JOIN labels l USING (doc_id)"""


def mirror_equality(spark, folder):
    """Documents against a mirror without marks of emphasis and with copies merged."""
    base = tables.table(spark, folder, "documents").select("lang", F.md5("text").alias("digest"))
    mirror = tables.table(spark, folder, "documents").select("lang", F.md5(F.regexp_replace("text", r"\*{3}", "")).alias("digest")).distinct()
    return quality.mirror_differences(base, mirror)


MIRROR_SQL = r"""
WITH b AS (SELECT lang, md5(text) AS digest FROM documents), m AS (SELECT DISTINCT lang, md5(regexp_replace(text, '\*{3}', '', 'g')) AS digest FROM documents)
SELECT *, 'base' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM m) UNION ALL SELECT *, 'mirror' FROM (SELECT * FROM m EXCEPT ALL SELECT * FROM b)"""


def provenance_repair(spark, folder):
    """Vectors that all name the paper of their label: owners come from the hierarchy and the links."""
    kind = F.when(F.col("label") % 3 == 0, "paper").when(F.col("label") % 3 == 1, "section").otherwise("curated")
    vectors = tables.table(spark, folder, "embeddings").select(
        kind.alias("kind"), F.when(kind == "paper", F.concat(F.lit("doc-"), "vec_id")).otherwise(F.col("vec_id").cast("string")).alias("entity_id"), F.concat(F.lit("doc-"), "label").alias("paper_id")
    )
    sections = tables.table(spark, folder, "labels").select(F.lit("section").alias("kind"), F.col("doc_id").cast("string").alias("entity_id"), F.concat(F.lit("doc-"), "doc_id").alias("paper_id"))
    notes = tables.table(spark, folder, "documents").select(F.lit("curated").alias("kind"), F.col("doc_id").cast("string").alias("entity_id"), F.lit(None).cast("string").alias("paper_id"))
    links = tables.table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("entry_id"), F.concat(F.lit("doc-"), "quality").alias("paper_id"))
    return quality.repair_provenance(vectors, sections.unionByName(notes), links).select("kind", "entity_id", F.coalesce("paper_id", F.lit("")).alias("paper_id"), "repaired")


PROVENANCE_SQL = """
WITH v AS (SELECT CASE label % 3 WHEN 0 THEN 'paper' WHEN 1 THEN 'section' ELSE 'curated' END AS kind, vec_id, 'doc-' || label AS old FROM embeddings),
o AS (SELECT v.*, CASE WHEN kind = 'paper' THEN 'doc-' || v.vec_id WHEN kind = 'section' THEN coalesce('doc-' || l.doc_id, old) WHEN d.doc_id IS NULL THEN old ELSE 'doc-' || l.quality END AS owner
  FROM v LEFT JOIN labels l ON l.doc_id = v.vec_id LEFT JOIN documents d ON d.doc_id = v.vec_id)
SELECT kind, CASE WHEN kind = 'paper' THEN 'doc-' || vec_id ELSE CAST(vec_id AS VARCHAR) END AS entity_id, coalesce(owner, '') AS paper_id, owner IS DISTINCT FROM old AS repaired FROM o"""


def text_density_gate(spark, folder):
    pages = (F.size(F.split("text", "\n")) / tables.LINES_PER_PAGE).cast("int") + 1
    documents = tables.table(spark, folder, "documents").select("doc_id", F.col("text").alias("markdown"), pages.alias("page_count"))
    judged = quality.text_density(documents)
    return judged.select("doc_id", F.col("alphanumeric").cast("bigint").alias("alphanumeric"), "verdict")


DENSITY_SQL = r"""
WITH d AS (SELECT doc_id, CAST(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS BIGINT) AS alphanumeric, length(text) AS n, length(regexp_replace(text, '[^�]', '', 'g')) AS r, len(string_split(text, chr(10))) // 10 + 1 AS pages FROM documents)
SELECT doc_id, alphanumeric, CASE WHEN r >= 32 AND r / greatest(1, n) > 0.05 THEN 'corrupt' WHEN alphanumeric < greatest(32, 64 * pages) THEN 'sparse' ELSE 'ok' END AS verdict FROM d"""


def stale_vectors(spark, folder):
    """Papers to embed again: never embedded, other bytes, other settings, or other notes."""
    files = tables.markdown_files(spark, folder).select("catalog_id", "content_hash", "text")
    papers = files.select(F.col("catalog_id").alias("paper_id"), "content_hash", F.length("text").alias("n_chars"))
    labels = tables.table(spark, folder, "labels").select(F.concat(F.lit("doc-"), "doc_id").alias("paper_id"), "doc_id", "quality", "toxic")
    notes = tables.note_rows(spark, folder)
    links = labels.select(F.col("quality").cast("string").alias("entry_id"), "paper_id")
    signature = incremental.notes_signature(links, notes)
    state = labels.join(papers, "paper_id").join(signature, "paper_id", "left").select(
        "paper_id", F.when(F.col("toxic") == 1, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(F.col("n_chars") > 500, "a").otherwise("b").alias("config_signature"), F.when(F.col("quality") == 1, F.col("notes_signature")).otherwise(F.lit("old")).alias("notes_signature"),
    )
    return incremental.stale_vectors(papers, state, signature, "a")


STALE_SQL = """
SELECT * FROM (SELECT 'doc-' || d.doc_id AS paper_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN toxic = 1 THEN 'content' WHEN length(text) <= 500 THEN 'settings' WHEN quality = 0 THEN 'notes' END AS reason
FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE reason IS NOT NULL"""


def glob_sources(spark, folder):
    """Canonical files of which any copy lies in ``src1`` or is named ``*7.md``."""
    files = _listing(spark, folder)
    return incremental.matching_sources(files, identity.deduplicate(files), ["src1/*", "*7.md"]).select("source_path")


GLOB_SQL = """
WITH s AS (SELECT source || '/' || doc_id || '.md' AS p, text FROM documents)
SELECT min(p) AS source_path FROM s GROUP BY text HAVING bool_or(starts_with(p, 'src1/') OR ends_with(p, '7.md'))"""


def excluded_sources(spark, folder):
    files = _listing(spark, folder)
    return files.where(~file_source.excluded(F.col("source_path"), ("src1", "/src2/"))).select("source_path")


def source_lookup(spark, folder):
    """Paper of every path, by alias where the path is a copy and by its own path otherwise."""
    files = tables.markdown_files(spark, folder)
    papers = identity.deduplicate(files).select(F.col("catalog_id").alias("paper_id"), "source_path", "content_hash")
    aliases = identity.alias_rows(files).join(papers.select(F.col("source_path").alias("canonical_path"), "paper_id"), "canonical_path").select("source_path", "paper_id")
    return identity.papers_by_source(papers, aliases, files.select("source_path"))


LOOKUP_SQL = """
SELECT source || '/' || doc_id || '.md' AS source_path, 'doc-' || first_value(doc_id) OVER (PARTITION BY text ORDER BY lower(source || '/' || doc_id || '.md')) AS paper_id FROM documents"""


def corpus_counts(spark, folder):
    index = open_corpus(spark, folder)
    aliases = identity.alias_rows(tables.markdown_files(spark, folder))
    parts = {"papers": index.papers, "source_aliases": aliases, "sections": index.sections, "curated_entries": index.notes, "levels": index.levels}
    rows = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in parts.items()]
    total = rows[0]
    for row in rows[1:]:
        total = total.unionByName(row)
    return total


COUNTS_SQL = q.with_(q.PAPERS, SECTIONS_SQL, select="""
SELECT 'papers' AS table_name, count(*) AS rows FROM papers UNION ALL SELECT 'source_aliases', (SELECT count(*) FROM documents) - count(*) FROM papers
UNION ALL SELECT 'sections', count(*) FROM sections UNION ALL SELECT 'curated_entries', count(*) FROM benchmark UNION ALL SELECT 'levels', 4""")


def readiness(spark, folder):
    """Integrity checks of the written snapshot."""
    from lectern.plans.corpus import snapshot_checks

    return quality.readiness(snapshot_checks(open_corpus(spark, folder)))


# A paper without a token in any section has no chunk and fails the first check; the others hold by construction.
READINESS_SQL = q.with_(q.PAPERS, SECTIONS_SQL, rf"""
tokens AS (SELECT paper_id, sum({q.count_tokens(UNMARKED)}) AS n FROM sections GROUP BY ALL),
bare AS (SELECT count(*) AS failing FROM papers LEFT JOIN tokens USING (paper_id) WHERE coalesce(n, 0) = 0)""", select="""
SELECT name AS "check", CASE WHEN name IN ('hierarchy', 'vectors') THEN failing ELSE 0 END AS failing, NOT (name IN ('hierarchy', 'vectors') AND failing > 0) AS passed
FROM bare, (VALUES ('hierarchy'), ('mirror'), ('vectors'), ('provenance'), ('empty chunks')) v(name)""")


def coverage_two_sets(spark, folder):
    """Every paper against two vector sets, of which one lacks the sections of every third document."""
    docs = tables.table(spark, folder, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("paper_id"), "doc_id")
    kinds = F.explode(F.array(F.lit("paper"), F.lit("section"), F.lit("chunk")))
    rows = docs.select("*", kinds.alias("kind")).withColumn("entity_id", F.concat_ws("/", "paper_id", "kind"))
    sets = F.explode(F.array(F.lit("set-a"), F.lit("set-b")))
    vectors = rows.select("*", sets.alias("model_fingerprint")).where("model_fingerprint = 'set-a' OR (doc_id % 3 <> 0 OR kind <> 'section') AND doc_id % 5 <> 0")
    found = quality.vector_coverage(rows, vectors)
    return found.select("paper_id", "model_fingerprint", "section_vectors", "paper_vectors", "complete")


TWO_SETS_SQL = """
SELECT 'doc-' || doc_id AS paper_id, s AS model_fingerprint, CAST(CASE WHEN s = 'set-a' OR (doc_id % 3 <> 0 AND doc_id % 5 <> 0) THEN 1 ELSE 0 END AS BIGINT) AS section_vectors,
  CAST(CASE WHEN s = 'set-a' OR doc_id % 5 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS paper_vectors, s = 'set-a' OR (doc_id % 3 <> 0 AND doc_id % 5 <> 0) AS complete
FROM documents, (VALUES ('set-a'), ('set-b')) v(s)"""


def ocr_pages(spark, folder):
    """Every page's text as a scanned page, with what could pass for Markdown made harmless."""
    rows = tables.table(spark, folder, "pages").select("page_id", F.replace("html", F.lit("<p>"), F.lit("\n# ")).alias("t"))
    return rows.select("page_id", F.md5(tx.scanned_page(F.col("t"), F.col("page_id"))).alias("digest"))


OCR_SQL = r"""
WITH l AS (SELECT page_id, list_transform(regexp_split_to_array(replace(html, '<p>', chr(10) || '# '), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'), lambda s:
    regexp_replace(regexp_replace(replace(regexp_replace(s, '^\s+|\s+$', '', 'g'), '$$', '$ $'), '^\\\[', '['), '^\\begin\{', 'begin{')) AS ls FROM pages),
m AS (SELECT page_id, list_transform(list_transform(list_transform(ls, lambda s: CASE WHEN s IN ('[', ']') THEN 'OCR symbol: ' || s ELSE s END),
    lambda s: CASE WHEN regexp_matches(s, '(?i)^(?:#{1,6}\s|`{3,}|~{3,}|<!--\s*page\s*:)') THEN 'OCR text: ' || s ELSE s END),
    lambda s: CASE WHEN regexp_matches(s, '(?i)^(?:theorem|lemma|proposition|corollary|definition|proof)\b') THEN 'OCR text: ' || s ELSE s END) AS ls FROM l)
SELECT page_id, md5(regexp_replace('# OCR page ' || page_id || chr(10) || chr(10) || regexp_replace(array_to_string(ls, chr(10)), '^\s+|\s+$', '', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM m"""


def _entries(spark, folder):
    """Benchmark items as notes of two catalogs; item n links the documents n and n + 1 of each thousand."""
    items = tables.table(spark, folder, "benchmark")
    entries = items.select(F.concat(F.lit("catalog-"), F.col("item_id") % 2).alias("catalog_id"), F.col("item_id").cast("string").alias("entry_id"),
                           F.when(F.col("item_id") % 5 > 0, 1000 - F.col("item_id")).cast("int").alias("source_line"))
    docs = tables.table(spark, folder, "documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("paper_id"))
    near = docs.select("paper_id", F.explode(F.array(F.col("doc_id") % 1000, (F.col("doc_id") + 1) % 1000)).alias("item"))
    return entries, near.select(F.col("item").cast("string").alias("entry_id"), "paper_id").join(entries.select("entry_id"), "entry_id", "left_semi")


ENTRIES = """
e AS (SELECT 'catalog-' || (item_id % 2) AS catalog_id, CAST(item_id AS VARCHAR) AS entry_id, CASE WHEN item_id % 5 > 0 THEN CAST(1000 - item_id AS INT) END AS source_line FROM benchmark),
l AS (SELECT DISTINCT CAST(item AS VARCHAR) AS entry_id, 'doc-' || doc_id AS paper_id FROM (SELECT doc_id, unnest([doc_id % 1000, (doc_id + 1) % 1000]) AS item FROM documents) WHERE CAST(item AS VARCHAR) IN (SELECT entry_id FROM e))"""


def entries_with_links(spark, folder):
    return notes.entries_in_order(*_entries(spark, folder)).withColumns({c: F.col(c).cast("bigint") for c in ("place", "link_no")})


ENTRIES_SQL = q.with_(ENTRIES, """
p AS (SELECT *, row_number() OVER (PARTITION BY catalog_id ORDER BY coalesce(source_line, 2147483647), entry_id) AS place FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY paper_id) AS link_no FROM l)""", select="SELECT catalog_id, entry_id, source_line, place, paper_id, link_no FROM p LEFT JOIN n USING (entry_id)")


def note_vector_coverage(spark, folder):
    """Two sets of note vectors, of which one holds some under the wrong paper."""
    entries, links = _entries(spark, folder)
    first = links.groupBy("entry_id").agg(F.min("paper_id").alias("paper_id"))
    rows = entries.join(first, "entry_id", "left").select(F.lit("curated").alias("kind"), F.col("entry_id").alias("entity_id"), "paper_id", F.explode(F.array(F.lit("set-a"), F.lit("set-b"))).alias("model_fingerprint"))
    wrong = (F.col("model_fingerprint") == "set-b") & (F.col("entity_id").cast("int") % 7 == 0)
    return notes.note_coverage(entries, links, rows.withColumn("paper_id", F.when(wrong, "doc-none").otherwise(F.col("paper_id"))))


NOTE_COVERAGE_SQL = q.with_(ENTRIES, select="""
SELECT s AS model_fingerprint, count(*) AS notes, CAST(count_if(s = 'set-a' OR CAST(entry_id AS INT) % 7 <> 0) AS BIGINT) AS covered, bool_and(s = 'set-a' OR CAST(entry_id AS INT) % 7 <> 0) AS complete
FROM e, (VALUES ('set-a'), ('set-b')) v(s) GROUP BY ALL""")


def _vector_table(rows, name):
    return rows.select("kind", "entity_id", "paper_id", F.col("vector").cast("array<double>").alias("vector"), F.lit(name).alias("model_name"), F.lit(f"print-{name}").alias("model_fingerprint"),
                       F.size("vector").alias("dimensions"), F.lit(True).alias("normalized"), F.timestamp_seconds(F.lit(60)).alias("created_at"), F.timestamp_seconds(F.lit(60)).alias("updated_at"))


def vector_upsert(spark, folder):
    """Vectors of even ids stored, those of ids divisible by three written again with the sign turned."""
    rows = tables.stored_vectors(spark, folder)
    fresh = rows.where("vec_id % 3 = 0").withColumn("vector", F.transform("vector", lambda x: -x))
    merged = dense.upsert_vectors(_vector_table(rows.where("vec_id % 2 = 0"), "m"), fresh, "m", "print-m")
    return merged.select("entity_id", F.round(F.get("vector", F.lit(0)), 5).alias("first_value"), (F.col("created_at") == F.timestamp_seconds(F.lit(60))).alias("first_stored"))


VECTOR_UPSERT_SQL = """
SELECT 'doc-' || vec_id AS entity_id, round(CASE WHEN vec_id % 3 = 0 THEN -(embedding[1]::DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) ELSE embedding[1]::DOUBLE END, 5) AS first_value,
  vec_id % 2 = 0 AS first_stored FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0"""


def paper_set_order(spark, folder):
    rows = tables.stored_vectors(spark, folder)
    sets = rows.select(F.when(F.col("label") == 3, "section").otherwise("paper").alias("kind"), F.concat(F.lit("set-"), "label").alias("model_fingerprint"),
                       F.concat(F.lit("model-"), F.col("label") % 2).alias("model_name"), F.size("vector").cast("bigint").alias("dimensions"))
    return dense.paper_vector_sets(sets)


SET_ORDER_SQL = """
SELECT *, row_number() OVER (ORDER BY vectors DESC, model_name, dimensions, model_fingerprint) AS place FROM (
  SELECT 'set-' || label AS model_fingerprint, 'model-' || (label % 2) AS model_name, CAST(len(embedding) AS BIGINT) AS dimensions, count(*) AS vectors FROM embeddings WHERE label <> 3 GROUP BY ALL)"""


def source_limit(spark, folder):
    """The first hundred canonical sources: a run over part of the corpus."""
    return identity.first_sources(identity.deduplicate(tables.markdown_files(spark, folder)), 100).select("source_path")


LIMIT_SQL = """
SELECT source_path FROM (SELECT arg_min(p, lower(p)) AS source_path FROM (SELECT text, source || '/' || doc_id || '.md' AS p FROM documents) GROUP BY text) ORDER BY lower(source_path), source_path LIMIT 100"""


QUERIES = {
    "changed_sources": (changed_sources, _state_sql("removed", "SELECT source_path, state FROM states")),
    "incomplete_scan": (incomplete_scan, _state_sql("kept", "SELECT state, count(*) AS paths FROM states GROUP BY ALL")),
    "manifest_drift": (manifest_drift, DRIFT_SQL),
    "retired_sources": (retired_sources, RETIRED_SQL),
    "upsert_merge": (upsert_merge, UPSERT_SQL),
    "failure_log": (failure_log, FAILURE_SQL),
    "layout_changes": (layout_changes, LAYOUT_SQL),
    "reindex_compact": (reindex_compact, COMPACT_SQL),
    "hierarchy_check": (hierarchy_check, HIERARCHY_SQL),
    "coverage_check": (coverage_check, COVERAGE_SQL),
    "mirror_equality": (mirror_equality, MIRROR_SQL),
    "provenance_repair": (provenance_repair, PROVENANCE_SQL),
    "text_density_gate": (text_density_gate, DENSITY_SQL),
    "stale_vectors": (stale_vectors, STALE_SQL),
    "glob_sources": (glob_sources, GLOB_SQL),
    "excluded_sources": (excluded_sources, "SELECT source || '/' || doc_id || '.md' AS source_path FROM documents WHERE source NOT IN ('src1', 'src2')"),
    "source_lookup": (source_lookup, LOOKUP_SQL),
    "corpus_counts": (corpus_counts, COUNTS_SQL),
    "readiness": (readiness, READINESS_SQL),
    "ocr_pages": (ocr_pages, OCR_SQL),
    "entries_with_links": (entries_with_links, ENTRIES_SQL),
    "note_vector_coverage": (note_vector_coverage, NOTE_COVERAGE_SQL),
    "vector_upsert": (vector_upsert, VECTOR_UPSERT_SQL),
    "paper_set_order": (paper_set_order, SET_ORDER_SQL),
    "source_limit": (source_limit, LIMIT_SQL),
    "coverage_two_sets": (coverage_two_sets, TWO_SETS_SQL),
}
