"""Registered queries: lexical, dense and hybrid search over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.operators import dense, evaluation, fusion, lexical, notes
from lectern.operators.identity import deduplicate
from lectern.operators.postings import numbered
from lectern.plans import search as plan
from lectern.plans.corpus_data import open_corpus, open_documents
from lectern.plans.generations import GenerationLog
from lectern.plans.index import paper_entities
from lectern.plans.registered import sql as q
from lectern.session import broadcast_if_small, computed_once, settle, shared_dir, spread
from lectern.sources import tables

def no_scope():
    return F.lit(None).cast("string").alias("scope")


def benchmark_queries(spark, folder):
    return tables.table(spark, folder, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text", no_scope())


def _math(queries):
    return queries.withColumn("text", tx.normalize_math(F.col("text")))


def _shown(hits, *more):
    return hits.select("query_id", "entity_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"), *more)


def bm25_topk(spark, folder):
    index = open_documents(spark, folder)
    return _shown(lexical.search_lexical(index, _math(benchmark_queries(spark, folder)), ("paper",), 60))


BM25_SQL = q.with_(q.PAPERS, q.POSTINGS, q.LEXICAL, select="SELECT query_id, paper_id AS entity_id, rank, round(score, 6) AS score FROM lexical")


def bm25_exact_phrase(spark, folder):
    index = open_documents(spark, folder)
    return _shown(lexical.search_lexical(index, benchmark_queries(spark, folder), ("paper",), 60, exact=True))


EXACT_CTE = f"""
counts AS (SELECT entry_id, text, paper_id, title, abstract,
  (len(t) - len(replace(t, needle, '')) + len(a) - len(replace(a, needle, '')) + len(b) - len(replace(b, needle, ''))) // len(needle) AS tf
  FROM quotes, fields WHERE contains(t, needle) OR contains(a, needle) OR contains(b, needle)),
phrase_df AS (SELECT entry_id, count(*) AS df FROM counts GROUP BY ALL),
exact_scored AS (SELECT c.entry_id, c.paper_id,
  round(({q.idf('s.n', 'd.df')}) * {q.saturation('c.tf', 'l.dl', 's.avgdl')}, 9)
  + CASE WHEN contains({q.fold("c.title || chr(10) || c.abstract")}, {q.fold('c.text')}) THEN 1 ELSE 0 END AS score
  FROM counts c JOIN phrase_df d USING (entry_id) JOIN lengths l USING (paper_id) CROSS JOIN stats s),
exact_ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, 'paper:' || paper_id) AS rank FROM exact_scored) WHERE rank <= 60)"""
EXACT_SQL = q.with_(q.PAPERS, q.POSTINGS, q.LINKS, EXACT_CTE,
                    select="SELECT entry_id AS query_id, paper_id AS entity_id, rank, round(score, 6) AS score FROM exact_ranked")


def bm25_in_paper(spark, folder):
    """Each note searched inside the first paper that quotes it; statistics stay corpus-wide."""
    index = open_documents(spark, folder)
    scope = index.links.groupBy("entry_id").agg(F.min("paper_id").alias("scope"))
    queries = _math(benchmark_queries(spark, folder)).drop("scope").join(scope.withColumnRenamed("entry_id", "query_id"), "query_id")
    return _shown(lexical.search_lexical(index, queries, ("paper",), 60))


IN_PAPER_SQL = q.with_(q.PAPERS, q.POSTINGS, q.LEXICAL, q.LINKS, select="""
SELECT query_id, s.paper_id AS entity_id, CAST(1 AS BIGINT) AS rank, round(score, 6) AS score
FROM scored s JOIN (SELECT entry_id AS query_id, min(paper_id) AS paper_id FROM links GROUP BY ALL) USING (query_id, paper_id)""")


def incremental_postings(spark, folder):
    """All documents, then a review of them, then the passages: three generations, searched as one index.

    The review takes documents of low quality away and gives the others of good quality another
    author, so their rows are replaced; statistics follow without a look at the other rows.
    """
    papers = tables.whole_papers(deduplicate(tables.markdown_files(spark, folder)))
    log = GenerationLog.open(spark, f"{shared_dir(spark)}/generations-{uuid.uuid4().hex}").append(paper_entities(papers))
    marks = tables.table(spark, folder, "labels").select(F.concat(F.lit("doc-"), "doc_id").alias("paper_id"), "quality").distinct()
    reviewed = papers.join(broadcast_if_small(marks), "paper_id")
    kept = reviewed.where("quality = 1").withColumn("authors", F.transform("authors", lambda a: F.concat(a, F.lit(" reviewed"))))
    gone = reviewed.where("quality = 0").select(F.lit("paper").alias("kind"), F.col("paper_id").alias("entity_id"))
    log = log.append(paper_entities(kept.drop("quality")), gone)
    items = tables.table(spark, folder, "benchmark").select(
        F.concat(F.lit("item-"), "item_id").alias("paper_id"), F.concat(F.lit("Passage "), "item_id").alias("title"), F.array(F.lit("benchmark")).alias("authors"),
        F.lit(None).cast("int").alias("year"), F.col("text").alias("abstract"), F.lit("markdown_reference").alias("source_kind"),
    )
    log = log.append(paper_entities(items)).compact()
    return _shown(lexical.search_lexical(log.index(), _math(benchmark_queries(spark, folder)), ("paper",), 60))


INCREMENTAL_SQL = q.with_(q.PAPERS.replace("papers AS (", "first_papers AS ("), """
papers AS (
  SELECT paper_id, CASE WHEN quality = 1 THEN author || ' reviewed' ELSE author END AS author, abstract, title
  FROM first_papers LEFT JOIN (SELECT DISTINCT 'doc-' || doc_id AS paper_id, quality FROM labels) USING (paper_id) WHERE quality IS NULL OR quality = 1
  UNION ALL SELECT 'item-' || item_id, 'benchmark', text, 'Passage ' || item_id FROM benchmark)""", q.POSTINGS, q.LEXICAL,
    select="SELECT query_id, paper_id AS entity_id, rank, round(score, 6) AS score FROM lexical")


def _turn_entities(spark, folder):
    turns = tables.conversation_sections(spark, folder)
    return turns.select(
        F.lit("section").alias("kind"), F.concat_ws("#", "paper_id", F.col("section_order").cast("string")).alias("entity_id"), "paper_id",
        F.array("heading", "text").alias("match_fields"), F.array(F.concat_ws(" ", "paper_id", F.lit("conversation"))).alias("extra_fields"),
    )


class LiveIndex:
    """Index rows of one small level, computed in the query instead of read back."""

    def __init__(self, entities, buckets=8, shards=8):
        self.buckets, self.shards, self.all_shards, self.dead = buckets, shards, shards, None
        self.entities = settle(numbered(lexical.tokenized(entities), shards))
        self.postings = settle(lexical.postings(self.entities, buckets))
        self.terms = lexical.term_stats(self.postings)
        self.levels = lexical.level_stats(self.entities)
        self.placed = self.entities.withColumn("shard", F.col("entity_bucket"))

    def only(self, kinds):
        return self


def bm25_field_scoped(spark, folder):
    """Turns matched by heading and text only, while the conversation title counts for the length."""
    index = LiveIndex(_turn_entities(spark, folder))
    return _shown(lexical.search_lexical(index, _math(benchmark_queries(spark, folder)), ("section",), 60))


FIELD_SQL = q.with_(f"""
turns AS (SELECT 'conv-' || conv_id || '#' || turn AS entity_id, role || ' ' || turn AS heading, text, 'conv-' || conv_id || ' conversation' AS extra FROM conversations),
tokens AS (SELECT entity_id AS paper_id, unnest(list_concat({q.index_tokens('heading')}, {q.index_tokens('text')})) AS term FROM turns),
post AS (SELECT paper_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
lengths AS (SELECT entity_id AS paper_id, len({q.index_tokens('heading')}) + len({q.index_tokens('text')}) + len({q.index_tokens('extra')}) AS dl FROM turns),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY ALL)""", q.LEXICAL.replace("'paper:' || paper_id", "'section:' || paper_id"),
    select="SELECT query_id, paper_id AS entity_id, rank, round(score, 6) AS score FROM lexical")


def term_statistics(spark, folder):
    index = open_documents(spark, folder).only(("paper",))
    counts = index.postings.groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda n, tf: n + tf)).alias("uses"))
    return counts


TERMS_SQL = q.with_(q.PAPERS, q.POSTINGS, select="SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS uses FROM post GROUP BY ALL")


# Dense search: one query per label, the sum of the label's vectors.
def _label_queries(spark, folder):
    rows = tables.stored_vectors(spark, folder)
    parts = rows.select("label", F.posexplode("vector").alias("at", "x")).groupBy("label", "at").agg(F.sum(F.col("x").cast("double")).alias("x"))
    # At most one row per dimension in a group.
    gathered = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs"))
    return gathered.select(F.col("label").cast("string").alias("query_id"), F.transform("xs", lambda s: s["x"]).alias("vector"), no_scope())


def cosine_topk(spark, folder):
    return _shown(dense.search_dense(tables.stored_vectors(spark, folder), _label_queries(spark, folder), 60))


COSINE_SQL = """
WITH parts AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
sums AS (SELECT label, pos, sum(x) AS x FROM parts GROUP BY ALL),
asked AS (SELECT label, list(x ORDER BY pos) AS v FROM sums GROUP BY ALL),
scored AS (SELECT CAST(a.label AS VARCHAR) AS query_id, 'doc-' || e.vec_id AS entity_id, round(list_cosine_similarity(e.embedding::DOUBLE[], a.v), 9) AS score FROM embeddings e, asked a)
SELECT query_id, entity_id, rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'paper:' || entity_id) AS rank FROM scored) WHERE rank <= 60"""


def vector_normalize(spark, folder):
    unit = tables.stored_vectors(spark, folder).withColumn("unit", vx.normalized(F.col("vector")))
    return unit.select("vec_id", F.round(vx.norm(F.col("unit")), 6).alias("unit_norm"), F.round(F.get("unit", F.lit(0)), 6).alias("first_value"),
                       F.size("unit").cast("bigint").alias("dimensions"))


NORMALIZE_SQL = """
SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS unit_norm, round(u[1], 6) AS first_value, len(u) AS dimensions FROM (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings)"""


def vector_codec(spark, folder):
    """float32 bytes out and back again; every vector must survive."""
    rows = tables.stored_vectors(spark, folder)
    coded = rows.withColumn("blob", vx.encode_float32("vector")).withColumn("size", F.size("vector"))
    back = coded.withColumn("decoded", vx.decode_float32("blob", "size"))
    return back.select("vec_id", F.length("blob").cast("bigint").alias("bytes"), (F.col("decoded") == F.col("vector")).alias("same"))


CODEC_SQL = "SELECT vec_id, CAST(4 * len(embedding) AS BIGINT) AS bytes, true AS same FROM embeddings"


def _sets(spark, folder):
    """Stored vectors as several sets: one per level name and label, written in label order."""
    rows = tables.stored_vectors(spark, folder)
    return rows.select(
        F.when(F.col("label") % 2 == 0, "paper").otherwise("section").alias("kind"), "vec_id", F.concat(F.lit("set-"), "label").alias("model_fingerprint"),
        F.concat(F.lit("model-"), (F.col("label") / 2).cast("int")).alias("model_name"), F.size("vector").alias("dimensions"), F.lit(True).alias("normalized"),
        F.timestamp_seconds(F.col("label") * 60).alias("updated_at"),
    )


def vector_set_inventory(spark, folder):
    sets = _sets(spark, folder)
    return dense.vector_sets(sets).join(dense.consistent_sets(sets).drop("vectors"), "model_fingerprint").withColumn("dimensions", F.col("dimensions").cast("bigint"))


INVENTORY_SQL = """
SELECT 'set-' || label AS model_fingerprint, 'model-' || (label // 2) AS model_name, CAST(len(embedding) AS BIGINT) AS dimensions, count(*) AS vectors, true AS consistent
FROM embeddings GROUP BY ALL"""


def newest_vector_set(spark, folder):
    return dense.newest_set(_sets(spark, folder)).select("kind", "vec_id", "model_fingerprint")


NEWEST_SQL = """
WITH s AS (SELECT CASE WHEN label % 2 = 0 THEN 'paper' ELSE 'section' END AS kind, vec_id, label FROM embeddings)
SELECT kind, vec_id, 'set-' || label AS model_fingerprint FROM s JOIN (SELECT kind, max(label) AS label FROM s GROUP BY ALL) USING (kind, label)"""


def _counted_documents(spark, folder):
    """Counted features of each document, in its row; and those of ids with several rows, ``(doc_id, feature, n)``, added up.

    Only the ids are shuffled, and the features of repeated ones.
    """
    docs = spread(tables.table(spark, folder, "documents").select("doc_id", "text"))
    again = broadcast_if_small(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")))
    same = F.col("doc_id").eqNullSafe(F.col("_again"))
    counts = vx.feature_counts(tx.feature_tokens(F.col("text")))
    single = computed_once(docs.join(again, same, "left_anti"), counts=counts).select("doc_id", "counts")
    several = docs.join(again, same, "left_semi").select("doc_id", F.inline(counts))
    return single, several.groupBy("doc_id", "feature").agg(F.sum("n").alias("n"))


def hash_features(spark, folder):
    """Distinct features of each document and the sum of their weights before hashing."""
    single, several = _counted_documents(spark, folder)
    zero = F.lit(0).cast("long")
    total = lambda start, of: F.aggregate("counts", start, lambda t, c: t + of(c))
    inside = single.where(F.size("counts") > 0).select(
        "doc_id", F.size("counts").cast("long").alias("features"), total(zero, lambda c: c["n"]).alias("uses"),
        F.round(total(F.lit(0.0), lambda c: vx.feature_weight(c["feature"], c["n"])), 4).alias("weight"),
    )
    weight = vx.feature_weight(F.col("feature"), F.col("n"))
    return inside.unionByName(several.groupBy("doc_id").agg(F.count("*").alias("features"), F.sum("n").alias("uses"), F.round(F.sum(weight), 4).alias("weight")))


FEATURES_SQL = f"""
WITH t AS (SELECT doc_id, {q.feature_tokens('text')} AS tok FROM documents),
f AS (SELECT doc_id, 'word:' || unnest(tok) AS feature FROM t
  UNION ALL SELECT doc_id, 'bigram:' || x.a || chr(31) || x.b FROM (SELECT doc_id, unnest(list_transform(range(1, len(tok)), lambda i: {{'a': tok[i], 'b': tok[i + 1]}})) AS x FROM t)),
c AS (SELECT doc_id, feature, count(*) AS n FROM f GROUP BY ALL)
SELECT doc_id, count(*) AS features, CAST(sum(n) AS BIGINT) AS uses,
  round(sum((CASE WHEN starts_with(feature, 'word:') THEN 1.0::DOUBLE ELSE 0.55::DOUBLE END) * (1 + ln(n))), 4) AS weight FROM c GROUP BY doc_id"""


def hash_embedding(spark, folder):
    """Feature-hash vector of every document with MD5 slots, one row per filled slot."""
    single, several = _counted_documents(spark, folder)
    features = single.select("doc_id", F.inline("counts")).unionByName(several)
    placed = features.select("doc_id", vx.md5_slots(64)(F.col("feature")).alias("at"), vx.feature_weight(F.col("feature"), F.col("n")).alias("weight"))
    # Summed in the task first, so at most 64 rows of a document are shuffled; rounding makes sums independent of their order.
    filled = placed.groupBy("doc_id", "at.slot").agg(F.round(F.sum(F.col("at.sign") * F.col("weight")), 9).alias("value"))
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("doc_id")))
    return filled.select("doc_id", "slot", F.round(F.when(length > 0, F.col("value") / length).otherwise(0.0), 5).alias("value"))


HASH_SQL = f"""
WITH t AS (SELECT doc_id, {q.feature_tokens('text')} AS tok FROM documents),
f AS (SELECT doc_id, 'word:' || unnest(tok) AS feature FROM t
  UNION ALL SELECT doc_id, 'bigram:' || x.a || chr(31) || x.b FROM (SELECT doc_id, unnest(list_transform(range(1, len(tok)), lambda i: {{'a': tok[i], 'b': tok[i + 1]}})) AS x FROM t)),
c AS (SELECT doc_id, feature, md5(feature) AS h, count(*) AS n FROM f GROUP BY ALL),
s AS (SELECT doc_id, CAST(('0x' || substr(h, 1, 8))::BIGINT % 64 AS INT) AS slot,
  round(sum((CASE WHEN ('0x' || substr(h, 9, 1))::INT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * (CASE WHEN starts_with(feature, 'word:') THEN 1.0::DOUBLE ELSE 0.55::DOUBLE END) * (1 + ln(n))), 9) AS value FROM c GROUP BY ALL)
SELECT doc_id, slot, round(CASE WHEN len > 0 THEN value / len ELSE 0.0::DOUBLE END, 5) AS value FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS len FROM s)"""


# Hybrid search with the given vectors: document n's vector is embedding n, and so is item n's.
def _given_dense(spark, folder, index, limit=60):
    vectors = tables.stored_vectors(spark, folder).join(index.papers.select("paper_id"), "paper_id", "left_semi")
    asked = tables.table(spark, folder, "benchmark").join(tables.table(spark, folder, "embeddings"), F.col("item_id") == F.col("vec_id"))
    queries = asked.select(F.col("item_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"), no_scope())
    return dense.search_dense(vectors, queries, limit)


def _given_lists(spark, folder, index):
    words = lexical.search_lexical(index, _math(benchmark_queries(spark, folder)), ("paper",), 60)
    return [plan.as_list(words, 0, 1.15), plan.as_list(_given_dense(spark, folder, index), 1, 1.15)]


def _fused(spark, folder, index):
    return plan.fuse(index, _given_lists(spark, folder, index))


DENSE_CTE = """
dense_scored AS (SELECT CAST(b.item_id AS VARCHAR) AS query_id, 'doc-' || e.vec_id AS paper_id, round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score
  FROM benchmark b JOIN embeddings v ON v.vec_id = b.item_id CROSS JOIN embeddings e WHERE 'doc-' || e.vec_id IN (SELECT paper_id FROM papers)),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'paper:' || paper_id) AS rank FROM dense_scored) WHERE rank <= 60)"""
FUSED_CTE = """
lists AS (SELECT query_id, 0 AS list_no, rank, paper_id, 1.15::DOUBLE AS weight FROM lexical UNION ALL SELECT query_id, 1, rank, paper_id, 1.15::DOUBLE FROM dense),
fused AS (SELECT query_id, paper_id, round(sum(weight / (60 + rank)), 12) AS score, min(list_no * 100000 + rank) AS first_seen FROM lists GROUP BY ALL),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen) AS place FROM fused) WHERE place <= 40)"""


def rrf_fuse(spark, folder):
    index = open_documents(spark, folder)
    fused = _fused(spark, folder, index)
    return fused.select("query_id", "entity_id", F.round("score", 6).alias("score"), F.col("first_seen.list_no").cast("bigint").alias("first_list"))


RRF_SQL = q.with_(q.PAPERS, q.POSTINGS, q.LEXICAL, DENSE_CTE, FUSED_CTE,
                  select="SELECT query_id, paper_id AS entity_id, round(score, 6) AS score, CAST(first_seen // 100000 AS BIGINT) AS first_list FROM fused")


def _scored_pool(spark, folder):
    index = open_documents(spark, folder)
    queries = benchmark_queries(spark, folder)
    pool = settle(plan.hydrate(index, fusion.top_pool(_fused(spark, folder, index), 40), ("paper",)))
    return index, queries, pool, fusion.lexical_f1(pool, queries, fusion.rerank_document())


def lexical_f1_rerank(spark, folder):
    _, _, pool, scores = _scored_pool(spark, folder)
    return pool.select("query_id", "key", "entity_id").join(scores, ["query_id", "key"]).select("query_id", "entity_id", F.round("rerank_score", 6).alias("rerank_score"))


DOCUMENT_SQL = "'DOCUMENT: ' || title || chr(10) || 'SECTION: ' || chr(10) || 'CONTENT:' || chr(10) || CASE WHEN abstract = '' THEN title ELSE abstract END"
F1_CTE = f"""
qtok AS (SELECT CAST(item_id AS VARCHAR) AS query_id, {q.feature_tokens('text')} AS qt FROM benchmark),
dtok AS (SELECT paper_id, {q.feature_tokens(DOCUMENT_SQL)} AS dt FROM papers WHERE paper_id IN (SELECT paper_id FROM pool)),
qn AS (SELECT query_id, token, count(*) AS n FROM (SELECT query_id, unnest(qt) AS token FROM qtok) GROUP BY ALL),
dn AS (SELECT paper_id, token, count(*) AS n FROM (SELECT paper_id, unnest(dt) AS token FROM dtok) GROUP BY ALL),
shared AS (SELECT p.query_id, p.paper_id, sum(least(qn.n, dn.n))::DOUBLE AS o FROM pool p JOIN qn USING (query_id) JOIN dn USING (paper_id, token) GROUP BY ALL),
f1 AS (SELECT p.query_id, p.paper_id, p.score, p.first_seen, CASE WHEN len(dt) = 0 OR len(qt) = 0 THEN 0 ELSE least(1.0::DOUBLE,
    CASE WHEN o IS NULL THEN 0 ELSE 2.0::DOUBLE * (o / len(dt)) * (o / len(qt)) / (o / len(dt) + o / len(qt)) END
    + CASE WHEN contains(array_to_string(dt, ' '), array_to_string(qt, ' ')) THEN 0.1::DOUBLE ELSE 0 END) END AS rerank
  FROM pool p JOIN qtok USING (query_id) JOIN dtok USING (paper_id) LEFT JOIN shared USING (query_id, paper_id))"""
F1_SQL = q.with_(q.PAPERS, q.POSTINGS, q.LEXICAL, DENSE_CTE, FUSED_CTE, F1_CTE,
                 select="SELECT query_id, paper_id AS entity_id, round(rerank, 6) AS rerank_score FROM f1")


def rerank_blend(spark, folder):
    _, _, pool, scores = _scored_pool(spark, folder)
    return fusion.blend(pool, scores).select("query_id", "entity_id", F.round("score", 6).alias("score"))


def _scaled(x):
    low, high = f"min({x}) OVER (PARTITION BY query_id)", f"max({x}) OVER (PARTITION BY query_id)"
    return f"CASE WHEN abs({high} - {low}) <= 1e-9 * greatest(abs({low}), abs({high})) THEN 1.0::DOUBLE ELSE ({x} - {low}) / ({high} - {low}) END"


BLEND_CTE = f"""
blended AS (SELECT query_id, paper_id, round(0.85::DOUBLE * ({_scaled('rerank')}) + 0.15::DOUBLE * ({_scaled('score')}), 9) AS score FROM f1)"""
BLEND_SQL = q.with_(q.PAPERS, q.POSTINGS, q.LEXICAL, DENSE_CTE, FUSED_CTE, F1_CTE, BLEND_CTE,
                    select="SELECT query_id, paper_id AS entity_id, round(score, 6) AS score FROM blended")


def hybrid_search(spark, folder):
    """Flagship: words and given vectors fused, re-ranked, capped and shown with snippets."""
    index, queries, pool, scores = _scored_pool(spark, folder)
    ranked = fusion.diversify(fusion.blend(pool, scores), 10, 2)
    return plan.as_results(index, ranked, queries).select("query_id", "rank", "result_id", "title", "pages", "score", "snippet")


def _snippet_sql(text, query, words):
    return rf"""(SELECT CASE WHEN cnt <= {words} THEN {q.strip('body')} ELSE
  CASE WHEN start > 0 THEN '… ' ELSE '' END || {q.strip(f"array_to_string(ws[start + 1 : start + {words}], '')")} || CASE WHEN start + {words} < cnt THEN ' …' ELSE '' END END
  FROM (SELECT *, greatest(center - {words} // 3, 0) AS start FROM (
    SELECT *, CASE WHEN spot > 0 AND before < cnt THEN before ELSE 0 END AS center FROM (
      SELECT *, len(ws) AS cnt, len(regexp_extract_all(substr(body, 1, greatest(spot - 1, 0)), '\S+')) AS before FROM (
        SELECT {text} AS body, regexp_extract_all({text}, '\S+\s*') AS ws,
          CASE WHEN {q.fold(q.math(query))} <> '' THEN strpos({q.fold(q.math(text))}, {q.fold(q.math(query))}) ELSE 0 END AS spot)))))"""


FINAL_CTE = """
final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'paper:' || paper_id) AS rank FROM blended) WHERE rank <= 10),
shown AS (SELECT f.query_id, f.rank, f.score, p.paper_id, p.title, CASE WHEN p.abstract = '' THEN p.title ELSE p.abstract END AS txt, b.text AS query_text
  FROM final f JOIN papers p USING (paper_id) JOIN benchmark b ON CAST(b.item_id AS VARCHAR) = f.query_id)"""
HYBRID_SQL = q.with_(q.PAPERS, q.POSTINGS, q.LEXICAL, DENSE_CTE, FUSED_CTE, F1_CTE, BLEND_CTE, FINAL_CTE, select=f"""
SELECT query_id, rank, 'r1:paper:' || paper_id AS result_id, title, 'unknown' AS pages, round(score, 6) AS score, {_snippet_sql('txt', 'query_text', 300)} AS snippet FROM shown""")


def exact_filter(spark, folder):
    """Fused pool reduced to rows that hold the math-normalised query."""
    index = open_documents(spark, folder)
    pool = plan.hydrate(index, fusion.top_pool(_fused(spark, folder, index), 40), ("paper",))
    return fusion.keep_exact(pool, benchmark_queries(spark, folder)).select("query_id", "entity_id", F.round("score", 6).alias("score"))


EXACT_FILTER_SQL = q.with_(q.PAPERS, q.POSTINGS, q.LEXICAL, DENSE_CTE, FUSED_CTE, select=f"""
SELECT query_id, paper_id AS entity_id, round(score + 2.0::DOUBLE, 6) AS score FROM pool JOIN papers p USING (paper_id) JOIN benchmark b ON CAST(b.item_id AS VARCHAR) = query_id
WHERE {q.fold(q.math('b.text'))} <> '' AND contains({q.fold(q.math("p.title || chr(10) || (CASE WHEN p.abstract = '' THEN p.title ELSE p.abstract END)"))}, {q.fold(q.math('b.text'))})""")


def diversify_cap(spark, folder):
    """Turns found for each query, at most two per conversation and ten in all."""
    index = LiveIndex(_turn_entities(spark, folder))
    hits = lexical.search_lexical(index, _math(benchmark_queries(spark, folder)), ("section",), 60)
    return _shown(fusion.diversify(hits.drop("rank"), 10, 2))


DIVERSIFY_SQL = FIELD_SQL.rsplit("SELECT query_id, paper_id AS entity_id", 1)[0] + """
SELECT query_id, paper_id AS entity_id, rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'section:' || paper_id) AS rank FROM (
    SELECT query_id, paper_id, score, row_number() OVER (PARTITION BY query_id, string_split(paper_id, '#')[1] ORDER BY score DESC, 'section:' || paper_id) AS n FROM lexical) WHERE n <= 2) WHERE rank <= 10"""


def snippets(spark, folder):
    """Snippet of 40 words of every document around each quoted note, or from its start."""
    index = open_documents(spark, folder)
    asked = index.links.join(index.notes.select("entry_id", F.col("text").alias("query")), "entry_id").select("paper_id", "entry_id", "query")
    rows = index.papers.select("paper_id", "abstract").join(broadcast_if_small(asked), "paper_id", "left").na.fill({"query": "", "entry_id": ""})
    return rows.select("paper_id", "entry_id", fusion.snippet(F.col("abstract"), F.col("query"), 40).alias("snippet"))


SNIPPET_SQL = q.with_(q.PAPERS, q.LINKS, f"""
picked AS (SELECT p.paper_id, coalesce(l.entry_id, '') AS entry_id, p.abstract AS txt, coalesce(qq.text, '') AS query_text
  FROM papers p LEFT JOIN links l USING (paper_id) LEFT JOIN quotes qq ON qq.entry_id = l.entry_id)""",
    select=f"SELECT paper_id, entry_id, {_snippet_sql('txt', 'query_text', 40)} AS snippet FROM picked")


# Notes: routing, shared notes, evaluation.
def note_routing(spark, folder):
    """Notes found for each document's label-free query: every note asked against the notes."""
    index = open_documents(spark, folder)
    hits = lexical.search_lexical(index, _math(benchmark_queries(spark, folder)), ("curated",), 60).withColumn("list_no", F.lit(0))
    unlinked, boosted = notes.route_notes(hits, index.links, index.notes)
    return unlinked.select("query_id", F.lit("note").alias("target"), "entity_id", F.col("rank").cast("bigint").alias("rank"), F.lit("").alias("routing_note")).unionByName(
        boosted.select("query_id", F.lit("paper").alias("target"), "entity_id", F.col("rank").cast("bigint").alias("rank"), "routing_note")
    )


NOTE_LEXICAL = f"""
ntok AS (SELECT CAST(item_id AS VARCHAR) AS paper_id, unnest(list_concat({q.index_tokens("'Benchmark > Passages'")}, list_concat({q.index_tokens("'bullet'")}, {q.index_tokens('text')}))) AS term FROM benchmark),
post AS (SELECT paper_id, term, count(*) AS tf FROM ntok GROUP BY ALL),
lengths AS (SELECT paper_id, count(*) AS dl FROM ntok GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY ALL)"""
ROUTING_SQL = q.with_(q.PAPERS, q.LINKS, NOTE_LEXICAL, q.LEXICAL.replace("'paper:' || paper_id", "'curated:' || paper_id"), """
loose AS (SELECT query_id, paper_id AS entity_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM lexical WHERE paper_id NOT IN (SELECT entry_id FROM links)),
routed AS (SELECT x.query_id, l.paper_id, min(x.rank) AS note_rank, arg_min(x.paper_id, x.rank) AS note FROM lexical x JOIN links l ON l.entry_id = x.paper_id GROUP BY ALL)""",
    select="""
SELECT query_id, 'note' AS target, entity_id, rank, '' AS routing_note FROM loose
UNION ALL SELECT query_id, 'paper', paper_id, row_number() OVER (PARTITION BY query_id ORDER BY note_rank, paper_id), trim(b.text) FROM routed JOIN benchmark b ON CAST(b.item_id AS VARCHAR) = note""")


def _label_links(spark, folder):
    """Catalog links: one note per source and label pair, linking all its labelled documents."""
    labels = tables.table(spark, folder, "labels").join(tables.table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    return labels.select(F.concat_ws("/", "source", "quality", "toxic").alias("entry_id"), F.concat(F.lit("doc-"), "doc_id").alias("paper_id"), "source")


def shared_notes(spark, folder):
    """For the first labelled paper of each source, the papers that share its notes."""
    links = _label_links(spark, folder)
    requests = links.groupBy(F.col("source").alias("query_id")).agg(F.min("paper_id").alias("paper_id"))
    found = notes.shared_note_papers(requests, links.drop("source"), 22)
    return found.select("query_id", "paper_id", "shared", F.col("rank").cast("bigint").alias("rank"))


SHARED_SQL = """
WITH l AS (SELECT source || '/' || quality || '/' || toxic AS entry_id, 'doc-' || doc_id AS paper_id, source FROM labels JOIN documents USING (doc_id)),
r AS (SELECT source AS query_id, min(paper_id) AS asked FROM l GROUP BY ALL),
s AS (SELECT r.query_id, o.paper_id, count(*) AS shared FROM r JOIN l a ON a.paper_id = r.asked JOIN l o ON o.entry_id = a.entry_id WHERE o.paper_id <> r.asked GROUP BY ALL)
SELECT * FROM (SELECT query_id, paper_id, shared, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, paper_id) AS rank FROM s) WHERE rank <= 22"""


def _evaluated(spark, folder, hits):
    index = open_documents(spark, folder)
    relevant = index.links.select(F.col("entry_id").alias("query_id"), "paper_id")
    ranked = evaluation.unique_ranked_papers(hits)
    return evaluation.query_metrics(ranked, relevant, benchmark_queries(spark, folder))


def eval_metrics(spark, folder):
    """Quality of the lexical list with quoting papers as the relevant ones."""
    index = open_documents(spark, folder)
    hits = lexical.search_lexical(index, _math(benchmark_queries(spark, folder)), ("paper",), 60)
    metrics = _evaluated(spark, folder, hits)
    return metrics.select("query_id", *[F.round(c, 6).alias(c) for c in metrics.columns if c != "query_id"])


def _metric_sql(ranked):
    return f"""
sizes AS (SELECT entry_id AS query_id, count(*) AS relevant FROM links GROUP BY ALL),
found AS (SELECT r.query_id, count_if(rank <= 5) AS in_5, count_if(rank <= 10) AS in_10, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1) END) AS dcg
  FROM {ranked} r JOIN links l ON l.entry_id = r.query_id AND l.paper_id = r.paper_id GROUP BY ALL),
metrics AS (SELECT CAST(b.item_id AS VARCHAR) AS query_id, round(coalesce(in_5 / relevant, 0), 6)::DOUBLE AS recall_at_5, round(coalesce(in_10 / relevant, 0), 6)::DOUBLE AS recall_at_10,
  round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(10, relevant) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 0), 6) AS ndcg_at_10
  FROM benchmark b LEFT JOIN sizes s ON s.query_id = CAST(b.item_id AS VARCHAR) LEFT JOIN found f ON f.query_id = CAST(b.item_id AS VARCHAR))"""


EVAL_SQL = q.with_(q.PAPERS, q.POSTINGS, q.LEXICAL, q.LINKS, _metric_sql("lexical"), select="SELECT * FROM metrics")


def eval_mean(spark, folder):
    """Macro mean over all queries for the fused, re-ranked search."""
    _, _, pool, scores = _scored_pool(spark, folder)
    ranked = fusion.diversify(fusion.blend(pool, scores), 10, 1)
    means = evaluation.mean_metrics(_evaluated(spark, folder, ranked))
    return means.select("queries", *[F.round(c, 5).alias(c) for c in means.columns if c != "queries"])


EVAL_MEAN_SQL = q.with_(q.PAPERS, q.POSTINGS, q.LEXICAL, DENSE_CTE, FUSED_CTE, F1_CTE, BLEND_CTE, FINAL_CTE, q.LINKS, _metric_sql("final").replace(", 6)", ", 12)"),
                        select="SELECT count(*) AS queries, round(avg(recall_at_5), 5) AS recall_at_5, round(avg(recall_at_10), 5) AS recall_at_10, round(avg(mrr), 5) AS mrr, round(avg(ndcg_at_10), 5) AS ndcg_at_10 FROM metrics")


# Whole-corpus searches over the four-level snapshot; hash vectors are outside SQL.
def _corpus_search(mode, pipeline):
    def run(spark, folder):
        index = open_corpus(spark, folder)
        found = plan.search(index, benchmark_queries(spark, folder), mode, pipeline)
        return found.select("query_id", "rank", "result_id", "kind", "paper_id", "section_path", "pages", "score", "snippet", "routing_note")

    return run


def research(spark, folder):
    """Each item with its single lines as variants."""
    index = open_corpus(spark, folder)
    lines = tables.table(spark, folder, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    variants = lines.where("at > 0").select("query_id", F.col("at").alias("variant_no"), "text")
    return plan.research_search(index, benchmark_queries(spark, folder), variants).select("query_id", "rank", "result_id", "score", "snippet", "routing_note")


def find_in_paper(spark, folder):
    index = open_corpus(spark, folder)
    scope = index.links.groupBy("entry_id").agg(F.min("paper_id").alias("scope")).withColumnRenamed("entry_id", "query_id")
    queries = benchmark_queries(spark, folder).drop("scope").join(scope, "query_id")
    return plan.search(index, queries, "precision", scoped=True).select("query_id", "rank", "result_id", "paper_id", "score", "snippet")


def related(spark, folder):
    """Papers related to the first paper of each source."""
    index = open_corpus(spark, folder)
    requests = index.papers.groupBy(F.get("authors", F.lit(0)).alias("query_id")).agg(F.min("paper_id").alias("paper_id"))
    return plan.related_papers(index, requests)


QUERIES = {
    "hybrid_search": (hybrid_search, HYBRID_SQL),
    "bm25_topk": (bm25_topk, BM25_SQL),
    "incremental_postings": (incremental_postings, INCREMENTAL_SQL),
    "bm25_exact_phrase": (bm25_exact_phrase, EXACT_SQL),
    "bm25_in_paper": (bm25_in_paper, IN_PAPER_SQL),
    "bm25_field_scoped": (bm25_field_scoped, FIELD_SQL),
    "term_statistics": (term_statistics, TERMS_SQL),
    "cosine_topk": (cosine_topk, COSINE_SQL),
    "vector_normalize": (vector_normalize, NORMALIZE_SQL),
    "vector_codec": (vector_codec, CODEC_SQL),
    "vector_set_inventory": (vector_set_inventory, INVENTORY_SQL),
    "newest_vector_set": (newest_vector_set, NEWEST_SQL),
    "hash_features": (hash_features, FEATURES_SQL),
    "hash_embedding": (hash_embedding, HASH_SQL),
    "rrf_fuse": (rrf_fuse, RRF_SQL),
    "lexical_f1_rerank": (lexical_f1_rerank, F1_SQL),
    "rerank_blend": (rerank_blend, BLEND_SQL),
    "exact_filter": (exact_filter, EXACT_FILTER_SQL),
    "diversify_cap": (diversify_cap, DIVERSIFY_SQL),
    "snippets": (snippets, SNIPPET_SQL),
    "note_routing": (note_routing, ROUTING_SQL),
    "shared_notes": (shared_notes, SHARED_SQL),
    "eval_metrics": (eval_metrics, EVAL_SQL),
    "eval_mean": (eval_mean, EVAL_MEAN_SQL),
    "precision_search": (_corpus_search("precision", "hybrid_rerank"), None),
    "discovery_search": (_corpus_search("discovery", "hybrid_rerank"), None),
    "exact_search": (_corpus_search("exact", "bm25"), None),
    "research_search": (research, None),
    "find_in_paper": (find_in_paper, None),
    "related_papers": (related, None),
}
