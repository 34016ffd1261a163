"""Search plans: which ranked lists a mode asks for, and how they become results.

A whole batch of queries, keyed by ``query_id``, is answered by one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import MODES, PIPELINES
from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.operators import dense, fusion, hierarchy, lexical, notes
from lectern.plans.index import Index, embed_parts
from lectern.session import broadcast_if_small, settle

# List weights of each mode.
KIND_WEIGHTS = {"paper": 1.15, "section": 1.1, "chunk": 1.0, "curated": 0.8}
ROUTED_WEIGHT = 1.2
EXACT_WEIGHTS = {"paper": 2.75, "chunk": 2.5, "normalized": 2.0, "dense": 0.35}
VARIANT_WEIGHT = 0.75
LIST_COLUMNS = ("query_id", "list_no", "weight", "rank", "key", "kind", "entity_id", "paper_id", "routing_note", "note_path")


def as_queries(spark, texts, scope: str | None = None) -> DataFrame:
    """Query rows from a list of texts."""
    rows = [(str(n), t, scope) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id string, text string, scope string")


def checked(mode: str, pipeline: str, top_k: int, per_paper: int | None) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}")
    if pipeline not in PIPELINES:
        raise ValueError(f"pipeline must be one of {sorted(PIPELINES)}")
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    if per_paper is not None and per_paper <= 0:
        raise ValueError("max_results_per_paper must be positive")


def as_list(hits: DataFrame, list_no, weight) -> DataFrame:
    """Ranked hits as fusion input; number and weight may be Columns."""
    number = list_no if isinstance(list_no, Column) else F.lit(list_no)
    share = weight if isinstance(weight, Column) else F.lit(float(weight))
    rows = hits
    for name in ("routing_note", "note_path"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    if "kind" not in rows.columns:
        rows = rows.withColumn("kind", F.split("key", ":")[0])
    return rows.withColumn("list_no", number.cast("int")).withColumn("weight", share).withColumn("rank", F.col("rank").cast("int")).select(*LIST_COLUMNS)


def _by_kind(values: dict[str, float]) -> Column:
    return reduce(lambda c, kv: c.when(F.col("kind") == kv[0], F.lit(kv[1])), list(values.items())[1:],
                  F.when(F.col("kind") == next(iter(values)), F.lit(next(iter(values.values())))))


def embed_queries(index: Index, queries: DataFrame) -> DataFrame:
    embed = vx.hash_embedding(index.settings.embedding.dimensions)
    return queries.withColumn("vector", embed(tx.feature_tokens(F.col("text"))))


def _dense(index: Index, queries: DataFrame, kinds, limit: int) -> DataFrame:
    vectors = dense.newest_set(index.only(kinds).vectors, vx.hash_identity(index.settings.embedding.dimensions)[1])
    return dense.search_dense(vectors, embed_queries(index, queries), limit)


def _split_notes(index: Index, hits: DataFrame, list_no: int) -> list[DataFrame]:
    curated = hits.where("kind = 'curated'").withColumn("list_no", F.lit(list_no))
    unlinked, boosted = notes.route_notes(curated, index.links, index.notes)
    return [
        as_list(unlinked.withColumn("kind", F.lit("curated")), list_no, KIND_WEIGHTS["curated"]),
        as_list(boosted.withColumn("kind", F.lit("paper")), list_no + 1, ROUTED_WEIGHT),
    ]


def plan_lists(index: Index, queries: DataFrame, mode: str, pipeline: str, scoped: bool = False) -> list[DataFrame]:
    """The ranked lists of a mode: lexical on the math-normalised text, dense on the raw text."""
    settings = index.settings.retrieval
    lexical_on, dense_on = pipeline != "dense", pipeline != "bm25"
    normalized = queries.withColumn("text", tx.normalize_math(F.col("text")))
    lists = []
    if mode == "exact":
        if lexical_on:
            kinds = ("chunk",) if scoped else ("paper", "chunk")
            hits = lexical.search_lexical(index, queries, kinds, settings.bm25_candidates, exact=True)
            lists.append(as_list(hits, F.when(F.col("kind") == "paper", 0).otherwise(1), _by_kind({k: EXACT_WEIGHTS[k] for k in kinds})))
            differs = tx.casefold(tx.normalize_math(F.col("text"))) != tx.casefold(F.col("text"))
            changed = queries.where(differs).withColumn("text", tx.normalize_math(F.col("text")))
            if not changed.isEmpty():
                hits = lexical.search_lexical(index, changed, ("chunk",), settings.bm25_candidates, exact=True)
                lists.append(as_list(hits, 2, EXACT_WEIGHTS["normalized"]))
        if dense_on:
            lists.append(as_list(_dense(index, queries, ("chunk",), settings.dense_candidates), 3, EXACT_WEIGHTS["dense"]))
        return lists
    kinds = ("chunk",) if mode == "precision" else ("section", "chunk") if scoped else ("paper", "section", "chunk", "curated")
    plain = [k for k in kinds if k != "curated"]
    first = {k: 2 * n for n, k in enumerate(kinds)}
    for enabled, offset in ((lexical_on, 0), (dense_on, 1)):
        if not enabled:
            continue
        if offset == 0:
            hits = lexical.search_lexical(index, normalized, kinds, settings.bm25_candidates)
        else:
            hits = _dense(index, queries, kinds, settings.dense_candidates)
        # Three lists read these few rows per query.
        hits = settle(hits) if "curated" in kinds else hits
        numbers = _by_kind({k: first[k] + offset for k in plain})
        lists.append(as_list(hits.where(F.col("kind") != "curated"), numbers, _by_kind({k: KIND_WEIGHTS[k] for k in plain})))
        if "curated" in kinds:
            lists.extend(_split_notes(index, hits, first["curated"] + 2 * offset))
    return lists


def hydrate(index: Index, pool: DataFrame, kinds=None) -> DataFrame:
    """Display columns of the pooled keys, which are of the given levels; a routed paper shows its note's path."""
    shown = (index if kinds is None else index.only(kinds)).entities.select(
        "kind", "entity_bucket", "entity_id", "section_order", "title", "authors", "year",
        F.col("section_path").alias("own_path"), "page_start", "page_end", "source_kind", "text",
    )
    bucket = F.pmod(F.xxhash64("entity_id"), F.lit(index.settings.layout.entity_buckets)).cast("int")
    return (
        pool.withColumn("entity_bucket", bucket)
        .join(shown, ["kind", "entity_bucket", "entity_id"])
        .withColumn("section_path", F.coalesce("note_path", "own_path"))
        .drop("entity_bucket", "own_path", "note_path")
    )


def finish(index: Index, fused: DataFrame, queries: DataFrame, mode: str, rerank: bool, top_k: int, per_paper: int) -> DataFrame:
    """Fused keys to result rows: pool, text, re-ranking, exact filter, diversification."""
    settings = index.settings.retrieval
    # At most the pool size per query, so the texts come to the keys and not the other way round.
    pool = broadcast_if_small(fusion.top_pool(fused, settings.rerank_candidates))
    # Texts of levels that no key is of are not looked at; there are four levels at most.
    pool = hydrate(index, pool, [r["kind"] for r in pool.select("kind").distinct().collect()] or None)
    if rerank:
        # The pool is bounded per query and read by the scorer and by the blend.
        pool = settle(pool)
        pool = fusion.blend(pool, fusion.lexical_f1(pool, queries, fusion.rerank_document()))
    if mode == "exact":
        pool = fusion.keep_exact(pool, queries)
    ranked = fusion.diversify(pool, top_k, per_paper)
    return as_results(index, with_previews(index, ranked), queries)


def with_previews(index: Index, ranked: DataFrame) -> DataFrame:
    """Sections without a text of their own show the start of what lies below them.

    Results that stay empty are left out, and ranks close up.
    """
    ranked = settle(ranked)
    bare = (F.trim("text") == "") & F.col("kind").isin("section", "chunk") & F.col("section_order").isNotNull()
    asked = ranked.where(bare).select("paper_id", F.col("section_order").alias("target_order")).distinct()
    if asked.isEmpty():
        return ranked
    requests = asked.select(F.concat_ws("#", "paper_id", "target_order").alias("request_id"), "paper_id", F.col("target_order").cast("int"), F.lit(0).cast("bigint").alias("offset"))
    requests = broadcast_if_small(requests)
    sections = index.sections.join(requests.select("paper_id").distinct(), "paper_id", "left_semi")
    if "parent_order" not in sections.columns:
        sections = hierarchy.attach_parents(sections)
    read = hierarchy.read_sections(requests, sections, max(64, 2 * index.settings.retrieval.snippet_words)).select(
        "paper_id", F.col("target_order").alias("section_order"), F.col("text").alias("_text"), F.col("page_start").alias("_start"), F.col("page_end").alias("_end")
    )
    filled = ranked.join(read, ["paper_id", "section_order"], "left")
    filled = filled.withColumn("page_start", F.when(bare, F.col("_start")).otherwise(F.col("page_start"))).withColumn("page_end", F.when(bare, F.col("_end")).otherwise(F.col("page_end")))
    filled = filled.withColumn("text", F.when(bare, F.coalesce("_text", F.lit(""))).otherwise(F.col("text"))).drop("_text", "_start", "_end")
    kept = filled.where((F.trim("text") != "") | ~F.col("kind").isin("section", "chunk"))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def as_results(index: Index, ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Public result rows with ids of this revision, page label, snippet and follow-ups."""
    asked = queries.select("query_id", F.col("text").alias("query_text"))
    result_id = F.concat(F.lit(f"r{index.revision}:"), "key")
    with_text = ranked.join(asked, "query_id")
    actions = F.to_json(
        F.struct(
            F.when(F.col("section_order").isNotNull(), F.struct(result_id.alias("result_id"), F.lit("section").alias("level"))).alias("expand_context"),
            F.when(F.col("section_order").isNotNull(), F.struct("paper_id", F.col("section_order").alias("section_id"))).alias("read_section"),
            F.when(F.col("paper_id").isNotNull(), F.struct("paper_id")).alias("paper_outline"),
            F.when(F.col("paper_id").isNotNull(), F.struct("paper_id", F.col("query_text").alias("query"))).alias("find_in_paper"),
        )
    )
    return with_text.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), result_id.alias("result_id"), "kind", "paper_id", "section_order",
        "title", F.array_join("authors", "; ").alias("authors"), "year", "section_path",
        tx.page_label(F.col("page_start"), F.col("page_end")).alias("pages"), "source_kind", F.round("score", 6).alias("score"),
        fusion.snippet(F.col("text"), F.col("query_text"), index.settings.retrieval.snippet_words).alias("snippet"),
        "routing_note", actions.alias("next_actions"),
    )


def fuse(index: Index, lists: list[DataFrame]) -> DataFrame:
    return fusion.reciprocal_rank_fusion(
        reduce(DataFrame.unionByName, lists), index.settings.retrieval.rrf_k, carry=("kind", "entity_id", "paper_id", "note_path")
    )


def search(index: Index, queries: DataFrame, mode: str = "precision", pipeline: str = "hybrid_rerank", top_k: int = 10,
           per_paper: int | None = None, scoped: bool = False) -> DataFrame:
    """Answer every query of the batch; ``scoped`` says that all rows carry a paper scope."""
    checked(mode, pipeline, top_k, per_paper)
    asked = queries.withColumn("text", tx.strip(F.col("text"))).where("text <> ''")
    fused = fuse(index, plan_lists(index, asked, mode, pipeline, scoped))
    rerank = pipeline == "hybrid_rerank" and mode != "exact"
    return finish(index, fused, asked, mode, rerank, top_k, per_paper or index.settings.retrieval.per_paper(mode))


def research_search(index: Index, queries: DataFrame, variants: DataFrame | None = None, pipeline: str = "hybrid_rerank",
                    top_k: int = 12) -> DataFrame:
    """Discovery search over each query and its given variants, re-ranked by the query.

    ``variants`` has ``(query_id, variant_no, text)`` with numbers from 1.
    """
    checked("discovery", pipeline, top_k, None)
    asked = queries.withColumn("text", tx.strip(F.col("text"))).where("text <> ''")
    base = asked.select("query_id", F.lit(0).alias("variant_no"), "text")
    every = base if variants is None else base.unionByName(variants.select("query_id", "variant_no", "text"))
    split = F.lit("\x1f")
    combined = every.select(F.concat("query_id", split, "variant_no").alias("query_id"), "text", F.lit(None).cast("string").alias("scope"))
    lists = []
    for rows in plan_lists(index, combined, "discovery", pipeline):
        number = F.element_at(F.split("query_id", split), -1).cast("int")
        lists.append(
            rows.withColumn("list_no", number * 100 + F.col("list_no"))
            .withColumn("weight", F.col("weight") * F.when(number == 0, 1.0).otherwise(VARIANT_WEIGHT))
            .withColumn("query_id", F.regexp_replace("query_id", "\x1f[0-9]+$", ""))
        )
    return finish(index, fuse(index, lists), asked, "discovery", pipeline == "hybrid_rerank", top_k,
                  index.settings.retrieval.discovery_max_results_per_paper)


def related_papers(index: Index, requests: DataFrame, top_k: int = 10) -> DataFrame:
    """Papers near each requested paper: stored vector, words, query vector, notes and shared notes.

    ``requests`` has ``(query_id, paper_id)``.
    """
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    limit = top_k + 12
    own = index.papers.select("paper_id", F.concat_ws("\n\n", F.when(F.col("title") != "", F.col("title")), F.when(F.col("abstract") != "", F.col("abstract"))).alias("text"))
    asked = requests.join(own, "paper_id").withColumn("scope", F.lit(None).cast("string"))
    vectors = dense.newest_set(index.only(("paper",)).vectors, vx.hash_identity(index.settings.embedding.dimensions)[1]).drop("kind")
    stored = requests.withColumnRenamed("paper_id", "entity_id").join(vectors.select("entity_id", "vector"), "entity_id")
    stored = stored.withColumn("scope", F.lit(None).cast("string"))
    # A paper may have any number of notes: their words and features are counted, never joined to one text.
    noted = requests.join(index.links.select("paper_id", "entry_id"), "paper_id").join(index.notes, "entry_id")
    words = noted.select("query_id", F.explode(tx.query_words(F.col("text"))).alias("phrase")).distinct()
    note_scores = lexical.score_phrases(
        index.only(("curated",)), lexical.phrase_terms(words.withColumn("scope", F.lit(None).cast("string"))), limit
    )
    note_hits = lexical.top_per_list(note_scores, limit).withColumn("list_no", F.lit(4))
    _, routed = notes.route_notes(note_hits, index.links, index.notes)
    place = F.struct(F.lit(0).alias("part"), F.coalesce("source_line", F.lit(2147483647)).alias("n"), F.col("entry_id").alias("id"))
    note_parts = noted.select(F.col("query_id").alias("paper_id"), place.alias("place"), "text")
    note_vectors = embed_parts(note_parts, index.settings.embedding.dimensions).select(
        F.col("paper_id").alias("query_id"), "vector", F.lit(None).cast("string").alias("scope")
    )
    paper_vectors = vectors.withColumn("kind", F.lit("paper"))
    shared = notes.shared_note_papers(requests, index.links, limit).select(
        "query_id", "rank", F.col("paper_id").alias("entity_id"), "paper_id", lexical.entity_key(F.lit("paper"), F.col("paper_id")).alias("key")
    )
    # Three lists of vectors in one search: the list's number goes with the query's id.
    split = F.lit("\x1f")
    vector_queries = (
        stored.select(F.concat("query_id", split, F.lit("0")).alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), "scope")
        .unionByName(embed_queries(index, asked).select(F.concat("query_id", split, F.lit("2")).alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), "scope"))
        .unionByName(note_vectors.select(F.concat("query_id", split, F.lit("3")).alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), "scope"))
    )
    near = dense.search_dense(paper_vectors, vector_queries, limit).withColumn("list_no", F.element_at(F.split("query_id", split), -1).cast("int"))
    near = near.withColumn("query_id", F.regexp_replace("query_id", "\x1f[0-9]+$", ""))
    lists = [
        as_list(near, F.col("list_no"), 1.0),
        as_list(lexical.search_lexical(index, asked, ("paper",), limit), 1, 1.0),
        as_list(routed, 4, 1.0),
        as_list(shared, 5, 1.0),
    ]
    fused = fuse(index, lists).join(requests.select("query_id", F.col("paper_id").alias("asked_id")), "query_id")
    others = fused.where("paper_id IS NOT NULL AND paper_id <> asked_id").drop("asked_id")
    ranked = fusion.diversify(others, top_k, 1, [F.desc("score"), F.asc("first_seen")]).drop("first_seen")
    shown = hydrate(index, ranked, ("paper",)).join(asked.select("query_id", F.col("text").alias("query_text")), "query_id")
    return shown.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "paper_id", "title", F.array_join("authors", "; ").alias("authors"), "year",
        F.round("score", 6).alias("score"), "source_kind", fusion.snippet(F.col("text"), F.col("query_text"), 180).alias("snippet"),
    )
