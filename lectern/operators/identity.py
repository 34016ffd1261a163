"""Exact duplicates, aliases and paper ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.session import broadcast_if_small

# File names that say nothing about the paper.
GENERIC_STEMS = (
    "article", "document", "download", "fulltext", "main", "paper", "preprint", "report", "scan", "untitled",
)


def _path_order() -> Column:
    return F.struct(
        tx.depth(F.col("source_path")).alias("depth"), tx.casefold(F.col("source_path")).alias("folded"), F.col("source_path").alias("path")
    )


def canonical_paths(sources: DataFrame) -> DataFrame:
    """Shallowest, then first path of each content hash, with the number of copies.

    A minimum per hash is combined before the shuffle, so a text copied millions of
    times sends one row per task.
    """
    return sources.groupBy("content_hash").agg(
        F.min(_path_order()).getField("path").alias("canonical_path"), F.count("*").alias("copies")
    )


def deduplicate(sources: DataFrame) -> DataFrame:
    """Canonical source rows only.

    The copies, found from paths and hashes alone, are taken away; the texts shuffle
    only if the copies are too many to broadcast.
    """
    copies = alias_rows(sources.select("source_path", "source_kind", "content_hash")).select("source_path")
    return sources.join(broadcast_if_small(copies), "source_path", "left_anti")


def first_sources(canonical: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` canonical sources by depth and path: a run over part of a corpus."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return canonical.orderBy(_path_order()).limit(limit)


def alias_rows(sources: DataFrame) -> DataFrame:
    """``source_path → canonical_path`` for every source that is a copy."""
    canonical = canonical_paths(sources).where("copies > 1").select("content_hash", "canonical_path")
    return (
        sources.select("source_path", "source_kind", "content_hash")
        .join(canonical, "content_hash")
        .where("source_path <> canonical_path")
    )


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def metadata_id(title: Column, authors: Column, year: Column, content_hash: Column) -> Column:
    """``author-year-title``; a hash prefix when the metadata is too thin."""
    year_text = F.when(year.isNotNull() & (year != 0), year.cast("string")).otherwise("")
    valid_hash = F.lower(content_hash).rlike("^[0-9a-f]{12,64}$")
    by_hash = F.when(valid_hash, F.concat(F.lit("paper-"), F.substring(F.lower(content_hash), 1, 12))).otherwise(
        F.raise_error(F.lit("content_hash must be a hexadecimal digest")).cast("string")
    )

    def chosen(author: Column, name: Column) -> Column:
        parts = F.filter(F.array(author, year_text, name), lambda p: p != "")
        return (
            F.when((name != "") & ((author != "") | (year_text != "")), _once(F.array_join(parts, "-"), lambda text: tx.slug(text)))
            .when(content_hash.isNotNull() & (content_hash != ""), by_hash)
            .when(name != "", name)
            .otherwise(F.raise_error(F.lit("no metadata and no hash to build a paper id from")).cast("string"))
        )

    return _once(tx.family_slug(authors), lambda author: _once(F.coalesce(tx.slug(title, 64), F.lit("")), lambda name: chosen(author, name)))


def stable_id(source: Column, catalog_id: Column, title: Column, authors: Column, year: Column, content_hash: Column) -> Column:
    """Catalog id, else a descriptive file stem, else metadata."""

    def by_stem(stem: Column) -> Column:
        usable = (stem != "") & ~stem.isin(*GENERIC_STEMS) & ~stem.rlike("^[0-9]+$")
        return F.when(usable, stem).otherwise(metadata_id(title, authors, year, content_hash))

    return _once(tx.slug(catalog_id), lambda listed: F.when(listed.isNotNull() & (listed != ""), listed).otherwise(_once(tx.slug(tx.stem(source)), by_stem)))


def unique_ids(candidates: DataFrame, occupied: DataFrame | None = None) -> DataFrame:
    """Resolve slug collisions: the first hash keeps the slug, others get a hash suffix.

    ``candidates`` has ``(candidate_id, content_hash, source_path)``.  The keeper is a
    per-slug minimum, combined before the shuffle; no group is ever listed.
    """
    # A source that already held the id goes before any other that asks for it.
    held = F.coalesce(F.col("held_id") == F.col("candidate_id"), F.lit(False)) if "held_id" in candidates.columns else F.lit(False)
    keeper = candidates.groupBy("candidate_id").agg(F.min(F.struct((~held).alias("new"), "source_path", "content_hash")).alias("keeper"))
    if occupied is not None:
        taken = occupied.select(F.col("paper_id").alias("candidate_id"), F.lit(True).alias("taken")).distinct()
        keeper = keeper.join(taken, "candidate_id", "left")
    else:
        keeper = keeper.withColumn("taken", F.lit(None).cast("boolean"))
    suffixed = F.concat_ws("-", "candidate_id", F.substring(F.lower("content_hash"), 1, 8))
    keeps = F.col("taken").isNull() & (F.col("content_hash") == F.col("keeper.content_hash"))
    return candidates.join(keeper, "candidate_id").select(
        "source_path", "content_hash", "candidate_id", F.when(keeps, F.col("candidate_id")).otherwise(suffixed).alias("paper_id")
    )


def papers_by_hash(papers: DataFrame, requests: DataFrame) -> DataFrame:
    """Smallest paper id for each requested content hash."""
    found = papers.groupBy("content_hash").agg(F.min("paper_id").alias("paper_id"))
    return requests.join(found, "content_hash")


def papers_by_source(papers: DataFrame, aliases: DataFrame, requests: DataFrame) -> DataFrame:
    """Paper of each requested path: by alias first, else by the paper's own path."""
    by_alias = aliases.select("source_path", F.col("paper_id").alias("alias_id"))
    direct = papers.groupBy("source_path").agg(F.min("paper_id").alias("own_id"))
    joined = requests.join(by_alias, "source_path", "left").join(direct, "source_path", "left")
    return joined.withColumn("paper_id", F.coalesce("alias_id", "own_id")).drop("alias_id", "own_id").where("paper_id IS NOT NULL")


def list_papers(papers: DataFrame) -> DataFrame:
    """Papers by year, missing years last, then title and id."""
    return papers.orderBy(F.coalesce("year", F.lit(9999)), F.lower("title"), "paper_id")
