"""What a new scan of the sources changes, and how stored rows follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx


def classify_sources(listing: DataFrame, stored: DataFrame, complete: bool = True) -> DataFrame:
    """State of every path: ``new``, ``changed``, ``unchanged``, ``copy``, ``removed`` or ``kept``.

    ``listing`` and ``stored`` have ``(source_path, content_hash)``.  A new or changed
    path whose bytes are already stored is a ``copy`` that only needs an alias.  Paths
    that are gone retire only after a complete scan and are kept otherwise.
    """
    old = stored.select("source_path", F.col("content_hash").alias("old_hash"))
    known = stored.select(F.col("content_hash"), F.lit(True).alias("known")).distinct()
    both = listing.select("source_path", "content_hash").join(old, "source_path", "full_outer").join(known, "content_hash", "left")
    state = (
        F.when(F.col("content_hash").isNull(), F.lit("removed" if complete else "kept"))
        .when(F.col("content_hash").eqNullSafe(F.col("old_hash")), "unchanged")
        .when(F.col("known"), "copy")
        .when(F.col("old_hash").isNull(), "new")
        .otherwise("changed")
    )
    return both.select("source_path", "content_hash", "old_hash", state.alias("state"))


def matching_sources(listing: DataFrame, canonical: DataFrame, patterns: list[str]) -> DataFrame:
    """Canonical sources of which any copy matches a glob by path or file name."""
    def regex(glob: str) -> str:
        import fnmatch

        return fnmatch.translate(glob).replace(r"\Z", r"\z")

    hit = F.lit(False)
    for glob in patterns:
        hit = hit | F.col("source_path").rlike(f"^{regex(glob)}") | tx.basename(F.col("source_path")).rlike(f"^{regex(glob)}")
    hashes = listing.where(hit).select("content_hash").distinct()
    return canonical.join(hashes, "content_hash", "left_semi")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows replaced by incoming rows of the same key; ``keep`` columns stay as first stored."""
    held = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep]) if keep else stored.select(*keys)
    fresh = incoming.join(held, keys, "left") if keep else incoming
    for column in keep:
        fresh = fresh.withColumn(column, F.coalesce(f"_{column}", column)).drop(f"_{column}")
    return stored.join(incoming.select(*keys), keys, "left_anti").unionByName(fresh.select(*stored.columns))


def latest_failures(log: DataFrame, cleared: DataFrame | None = None) -> DataFrame:
    """Newest error per path and stage; cleared paths drop out."""
    rows = log.groupBy("source_path", "stage").agg(
        F.max_by("error", F.struct("updated_at", "error")).alias("error"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at")
    )
    return rows if cleared is None else rows.join(cleared.select("source_path"), "source_path", "left_anti")


def reconcile_owners(papers: DataFrame, aliases: DataFrame, listing: DataFrame) -> DataFrame:
    """For each paper: stay, move to a live copy of the same bytes, or retire.

    ``papers`` has ``(paper_id, source_path, content_hash)`` and ``aliases`` every
    ``(paper_id, source_path)``.  The first live path is a minimum per paper.
    """
    live = (
        aliases.join(listing.select("source_path", F.col("content_hash").alias("now_hash")), "source_path")
        .join(papers.select("paper_id", "content_hash"), "paper_id")
        .where("now_hash = content_hash")
        .groupBy("paper_id")
        .agg(F.min(F.struct(tx.depth(F.col("source_path")).alias("depth"), tx.casefold(F.col("source_path")).alias("folded"), F.col("source_path").alias("path"))).getField("path").alias("live_path"))
    )
    own = listing.select("source_path", F.col("content_hash").alias("own_hash"))
    joined = papers.join(live, "paper_id", "left").join(own, "source_path", "left")
    action = (
        F.when(F.col("own_hash").eqNullSafe(F.col("content_hash")), "stay").when(F.col("live_path").isNotNull(), "repoint").otherwise("retire")
    )
    return joined.select(
        "paper_id", "source_path", action.alias("action"), F.when(action == "stay", F.col("source_path")).otherwise(F.col("live_path")).alias("new_path")
    )


def stale_vectors(papers: DataFrame, state: DataFrame, notes_signature: DataFrame, config_signature: str) -> DataFrame:
    """Papers whose vectors no longer match their bytes, settings or notes.

    ``state`` has ``(paper_id, content_hash, config_signature, notes_signature)``.
    """
    old = state.select("paper_id", F.col("content_hash").alias("old_hash"), F.col("config_signature").alias("old_config"), F.col("notes_signature").alias("old_notes"))
    joined = papers.select("paper_id", "content_hash").join(notes_signature, "paper_id", "left").join(old, "paper_id", "left")
    reason = (
        F.when(F.col("old_hash").isNull(), "missing")
        .when(~F.col("old_hash").eqNullSafe(F.col("content_hash")), "content")
        .when(~F.col("old_config").eqNullSafe(F.lit(config_signature)), "settings")
        .when(~F.col("old_notes").eqNullSafe(F.col("notes_signature")), "notes")
    )
    return joined.select("paper_id", reason.alias("reason")).where("reason IS NOT NULL")


def notes_signature(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Order-free signature of each paper's notes, combined before the shuffle."""
    hashed = links.select("entry_id", "paper_id").join(notes.select("entry_id", "source_line", "text"), "entry_id")
    row = F.xxhash64("entry_id", "source_line", "text").cast("decimal(38,0)")
    return hashed.groupBy("paper_id").agg(F.concat_ws(":", F.count("*"), F.sum(row), F.bit_xor(F.xxhash64("text", "source_line"))).alias("notes_signature"))


def layout_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Papers whose section or chunk layout signature differs."""
    def signature(rows):
        row = F.xxhash64("section_order", "chunk_index", "token_count", "text").cast("decimal(38,0)")
        return rows.groupBy("paper_id").agg(F.count("*").alias("n"), F.sum(row).alias("sum"))

    left = signature(old).select("paper_id", F.struct("n", "sum").alias("before"))
    right = signature(new).select("paper_id", F.struct("n", "sum").alias("after"))
    return left.join(right, "paper_id", "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).select(
        "paper_id", F.col("before.n").alias("old_chunks"), F.col("after.n").alias("new_chunks")
    )


def manifest(listing: DataFrame) -> DataFrame:
    return listing.select(F.col("source_path").alias("path"), F.col("source_kind").alias("kind"), F.col("content_hash").alias("sha256"))


def manifest_drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Manifest rows that exist on one side only."""
    gone = stored.exceptAll(current).withColumn("change", F.lit("stored only"))
    return gone.unionByName(current.exceptAll(stored).withColumn("change", F.lit("current only")))
