"""One ingest run: scan, compare with the previous snapshot, write the next one.

A snapshot is immutable; the next revision takes unchanged papers' sections from the
previous one and parses only new or changed sources.  A run commits by setting a pointer, and one
bad source costs only itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.config import Settings
from lectern.functions import text as tx
from lectern.operators import catalog, entities, identity, incremental, metadata
from lectern.plans.index import Index, IndexWriter, set_pointer
from lectern.session import broadcast_if_small, settle
from lectern.sources import files
from lectern.sources.listing import list_files, read_files


def _catalog(spark: SparkSession, path: str | None) -> DataFrame | None:
    return None if path is None else settle(catalog.parse_catalog(files.catalog_lines(spark, path)))


def _record_fields(entries: DataFrame) -> DataFrame:
    """Catalog fields of each file: those of its first table row."""
    rows = entries.where("record_id IS NOT NULL").select("catalog_id", "line_no", F.explode("artifacts").alias("artifact"), F.map_from_entries("fields").alias("fields"))
    order = Window.partitionBy("artifact").orderBy("catalog_id", "line_no")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("artifact", "fields")


def read_papers(markdown: DataFrame, entries: DataFrame | None, listing: DataFrame, previous: Index | None, occupied: DataFrame | None = None) -> DataFrame:
    """Paper rows of canonical Markdown sources: id, usable title, authors, year, abstract.

    ``occupied`` has the ``paper_id`` of papers that move on unread; no other source gets these.
    """
    rows = markdown
    if entries is not None:
        ids, known = catalog.artifact_ids(entries), listing.select("source_path")
        published = catalog.publish_aliases(ids, known).select(F.col("alias").alias("source_path"), F.col("paper_id").alias("alias_id"))
        # Files of one row are several papers unless their bytes say otherwise.
        resolved = entities.resolve(entries, listing).select("source_path", F.col("paper_id").alias("resolved_id"))
        aliases = published.join(resolved, "source_path", "full_outer").select("source_path", F.coalesce("resolved_id", "alias_id").alias("catalog_id"))
        matched = catalog.match_artifacts(ids, known).join(_record_fields(entries), "artifact", "left").select("source_path", "fields")
        rows = rows.join(aliases, "source_path", "left").join(matched, "source_path", "left")
    else:
        rows = rows.withColumn("catalog_id", F.lit(None).cast("string")).withColumn("fields", F.lit(None).cast("map<string,string>"))
    wanted = identity.stable_id(F.col("source_path"), F.col("catalog_id"), F.col("title"), F.col("authors"), F.col("year"), F.col("content_hash"))
    held = None
    if previous is not None:
        # A path keeps the id it had, whatever its new text would suggest.
        held = previous.papers.select("source_path", F.col("paper_id").alias("held_id"))
        rows = rows.join(held, "source_path", "left")
    else:
        rows = rows.withColumn("held_id", F.lit(None).cast("string"))
    rows = settle(rows.withColumn("candidate_id", F.coalesce("held_id", wanted)))
    final = identity.unique_ids(rows.select("source_path", "content_hash", "candidate_id", "held_id"), occupied).select("source_path", "paper_id")
    listed = metadata.catalog_title(F.col("fields"))
    title = F.when(metadata.usable_title(F.col("title"), F.col("source_path")), F.col("title")).when(listed != "", listed).otherwise(metadata.fallback_title(F.col("source_path")))
    cited = metadata.catalog_authors(F.col("fields"))
    authors = F.when(metadata.usable_authors(F.col("authors")) | (F.size(cited) == 0), F.col("authors")).otherwise(cited)
    year = F.coalesce(tx.find_year(F.concat_ws(" ", tx.stem(F.col("source_path")), listed)), F.col("year"))
    return rows.join(final, "source_path").select(
        "paper_id", title.alias("title"), authors.alias("authors"), year.alias("year"), "abstract", "source_path", "source_kind", "content_hash", "markdown"
    )


@dataclass(frozen=True)
class Scan:
    """What one look at the sources found.

    ``listing`` has the good sources with the hashes of their bytes, ``fresh`` the contents of those
    that no earlier run has indexed, ``failures`` one row for each source or folder that failed.
    """

    listing: DataFrame
    fresh: DataFrame
    failures: DataFrame
    complete: bool


def scan_sources(spark: SparkSession, root: str, entries: DataFrame | None, settings: Settings, previous: Index | None = None, unstable: DataFrame | None = None) -> Scan:
    """List and hash the sources, read the new ones, and part those to index from those that fail.

    ``unstable`` has ``source_path`` of files that changed while an earlier attempt read them.
    """
    found = settle(list_files(spark, root).where(~files.excluded(F.col("source_path"), settings.exclude_dirs)))
    errors = found.where("error IS NOT NULL").select("source_path", F.lit("scan").alias("stage"), "error")
    wanted = found.where("error IS NULL").drop("error")
    if entries is not None:
        names = catalog.artifact_ids(entries).select("artifact").where(F.lower("artifact").endswith(".md") & ~tx.casefold(tx.basename(F.col("artifact"))).isin(*catalog.ADMIN_FILES))
        matched = catalog.match_artifacts(names, wanted.select("source_path")).where("artifact IS NOT NULL").select("source_path").distinct()
        wanted = wanted.join(matched, "source_path", "left_semi")
    hashed = read_files(wanted, content=False).drop("content").join(wanted.select("source_path", "real_path"), "source_path")
    failed = F.when(F.col("error").isNotNull(), F.struct(F.lit("read").alias("stage"), "error"))
    if unstable is not None:
        changed = F.struct(F.lit("verify").alias("stage"), F.lit("the file changed while it was read").alias("error"))
        hashed = hashed.join(unstable.select("source_path", F.lit(True).alias("moved")), "source_path", "left")
        failed = F.coalesce(failed, F.when(F.col("moved"), changed))
    hashed = settle(hashed.select("source_path", F.lit("markdown_reference").alias("source_kind"), "content_hash", "real_path", failed.alias("failed")))
    good = hashed.where("failed IS NULL").drop("failed")
    new = identity.deduplicate(good)
    if previous is not None:
        new = new.join(previous.papers.select("content_hash"), "content_hash", "left_anti")
    contents = settle(read_files(new).where("error IS NULL"))
    bare = F.trim(F.regexp_replace(F.decode("content", "UTF-8"), r"<!--.*?-->|\s", "")) == ""
    empty = contents.where(bare).select("content_hash", F.struct(F.lit("parse").alias("stage"), F.lit("no readable text").alias("error")).alias("failed"))
    parted = settle(good.join(broadcast_if_small(empty), "content_hash", "left"))
    failures = errors.unionByName(hashed.where("failed IS NOT NULL").select("source_path", "failed.*")).unionByName(parted.where("failed IS NOT NULL").select("source_path", "failed.*"))
    listing = parted.where("failed IS NULL").drop("failed")
    fresh = contents.where(~bare).select("source_path", F.lit("markdown_reference").alias("source_kind"), "content")
    return Scan(listing, fresh, settle(failures), errors.isEmpty())


def changed_since(scan: Scan) -> DataFrame:
    """``source_path`` of indexed files whose bytes are not those that were read: a second look, by hash alone."""
    again = read_files(scan.listing, content=False).select("source_path", F.col("content_hash").alias("now_hash"))
    return scan.listing.join(again, "source_path").where(~F.col("now_hash").eqNullSafe(F.col("content_hash"))).select("source_path")


def ingest(spark: SparkSession, root: str, catalog_path: str | None, target: str, revision: int, settings: Settings | None = None,
           previous: Index | None = None, complete: bool = True, attempts: int = 3) -> tuple[Index, DataFrame]:
    """Write revision ``revision`` under ``target``; returns it with the path states of the run.

    A source that cannot be listed, read or parsed becomes a row of the ``failures`` table, and what
    was known of it stays.  Each attempt goes to a folder of its own; the revision's pointer is set
    to it once a second look finds the same bytes.  Sources that changed meanwhile count as failed
    in the next attempt.  Papers whose files were not seen stay if the scan met errors, or if
    ``complete=False`` says that more sources exist than were scanned.
    """
    settings = settings or Settings()
    entries = _catalog(spark, catalog_path)
    unstable = None
    for attempt in range(attempts):
        scan = scan_sources(spark, root, entries, settings, previous, unstable)
        index, states = _write_revision(spark, scan, entries, target, revision, attempt, settings, previous, complete and scan.complete)
        moved = settle(changed_since(scan))
        if moved.isEmpty():
            set_pointer(spark, target, revision, index.root)
            return index, states.groupBy("state").agg(F.count("*").alias("paths"))
        unstable = moved if unstable is None else settle(unstable.unionByName(moved).distinct())
    raise RuntimeError(f"sources kept changing in {attempts} attempts; revision {revision} was not committed")


def _write_revision(spark, scan: Scan, entries, target: str, revision: int, attempt: int, settings: Settings, previous: Index | None, complete: bool):
    listing = scan.listing.drop("real_path")
    stored = listing.limit(0) if previous is None else spark.read.parquet(f"{previous.root}/manifest")
    failed = scan.failures.select("source_path").distinct()
    # A source that failed is neither gone nor changed: it stays as it was stored.
    retained = stored.join(failed, "source_path", "left_semi")
    seen = settle(listing.unionByName(retained.select(*listing.columns)))
    states = settle(incremental.classify_sources(seen, stored, complete).join(failed.withColumn("_failed", F.lit(True)), "source_path", "left").select(
        "source_path", "content_hash", "old_hash", F.when(F.col("_failed"), "failed").otherwise(F.col("state")).alias("state")
    ))
    canonical = identity.deduplicate(listing)
    known = listing.select("source_path")
    if previous is None:
        papers = read_papers(files.markdown_text(scan.fresh), entries, listing, None)
        kept = None
    else:
        # Papers whose bytes are still present move on unread; only other hashes are parsed.
        live = canonical.select("content_hash", F.col("source_path").alias("live_path"))
        same = previous.papers.join(live, "content_hash").withColumn("source_path", F.col("live_path")).drop("live_path")
        held = retained.select("source_path")
        if not complete:
            held = held.unionByName(states.where("state = 'kept'").select("source_path")).distinct()
        same = same.unionByName(previous.papers.join(live, "content_hash", "left_anti").join(held, "source_path", "left_semi"))
        kept = settle(same)
        papers = kept.unionByName(read_papers(files.markdown_text(scan.fresh), entries, listing, previous, kept.select("paper_id")))
    writer = IndexWriter(spark, target, revision, settings, attempt)
    writer.papers(papers)
    writer.hierarchy(previous, None if kept is None else kept.select("paper_id"))
    writer.child_levels()
    manifest = seen if complete or previous is None else seen.unionByName(stored.join(states.where("state = 'kept'"), "source_path", "left_semi").select(*seen.columns))
    notes, links = _notes(entries, known, writer.index, listing)
    writer.notes(notes, links)
    writer.vectors()
    writer.write("manifest", manifest)
    writer.write("failures", _failure_log(spark, scan, previous, complete))
    return writer.index, states


def _failure_log(spark, scan: Scan, previous: Index | None, complete: bool) -> DataFrame:
    """The newest error of each path and stage; paths that were read again, or are gone, drop out."""
    now = F.current_timestamp()
    fresh = scan.failures.select("source_path", "stage", "error", now.alias("created_at"), now.alias("updated_at"))
    if previous is None or not previous.has("failures"):
        return incremental.latest_failures(fresh)
    old = previous.table("failures")
    still = old.join(scan.failures.select("source_path", "stage"), ["source_path", "stage"], "left_semi")
    if not complete:
        # What an incomplete scan did not see may still be broken.
        unseen = old.join(scan.listing.select("source_path"), "source_path", "left_anti").join(scan.failures.select("source_path"), "source_path", "left_anti")
        still = still.unionByName(unseen)
    return incremental.latest_failures(still.unionByName(fresh))


def _notes(entries: DataFrame | None, known: DataFrame, index: Index, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog entries as notes, linked to the papers their files finally became."""
    spark = index.spark
    if entries is None:
        empty = spark.createDataFrame([], "entry_id string, heading_path string, entry_type string, text string, source_line int")
        return empty, spark.createDataFrame([], "entry_id string, paper_id string")
    # Lines of several catalogs are told apart by the file.
    entry_id = F.concat_ws("#", F.substring(F.sha2("catalog_id", 256), 1, 8), "line_no")
    notes = entries.select(entry_id.alias("entry_id"), "heading_path", "entry_type", "text", F.col("line_no").cast("int").alias("source_line"))
    by_hash = index.papers.select("content_hash", F.col("paper_id").alias("final_id"))
    finals = listing.select("source_path", "content_hash").join(by_hash, "content_hash").select(F.col("source_path").alias("alias"), "final_id")
    matched = catalog.match_artifacts(catalog.artifact_ids(entries), known).where("artifact IS NOT NULL").select("artifact", F.col("source_path").alias("alias"))
    named = matched.join(finals, "alias").select(F.col("artifact").alias("alias"), F.col("final_id").alias("paper_id"))
    by_file = catalog.link_entries(entries, named.groupBy("alias").agg(F.min("paper_id").alias("paper_id")))
    return notes, by_file.select(entry_id.alias("entry_id"), "paper_id")
