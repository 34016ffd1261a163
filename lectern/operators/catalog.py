"""Curated catalogs: Markdown lines to records and notes, and artifact names to papers.

A catalog is a relation of lines, not one text: headings and table headers are
carried to the lines under them span by span, so a catalog may have any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators.ranking import blocked_carry

# Catalog line patterns and the headers that name a record.
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
SEPARATOR_CELL = r"^:?-{3,}:?$"
ARTIFACT = r"(?i)(?<![\p{L}\p{N}_.-])((?:[A-Za-z0-9_.-]+/)*[A-Za-z0-9][A-Za-z0-9_.-]*\.(?:pdf|md))(?![\p{L}\p{N}_.-])"
ID_HEADERS = ("name", "id", "paper", "paper id", "record", "work")
ADMIN_FILES = ("agents.md", "index.md", "readme.md")
MAX_HEADING = 6


def split_row(line: Column) -> Column:
    """Cells of a pipe row; an escaped pipe stays in its cell."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(bare, r"(?<!\\)\|"), tx.strip)


def artifacts_in(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ARTIFACT), F.lit(1)), tx.artifact_path))


def record_id(first_cell: Column, artifacts: Column, first_header: Column, line_no: Column) -> Column:
    """Explicit id column, else the first artifact's stem, else the first cell, else the line."""
    cell = tx.record_slug(first_cell)
    by_file = tx.record_slug(tx.stem(F.get(artifacts, 0)))
    chosen = F.when(first_header.isin(*ID_HEADERS) & (cell != ""), cell).when(F.size(artifacts) > 0, by_file).otherwise(cell)
    return F.when(chosen != "", chosen).otherwise(F.concat(F.lit("curated-row-"), line_no))


def parse_catalog(lines: DataFrame) -> DataFrame:
    """``(catalog_id, line_no, line)`` to entries: table rows and bullets in line order."""
    level = F.length(F.regexp_extract("line", HEADING, 1))
    marked = lines.withColumn("level", level).withColumn("pipe", F.ltrim("line").startswith("|")).withColumn(
        "is_separator",
        F.col("pipe") & F.forall(split_row(F.col("line")), lambda c: F.regexp_replace(tx.clean_cell(c), " ", "").rlike(SEPARATOR_CELL)),
    )
    named = blocked_carry(marked, ["catalog_id"], "line_no", {"previous": F.col("line")})
    at = F.col("line_no")
    carried = {f"h{n}": F.when(F.col("level") == n, F.struct(at.alias("at"), tx.clean_cell(F.regexp_extract("line", HEADING, 2)).alias("name"))) for n in range(1, MAX_HEADING + 1)}
    carried["header"] = F.when(F.col("is_separator") & F.ltrim("previous").startswith("|"), F.struct(at.alias("at"), F.col("previous").alias("line")))
    carried["plain_at"] = F.when(~F.col("pipe"), at)
    carried["anchor_at"] = F.when(~F.col("line").rlike(r"^(?:  |\t)"), at)
    placed = blocked_carry(named, ["catalog_id"], "line_no", carried)
    parts, above = [], F.lit(-1).cast("bigint")
    for n in range(1, MAX_HEADING + 1):
        spot = F.col(f"h{n}.at")
        parts.append(F.when((spot > above) & (F.col(f"h{n}.name") != ""), F.col(f"h{n}.name")))
        above = F.greatest(above, spot)
    located = placed.withColumn("heading_path", F.concat_ws(" > ", *parts))

    in_table = F.col("pipe") & ~F.col("is_separator") & F.col("header").isNotNull() & (F.col("header.at") > F.coalesce("plain_at", F.lit(-1)))
    cells = F.transform(split_row(F.col("line")), tx.clean_cell)
    headers = F.transform(split_row(F.col("header.line")), lambda c, n: F.coalesce(F.nullif(F.lower(tx.clean_cell(c)), F.lit("")), F.concat(F.lit("column_"), n + 1)))
    rows = (
        located.where(in_table)
        .withColumn("cells", cells)
        .withColumn("headers", headers)
        .where(F.exists("cells", lambda c: c != ""))
        .withColumn("artifacts", artifacts_in(F.col("line")))
        .withColumn("record_id", record_id(F.get("cells", F.lit(0)), F.col("artifacts"), F.get("headers", F.lit(0)), at))
        .withColumn("fields", F.transform("headers", lambda h, n: F.struct(h.alias("key"), F.coalesce(F.get("cells", n), F.lit("")).alias("value"))))
    )
    files = F.when(F.size("artifacts") > 0, F.concat(F.lit("artifacts: "), F.array_join("artifacts", "; ")))
    shown = F.transform(F.filter("fields", lambda f: f["value"] != ""), lambda f: F.concat(f["key"], F.lit(": "), f["value"]))
    shown = F.when(F.size(shown) > 0, F.array_join(shown, "\n"))
    table_entries = rows.select(
        "catalog_id", "line_no", "heading_path", F.lit("table_row").alias("entry_type"), "record_id", "fields", "artifacts",
        F.concat_ws("\n", "record_id", shown, files).alias("text"),
    )

    bullet = F.trim("line").rlike(r"^[-*] ") & (F.length(F.trim("line")) > 3)
    own_anchor = F.when(F.col("line").rlike(r"^(?:  |\t)"), F.col("anchor_at")).otherwise(at)
    free = located.where(~F.col("pipe") & (F.col("level") == 0)).withColumn("anchor", own_anchor).withColumn("is_bullet", bullet)
    # The lines of one note, which is one bullet with its indented continuation.
    joined = free.groupBy("catalog_id", "anchor").agg(
        F.min(F.when(F.col("is_bullet"), at)).alias("line_no"),
        F.array_sort(F.collect_list(F.struct("line_no", tx.strip(F.col("line")).alias("line"), "heading_path"))).alias("members"),
    ).where("line_no IS NOT NULL")
    note_lines = F.filter("members", lambda m: (m["line_no"] >= F.col("line_no")) & (m["line"] != ""))
    raw = F.array_join(F.transform(note_lines, lambda m: F.when(m["line_no"] == F.col("line_no"), tx.strip(F.substring(m["line"], 2, 1 << 30))).otherwise(m["line"])), " ")
    bullets = (
        joined.withColumn("raw", raw).withColumn("artifacts", artifacts_in(F.col("raw"))).select(
            "catalog_id", "line_no", F.get(F.col("members.heading_path"), F.lit(0)).alias("heading_path"), F.lit("bullet").alias("entry_type"),
            F.lit(None).cast("string").alias("record_id"), F.lit(None).cast("array<struct<key:string,value:string>>").alias("fields"), "artifacts",
            F.concat_ws("\n", tx.clean_cell(F.col("raw")), files).alias("text"),
        )
    )
    return table_entries.unionByName(bullets)


def artifact_ids(entries: DataFrame) -> DataFrame:
    """Paper id of every named artifact: its first table row's record, else its own stem."""
    named = entries.select("catalog_id", "line_no", "record_id", F.explode("artifacts").alias("artifact"))
    first = named.groupBy("artifact").agg(F.min_by("record_id", F.when(F.col("record_id").isNotNull(), F.struct("catalog_id", "line_no"))).alias("record_id"))
    return first.select("artifact", F.coalesce("record_id", tx.record_slug(tx.stem(F.col("artifact")))).alias("paper_id"))


def _unique(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with exactly one value."""
    return rows.groupBy(key).agg(F.count("*").alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")


def match_artifacts(references: DataFrame, known: DataFrame) -> DataFrame:
    """Match catalog names to known source paths: exact path, folded path, then file name.

    A bare name counts only if its file name is unique among the sources, and a folded
    or file name match only if it is unique on both sides.  Returns every known
    ``source_path`` with its ``artifact`` or null.
    """
    refs = references.select("artifact").distinct().withColumn("folded", tx.casefold(F.col("artifact"))).withColumn("name", tx.casefold(tx.basename(F.col("artifact"))))
    paths = known.select("source_path").distinct().withColumn("folded", tx.casefold(F.col("source_path"))).withColumn("name", tx.casefold(tx.basename(F.col("source_path"))))
    one_path = _unique(paths, "folded", "source_path").select("folded", F.lit(True).alias("one_path"))
    one_name = _unique(paths, "name", "source_path").select("name", F.lit(True).alias("one_name"))
    exact = refs.select(F.col("artifact").alias("source_path"), F.col("artifact").alias("exact"))
    by_path = _unique(refs, "folded", "artifact").withColumnRenamed("artifact", "by_path")
    by_name = _unique(refs, "name", "artifact").withColumnRenamed("artifact", "by_name")
    joined = (
        paths.join(one_path, "folded", "left").join(one_name, "name", "left")
        .join(exact, "source_path", "left").join(by_path, "folded", "left").join(by_name, "name", "left")
    )
    usable = F.contains("source_path", F.lit("/")) | F.col("one_name")
    return joined.select(
        "source_path",
        F.coalesce(F.when(usable, F.col("exact")), F.when(usable & F.col("one_path"), F.col("by_path")), F.when(F.col("one_name"), F.col("by_name"))).alias("artifact"),
    )


def publish_aliases(ids: DataFrame, known: DataFrame) -> DataFrame:
    """Every spelling of an artifact with its paper id.

    Known paths take their match's id or their own stem; bare file names follow where
    one source, or one reference without sources, owns them; names shared by several
    sources are withdrawn.
    """
    matched = match_artifacts(ids, known).join(ids, "artifact", "left").select(
        F.col("source_path").alias("alias"), F.coalesce("paper_id", tx.record_slug(tx.stem(F.col("source_path")))).alias("paper_id"), F.lit(0).alias("turn")
    )
    named = ids.select(F.col("artifact").alias("alias"), "paper_id", F.lit(1).alias("turn"))
    known_names = known.select("source_path").distinct().groupBy(tx.casefold(tx.basename(F.col("source_path"))).alias("name")).agg(F.count("*").alias("sources"), F.min("source_path").alias("source_path"))
    ref_names = ids.groupBy(tx.casefold(tx.basename(F.col("artifact"))).alias("name")).agg(F.count("*").alias("references"), F.min("artifact").alias("artifact"))
    owners = known_names.join(ref_names, "name", "full_outer")
    anchored = owners.where(
        ((F.col("sources") == 1) & (F.coalesce("references", F.lit(0)) <= 1)) | (F.col("sources").isNull() & (F.col("references") == 1))
    ).withColumn("anchor", F.coalesce("source_path", "artifact"))
    direct = matched.unionByName(named)
    first_of = direct.groupBy("alias").agg(F.min_by("paper_id", "turn").alias("paper_id"))
    spelled = anchored.select("anchor", F.explode(F.array_compact(F.array(tx.basename(F.col("source_path")), tx.basename(F.col("artifact"))))).alias("alias"))
    bare = spelled.join(first_of.select(F.col("alias").alias("anchor"), "paper_id"), "anchor").select("alias", "paper_id", F.lit(2).alias("turn"))
    every = direct.unionByName(bare).groupBy("alias").agg(F.min_by("paper_id", "turn").alias("paper_id"))
    shared = known_names.where("sources > 1").select("name")
    loose = every.withColumn("name", F.when(~F.contains("alias", F.lit("/")), tx.casefold(F.col("alias"))))
    return loose.join(shared, "name", "left_anti").select("alias", "paper_id")


def link_entries(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(catalog_id, line_no, paper_id)`` links; a row without files links by its record id if that is known."""
    by_file = entries.select("catalog_id", "line_no", F.explode("artifacts").alias("alias")).join(aliases, "alias").select("catalog_id", "line_no", "paper_id")
    known = aliases.select("paper_id").distinct()
    by_record = entries.where((F.size("artifacts") == 0) & F.col("record_id").isNotNull()).select("catalog_id", "line_no", F.col("record_id").alias("paper_id"))
    return by_file.unionByName(by_record.join(known, "paper_id", "left_semi")).distinct()
