"""Corpus files on shared storage: listing, exclusion, hashing, Markdown and catalog text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators.catalog import ADMIN_FILES, match_artifacts
from lectern.operators.metadata import abstract_of, text_metadata


def relative(path: Column, root: str) -> Column:
    """Path under the root, whatever scheme the reader put before it."""
    return F.regexp_replace(path, r"^(?:[a-z0-9]+:)?/*\Q" + root.strip("/") + r"\E/+", "")


def excluded(path: Column, exclusions) -> Column:
    hit = F.lit(False)
    for prefix in (e.strip("/") for e in exclusions):
        hit = hit | (path == prefix) | path.startswith(prefix + "/")
    return hit


def scan(spark: SparkSession, root: str, suffix: str, kind: str, exclusions=()) -> DataFrame:
    """Files of a suffix under a root, with content; suffix case does not matter."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = relative(F.col("path"), root)
    return files.where(F.lower("path").endswith(suffix)).select(path.alias("source_path"), F.lit(kind).alias("source_kind"), "modificationTime", "length", "content").where(
        ~excluded(F.col("source_path"), exclusions)
    )


def listing(files: DataFrame) -> DataFrame:
    """``(source_path, source_kind, content_hash)`` of scanned files."""
    return files.select("source_path", "source_kind", F.sha2("content", 256).alias("content_hash"))


def scan_sources(spark: SparkSession, root: str, references: DataFrame | None = None, exclusions=(), admin_files=ADMIN_FILES) -> DataFrame:
    """PDF files and the Markdown files that the catalog names, unique by path and kind.

    ``admin_files`` are names that never hold a paper; add those of the site.
    """
    pdfs = scan(spark, root, ".pdf", "pdf", exclusions)
    if references is None:
        return pdfs
    named = references.where(F.lower("artifact").endswith(".md") & ~tx.casefold(tx.basename(F.col("artifact"))).isin(*admin_files))
    markdown = scan(spark, root, ".md", "markdown_reference", exclusions)
    kept = match_artifacts(named, markdown).where("artifact IS NOT NULL").select("source_path")
    return pdfs.unionByName(markdown.join(kept, "source_path", "left_semi")).dropDuplicates(["source_path", "source_kind"])


def markdown_text(files: DataFrame) -> DataFrame:
    """Decoded, cleaned Markdown with the metadata found in it; bad bytes become U+FFFD."""
    text = tx.clean_markdown(F.decode(F.col("content"), "UTF-8"))
    rows = files.select("source_path", "source_kind", F.sha2("content", 256).alias("content_hash"), text.alias("markdown"))
    return rows.withColumn("meta", text_metadata(F.col("markdown"))).select("*", "meta.*", abstract_of(F.col("markdown")).alias("abstract")).drop("meta")


def pages_to_markdown(pages: Column) -> Column:
    """Array of page texts to Markdown with one-based page markers."""
    return tx.clean_markdown(
        F.array_join(F.transform(pages, lambda p, n: F.concat(F.lit("<!-- page: "), n + 1, F.lit(" -->\n\n"), tx.strip(p))), "\n\n")
    )


def separators_to_markers(markdown: Column) -> Column:
    """``{n}-----`` page separators to page markers, counted from one."""
    separator = r"(?m)^\s*\{(-?\d+)\}\s*-{20,}\s*$"
    first = F.array_min(F.transform(F.regexp_extract_all(markdown, F.lit(separator), F.lit(1)), lambda n: n.try_cast("int")))
    parts = F.split(markdown, separator)
    numbers = F.regexp_extract_all(markdown, F.lit(separator), F.lit(1))
    shift = F.when(first == 0, 1).otherwise(0)
    joined = F.array_join(
        F.transform(parts, lambda p, n: F.when(n == 0, p).otherwise(F.concat(F.lit("<!-- page: "), F.get(numbers, n - 1).try_cast("int") + shift, F.lit(" -->"), p))), ""
    )
    return F.when(first.isNull(), markdown).otherwise(joined)


def catalog_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of catalog files with their numbers."""
    files = spark.read.text(path, wholetext=True).withColumn("catalog_id", F.input_file_name())
    return files.select("catalog_id", F.posexplode(F.split("value", r"\r\n?|\n")).alias("at", "line")).select("catalog_id", (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


def evaluation_queries(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows from JSON: a list of objects or ``{"queries": [...]}``."""
    text = spark.read.text(path, wholetext=True)
    row = "array<struct<query:string,relevant_papers:array<string>,mode:string,label_source:string,notes:string>>"
    wrapped = F.from_json("value", f"queries {row}")["queries"]
    rows = text.select(F.posexplode(F.coalesce(F.when(F.ltrim("value").startswith("["), F.from_json("value", row)), wrapped)).alias("at", "row"))
    missing = F.raise_error(F.lit("every evaluation row needs a non-empty query")).cast("string")
    query = F.when(F.trim(F.coalesce("row.query", F.lit(""))) != "", F.col("row.query")).otherwise(missing)
    return rows.select(
        F.col("at").cast("string").alias("query_id"), query.alias("text"), F.coalesce("row.relevant_papers", F.array().cast("array<string>")).alias("relevant_papers"),
        F.coalesce("row.mode", F.lit("precision")).alias("mode"), F.coalesce("row.label_source", F.lit("weak_index_label")).alias("label_source"),
    )
