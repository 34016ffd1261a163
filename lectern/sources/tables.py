"""Corpus inputs taken from the given Parquet tables.

``documents`` become Markdown files, ``benchmark`` items become curated notes,
``embeddings`` become stored vectors and ``conversations`` a second hierarchy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.session import computed_once, spread

LINES_PER_PAGE = 10
NOTE_PATH = "Benchmark > Passages"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"\S+"))


def render_markdown(text: Column) -> Column:
    """Short lines as headings, long lines as paragraphs, a page marker every ten lines."""

    def block(line, at):
        marker = F.when(
            at % LINES_PER_PAGE == 0,
            F.concat(F.lit("<!-- page: "), (at / LINES_PER_PAGE).cast("int") + 1, F.lit(" -->\n")),
        ).otherwise("")
        depth = F.when(at == 0, "# ").when(tx.more_words(line, 2), "### ").otherwise("## ")
        body = (
            F.when(tx.more_words(line, 5), line)
            .when(line.rlike(r"\S"), F.concat(depth, tx.strip(line)))
            .otherwise("")
        )
        return F.concat(marker, body)

    return F.array_join(F.transform(F.split(text, "\n"), block), "\n\n")


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """One Markdown source per document row, with path, hash and text."""
    return spread(table(spark, folder, "documents")).select(
        F.concat_ws("/", "source", F.concat("doc_id", F.lit(".md"))).alias("source_path"),
        F.lit("markdown_reference").alias("source_kind"),
        F.sha2("text", 256).alias("content_hash"),
        F.concat(F.lit("doc-"), "doc_id").alias("catalog_id"),
        F.array("source").alias("authors"),
        "lang",
        "text",
    )


def paper_rows(sources: DataFrame, abstract: Column | None = None) -> DataFrame:
    """Paper metadata of canonical sources: title, abstract and Markdown."""
    first = tx.strip(F.get(F.split("text", "\n", 2), 0))
    if abstract is None:
        paragraphs = F.filter(F.split("text", "\n"), lambda s: tx.more_words(s, 5))
        abstract = F.coalesce(tx.strip(F.get(paragraphs, 0)), F.lit(""))
    read = computed_once(computed_once(sources, first=first), long=tx.more_words(F.col("first"), 5), abstract=abstract)
    untitled = F.concat(F.lit("Document "), F.substring("catalog_id", 5, 64))
    return read.select(
        F.col("catalog_id").alias("paper_id"),
        F.when((F.col("first") != "") & ~F.col("long"), F.col("first")).otherwise(untitled).alias("title"),
        "authors", F.lit(None).cast("int").alias("year"), "abstract", "source_path", "source_kind", "content_hash",
        tx.clean_markdown(render_markdown(F.col("text"))).alias("markdown"),
    )


def whole_papers(sources: DataFrame) -> DataFrame:
    """Papers whose abstract is the document's whole text, for search at one level."""
    return paper_rows(sources, F.col("text")).drop("markdown")


def note_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").cast("string").alias("entry_id"),
        F.lit(NOTE_PATH).alias("heading_path"),
        F.lit("bullet").alias("entry_type"),
        "text",
        F.col("item_id").cast("int").alias("source_line"),
    )


def stored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.lit("paper").alias("kind"),
        F.concat(F.lit("doc-"), "vec_id").alias("entity_id"),
        F.concat(F.lit("doc-"), "vec_id").alias("paper_id"),
        "vec_id",
        "label",
        F.col("embedding").alias("vector"),
    )


def turn_papers(spark: SparkSession, folder: str) -> DataFrame:
    """One paper per conversation turn: role and number as title, the first line as abstract."""
    title = F.concat_ws(" ", F.col("role"), F.col("turn").cast("string"))
    body = tx.strip(F.col("text"))
    return table(spark, folder, "conversations").select(
        F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("paper_id"), title.alias("title"), F.array(F.concat(F.lit("conv-"), "conv_id")).alias("authors"),
        F.lit(None).cast("int").alias("year"), F.get(F.split(body, "\n"), 0).alias("abstract"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("source_path"),
        F.lit("markdown_reference").alias("source_kind"), F.sha2("text", 256).alias("content_hash"), tx.clean_markdown(F.concat(F.lit("# "), title, F.lit("\n\n"), "text")).alias("markdown"),
    )


def conversation_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as sections: user and system turns are top level, replies lie under them."""
    return table(spark, folder, "conversations").select(
        F.concat(F.lit("conv-"), "conv_id").alias("paper_id"),
        F.col("turn").cast("int").alias("section_order"),
        F.when(F.col("role") == "assistant", 2).otherwise(1).alias("level"),
        F.concat_ws(" ", F.col("role"), F.col("turn").cast("string")).alias("heading"),
        "text",
    )
