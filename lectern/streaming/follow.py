"""Following a folder: new Markdown files become section and chunk rows as they arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.config import ChunkSettings
from lectern.functions import text as tx
from lectern.operators.sections import chunk_sections, number_chunks, parse_sections
from lectern.session import settle
from lectern.sources.files import markdown_text, relative


def follow_folder(spark: SparkSession, root: str, target: str, progress: str, settings: ChunkSettings | None = None) -> StreamingQuery:
    """Start the stream; each batch writes its own folder, so that a repeated batch replaces itself."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)

    def write(batch, number: int) -> None:
        sources = batch.select(relative(F.col("path"), root).alias("source_path"), F.lit("markdown_reference").alias("source_kind"), "content")
        read = markdown_text(sources)
        # Files of one name in several folders are several papers, so the path is part of the id.
        own_id = F.concat_ws("-", tx.slug(tx.stem(F.col("source_path"))), F.substring(F.sha2("source_path", 256), 1, 12))
        papers = settle(read.select("source_path", "content_hash", own_id.alias("paper_id"), "title", "markdown"))
        owners = papers.select("paper_id", "source_path", "content_hash")
        parse_sections(papers).join(owners, "paper_id").write.mode("overwrite").parquet(f"{target}/sections/batch={number}")
        sections = spark.read.parquet(f"{target}/sections/batch={number}").drop("source_path", "content_hash")
        chunks = number_chunks(chunk_sections(sections, settings))
        chunks.join(owners, "paper_id").write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", progress).start()
