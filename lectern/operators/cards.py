"""Research cards: one deterministic routing row per paper."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import metadata

TOPICS = 16


def research_cards(papers: DataFrame, sections: DataFrame, notes: DataFrame, links: DataFrame) -> DataFrame:
    """Headings, number of notes and topics of each paper.

    Topic words are counted over the parts of a card, as a paper may have any number
    of notes; the notes themselves stay rows of the link table.
    """
    headings = sections.where("heading <> ''")
    listed = headings.groupBy("paper_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("section_order", "heading_path"))), lambda h: h["heading_path"]).alias("section_headings")
    )
    noted = links.select("entry_id", "paper_id").join(notes, "entry_id").select("paper_id", F.trim("text").alias("text"), "source_line").where("text <> ''")
    distinct = noted.groupBy("paper_id", "text").agg(F.min("source_line").alias("source_line"))
    counts = distinct.groupBy("paper_id").agg(F.count("*").alias("notes"))
    parts = (
        papers.select("paper_id", F.lit(0).alias("part"), F.lit(0).alias("n"), F.concat_ws("\n", "title", "abstract").alias("text"))
        .unionByName(headings.select("paper_id", F.lit(1).alias("part"), F.col("section_order").alias("n"), F.col("heading_path").alias("text")))
        .unionByName(distinct.select("paper_id", F.lit(2).alias("part"), F.coalesce("source_line", F.lit(2147483647)).alias("n"), "text"))
    )
    words = F.transform(F.regexp_extract_all("text", F.lit(metadata.TOPIC_WORD), F.lit(0)), lambda w: F.lower(w))
    counted = (
        parts.select("paper_id", "part", "n", F.posexplode(words).alias("place", "topic"))
        .where(~F.col("topic").isin(*metadata.STOP_WORDS))
        .groupBy("paper_id", "topic")
        .agg(F.count("*").alias("uses"), F.min(F.struct("part", "n", "place")).alias("place"))
    )
    order = Window.partitionBy("paper_id").orderBy(F.desc("uses"), F.asc("place"))
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOPICS)
    topics = top.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))), lambda t: t["topic"]).alias("topics"))
    empty = F.array().cast("array<string>")
    return (
        papers.select("paper_id", "title", F.array_join("authors", "; ").alias("authors"), "year", "abstract", "source_kind")
        .join(listed, "paper_id", "left").join(counts, "paper_id", "left").join(topics, "paper_id", "left")
        .withColumn("section_headings", F.to_json(F.coalesce("section_headings", empty)))
        .withColumn("topics", F.to_json(F.coalesce("topics", empty)))
        .na.fill(0, ["notes"])
    )


def write_cards(cards: DataFrame, path: str) -> None:
    """Cards as JSON lines; an existing folder is never overwritten."""
    cards.write.mode("errorifexists").json(path)
