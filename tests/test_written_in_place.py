"""Tables of a snapshot and of a generation are written where their rows lie, in a codec that saves room."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lectern.config import LayoutSettings
from lectern.plans import index as plans
from lectern.plans.generations import GenerationLog


def _entities(spark, count):
    rows = spark.range(count).select(F.concat(F.lit("e"), "id").alias("entity_id"), F.concat_ws(" ", F.lit("the common words and word"), "id").alias("text"))
    return rows.select(F.lit("section").alias("kind"), "entity_id", F.col("entity_id").alias("paper_id"), F.array("text").alias("match_fields"), F.array().cast("array<string>").alias("extra_fields"))


def test_posting_blocks_of_a_generation_are_not_shuffled(spark, tmp_path, monkeypatch):
    plans_seen, plain = [], plans.write_in_place

    def seen(rows, path, partition, mode="errorifexists"):
        if path.endswith("postings"):
            plans_seen.append(rows._jdf.queryExecution().executedPlan().toString())
        plain(rows, path, partition, mode)

    monkeypatch.setattr(plans, "write_in_place", seen)
    log = GenerationLog.open(spark, str(tmp_path / "log"), LayoutSettings(term_buckets=4, entity_buckets=3))
    log = log.append(_entities(spark, 300)).append(_entities(spark, 320).where("entity_id > 'e29'"))
    assert len(plans_seen) == 2 and not any("Exchange" in p for p in plans_seen)
    held = log.table(log.generations[0].name, "postings")
    words = held.where("term = 'common'")
    assert words.agg(F.sum("n")).first()[0] == 300 and held.agg(F.countDistinct("term")).first()[0] == 305
    files = glob.glob(f"{tmp_path}/log/generations/*/*/**/*.parquet", recursive=True)
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files if pq.ParquetFile(f).metadata.num_rows} == {"ZSTD"}


def test_vectors_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    seen, plain = [], plans.write_in_place
    monkeypatch.setattr(plans, "write_in_place", lambda rows, path, *rest: seen.append((path, rows._jdf.queryExecution().executedPlan().toString())) or plain(rows, path, *rest))
    writer = plans.IndexWriter(spark, str(tmp_path / "index"), 1)
    rows = _entities(spark, 40).select("*", F.lit(None).cast("int").alias("section_order"), F.lit("t").alias("title"), F.array(F.lit("a")).alias("authors"), F.lit(None).cast("int").alias("year"), F.lit("s").alias("section_path"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), F.lit("x").alias("source_kind"), F.col("match_fields")[0].alias("text"))
    writer.entities(rows)
    writer.vectors(("section",))
    (_, plan), = [s for s in seen if s[0].endswith("vectors")]
    assert "Exchange" not in plan and writer.index.table("vectors").count() == 40
