"""Snapshots that write a table when it is first read."""

from pyspark.sql import functions as F

from lectern.operators import lexical
from lectern.operators.postings import RUN_ROWS, numbered, posting_blocks
from lectern.plans import corpus_data
from lectern.plans.index import Index

FOLDER = "/root/testdata/sf0.001"


def _opened(spark, tmp_path, name):
    return corpus_data.build_corpus(spark, FOLDER, str(tmp_path / name))


def _tables(index):
    import os

    return {n for n in os.listdir(index.root)} if os.path.exists(index.root) else set()


def test_sections_alone_write_no_index(spark, tmp_path):
    index = _opened(spark, tmp_path, "a")
    assert index.sections.count() > 0
    assert _tables(index) == {"papers", "blocks", "settings", "sections"}


def test_a_level_alone_is_written_once(spark, tmp_path):
    index = _opened(spark, tmp_path, "a").only(("chunk",))
    blocks = index.postings.count()
    assert blocks == index.postings.count() == index.only(("chunk",)).postings.count()
    assert {r["kind"] for r in spark.read.parquet(f"{index.root}/entities").select("kind").distinct().collect()} == {"chunk"}
    assert "vectors" not in _tables(index) and "links" not in _tables(index)


def test_parts_equal_a_whole_snapshot(spark, tmp_path):
    """Levels written apart, in another order, give the statistics of levels written together."""
    index = _opened(spark, tmp_path, "a")
    for kind in ("curated", "chunk", "paper", "section"):
        index.only((kind,)).terms.count()
    corpus_data.whole(index)
    plain = Index(spark, index.root, index.revision, index.settings)
    counted = index.entities.select("kind", "entity_id", F.explode(F.array_distinct(F.split("tokens", " "))).alias("term")).where("term <> ''")
    want = counted.groupBy("kind", "term").agg(F.count("*").alias("df"))
    have = plain.terms.select("kind", "term", "df")
    assert have.exceptAll(want).isEmpty() and want.exceptAll(have).isEmpty()
    assert plain.levels.count() == 4 and plain.vectors.count() == plain.entities.count()


def test_shards_grow_with_the_texts(spark):
    few = spark.createDataFrame([("x" * 1000,)], "text string")
    assert corpus_data.layout_of(few).entity_buckets == corpus_data.FEWEST
    many = few.withColumn("text", F.repeat("text", 30_000)).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(20))))
    assert corpus_data.layout_of(many).entity_buckets == -(-20 * 30_000_000 // corpus_data.SHARD_BYTES)


def test_blocks_of_rows_that_lie_in_several_splits(spark):
    """Postings of dealt rows are those of shuffled ones, whatever split and order the rows come in."""
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.col("id") % 7), lambda i: F.concat(F.lit("w"), (i * 3 + F.col("id")) % 11)), " ")
    rows = spark.range(3 * RUN_ROWS).select(
        F.lit("paper").alias("kind"), F.format_string("e%05d", "id").alias("entity_id"), words.alias("tokens"), (F.col("id") % 7 + 1).cast("int").alias("dl")
    )
    held = numbered(rows, 2)
    shown = lambda blocks: blocks.select("kind", "shard", "run", "term", F.col("first_row").alias("at"), F.posexplode("rows"), "tfs").select(
        "kind", "shard", "run", "term", F.get("tfs", F.col("pos")).alias("tf")).groupBy("kind", "shard", "run", "term").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))
    want, have = shown(posting_blocks(held)), shown(posting_blocks(held.repartition(5), dealt=True))
    assert have.exceptAll(want).isEmpty() and want.exceptAll(have).isEmpty()
    assert lexical.term_stats(lexical.postings(held.repartition(5), 4, dealt=True)).agg(F.sum("df")).first()[0] == want.agg(F.sum("n")).first()[0]
