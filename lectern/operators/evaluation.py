"""Retrieval quality against labelled papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique_ranked_papers(results: DataFrame) -> DataFrame:
    """First hit of each paper, ranked anew per query."""
    first = results.where("paper_id IS NOT NULL").groupBy("query_id", "paper_id").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("query_id").orderBy("rank", "paper_id")
    return first.withColumn("rank", F.row_number().over(order))


def query_metrics(ranked: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """Recall@5, recall@10, reciprocal rank and nDCG@10 of every query; zeros without labels.

    ``ranked`` is at most as deep as the search asked for; labels only join to it and
    are counted, whatever their number.
    """
    labels = relevant.select("query_id", "paper_id").distinct()
    found = ranked.join(labels, ["query_id", "paper_id"]).groupBy("query_id").agg(
        F.count_if(F.col("rank") <= 5).alias("in_5"), F.count_if(F.col("rank") <= 10).alias("in_10"), F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= 10, 1.0 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
    )
    sizes = labels.groupBy("query_id").agg(F.count("*").alias("relevant"))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.lit(10), F.col("relevant")).cast("int")), F.lit(0.0), lambda total, n: total + 1.0 / F.log2(n + 1.0)
    )
    zero = lambda value: F.coalesce(value, F.lit(0.0))
    return (
        queries.select("query_id").join(sizes, "query_id", "left").join(found, "query_id", "left").select(
            "query_id",
            zero(F.col("in_5") / F.col("relevant")).alias("recall_at_5"),
            zero(F.col("in_10") / F.col("relevant")).alias("recall_at_10"),
            zero(1.0 / F.col("first")).alias("mrr"),
            zero(F.when(F.col("relevant") > 0, F.col("dcg") / ideal)).alias("ndcg_at_10"),
        )
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    names = ("recall_at_5", "recall_at_10", "mrr", "ndcg_at_10")
    return metrics.agg(F.count("*").alias("queries"), *[F.avg(n).alias(n) for n in names])
