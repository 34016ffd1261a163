"""Helpers that several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import settle

BATCH_BYTES = 8 << 20
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of the session limited in bytes, for text columns that go to Python.

    Rows differ widely in length; a limit by rows alone would let memory grow with the texts.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def range_running_sum(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` in the global order, without one task sorting all rows.

    Rows are dealt by range of ``order``; only one total per partition is summed in a single
    place.  The dealt rows are settled first, since partition numbers must not change on a rerun.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    dealt = settle(dealt)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(F.sum(value).alias("_total"))
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        dealt.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets, "_part")
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_part", "_before", "_inside")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges ``(a, b)``: rows ``(node, component)``, the smallest node.

    Alternates the large-star and small-star steps until the edges stay as they are.  Each step
    is a combinable minimum and an equi-join with one row per node; only a count and a checksum
    of the edges reach the driver.  Nodes without an edge to another node are not returned.
    """
    held = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return held.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                held.select("b", "b")
            ).distinct()
        seen = state
        both = held.union(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("x"), "a", "m")
        held = settle(
            small.select(F.col("a"), F.col("m").alias("b"))
            .union(small.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
