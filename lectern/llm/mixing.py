"""Mixing sources to target weights by weighted fair queueing.

Documents of a source stand in a shuffled order, repeated once per epoch.  A document's virtual
time is the number of its source's tokens up to it, divided by the source's weight; sorting all
sources by virtual time serves each by its weight, and cutting at the total budget gives the
mix.  Tokens are counted to the middle of the document: a source then ends within half a
document of its share, where whole finish times would always leave it short.  A source that has
run out of epochs no longer takes part, so its share goes to the others by weight.

Defined cases: a null text has size 0 and is never taken; a null source is a source, the last in
order; repeated rows are documents of their own; an empty table gives no rows; other columns are
not read.  The order of the shuffle depends on ``doc_id`` and ``seed`` only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import range_running_sum, word_count
from lectern.session import settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix"
BLOCK_ROWS = 4096


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``source, rows, source_size, weight, target``, one row per source.

    Targets fill up by weight; sources by rising ``limit / weight`` reach their limit first.  The
    windows run over one row per source.
    """
    ranked = Window.orderBy(F.asc_nulls_last("source"))
    totals = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    filled = Window.orderBy("_full", F.asc_nulls_last("source"))
    before, rest = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    limited = (
        totals.withColumn("weight", weight)
        .withColumn("_limit", epochs * F.col("source_size").cast("double"))
        .withColumn("_full", F.col("_limit") / F.col("weight"))
        .withColumn("_budget", share * F.sum("source_size").over(everything).cast("double"))
        .withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("_stops", F.col("_level") >= F.col("_full"))
        .withColumn("_free", F.sum(F.when(~F.col("_stops"), F.col("weight"))).over(everything))
        .withColumn("_spent", F.coalesce(F.sum(F.when(F.col("_stops"), F.col("_limit"))).over(everything), F.lit(0.0)))
    )
    target = F.when(F.col("_stops"), F.col("_limit")).otherwise(F.col("weight") * (F.col("_budget") - F.col("_spent")) / F.col("_free"))
    return limited.select("source", "rows", "source_size", "weight", target.alias("target"))


def queue(sized: DataFrame, targets: DataFrame, seed: str = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add each row's place in its source: ``_tie`` (the shuffle) and ``_done`` (tokens up to it).

    A source is summed in blocks of its shuffled order, so a large one is spread over many tasks.
    """
    joined = sized.join(targets.select(F.col("source").alias("_source"), "rows", "source_size", "weight", "target"), F.col("source").eqNullSafe(F.col("_source")))
    tie = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    share = F.conv(F.substring("_tie", 1, 8), 16, 10).cast("double") / float(1 << 32)
    placed = joined.withColumn("_tie", tie).withColumn("_block", F.floor(share * F.ceil(F.col("rows") / block_rows)))
    keys = ["_source", "_block"]
    earlier = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys).agg(F.sum("size").alias("_total")).select(
        F.col("_source").alias("_s"), F.col("_block").alias("_b"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys).orderBy("_tie", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_inside", F.sum("size").over(inside))
        .join(offsets, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
        .withColumn("_done", F.col("_before") + F.col("_inside"))
        .select("doc_id", "source", "size", "source_size", "weight", "target", "_tie", "_done")
    )


def virtual_time(epoch):
    return (epoch * F.col("source_size") + F.col("_done") - F.col("size") / 2) / F.col("weight")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken``, one row per row of ``docs``.

    ``copies`` is how often the mix takes the document, ``taken`` the words of these copies.
    """
    sized = settle(sizes(docs))
    targets = settle(source_targets(sized, weights, share, epochs))
    queued = settle(queue(sized, targets, seed))
    items = (
        queued.where("size > 0")
        .withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .select(virtual_time(F.col("_epoch")).alias("_time"), "_tie", "_epoch", "size")
    )
    order = ["_time", "_tie", "_epoch"]
    budget = share * (sized.agg(F.sum("size")).first()[0] or 0)
    served = range_running_sum(items, order, "size", "_served")
    last = served.where(F.col("_served") <= budget).agg(F.max(F.struct(*order)).alias("at")).first()["at"]
    copies = F.lit(0)
    if last is not None:
        for epoch in range(epochs):
            time = virtual_time(F.lit(epoch))
            tied = (F.col("_tie") < last["_tie"]) | ((F.col("_tie") == last["_tie"]) & F.lit(epoch <= last["_epoch"]))
            inside = (F.col("size") > 0) & ((time < last["_time"]) | ((time == last["_time"]) & tied))
            copies = copies + F.when(inside, 1).otherwise(0)
    return queued.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it, all columns kept.

    Rows are matched to their copies by ``doc_id``, source and size, and by number where several
    rows agree in all three.
    """
    mine = ["_mix_doc", "_mix_source", "_mix_size"]
    named = docs.withColumns({
        "_mix_doc": F.col("doc_id").cast("long"), "_mix_source": F.col("source").cast("string"), "_mix_size": word_count(F.col("text")),
    })
    numbered = named.withColumn("_mix_no", F.row_number().over(Window.partitionBy(*mine).orderBy(F.xxhash64("text"))))
    counts = mix(docs, **options).where("copies > 0").select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "copies",
        F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("copies")).alias("_n"),
    )
    matched = numbered.join(
        counts.withColumnRenamed("copies", "_mix_copies"),
        F.col("_mix_doc").eqNullSafe(F.col("_d")) & F.col("_mix_source").eqNullSafe(F.col("_s")) & (F.col("_mix_size") == F.col("_z")) & (F.col("_mix_no") == F.col("_n")),
    )
    return matched.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*docs.columns)
