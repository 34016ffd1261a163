"""Batches sent to Python are bounded by bytes, so a worker's memory does not grow with a split."""

import pyarrow as pa
from pyspark.sql import functions as F

from lectern.operators import dense
from lectern.session import BATCH_BYTES, shared_dir


def test_blocks_of_vectors_come_in_bounded_batches(spark):
    """Thirty blocks of 1 MB in one split, each with the queries it meets, are several batches."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["held"])

    shared_dir(spark)
    blocks = spark.range(30).coalesce(1).select(F.lit(64).alias("size"), F.repeat(F.lit("x"), 1 << 20).cast("binary").alias("block"))
    asked = spark.range(1).select(F.lit(64).alias("size"), F.repeat(F.lit("y"), 1 << 16).cast("binary").alias("asked"))
    held = [r["held"] for r in dense.meet(blocks, asked, 1 << 16).select("block", "asked").mapInArrow(sizes, "held long").collect()]
    assert sum(held) >= 30 << 20 and max(held) <= BATCH_BYTES + (2 << 20)
