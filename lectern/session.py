"""Session set-up and the one way intermediate results are cut from their lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 8 << 20
# A batch sent to Python is held there several times over.
BATCH_BYTES = 8 << 20


def get_session(app_name: str = "lectern", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Files of settled results go once nothing refers to them.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only a local-mode session may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    # A limit by rows would let memory grow with the texts.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    configured = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="lectern-", dir="/tmp")
    context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder; later branches read the files.

    Used where several branches read one expensive or order-sensitive result, so
    that a lost executor neither recomputes it nor sees it change.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Share a scan with fewer splits than cores among all cores; other scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Compute a side that is usually small, measure it, and broadcast it only within ``limit`` bytes.

    Beyond the bound the join is left to Spark, which shuffles and splits skewed keys.
    """
    held = settle(df)
    size = held.agg(F.sum(16 + F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in held.columns]))))).first()[0]
    return F.broadcast(held) if (size or 0) <= limit else held


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A plain projection may be inlined into every expression that reads it, also into
    array functions that run once per element; a generator of one row is not.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
