"""Exact cosine search: blocks of vectors are multiplied with blocks of queries.

Both sides are packed into blocks where they lie, one row each.  A vector block meets every query
block of its size, and a task keeps the best rows of each query over the blocks it has seen, so
that what is shuffled is a short list for each query and task.  Few queries are broadcast, after
their size is measured; more are dealt, with the vector blocks, over salts.  Nothing goes through
the driver and the plan is the same for any number of queries.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import KINDS
from lectern.functions.vectors import normalized
from lectern.operators.incremental import upsert
from lectern.operators.lexical import SCORE_DIGITS, entity_key, top_per_list
from lectern.session import BROADCAST_BYTES, settle

# Rows and bytes a block holds at most.
BLOCK_ROWS = 1024
BLOCK_BYTES = 2 << 20
# Queries whose best rows a task holds before it gives them out.
HELD_QUERIES = 4096
# Vector blocks that share a salt when queries are too many to be broadcast.
SALT_BLOCKS = 16
FOUND = "query_id string, kind string, entity_id string, paper_id string, score double"


def _units(column: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    """Rows of a list column as unit vectors; a vector of no length stays zero."""
    offsets = column.offsets.to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    matrix = flat[(offsets[rows] - offsets[0])[:, None] + np.arange(size)].astype(np.float64)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _packed(rows: DataFrame, names: list[str]) -> DataFrame:
    """``size, block``: the rows of each vector size in bounded blocks, packed where they lie."""

    def pack(batches):
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                chosen = np.flatnonzero(sizes == size)
                most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(size, 1))))
                for low in range(0, len(chosen), most):
                    part = chosen[low : low + most]
                    held = {n: batch.column(n).take(pa.array(part)).to_pylist() for n in names}
                    held["units"] = _units(batch.column("vector"), part, size)
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([pickle.dumps(held)])], names=["size", "block"])

    return rows.where(F.col("vector").isNotNull()).select(*names, "vector").mapInArrow(pack, "size int, block binary")


class _Best:
    """The best rows so far of each query and level."""

    def __init__(self, limit: int):
        self.limit = limit
        self.held: dict[tuple[str, str], list] = {}

    def add(self, vectors: dict, queries: dict) -> None:
        kinds = np.array(vectors["kind"], object)
        entities, papers = np.array(vectors["entity_id"], object), np.array(vectors["paper_id"], object)
        scopes, limit = queries["scope"], self.limit
        for kind in set(vectors["kind"]):
            rows = np.flatnonzero(kinds == kind)
            scores = np.round(queries["units"] @ vectors["units"][rows].T, SCORE_DIGITS)
            for at, query in enumerate(queries["query_id"]):
                chosen, line = rows, scores[at]
                if scopes[at] is not None:
                    inside = papers[rows] == scopes[at]
                    chosen, line = rows[inside], line[inside]
                kept = self.held.setdefault((query, kind), [])
                # Every row that ties with the last place stays; the key decides later.
                least = -max(k[0] for k in kept) if len(kept) >= limit else -np.inf
                if len(line) > limit:
                    least = max(least, np.partition(line, -limit)[-limit])
                chosen, line = chosen[line >= least], line[line >= least]
                kept.extend(zip((-line).tolist(), entities[chosen], papers[chosen]))
                if len(kept) > limit:
                    kept.sort(key=lambda t: (t[0], t[1]))
                    del kept[limit:]

    def give(self) -> pa.RecordBatch:
        out = [(query, kind, e, p, -s) for (query, kind), kept in self.held.items() for s, e, p in kept]
        self.held = {}
        columns = list(zip(*out)) if out else [[]] * 5
        types = [pa.string()] * 4 + [pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=[c.split()[0] for c in FOUND.split(", ")])


def search_dense(vectors: DataFrame, queries: DataFrame, limit: int, kinds=None) -> DataFrame:
    """Best ``limit`` stored vectors per query and level by exact cosine.

    ``vectors`` has ``(kind, entity_id, paper_id, vector)`` of one vector set and
    ``queries`` has ``(query_id, vector, scope)``.  Vectors of another size never match.
    """
    rows = vectors.select("kind", "entity_id", "paper_id", F.col("vector").cast("array<float>").alias("vector"))
    if kinds is not None:
        rows = rows.where(F.col("kind").isin(list(kinds)))
    blocks = _packed(rows, ["kind", "entity_id", "paper_id"])
    dealt = queries.select("query_id", "scope", F.col("vector").cast("array<double>").alias("vector"))
    # Queries come together in few blocks; a block is bounded however many there are.
    asked = settle(_packed(dealt.coalesce(max(1, dealt.sparkSession.sparkContext.defaultParallelism // 4)), ["query_id", "scope"]).withColumnRenamed("block", "asked"))
    if asked.isEmpty():
        return top_per_list(rows.sparkSession.createDataFrame([], FOUND).withColumn("key", entity_key(F.col("kind"), F.col("entity_id"))), limit)
    bytes_asked = asked.agg(F.sum(F.length("asked"))).first()[0]
    met = meet(blocks, asked, bytes_asked)

    def multiply(batches):
        best = _Best(limit)
        for batch in batches:
            for packed, wanted in zip(batch.column("block"), batch.column("asked")):
                best.add(pickle.loads(packed.as_py()), pickle.loads(wanted.as_py()))
                if len(best.held) > HELD_QUERIES:
                    yield best.give()
        yield best.give()

    found = met.select("block", "asked").mapInArrow(multiply, FOUND)
    return top_per_list(found.withColumn("key", entity_key(F.col("kind"), F.col("entity_id"))), limit)


def meet(blocks: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """Every vector block with every query block of its size.

    Up to ``BROADCAST_BYTES`` the query blocks are broadcast and the vectors stay where they are;
    beyond, each salt of vector blocks receives the query blocks once.
    """
    if size <= BROADCAST_BYTES:
        return blocks.join(F.broadcast(asked), "size")
    held = settle(blocks)
    salts = max(1, -(-held.count() // SALT_BLOCKS))
    salted = held.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    sent = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(sent, ["size", "salt"])


def newest_set(vectors: DataFrame, model: str | None = None) -> DataFrame:
    """Rows of the most recently written vector set of each level, by model name or fingerprint."""
    chosen = vectors if model is None else vectors.where((F.col("model_fingerprint") == model) | (F.col("model_name") == model))
    newest = chosen.groupBy("kind").agg(
        F.max_by("model_fingerprint", F.struct("updated_at", "model_fingerprint")).alias("model_fingerprint")
    )
    # At most one row per level.
    return chosen.join(F.broadcast(newest), ["kind", "model_fingerprint"])


def paper_vector_sets(vectors: DataFrame) -> DataFrame:
    """Vector sets with paper-level vectors, the fullest first: sets are few, one row each."""
    sets = vector_sets(vectors.where("kind = 'paper'"))
    order = Window.orderBy(F.desc("vectors"), "model_name", "dimensions", "model_fingerprint")
    return sets.withColumn("place", F.row_number().over(order).cast("bigint"))


def upsert_vectors(stored: DataFrame, incoming: DataFrame, model_name: str, fingerprint: str) -> DataFrame:
    """``stored`` with the unit vectors of ``incoming (kind, entity_id, paper_id, vector)`` in one set.

    A set has one model and one dimension, so mixed sizes, a name or size unlike the stored
    ones, and unknown levels are errors.  The first ``created_at`` of a row stays.
    """
    kinds = {r[0] for r in incoming.select("kind").distinct().collect()} - set(KINDS)
    if kinds:
        raise ValueError(f"unsupported result kinds: {', '.join(sorted(map(str, kinds)))}")
    sizes = [r[0] for r in incoming.select(F.size("vector")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("one vector set cannot hold mixed dimensions")
    held = stored.where(F.col("model_fingerprint") == fingerprint).select("model_name", "dimensions").distinct().limit(2).collect()
    if sizes and any((r["model_name"], r["dimensions"]) != (model_name, sizes[0]) for r in held):
        raise ValueError("the fingerprint already names another model or dimension")
    rows = incoming.select(
        "kind", "entity_id", "paper_id", normalized(F.col("vector")).alias("vector"), F.lit(model_name).alias("model_name"), F.lit(fingerprint).alias("model_fingerprint"),
        F.size("vector").alias("dimensions"), F.lit(True).alias("normalized"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"),
    )
    return upsert(stored, rows, ["kind", "entity_id", "model_fingerprint"], ("created_at",))


def vector_sets(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("model_fingerprint", "model_name", "dimensions").agg(F.count("*").alias("vectors"))


def consistent_sets(vectors: DataFrame) -> DataFrame:
    """Fingerprints and whether each names exactly one (model, size, normalized) set."""
    identities = vectors.groupBy("model_fingerprint", "model_name", "dimensions", "normalized").agg(F.count("*").alias("n"))
    return identities.groupBy("model_fingerprint").agg(
        ((F.count("*") == 1) & F.bool_and("normalized")).alias("consistent"), F.sum("n").alias("vectors")
    )
