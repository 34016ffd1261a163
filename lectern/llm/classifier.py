"""A quality classifier: random-indexing word vectors, pooled per text, under a two-layer network.

Words are runs of one kind of character (lower-case letters, capitals, digits, other signs).  A
word's vector is the sum of the sparse random vectors of the words around it, over all documents;
vectors are kept by hash of the word in a table of fixed size, 1 MB, which each task fills for its
rows and Spark adds up.  A text is the mean and the spread of its word vectors.  The network is
trained with numpy on at most ``TRAIN_ROWS`` labelled rows, its temperature on a part kept aside.

Defined cases: a null or empty text, or one without words, has a zero vector and still gets a
score; without labels of both kinds every score is the share of the label that was seen, or 0.5;
repeated rows are judged alike; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.language import remainder
from lectern.llm.shared import bounded_batches
from lectern.llm.words import WHITE_SPACE, WordHasher, byte_slices
from lectern.session import settle

BUCKET_BITS = 13
SIZE = 32
SPARSE = 2
REACH = 2
GROUPS = 64
TRAIN_ROWS = 20_000
HIDDEN = 32
ROUNDS = 60
THRESHOLD = 0.3


def character_classes() -> np.ndarray:
    classes = np.full(256, 4, np.uint8)
    classes[97:123] = classes[128:] = 1
    classes[65:91] = 2
    classes[48:58] = 3
    classes[list(WHITE_SPACE)] = 0
    return classes


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def context_table(docs: DataFrame) -> np.ndarray:
    """One vector per bucket of words, counted over all texts; a table of fixed size."""
    cells = SIZE << BUCKET_BITS
    per_group = cells // GROUPS

    def count(batches):
        hasher, table = WordHasher(classes=character_classes()), np.zeros(cells, np.int64)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                hashes, first = hasher(part.column("text"))
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                base = _buckets(hashes) * SIZE
                for step in range(1, REACH + 1):
                    near = row[step:] == row[:-step]
                    for own, other in ((slice(None, -step), slice(step, None)), (slice(step, None), slice(None, -step))):
                        where, around = base[own][near], hashes[other][near]
                        for at in range(SPARSE):
                            bits = around >> np.uint64(8 * at)
                            place = where + (bits & np.uint64(SIZE - 1)).astype(np.int64)
                            up = (bits & np.uint64(128)) > 0
                            table += np.bincount(place[up], minlength=cells)
                            table -= np.bincount(place[~up], minlength=cells)
        for group in range(GROUPS):
            part = table[group * per_group : (group + 1) * per_group]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slot", "cells"])

    def add(batches):
        totals: dict = {}
        for batch in batches:
            for group, raw in zip(batch.column("slot").to_pylist(), batch.column("cells").to_pylist()):
                part = np.frombuffer(raw, np.int64)
                totals[group] = totals[group] + part if group in totals else part
        for group, part in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slot", "cells"])

    shape = "slot int, cells binary"
    parts = bounded_batches(docs).select(F.col("text").cast("string")).mapInArrow(count, shape).repartition(GROUPS, "slot").mapInArrow(add, shape).collect()
    table = np.zeros((GROUPS, per_group))
    for r in parts:
        table[r["slot"]] = np.frombuffer(r["cells"], np.int64)
    table = table.reshape(-1, SIZE)
    return (table / np.maximum(np.sqrt((table * table).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)


def pooled(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """``doc_id, features``: mean and spread of the word vectors of every text, as float32 bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def pool(batches):
        hasher = WordHasher(classes=character_classes())
        for batch in batches:
            for part in byte_slices(batch, "text"):
                hashes, first = hasher(part.column("text"))
                buckets, raw = _buckets(hashes), []
                for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
                    vectors = shared.value[buckets[low:high]]
                    row = np.zeros(2 * SIZE, np.float32) if low == high else np.concatenate([vectors.mean(axis=0), vectors.std(axis=0)])
                    raw.append(row.astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "features"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pool, "doc_id long, features binary")


class Network:
    """Two layers with a temperature; scores are chances of label 1."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, hidden: int = HIDDEN, rounds: int = ROUNDS):
        self.constant = None
        if len(labels) == 0 or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return
        draw = np.random.default_rng(5)
        self.centre, self.scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
        order = draw.permutation(len(rows))
        aside = max(1, len(rows) // 5)
        test, train = order[:aside], order[aside:]
        x, y = (rows[train] - self.centre) / self.scale, labels[train].astype(float)
        sizes = [(x.shape[1], hidden), (hidden,), (hidden, 1), (1,)]
        self.weights = [draw.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for s in sizes]
        self.temperature = 1.0
        moment = [np.zeros(s) for s in sizes], [np.zeros(s) for s in sizes]
        step = 0
        for _ in range(rounds):
            for low in range(0, len(x), 128):
                pick = draw.integers(0, len(x), 128)
                step += 1
                for i, g in enumerate(self._slopes(x[pick], y[pick])):
                    moment[0][i] = 0.9 * moment[0][i] + 0.1 * g
                    moment[1][i] = 0.999 * moment[1][i] + 0.001 * g * g
                    self.weights[i] -= 0.003 * (moment[0][i] / (1 - 0.9**step)) / (np.sqrt(moment[1][i] / (1 - 0.999**step)) + 1e-8)
        logits, truth = self._logits((rows[test] - self.centre) / self.scale)[1], labels[test]
        choices = np.exp(np.linspace(-1.5, 2.5, 81))
        losses = [np.logaddexp(0, np.where(truth == 1, -logits, logits) / t).mean() for t in choices]
        self.temperature = float(choices[int(np.argmin(losses))])

    def _logits(self, x: np.ndarray):
        middle = np.tanh(x @ self.weights[0] + self.weights[1])
        return middle, (middle @ self.weights[2] + self.weights[3])[:, 0]

    def _slopes(self, x: np.ndarray, y: np.ndarray):
        middle, logits = self._logits(x)
        error = ((1 / (1 + np.exp(-np.clip(logits, -50, 50))) - y) / len(y))[:, None]
        inner = (error @ self.weights[2].T) * (1 - middle * middle)
        return x.T @ inner + 1e-4 * self.weights[0], inner.sum(axis=0), middle.T @ error + 1e-4 * self.weights[2], error.sum(axis=0)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        logits = self._logits((rows - self.centre) / self.scale)[1] / self.temperature
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), 2 * SIZE).astype(float)


def fit(features: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Network:
    """Train on ``labels (doc_id, label)``, at most ``train_rows`` of them by hash of the id."""
    chosen = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(train_rows)
    held = features.join(chosen, "doc_id").select("doc_id", "features", F.col("label").cast("int")).toArrow().sort_by([("doc_id", "ascending")])
    return Network(_matrix(held.column("features").to_pylist()), np.array(held.column("label").to_pylist(), np.int64))


def scored(features: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    shared = features.sparkSession.sparkContext.broadcast(network)

    def score(batches):
        for batch in batches:
            found = shared.value.scores(_matrix(batch.column("features").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return features.mapInArrow(score, "doc_id long, score double, predicted int")


def held_out_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels whose remainder by 5 is not 0, score all documents, and mark those held out."""
    features = settle(pooled(docs, context_table(docs)))
    network = fit(features, labels.select(F.col("doc_id").cast("long"), F.col("quality").alias("label")).where(remainder(5) != 0))
    found = scored(features, network)
    return found.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
