"""MinHash near-duplicates by a multi-index Hamming join.

A document's MinHash signature has 66 values of 16 bits, cut into 11 chunks of 6.  Two signatures
that differ in at most 21 = 2 * 11 - 1 values have a chunk that differs in at most one (pigeonhole),
so each chunk is looked up under its 6 keys that leave one value out: every pair within 21 values
shares a key.  A pair of similarity 0.85 differs in 9.9 values on average (deviation 2.9); it is
missed with a probability of about 6e-5, more similar pairs far less.  Below 0.85 pairs that share
a key are confirmed up to the distance that one in 10^6 pairs of that similarity exceeds: at 0.80,
where a chunk has at most one difference with a probability of 0.655, a pair is missed if none of
11 has (8e-6) or if it exceeds that distance, with a probability of about 9e-6 together.

No group of equal keys is ever expanded into pairs.  Documents of equal shingle sets are one class.
Each class of a key is tied to the smallest of that key by a running window; connected classes form
a neighbourhood, which is read once, in blocks of bounded size.  Inside two blocks, pairs within
the Hamming threshold are confirmed on full sets, nearest first, skipping pairs already connected:
what leaves a task is a forest of confirmed links, which has the components of all of them.

Defined cases: a text that is null or has no word has an empty set and no link; a null ``doc_id``
is linked with nothing, has a null component and is kept; rows of one ``doc_id`` are one document;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import bounded_batches, components
from lectern.llm.words import GOLDEN, WordHasher, byte_slices, mix, row_shingles
from lectern.session import settle

SHINGLE = 5
PERCENT = 85
CHUNKS, WIDTH = 11, 6
MAX_DISTANCE = 2 * CHUNKS - 1
BLOCK = 1024
# Below PERCENT: the share of pairs that may differ in more values than are confirmed.
EXCEEDED = 1e-6


def distance_limit(percent: int = PERCENT) -> int:
    """In how many values of their signatures pairs to confirm may differ."""
    if percent >= PERCENT:
        return MAX_DISTANCE
    count, same = CHUNKS * WIDTH, percent / 100
    beyond, limit = 0.0, count
    while limit and beyond + math.comb(count, limit) * (1 - same) ** limit * same ** (count - limit) <= EXCEEDED:
        beyond += math.comb(count, limit) * (1 - same) ** limit * same ** (count - limit)
        limit -= 1
    return limit


def multipliers(count: int = CHUNKS * WIDTH) -> np.ndarray:
    return mix((np.arange(count, dtype=np.uint64) + np.uint64(11)) * np.uint64(GOLDEN)) | np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """16 bits of the least hash under each factor; long sets are read in parts."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(shingles), 2048):
        least = np.minimum(least, (factors[:, None] * shingles[None, low : low + 2048]).min(axis=1))
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature the keys of its chunks with one value left out, ``CHUNKS * WIDTH`` of them."""
    parts = signatures.reshape(len(signatures), CHUNKS, WIDTH).astype(np.uint64)
    keys = np.empty((len(signatures), CHUNKS, WIDTH), np.uint64)
    chunk = np.arange(CHUNKS, dtype=np.uint64)[None, :]
    for left_out in range(WIDTH):
        total = chunk * np.uint64(WIDTH) + np.uint64(left_out)
        for at in range(WIDTH):
            if at != left_out:
                total = mix(total * np.uint64(GOLDEN) + parts[:, :, at])
        keys[:, :, left_out] = total
    return keys.reshape(len(signatures), -1)


def _sets(column: pa.Array, hasher: WordHasher, size: int):
    hashes, first = hasher(column)
    return [np.unique(s) for s in row_shingles(hashes, first, size)]


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, mark, signature``; ``mark`` is a 128-bit fingerprint of the whole set."""

    def sketch(batches):
        hasher, factors = WordHasher(lower=True), multipliers()
        for batch in batches:
            for part in byte_slices(batch, "text"):
                sets = _sets(part.column("text"), hasher, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([signature(s, factors).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "mark", "signature"],
                )

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        sketch, "doc_id long, n_shingles long, mark binary, signature binary"
    )


def neighbourhoods(classes: DataFrame) -> DataFrame:
    """``rep, hood``: classes that share keys, directly or through others."""

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                raw = b"".join(batch.column("signature").to_pylist())
                keys = chunk_keys(np.frombuffer(raw, np.uint16).reshape(batch.num_rows, -1)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep"), pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * keys.shape[1], pa.array(keys.ravel()))],
                    names=["rep", "keys"],
                )

    keys = classes.select("rep", "signature").mapInArrow(keyed, "rep long, keys array<long>").select("rep", F.explode("keys").alias("key"))
    running = Window.partitionBy("key").orderBy("rep").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ties = keys.withColumn("first", F.first("rep").over(running)).where("first <> rep")
    return components(ties.select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()).select(
        F.col("node").alias("rep"), F.col("component").alias("hood")
    )


def _confirm(group: list, percent: int, across: bool):
    """Confirmed links of one group, as a forest over its members."""
    reps = [g[0] for g in group]
    count = len(reps)
    signatures = np.frombuffer(b"".join(g[1] for g in group), np.uint16).reshape(count, -1)
    sets = [np.frombuffer(g[2], np.uint64) for g in group]
    side = np.array([g[3] for g in group])
    sizes = np.array([len(s) for s in sets])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.cumsum(sizes)[:-1]
    members = np.split(local, cuts)
    marked = np.zeros(local.max() + 1, bool)
    owner = np.arange(count)
    limit = distance_limit(percent)
    for x in range(count - 1):
        rest = np.arange(x + 1, count)
        if across:
            rest = rest[side[rest] != side[x]]
        distance = (signatures[rest] != signatures[x]).sum(axis=1)
        sized = 100 * np.minimum(sizes[rest], sizes[x]) >= percent * np.maximum(sizes[rest], sizes[x])
        near = (distance <= limit) & sized & (owner[rest] != owner[x])
        if not near.any():
            continue
        rest = rest[near][np.argsort(distance[near], kind="stable")]
        marked[members[x]] = True
        for y in rest.tolist():
            if owner[y] == owner[x]:
                continue
            shared = int(np.count_nonzero(marked[members[y]]))
            if 100 * shared >= percent * (int(sizes[x] + sizes[y]) - shared):
                yield reps[x], reps[y]
                owner[owner == owner[y]] = owner[x]
        marked[members[x]] = False


def confirmed_links(docs: DataFrame, classes: DataFrame, hoods: DataFrame, percent: int = PERCENT, size: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between class representatives whose sets are similar enough.

    A neighbourhood of more than ``block`` classes is cut into blocks by hash, and each pair of
    blocks is a group of its own, so no task holds more than two blocks of sets.
    """
    blocks = hoods.groupBy("hood").agg(F.ceil(F.count("*") / F.lit(float(block))).alias("blocks"))
    wanted = (
        hoods.join(blocks, "hood").join(classes, "rep")
        .select("rep", "hood", "blocks", "mark", "signature", F.pmod(F.xxhash64("rep"), "blocks").alias("mine"))
    )
    texts = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    found = texts.join(wanted, "rep")
    kept = ["rep", "hood", "blocks", "mine", "signature"]

    def full_sets(batches):
        hasher = WordHasher(lower=True)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                raw = [s.tobytes() for s in _sets(part.column("text"), hasher, size)]
                same = pa.array([xxhash.xxh3_128_digest(r) == m for r, m in zip(raw, part.column("mark").to_pylist())])
                out = pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(raw, pa.large_binary())], names=[*kept, "shingles"])
                yield out.filter(same)

    sets = found.mapInArrow(full_sets, "rep long, hood long, blocks long, mine long, signature binary, shingles binary")
    dealt = (
        sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("hood", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "rep", "signature", "shingles", (F.col("mine") > F.col("other")).cast("int").alias("side"))
        .repartition("hood", "low", "high")
        .sortWithinPartitions("hood", "low", "high", "rep")
    )

    def link(batches):
        open_key, group = None, []

        def close():
            if len(group) > 1:
                yield from _confirm(group, percent, open_key[1] != open_key[2])

        def out(links):
            a, b = zip(*links)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        links = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("hood", "low", "high", "rep", "signature", "shingles", "side")]
            for hood, low, high, rep, sign, shingles, side in zip(*columns):
                if (hood, low, high) != open_key:
                    links.extend(close())
                    open_key, group = (hood, low, high), []
                group.append((rep, sign, shingles, side))
            if links:
                yield out(links)
                links = []
        links.extend(close())
        if links:
            yield out(links)

    return dealt.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``."""
    sketched = settle(sketches(docs, size))
    linked = sketched.where("doc_id is not null and n_shingles > 0")
    # One class per set; rows of one document id share their smallest class below.
    classes = linked.groupBy("mark").agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature"))
    members = settle(linked.join(classes.select("mark", "rep"), "mark").select("doc_id", "rep").distinct())
    classes = settle(classes)
    hoods = settle(neighbourhoods(classes))
    links = settle(confirmed_links(docs, classes, hoods, percent, size, block))
    every = links.union(members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = components(every).select(F.col("node").alias("_node"), "component")
    return (
        sketched.join(found, F.col("doc_id") == F.col("_node"), "left")
        .withColumn("component_id", F.coalesce("component", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group; of repeated rows of that document one stays."""
    dropped = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("_d")).distinct()
    left = docs.join(dropped, F.col("doc_id").cast("long") == F.col("_d"), "left_anti")
    same = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy(F.xxhash64("text"))
    return left.withColumn("_n", F.row_number().over(same)).where("_n = 1 or doc_id is null").drop("_n")
