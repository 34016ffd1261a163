"""Approximate nearest neighbours by a robust-pruned directed graph over shards of the vectors.

Equal vectors are one node, with their smallest ids.  Each shard of at most about ``shard_size``
nodes becomes a graph: nodes enter in growing batches, a greedy search from the middle proposes
neighbours, and pruning keeps a neighbour only if no kept one is closer to it by the factor
``alpha``, so long edges survive.  Queries, in blocks, run a beam search in every shard; the best
of all shards are merged.  Inner products become distances by one more coordinate that gives all
vectors of a shard equal length, so the graph serves the largest inner product.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, and rows
without an id, take no part; a row that occurs twice counts once; vectors of other dimensions are
searched among themselves; fewer candidates than ``k`` give fewer rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import settle

NEIGHBOURS = 20
SHARD_SIZE = 8192
QUERY_BLOCK = 2048
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 128
ALPHA = 1.2
STEP = 4
BATCH = 256


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Scaled vectors with one more coordinate that makes all lengths 1."""
    scaled = vectors / np.abs(vectors).max()
    squares = (scaled * scaled).sum(axis=1)
    longest = squares.max()
    return np.hstack([scaled, np.sqrt(np.maximum(longest - squares, 0))[:, None]]).astype(np.float32) / np.float32(np.sqrt(longest))


def beam_search(points: np.ndarray, edges: np.ndarray, queries: np.ndarray, entry: int, beam: int):
    """For each query the nodes nearest to it, nearest first (-1 for none), and the nodes expanded."""
    count = len(queries)
    ids = np.full((count, beam), -1, np.int32)
    far = np.full((count, beam), np.inf, np.float32)
    done = np.ones((count, beam), bool)
    ids[:, 0], done[:, 0] = entry, False
    far[:, 0] = ((queries - points[entry]) ** 2).sum(axis=1)
    # A node met before is in the beam or was too far for it, so each is measured once.
    size = len(points)
    seen = np.zeros(count * size, bool)
    seen[entry::size] = True
    first = np.empty(count * size, np.int32)
    steps = []
    active = np.arange(count)
    while len(active):
        fresh = ~done[active]
        pick = fresh & (np.cumsum(fresh, axis=1) <= STEP)
        row, column = np.nonzero(pick)
        owner = active[row]
        nodes = ids[owner, column]
        done[owner, column] = True
        steps.append((owner, nodes))
        found = edges[nodes]
        code = (found + (owner * size)[:, None]).ravel()[found.ravel() >= 0]
        code = code[~seen[code]]
        # Of a node that several expanded ones name, one stays.
        line = np.arange(len(code), dtype=np.int32)
        first[code] = line
        code = code[first[code] == line]
        seen[code] = True
        owner, found = np.divmod(code, size)
        gone = points[found] - queries[owner]
        away = np.einsum("ab,ab->a", gone, gone)
        near = away < far[owner, -1]
        found, owner, away = found[near], owner[near], away[near]
        if len(found):
            some, at, sizes = np.unique(owner, return_index=True, return_counts=True)
            line, place = np.repeat(np.arange(len(some)), sizes), np.arange(len(found)) - np.repeat(at, sizes)
            every = np.full((len(some), beam + sizes.max()), np.inf, np.float32)
            nodes, was = np.full(every.shape, -1, np.int32), np.ones(every.shape, bool)
            every[:, :beam], nodes[:, :beam], was[:, :beam] = far[some], ids[some], done[some]
            every[line, beam + place], nodes[line, beam + place], was[line, beam + place] = away, found, False
            best = np.argpartition(every, beam - 1, axis=1)[:, :beam]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(every, best, axis=1), axis=1, kind="stable"), axis=1)
            far[some], ids[some], done[some] = (np.take_along_axis(x, best, axis=1) for x in (every, nodes, was))
        active = active[(~done[active]).any(axis=1)]
    owner, nodes = (np.concatenate(x) for x in zip(*steps))
    order = np.argsort(owner, kind="stable")
    return ids, np.split(nodes[order], np.cumsum(np.bincount(owner, minlength=count))[:-1])


def robust_prune(points: np.ndarray, nodes: np.ndarray, proposed: list, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours for each node out of its proposals; -1 fills up."""
    out = np.full((len(nodes), degree), -1, np.int32)
    widest = max(map(len, proposed))
    rows = max(1, (1 << 22) // (widest * widest))
    for low in range(0, len(nodes), rows):
        part, lists = nodes[low : low + rows], proposed[low : low + rows]
        size = max(map(len, lists))
        table = np.full((len(part), size), -1, np.int32)
        for r, found in enumerate(lists):
            table[r, : len(found)] = found
        table[table == part[:, None]] = -1
        places = points[table]
        gone = places - points[part][:, None, :]
        away = np.einsum("abc,abc->ab", gone, gone)
        away[table < 0] = np.inf
        order = np.argsort(away, axis=1, kind="stable")
        table, away = np.take_along_axis(table, order, axis=1), np.take_along_axis(away, order, axis=1)
        places = points[table]
        lengths = np.einsum("abc,abc->ab", places, places)
        between = lengths[:, :, None] + lengths[:, None, :] - 2 * (places @ places.transpose(0, 2, 1))
        alive = np.isfinite(away)
        line = np.arange(len(part))
        for at in range(degree):
            first = alive.argmax(axis=1)
            any_left = alive[line, first]
            if not any_left.any():
                break
            out[low : low + rows][any_left, at] = table[line, first][any_left]
            alive &= ~(alpha * alpha * between[line, first] <= away)
            alive[line, first] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Out-edges of every node, and the node where searches start."""
    count = len(points)
    edges = np.full((count, degree), -1, np.int32)
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(7).permutation(count)
    order = order[order != entry]
    low, size = 0, 1
    while low < len(order):
        nodes = order[low : low + size]
        _, expanded = beam_search(points, edges, points[nodes], entry, beam)
        edges[nodes] = robust_prune(points, nodes, expanded, degree, alpha)
        back: dict[int, list] = {}
        for node, row in zip(nodes.tolist(), edges[nodes].tolist()):
            for other in row:
                if other >= 0:
                    back.setdefault(other, []).append(node)
        full, proposals = [], []
        for other, new in back.items():
            mine = [n for n in edges[other].tolist() if n >= 0]
            held = len(mine)
            new = [n for n in new if n not in mine]
            if held + len(new) <= degree:
                edges[other, held : held + len(new)] = new
            else:
                full.append(other)
                proposals.append([*mine, *new])
        if full:
            edges[full] = robust_prune(points, np.array(full), proposals, degree, alpha)
        low += size
        size = min(2 * size, BATCH)
    return edges, entry


def usable(vector):
    """A condition: not null or empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def build_index(vectors: DataFrame, k: int = NEIGHBOURS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """``dim, shard, at, entry, v, ids, edges``: every distinct vector as a node of its shard's graph.

    ``ids`` are the ``k + 1`` smallest ids of the vector; more can be in no result.
    """
    smallest = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    nodes = settle(
        vectors.withColumn("_r", smallest).where(F.col("_r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
        .withColumn("dim", F.size("v"))
    )
    shards = nodes.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(float(shard_size))).alias("shards"))
    dealt = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), "shards"))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.iloc[np.argsort([i[0] for i in group["ids"]])]
        edges, entry = build_graph(lifted(np.stack(group["v"].to_numpy())))
        return pd.DataFrame({"dim": key[0], "shard": key[1], "at": np.arange(len(group)), "entry": entry, "v": group["v"].to_numpy(), "ids": group["ids"].to_numpy(), "edges": list(edges)})

    # One shard is much work on few bytes, so shards must not be put together by size.
    tasks = 4 * max(1, -(-nodes.count() // shard_size))
    return dealt.select("dim", "shard", "v", "ids").repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInPandas(
        build, "dim int, shard long, at int, entry int, v array<double>, ids array<long>, edges array<int>"
    )


def search_index(index: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, beam: int = SEARCH_BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """``qid, vec_id, score``: the best ``k + 1`` of each query of ``queries (qid, v)``.

    Each shard meets each block of queries once; both sides of such a group are bounded.
    """
    asked = queries.withColumn("dim", F.size("v"))
    blocks = asked.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(float(block))).alias("blocks"))
    shards = index.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    left = index.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    right = (
        asked.join(blocks, "dim").join(shards, "dim").withColumn("block", F.pmod(F.xxhash64("qid"), "blocks"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    )

    def search(key: tuple, nodes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if nodes.empty or asked.empty:
            return pd.DataFrame({"qid": [], "vec_id": [], "score": []}).astype({"qid": "int64", "vec_id": "int64"})
        nodes = nodes.sort_values("at")
        exact, wanted = np.stack(nodes["v"].to_numpy()), np.stack(asked["v"].to_numpy())
        points, edges = lifted(exact), np.stack(nodes["edges"].to_numpy())
        ids, qids = nodes["ids"].to_numpy(), asked["qid"].to_numpy()
        scaled = wanted / np.abs(wanted).max(axis=1, keepdims=True)
        unit = np.hstack([scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)), np.zeros((len(scaled), 1))]).astype(np.float32)
        out = []
        for low in range(0, len(unit), BATCH):
            found, _ = beam_search(points, edges, unit[low : low + BATCH], int(nodes["entry"].iloc[0]), min(beam, len(points)))
            for at, row in enumerate(found, low):
                row = row[row >= 0]
                scores = (exact[row] * wanted[at]).sum(axis=1)
                best = sorted((-s, i) for s, r in zip(scores.tolist(), row.tolist()) for i in ids[r])[: k + 1]
                out.extend((int(qids[at]), i, -s) for s, i in best)
        return pd.DataFrame(out, columns=["qid", "vec_id", "score"])

    met = left.groupBy("dim", "shard", "block").cogroup(right.select("dim", "shard", "block", "qid", "v").groupBy("dim", "shard", "block"))
    found = met.applyInPandas(search, "qid long, vec_id long, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).drop("_r")


def nearest(table: DataFrame, is_query, k: int = NEIGHBOURS, shard_size: int = SHARD_SIZE, vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``table`` for which ``is_query`` holds."""
    rows = table.select(F.col("vec_id").cast("long"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    index = settle(build_index(rows, k, shard_size))
    asking = rows.where(is_query)
    queries = settle(asking.groupBy("v").agg(F.min("vec_id").alias("qid")))
    found = settle(search_index(index, queries, k))
    each = asking.join(queries, "v").select(F.col("vec_id").alias("query_id"), "qid").distinct().join(found, "qid").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
