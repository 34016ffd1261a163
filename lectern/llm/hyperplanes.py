"""Hard-negative mining by multiway hyperplane trees with sibling ranges.

The rows are dealt to shards, and each shard becomes one tree.  A node takes split points that lie
far apart; every row falls to the nearest of them, and for each split point and each subtree the
smallest and the largest distance between them is kept.  A search wants rows whose score, an inner
product, lies in a window; with the lengths of a subtree's vectors the window is an annulus of
distances around the query.  Distances to the split points bound the distance to every row of every
subtree, and a subtree goes where these bounds miss the annulus.  The lower end of a window rises to
the worst score of the best rows found so far.  What is left is scored exactly in the leaves, so
the answer is that of a full scan.

The first search finds each anchor's positives, a second one the negatives in their windows.  A
shard and the anchors, in blocks that are sent to every shard once, meet in a task that holds one
tree and one block at a time.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take
no part; of rows with one id the one with the least label and components counts; vectors of
different sizes never meet; equal vectors share a leaf however many there are; components and
scores are exact integers, also beyond 64 bits, up to 2**408 and 10**31 in size (what is beyond
counts as that), but a score beyond 64 bits is returned as the nearest one of them; an anchor without a positive, and a positive without a negative, give no rows; other
columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import bounded_batches
from lectern.session import broadcast_if_small, settle

SHARD_SIZE = 8192
ANCHOR_BLOCK = 4096
FANOUT = 16
LEAF = 64
POSITIVES = 5
NEGATIVES = 5
LOWEST_PERCENT, HIGHEST_PERCENT = 80, 100
SLACK = 1e-9
RANK_BITS = 20
LONG = (1 << 63) - 1
MOST = 2.0**400
MOST_SCORE = 10**31


def quantised(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, label, v`` of the rows that take part: moved labels, components as whole numbers."""
    wide = F.col(vector).cast("array<double>")
    sound = ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull()).where(sound)
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    # Floors stay doubles, which hold every one of them exactly.
    whole = F.transform(wide, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x * 256).cast("double")).otherwise(F.greatest(F.least(x, F.lit(MOST)), F.lit(-MOST)) * 256))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), whole.alias("v"))
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")


def stacked(vectors) -> np.ndarray:
    """Rows of whole numbers as one matrix: doubles while all products stay exact, else Python integers."""
    matrix = np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), -1)
    largest = float(np.abs(matrix).max()) if matrix.size else 0.0
    if matrix.shape[1] * largest * largest < 2.0**42:
        return matrix
    exact = np.empty(matrix.shape, object)
    for at, x in np.ndenumerate(matrix):
        exact[at] = int(x)
    return exact


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all of ``b``."""
    if a.dtype == object or b.dtype == object:
        whole = [[int(x) for x in row] for row in a], [[int(x) for x in row] for row in b]
        out = np.empty((len(a), len(b)), object)
        for i, x in enumerate(whole[0]):
            for j, y in enumerate(whole[1]):
                out[i, j] = sum(p * q for p, q in zip(x, y))
        return out
    return (a @ b.T).astype(np.int64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


class HyperplaneTree:
    """One shard's tree over rows ordered by id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, fanout: int = FANOUT, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.points = ids[order], labels[order], points[order]
        self.squares = (self.points.astype(np.float64) ** 2).sum(axis=1)
        self.nodes: list[tuple] = []
        random = np.random.default_rng(7)
        waiting = [(np.arange(len(ids)), None, 0)]
        while waiting:
            rows, parent, place = waiting.pop()
            number = len(self.nodes)
            if parent is not None:
                self.nodes[parent][4][place] = number
            splits = self._splits(rows, fanout, random) if len(rows) > leaf else []
            if len(splits) < 2:
                self.nodes.append((rows,))
                continue
            far = _distances(self.points[rows], self.points[splits])
            nearest = far.argmin(axis=1)
            members = [np.flatnonzero(nearest == j) for j in range(len(splits))]
            low = np.array([far[m].min(axis=0) for m in members]).T
            high = np.array([far[m].max(axis=0) for m in members]).T
            lengths = np.array([(self.squares[rows[m]].min(), self.squares[rows[m]].max()) for m in members])
            self.nodes.append((np.array(splits), low, high, lengths, [0] * len(splits)))
            waiting.extend((rows[m], number, j) for j, m in enumerate(members))

    def _splits(self, rows: np.ndarray, fanout: int, random) -> list[int]:
        """Rows that lie far apart, the next always the farthest from those taken; equal rows are one."""
        sample = rows if len(rows) <= 8 * fanout else random.choice(rows, 8 * fanout, replace=False)
        taken = [int(sample[0])]
        away = _distances(self.points[sample], self.points[taken])[:, 0]
        if not away.max() > 0:
            # A sample of equal rows says nothing of the others.
            sample = rows
            away = _distances(self.points[sample], self.points[taken])[:, 0]
        while len(taken) < fanout and away.max() > SLACK * (1 + np.sqrt(self.squares[rows].max())):
            taken.append(int(sample[away.argmax()]))
            away = np.minimum(away, _distances(self.points[sample], self.points[taken[-1:]])[:, 0])
        return taken

    def search(self, anchors: np.ndarray, own: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        """Best ``k`` rows for each anchor and window: arrays ``(anchor, window, k)`` of scores and row numbers.

        ``low`` and ``high`` are arrays ``(anchor, window)`` of whole scores; rows of the anchor's
        own id never count, nor those with its label, or only those with it if ``same``.  Missing
        results have row number -1.
        """
        exact = self.points.dtype == object or anchors.dtype == object
        kind = object if exact else np.int64
        base, top = 1 << RANK_BITS, (1 << RANK_BITS) - 1
        none = -(1 << 1000) if exact else -LONG
        count, windows = low.shape
        # Score and row number in one integer: a greater one is the better row, smaller ids first.
        best = np.full((count, windows, k), none, dtype=kind)
        floor = low.astype(kind)
        squares = (anchors.astype(np.float64) ** 2).sum(axis=1)
        largest = max(float(self.squares.max()), float(squares.max()), 1.0)
        # Computed distances are off by rounding only; these margins are far beyond that.
        slack, wide = np.sqrt(SLACK * largest), 1e-6 * largest
        waiting = [(0, np.flatnonzero((low <= high).any(axis=1)), None)]
        self.scored = 0
        while waiting:
            number, active, bounds = waiting.pop()
            if bounds is not None:
                active = active[self._met(active, bounds, floor, high, squares, wide)]
            if not len(active):
                continue
            node = self.nodes[number]
            if len(node) == 1:
                self._leaf(node[0], active, anchors, own, labels, floor, high, best, same, base, top, none)
                continue
            splits, near, far, lengths, children = node
            away = _distances(anchors[active], self.points[splits])
            for j in np.argsort([away[:, j].mean() for j in range(len(splits))])[::-1]:
                least = np.maximum(np.maximum(away - far[:, j], near[:, j] - away).max(axis=1) - slack, 0)
                most = (away + far[:, j]).min(axis=1) + slack
                bounds = (least, most, lengths[j])
                met = self._met(active, bounds, floor, high, squares, wide)
                if met.any():
                    waiting.append((children[j], active[met], (least[met], most[met], lengths[j])))
        found = best > none
        scores = np.where(found, best // base, 0)
        return scores, np.where(found, top - (best - (best // base) * base), -1).astype(np.int64)

    @staticmethod
    def _met(active, bounds, floor, high, squares, slack):
        """Whether a subtree's distances meet the annulus of any window."""
        least, most, (short, long) = bounds
        up = high[active].max(axis=1).astype(np.float64)
        down = floor[active].min(axis=1).astype(np.float64)
        return (least * least <= squares[active] + long - 2 * down + slack) & (most * most >= squares[active] + short - 2 * up - slack)

    def _leaf(self, rows, active, anchors, own, labels, floor, high, best, same, base, top, none):
        k = best.shape[2]
        for low in range(0, len(rows), 1024):
            part = rows[low : low + 1024]
            step = max(1, (1 << 20) // len(part))
            for at in range(0, len(active), step):
                some = active[at : at + step]
                score = _products(anchors[some], self.points[part])
                self.scored += score.size
                alike = labels[some][:, None] == self.labels[part][None, :]
                allowed = (alike if same else ~alike) & (own[some][:, None] != self.ids[part][None, :])
                place = score * base + (top - part)[None, :]
                for window in range(best.shape[1]):
                    fits = allowed & (score >= floor[some, window][:, None]) & (score <= high[some, window][:, None])
                    line = np.flatnonzero(fits.any(axis=1))
                    if not len(line):
                        continue
                    every = np.concatenate([best[some[line], window], np.where(fits[line], place[line], none)], axis=1)
                    every = -np.sort(-every, axis=1)[:, :k] if every.dtype == object else -np.partition(-every, k - 1, axis=1)[:, :k]
                    best[some[line], window] = every
                    worst = every.min(axis=1)
                    full = worst > none
                    floor[some[line[full]], window] = worst[full] // base


def build_trees(rows: DataFrame, shard_size: int = SHARD_SIZE) -> DataFrame:
    """``dim, shard, tree``: the trees of ``rows (vec_id, label, v)``."""
    sized = settle(rows.withColumn("dim", F.size("v")))
    shards = sized.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(float(shard_size))).alias("shards"))
    dealt = sized.join(broadcast_if_small(shards), "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), "shards"))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tree = HyperplaneTree(group["vec_id"].to_numpy(), group["label"].to_numpy(), stacked(group["v"]))
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [pickle.dumps(tree.__dict__)]})

    # One shard is much work on few bytes, so shards must not be put together by size.
    tasks = 2 * max(1, -(-sized.count() // shard_size))
    return dealt.select("dim", "shard", "vec_id", "label", "v").repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInPandas(
        build, "dim int, shard long, tree binary"
    )


def search_trees(trees: DataFrame, asked: DataFrame, same: bool, k: int, block: int = ANCHOR_BLOCK) -> DataFrame:
    """``anchor_id, of, vec_id, score``: the best ``k`` of every tree in every window of every anchor.

    ``asked`` has ``(vec_id, label, v, windows)``, the windows as an array of ``(of, low, high)``.
    """
    sized = asked.withColumn("dim", F.size("v"))
    blocks = sized.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(float(block))).alias("blocks"))
    dealt = sized.join(broadcast_if_small(blocks), "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), "blocks"))

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        held = {
            "ids": group["vec_id"].to_numpy(), "labels": group["label"].to_numpy(), "points": stacked(group["v"]),
            "windows": [[(w["of"], w["low"], w["high"]) for w in row] for row in group["windows"]],
        }
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "anchors": [pickle.dumps(held)]})

    packed = dealt.select("dim", "block", "vec_id", "label", "v", "windows").groupBy("dim", "block").applyInPandas(pack, "dim int, block long, anchors binary")
    shards = trees.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    sent = packed.join(shards, "dim").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), "block", F.lit(None).cast("binary").alias("tree"), "anchors")
    held = trees.select("dim", "shard", F.lit(-1).cast("long").alias("block"), "tree", F.lit(None).cast("binary").alias("anchors"))

    def run(batches):
        tree, place = None, None
        for batch in batches:
            for dim, shard, packed_tree, anchors in zip(batch["dim"], batch["shard"], batch["tree"], batch["anchors"]):
                if packed_tree is not None:
                    tree, place = HyperplaneTree.__new__(HyperplaneTree), (dim, shard)
                    tree.__dict__ = pickle.loads(packed_tree)
                elif place == (dim, shard):
                    yield found(tree, pickle.loads(anchors))

    def found(tree: HyperplaneTree, held: dict) -> pd.DataFrame:
        windows = held["windows"]
        width = max(map(len, windows))
        # The whole range of scores where none is given; a missing window is empty.
        most = 2 * int(np.sqrt(float(tree.squares.max())) * np.sqrt((held["points"].astype(np.float64) ** 2).sum(axis=1).max()) + 1)
        kind = np.int64 if most < 1 << 42 else object
        low, high = np.full((len(windows), width), 1, kind), np.full((len(windows), width), 0, kind)
        for i, row in enumerate(windows):
            for j, (_, a, b) in enumerate(row):
                low[i, j], high[i, j] = -most if a is None else max(int(a), -most), most if b is None else min(int(b), most)
        scores, places = tree.search(held["points"], held["ids"], held["labels"], low, high, same, k)
        i, j, r = np.nonzero(places >= 0)
        of = [windows[a][b][0] for a, b in zip(i.tolist(), j.tolist())]
        exact = [str(max(-MOST_SCORE, min(MOST_SCORE, int(s)))) for s in scores[i, j, r]]
        return pd.DataFrame({"anchor_id": held["ids"][i], "of": pd.array(of, "Int64"), "vec_id": tree.ids[places[i, j, r]], "score": pd.Series(exact, dtype=object)})

    tasks = 2 * max(1, trees.count())
    met = held.unionByName(sent).repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", "block")
    out = bounded_batches(met).mapInPandas(run, "anchor_id long, of long, vec_id long, score string")
    return out.withColumn("score", F.col("score").cast("decimal(38,0)"))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   lowest: int = LOWEST_PERCENT, highest: int = HIGHEST_PERCENT, shard_size: int = SHARD_SIZE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``(vec_id, label, v)``; anchors are the rows where ``is_anchor`` holds.
    """
    rows = settle(rows)
    trees = settle(build_trees(rows, shard_size))
    anchors = rows.where(is_anchor)
    score = "decimal(38,0)"
    whole = F.array(F.struct(F.lit(None).cast("long").alias("of"), F.lit(None).cast(score).alias("low"), F.lit(None).cast(score).alias("high")))
    nearest = search_trees(trees, anchors.withColumn("windows", whole), True, positives)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    chosen = settle(nearest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # The least whole score that is lowest percent of the positive's, and the greatest that is highest percent.
    low = F.expr(f"-floor(cast(-{lowest} as decimal(3, 0)) * positive_score / 100)").cast(score)
    high = F.expr(f"floor(cast({highest} as decimal(3, 0)) * positive_score / 100)").cast(score)
    windows = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("of"), low.alias("low"), high.alias("high"))).alias("windows"))
    asked = anchors.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    found = search_trees(trees, asked, False, negatives).withColumnRenamed("of", "positive_id")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    bounded = lambda c: F.greatest(F.least(F.col(c), F.lit(LONG)), F.lit(-LONG - 1)).cast("long")
    return ranked.join(chosen, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("long").alias("rank"), F.col("vec_id").alias("negative_id"), bounded("positive_score").alias("positive_score"), bounded("score").alias("negative_score")
    )
