"""Block-max postings with positions: how they are built, searched for the best rows, and merged.

The entities of a level lie in shards and have a number in their shard.  A shard is cut into runs of
neighbouring numbers, and a posting block holds the postings of one term in one run: numbers,
frequencies, lengths and positions, coded as differences, with the run's largest frequency and
smallest length, which bound what any posting of the block can add to a score.

A search sends each query to every shard.  There its terms are taken in the order of their bounds;
once the best rows so far are out of reach of the terms left, only rows that may still get among
them are looked up.  So a shard gives at most the wanted
number of rows to a query, however many match.  A phrase is found by merging positions in the rows
that hold its rarest term; no text and no list of tokens is read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

RUN_ROWS = 1024
# The term of blocks that list dead rows; no token is empty.
GONE = ""
RUN_TOKENS = 1 << 20
POSITION_BITS = 32
MARGIN = 1e-6
BLOCKS = (
    "kind string, shard int, run int, term string, first_row int, last_row int, rows array<int>, tfs array<int>, dls array<int>, "
    "positions array<int>, max_tf int, min_dl int"
)
CUT_COLUMNS = ["kind", "shard", "run", "term", "rows", "tfs", "dls", "positions"]


def shard_of(entity_id: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(entity_id), F.lit(shards)).cast("int")


def numbered(entities: DataFrame, shards: int) -> DataFrame:
    """Entities with their shard and their number in it, in the order of their ids."""
    sharded = entities.withColumn("entity_bucket", shard_of(F.col("entity_id"), shards))
    order = Window.partitionBy("kind", "entity_bucket").orderBy("entity_id")
    return sharded.withColumn("row_no", (F.row_number().over(order) - 1).cast("int"))


class _Run:
    """Tokens of neighbouring rows of one shard, gathered into posting blocks."""

    def __init__(self):
        self.ids: dict[str, int] = {"": 0}
        self.terms, self.rows, self.lengths, self.place = [], [], [], []

    def add(self, row: int, length: int, tokens: list) -> None:
        ids = self.ids
        found = np.array([ids.setdefault(t, len(ids)) for t in tokens], np.int64)
        self.terms.append(found)
        self.rows.append(row)
        self.lengths.append(length)
        self.place.append(len(found))

    def blocks(self, kind: str, shard: int, run: int) -> pa.RecordBatch | None:
        sizes = np.array(self.place)
        terms = np.concatenate(self.terms)
        rows = np.repeat(np.array(self.rows), sizes)
        lengths = np.repeat(np.array(self.lengths), sizes)
        positions = np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(terms, kind="stable")
        order = order[np.searchsorted(terms[order], 1) :]  # the empty token only parts fields
        if not len(order):
            return None
        terms, rows, lengths, positions = terms[order], rows[order], lengths[order], positions[order]
        new_term = np.ones(len(terms), bool)
        new_term[1:] = terms[1:] != terms[:-1]
        new_posting = new_term.copy()
        new_posting[1:] |= rows[1:] != rows[:-1]
        gaps = np.diff(positions, prepend=0)
        gaps[new_posting] = positions[new_posting]
        at = np.flatnonzero(new_posting)
        tfs = np.diff(np.append(at, len(terms)))
        own, first = rows[at], np.flatnonzero(new_term[at])
        steps = np.diff(own, prepend=0)
        steps[first] = own[first]
        ends = np.append(first[1:], len(at))
        names = np.empty(len(self.ids), object)
        names[list(self.ids.values())] = list(self.ids)

        def lists(values, edges):
            return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values.astype(np.int32)))

        edges, count = np.append(first, len(at)), len(first)
        columns = [
            pa.array([kind] * count), pa.array([shard] * count, pa.int32()), pa.array([run] * count, pa.int32()), pa.array(names[terms[at[first]]].tolist(), pa.string()),
            pa.array(own[first].astype(np.int32)), pa.array(own[ends - 1].astype(np.int32)), lists(steps, edges), lists(tfs, edges), lists(lengths[at], edges),
            lists(gaps, np.append(np.flatnonzero(new_term), len(terms))), pa.array(np.maximum.reduceat(tfs, first).astype(np.int32)), pa.array(np.minimum.reduceat(lengths[at], first).astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BLOCKS.split(", ")])


def posting_blocks(entities: DataFrame, dealt: bool = False) -> DataFrame:
    """Posting blocks of ``entities (kind, entity_bucket, row_no, dl, tokens)``; tokens are parted by blanks.

    Rows that are ``dealt`` lie by shard and number already and are not shuffled.  A run is a range of
    numbers, so a term has several blocks in a run whose rows lie in several splits or hold very much text.
    """

    def build(batches):
        held, place, last = _Run(), None, -1
        tokens_held = 0
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in range(4)]
            texts = batch.column(4)
            for at, (kind, shard, row, length) in enumerate(zip(*columns)):
                here = (kind, shard, row // RUN_ROWS)
                if place != here or row <= last or tokens_held >= RUN_TOKENS:
                    made = held.blocks(*place) if place else None
                    if made is not None:
                        yield made
                    held, place, tokens_held = _Run(), here, 0
                tokens = (texts[at].as_py() or "").split(" ")
                held.add(row, length, tokens)
                last = row
                tokens_held += len(tokens)
        made = held.blocks(*place) if place else None
        if made is not None:
            yield made

    columns = entities.select("kind", "entity_bucket", "row_no", F.col("dl").cast("int"), "tokens")
    if not dealt:
        columns = columns.repartition("kind", "entity_bucket").sortWithinPartitions("kind", "entity_bucket", "row_no")
    return columns.mapInArrow(build, BLOCKS)


def _gathered(found: list, names: tuple, **fixed) -> pd.DataFrame:
    """One frame from ``(query, values, …)`` items, with plain object columns for texts."""
    owners = np.empty(sum(len(f[1]) for f in found), object)
    at = 0
    for query, first, *_ in found:
        for n in range(at, at + len(first)):
            owners[n] = query
        at += len(first)
    columns = {n: np.concatenate([f[i + 1] for f in found]) if found else np.zeros(0) for i, n in enumerate(names)}
    same = {n: np.full(len(owners), v, object if isinstance(v, str) else None) for n, v in fixed.items()}
    return pd.DataFrame({"query_id": pd.Series(owners, dtype=object), **same, **columns})


class _Postings:
    """All postings of a term in one shard; they are put together when a query first needs them."""

    __slots__ = ("most", "_held", "_at", "_rows", "_parts", "_dense")

    def __init__(self, held: pd.DataFrame, at: np.ndarray, most: float):
        self.most, self._held, self._at = most, held, at
        self._rows = self._parts = self._dense = None

    def read(self, saturation, mean: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows in their order and what each adds to a score of weight 1."""
        if self._rows is None:
            at, column = self._at, lambda name: self._held[name].to_numpy()[self._at]
            rows = np.concatenate([np.cumsum(r) for r in column("rows")])
            parts = saturation(np.concatenate(column("tfs")).astype(np.float64), np.concatenate(column("dls")), mean)
            if len(at) > 1 and np.any(rows[1:] < rows[:-1]):
                order = np.argsort(rows, kind="stable")
                rows, parts = rows[order], parts[order]
            self._rows, self._parts = rows, parts
        return self._rows, self._parts

    def at(self, some: np.ndarray, saturation, mean: float, size: int) -> np.ndarray:
        """What each of some rows gains; a term in a quarter of the rows is spread over all of them once."""
        rows, parts = self.read(saturation, mean)
        if 4 * len(rows) >= size:
            if self._dense is None:
                self._dense = np.zeros(size)
                self._dense[rows] = parts
            return self._dense[some]
        place = np.minimum(np.searchsorted(rows, some), len(rows) - 1)
        return np.where(rows[place] == some, parts[place], 0.0)


def _best_rows(terms: list, mean: float, size: int, saturation, limit: int | None, allowed):
    """Rows and scores of one query in one shard; ``terms`` has ``(weight, postings)``.

    With a ``limit`` the rows are the best ones, others the search may leave out or score too low.
    Postings of several terms are added at once; whether the terms left can still bring a new row
    is asked each time the postings read have doubled.
    """
    bounds = sorted(((weight * postings.most, weight, postings) for weight, postings in terms), key=lambda t: -t[0])
    left = np.append(np.cumsum([b for b, _, _ in bounds][::-1])[::-1], 0.0)
    score, waiting, read, ask = np.zeros(size), [], 0, 2 * (limit or 0)

    def found():
        # Every posting adds something.
        rows = np.flatnonzero(score)
        return rows if allowed is None else rows[allowed[rows]]

    for at, (_, weight, postings) in enumerate(bounds):
        rows, parts = postings.read(saturation, mean)
        waiting.append((rows, weight * parts))
        read += len(rows)
        last = at + 1 == len(bounds)
        if not last and (limit is None or read < ask):
            continue
        score += np.bincount(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]), size)
        waiting, ask = [], 2 * read
        alive = found()
        if last or len(alive) <= limit:
            continue
        worst = np.partition(score[alive], -limit)[-limit]
        # A row not seen yet can reach no more than what is left.
        if left[at + 1] < worst - MARGIN:
            break
    else:
        return alive, score[alive]
    held = score[alive]
    for after in range(at + 1, len(bounds)):
        if after == at + 1 or len(alive) > 2 * limit:
            worst = np.partition(held, -limit)[-limit]
            near = held + left[after] >= worst - MARGIN
            alive, held = alive[near], held[near]
        _, weight, postings = bounds[after]
        held = held + weight * postings.at(alive, saturation, mean, size)
    return alive, held


def best_of_shards(blocks: DataFrame, asked: DataFrame, limit: int | None, saturation, digits: int) -> DataFrame:
    """``query_id, kind, shard, row_no, score``: at most ``limit`` rows for a query and shard.

    ``blocks`` has the posting blocks of the asked terms, dealt to query parts: ``(kind, shard,
    part, term, …)``.  ``asked`` has ``(kind, shard, part, query_id, avgdl, terms, allowed)`` with
    terms as an array of ``(term, weight)``; ``allowed`` lists the rows in a query's scope, or is null.
    Blocks of the term ``GONE`` list rows that are dead.
    """

    def search(key: tuple, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        kind, shard, _ = key
        out = []
        if not held.empty and not asked.empty:
            size, mean = int(held["last_row"].max()) + 1, float(asked["avgdl"].iloc[0])
            most = saturation(held["max_tf"].to_numpy(np.float64), held["min_dl"].to_numpy(), mean)
            by_term = {term: _Postings(held, at, float(most[at].max())) for term, at in held.groupby("term").indices.items()}
            live, gone = None, by_term.pop(GONE, None)
            if gone is not None:
                live = np.ones(size, bool)
                live[gone.read(saturation, mean)[0]] = False
            for row in asked.itertuples():
                terms = [(weight, by_term[name]) for name, weight in zip(row.names, row.weights.tolist()) if name in by_term]
                if not terms:
                    continue
                allowed = live
                if row.allowed is not None:
                    inside = np.asarray(row.allowed)
                    allowed = np.zeros(size, bool)
                    allowed[inside[inside < size]] = True
                    allowed = allowed if live is None else allowed & live
                rows, scores = _best_rows(terms, mean, size, saturation, limit, allowed)
                scores = np.round(scores, digits)
                order = np.lexsort((rows, -scores))[:limit]
                out.append((row.query_id, rows[order], scores[order]))
        return _gathered(out, ("row_no", "score"), kind=kind, shard=shard)[["query_id", "kind", "shard", "row_no", "score"]]

    keys = ["kind", "shard", "part"]
    left = blocks.select(*keys, "term", "first_row", "last_row", "rows", "tfs", "dls", "max_tf", "min_dl").groupBy(*keys)
    right = asked.select(*[F.col(k).alias(k) for k in keys], "query_id", "avgdl", F.col("terms.term").alias("names"), F.col("terms.weight").alias("weights"), "allowed").groupBy(*keys)
    return left.cogroup(right).applyInPandas(search, "query_id string, kind string, shard int, row_no int, score double")


def row_numbers(rows: Column) -> Column:
    """The numbers of a block's rows, which are coded as differences."""
    return F.aggregate(rows, F.array().cast("array<int>"), lambda held, step: F.concat(held, F.array(F.coalesce(F.get(held, F.size(held) - 1), F.lit(0)) + step)))


def _values(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists of a column and the length of each list."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


@F.pandas_udf(BinaryType())
def row_bits(rows: pd.Series) -> pd.Series:
    """The numbers of some rows of a run as one bit for each row of the run."""

    def bits(some) -> bytes:
        held = np.zeros(RUN_ROWS, bool)
        held[np.asarray(some) % RUN_ROWS] = True
        return np.packbits(held).tobytes()

    return rows.map(bits)


def cut_to_rows(blocks: DataFrame) -> DataFrame:
    """Posting blocks with the postings of the rows in ``wanted`` only; blocks without any are left out.

    ``wanted`` has the rows of a block's run as numbers or as :func:`row_bits`.
    """

    def cut(batches):
        for batch in batches:
            steps, sizes = _values(batch.column("rows"))
            if not len(steps):
                continue
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rows = _sums(steps, sizes)
            wanted = np.frombuffer(b"".join(batch.column("wanted").to_pylist()), np.uint8).reshape(-1, RUN_ROWS // 8)
            place = rows % RUN_ROWS
            keep = (wanted[owner, place >> 3] >> (7 - (place & 7))) & 1 == 1
            if not keep.any():
                continue
            tfs, dls = _values(batch.column("tfs"))[0], _values(batch.column("dls"))[0]
            positions = _values(batch.column("positions"))[0][np.repeat(keep, tfs)]
            rows, owner, tfs, dls = rows[keep], owner[keep], tfs[keep], dls[keep]
            left, first = np.unique(owner, return_index=True)
            steps = np.diff(rows, prepend=0)
            steps[first] = rows[first]
            edges = np.append(first, len(rows)).astype(np.int32)
            places = np.concatenate(([0], np.cumsum(tfs)))[edges].astype(np.int32)
            named = [batch.column(n).take(pa.array(left)) for n in ("kind", "shard", "run", "term")]
            lists = [pa.ListArray.from_arrays(pa.array(e), pa.array(v.astype(np.int32))) for e, v in ((edges, steps), (edges, tfs), (edges, dls), (places, positions))]
            yield pa.RecordBatch.from_arrays([*named, *lists], names=CUT_COLUMNS)

    if dict(blocks.dtypes)["wanted"] != "binary":
        blocks = blocks.withColumn("wanted", row_bits("wanted"))
    types = dict(c.split() for c in BLOCKS.split(", "))
    return blocks.select(*CUT_COLUMNS, "wanted").mapInArrow(cut, ", ".join(f"{n} {types[n]}" for n in CUT_COLUMNS))


def _sums(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums of lists that lie behind one another and have ``sizes``, none of them 0."""
    total, ends = np.cumsum(steps, dtype=np.int64), np.cumsum(sizes)
    return total - np.repeat(np.concatenate(([0], total))[ends - sizes], sizes)


class _Places:
    """Every occurrence of every term in a run as one integer, the row, then the position; a term's are in order."""

    def __init__(self, held: pd.DataFrame):
        terms, names = pd.factorize(held["term"])
        order = np.lexsort((held["first_row"], terms))
        column = lambda name: held[name].to_numpy()[order]
        sizes, tfs, dls = np.array([len(r) for r in column("rows")]), np.concatenate(column("tfs")), np.concatenate(column("dls"))
        rows = _sums(np.concatenate(column("rows")), sizes)
        codes = (np.repeat(rows, tfs) << POSITION_BITS) | _sums(np.concatenate(column("positions")), tfs)
        of = np.repeat(np.repeat(terms[order], sizes), tfs)
        # A term has several blocks in a run, which may overlap.
        if np.any((codes[1:] <= codes[:-1]) & (of[1:] == of[:-1])):
            codes = codes[np.lexsort((codes, of))]
        edges = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(names)))))
        self._codes = {name: codes[low:high] for name, low, high in zip(names, edges[:-1].tolist(), edges[1:].tolist())}
        self._low = int(rows.min())
        self._lengths = np.zeros(int(rows.max()) - self._low + 1, np.int64)
        self._lengths[rows - self._low] = dls

    def holding(self, terms) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Rows that hold the terms one behind the other, how often, and the rows' lengths."""
        found = [self._codes.get(t) for t in terms]
        if any(f is None for f in found):
            return None
        order = sorted(range(len(found)), key=lambda n: len(found[n]))
        starts = found[order[0]] - order[0]
        # The few places of the rarest term are looked up in those of the others.
        for n in order[1:]:
            if not len(starts):
                return None
            at = np.minimum(np.searchsorted(found[n], starts + n), len(found[n]) - 1)
            starts = starts[found[n][at] == starts + n]
        if not len(starts):
            return None
        rows, counts = np.unique(starts >> POSITION_BITS, return_counts=True)
        return rows, counts, self._lengths[rows - self._low]


def merged_positions(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """``query_id, phrase, kind, shard, row_no, tf, dl`` of the rows that hold a whole phrase.

    Both sides are dealt by ``(kind, shard, run)``; ``asked`` has ``(query_id, phrase, terms)``.
    """

    def merge(key: tuple, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        kind, shard, _ = key
        out = []
        if not held.empty:
            places = _Places(held)
            for query, phrase, terms in zip(asked["query_id"], asked["phrase"], asked["terms"]):
                found = places.holding(terms)
                if found is not None:
                    out.append(((query, phrase), *found))
        held = _gathered(out, ("row_no", "tf", "dl"), kind=kind, shard=shard)
        held["phrase"] = np.array([q[1] for q in held["query_id"]], object)
        held["query_id"] = np.array([q[0] for q in held["query_id"]], object)
        return held[["query_id", "phrase", "kind", "shard", "row_no", "tf", "dl"]]

    keys = ["kind", "shard", "run"]
    left = blocks.select(*keys, "term", F.get("rows", F.lit(0)).alias("first_row"), "rows", "tfs", "dls", "positions").groupBy(*keys)
    right = asked.select(*[F.col(k).alias(k) for k in keys], "query_id", "phrase", "terms").groupBy(*keys)
    return left.cogroup(right).applyInPandas(merge, "query_id string, phrase string, kind string, shard int, row_no int, tf int, dl int")
