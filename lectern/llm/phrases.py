"""Phrase collocations: n-grams counted in HAT-tries, cut scores, and the best phrases of a language.

A phrase can only be frequent if its words, its pairs and its triples are.  So words are counted
first; then pairs, and then triples, are counted by their hashes alone, as sorted runs of numbers
that are merged per range of hashes and leave a bit field of what may be frequent; at last the
phrases that the fields let through are counted exactly.  A wrong hit in a field costs a needless
count and no more, and no frequent phrase is ever missed.

Within a task of the last pass the phrases of a language lie in a trie over word ids: a first word
leads to a hash container of the words after it, and a container that grows over ``BURST`` entries
bursts into one container per next word.  When a task holds ``HELD`` entries, its largest subtrees
leave it whole, each as a sorted run.  Spark deals the runs by the first two words of a phrase and
adds them up.

Defined cases: a null text has no words; a null ``lang`` is ``und``; repeated rows count as often as
they occur; texts of any length are read whole; other columns are not read; a language without a
frequent phrase, and an empty table, give no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from heapq import nlargest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import bounded_batches
from lectern.llm.words import GOLDEN, WordHasher, byte_slices, give_back_memory, mix, text_bytes
from lectern.session import broadcast_if_small, settle

MINIMUM = 30
LONGEST = 4
TOP = 2000
NESTED_PERCENT = 80
SCALE = 2_000_000
BURST = 4096
HELD = 400_000
KEPT_WORDS = 400_000
ID_BITS = 21
# A phrase's hash in the counts by hash; bits of the largest field; numbers a task or a merge holds.
HASH_BITS = 40
MOST_BITS = 27
HELD_HASHES = 1 << 21
SLICE_BYTES = 1 << 20
NO_LANGUAGE = "und"
# What ends a piece of text, and white space between words.
ENDS = rb".,;:!?\n\x0b\x0c\r"
TOKEN = re.compile(rb"[^ \t" + ENDS + rb"]+|[" + ENDS + rb"]")
COUNTS = "lang string, phrase string, n long"


class _Words(dict):
    """Ids of the words met so far, from 1 on; 0 is an end of a piece."""

    def __init__(self):
        super().__init__({bytes([c]): 0 for c in b".,;:!?\n\x0b\x0c\r"})
        self.names = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.names)
        self.names.append(word)
        return number


class HatTrie:
    """Counts of phrases of word ids: burstable hash containers under a shallow trie.

    What follows a phrase's first word is one integer, ``ID_BITS`` bits a word from the top, so an
    integer's first word is that of the next level, and 0 is the phrase that ends here.
    """

    SHIFT = (LONGEST - 2) * ID_BITS
    REST = (1 << SHIFT) - 1

    def __init__(self):
        self.roots: dict[int, dict | list] = {}
        self.entries: dict[int, int] = {}

    def __len__(self) -> int:
        return sum(self.entries.values())

    def add(self, heads: np.ndarray, rests: np.ndarray) -> None:
        """Count phrases by first word and what follows it."""
        if not len(heads):
            return
        order = np.lexsort((rests, heads))
        heads, rests = heads[order], rests[order]
        new = np.ones(len(heads), bool)
        new[1:] = (heads[1:] != heads[:-1]) | (rests[1:] != rests[:-1])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(heads))).tolist()
        heads, rests = heads[at], rests[at].tolist()
        edges = np.flatnonzero(np.diff(heads, prepend=-1)).tolist()
        for head, low, high in zip(heads[edges].tolist(), edges, [*edges[1:], len(heads)]):
            held = self.roots.get(head)
            if held is None:
                self.roots[head] = dict(zip(rests[low:high], counts[low:high]))
                self.entries[head] = high - low
            else:
                self.entries[head] += self._count(held, rests[low:high], counts[low:high])
            held = self.roots[head]
            if type(held) is dict and len(held) > BURST:
                self.roots[head] = self._burst(held)

    def _count(self, held, rests: list, counts: list) -> int:
        if type(held) is dict:
            before, get = len(held), held.get
            for rest, count in zip(rests, counts):
                held[rest] = get(rest, 0) + count
            return len(held) - before
        # A burst container: one container for each next word.
        new, children = 0, held[0]
        for rest, count in zip(rests, counts):
            child = children.setdefault(rest >> self.SHIFT, {})
            key = rest & self.REST
            if key in child:
                child[key] += count
            else:
                child[key] = count
                new += 1
        return new

    def _burst(self, held: dict) -> list:
        children: dict[int, dict] = {}
        for rest, count in held.items():
            children.setdefault(rest >> self.SHIFT, {})[rest & self.REST] = count
        return [children]

    def largest(self, share: int) -> list[int]:
        """First words of the largest subtrees that together hold at least ``share`` entries."""
        heads, taken = [], 0
        for head in nlargest(len(self.entries), self.entries, self.entries.get):
            if taken >= share:
                break
            heads.append(head)
            taken += self.entries[head]
        return heads

    def take(self, head: int):
        """Remove a subtree; its phrases as first word, what follows, count."""
        held = self.roots.pop(head)
        del self.entries[head]
        if type(held) is dict:
            return list(held.items())
        return [((word << self.SHIFT) | rest, count) for word, child in held[0].items() for rest, count in child.items()]


def _hasher() -> WordHasher:
    """Words in lower case; what ends a piece is a word of class 2."""
    classes = np.ones(256, np.uint8)
    classes[[9, 32]] = 0
    classes[list(b".,;:!?\n\x0b\x0c\r")] = 2
    return WordHasher(lower=True, classes=classes)


def _language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _joined_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(left * np.uint64(GOLDEN) + right)


def _bits_set(field: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - bits)
    return (field[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


class _Counter:
    """What one task has counted: words, hashes of pairs or triples, or phrases in one trie a language."""

    def __init__(self, fields=(), hashed: int = 0, chunk_bits: int = 0, minimum: int = MINIMUM):
        self.fields, self.hashed, self.chunk_bits, self.minimum = fields, hashed, chunk_bits, minimum
        self.clear()
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.hasher = _hasher()

    def clear(self) -> None:
        self.words, self.tries, self.counts = _Words(), {}, {}

    def add(self, part: pa.RecordBatch) -> None:
        """Count the texts of a batch ``(lang, text)``."""
        if self.fields:
            self._add_phrases(part)
        else:
            self._add_words(part)

    def _add_words(self, part: pa.RecordBatch) -> None:
        data, offsets = text_bytes(part.column(1))
        raw, at = data.tobytes().lower(), offsets.tolist()
        by_lang: dict[str, list] = {}
        for lang, low, high in zip(part.column(0).to_pylist(), at, at[1:]):
            by_lang.setdefault(lang, []).extend(map(self.words.__getitem__, TOKEN.findall(raw, low, high)))
        for lang, tokens in by_lang.items():
            counts = np.bincount(np.array(tokens, np.int64), minlength=len(self.words.names))
            before = self.counts.get(lang)
            if before is not None:
                counts[: len(before)] += before
            self.counts[lang] = counts

    def _add_phrases(self, part: pa.RecordBatch) -> None:
        """Phrases are found by the hashes of their words; words are told apart by their letters only where one may be frequent."""
        data, starts, ends, first = self.hasher.spans(part.column(1))
        if len(starts) < 2:
            return
        langs = part.column(0).to_pylist()
        names = sorted(set(langs))
        codes = np.array([names.index(lang) for lang in langs])
        code = np.repeat(codes, np.diff(first))
        salt = np.array([_language_hash(lang) for lang in names], np.uint64)
        with np.errstate(over="ignore"):
            own = mix(self.hasher.hashes(data, starts, ends) + salt[code])
        good = (self.hasher.classes[data[starts]] == 1) & _bits_set(*self.fields[0], own)
        follows = good[:-1] & good[1:]
        # The last word of a text and the first of the next are no pair.
        heads = first[1:-1]
        follows[heads[(heads > 0) & (heads < len(starts))] - 1] = False
        at = np.flatnonzero(follows)
        hashes = _joined_hashes(own[at], own[at + 1])
        if len(self.fields) > 1:
            kept = _bits_set(*self.fields[1], hashes)
            at, hashes = at[kept], hashes[kept]
        if self.hashed == 2:
            self._hold(hashes)
            return
        next_too = np.flatnonzero(at[1:] == at[:-1] + 1)
        thirds = at[next_too]
        triples = _joined_hashes(hashes[next_too], own[thirds + 2])
        if self.hashed == 3:
            self._hold(triples)
            return
        thirds = thirds[_bits_set(*self.fields[2], triples)]
        fourths = thirds[:-1][thirds[1:] == thirds[:-1] + 1]
        needed = np.zeros(len(starts), bool)
        needed[at] = needed[at + 1] = True
        needed = np.flatnonzero(needed)
        raw = data.tobytes().lower()
        ids = np.zeros(len(starts), np.int64)
        ids[needed] = [self.words[raw[a:b]] for a, b in zip(starts[needed].tolist(), ends[needed].tolist())]
        one, two = 2 * ID_BITS, ID_BITS
        for places, size in ((at, 2), (thirds, 3), (fourths, 4)):
            rest = ids[places + 1] << one
            if size > 2:
                rest |= ids[places + 2] << two
            if size > 3:
                rest |= ids[places + 3]
            for n, lang in enumerate(names):
                mine = code[places] == n
                self.tries.setdefault(lang, HatTrie()).add(ids[places[mine]], rest[mine])

    def _hold(self, hashes: np.ndarray) -> None:
        values, counts = np.unique(hashes >> np.uint64(64 - HASH_BITS), return_counts=True)
        self.found.append((values, counts))
        if sum(len(v) for v, _ in self.found) > HELD_HASHES:
            self.found = [_added(self.found)]

    def hash_runs(self, whole: bool):
        """Sorted runs of hashes and counts, one for each range, differences byte by byte."""
        if not self.found or not whole and sum(len(v) for v, _ in self.found) <= HELD_HASHES:
            return
        values, counts = _added(self.found)
        self.found = []
        shift = HASH_BITS - self.chunk_bits
        chunks = (values >> np.uint64(shift)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.diff(chunks, prepend=-1)), len(chunks))
        width = np.uint8 if self.minimum < 256 else np.uint32
        low = (values & np.uint64((1 << shift) - 1)).astype(np.uint32)
        runs = []
        for a, b in zip(edges, edges[1:]):
            steps = np.diff(low[a:b], prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            # A count at the minimum is enough; more need not be told apart.
            runs.append(zlib.compress(steps + np.minimum(counts[a:b], self.minimum).astype(width).tobytes(), 1))
        sizes = np.diff(edges).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(chunks[edges[:-1]]), pa.array(sizes), pa.array(runs, pa.binary())], names=["chunk", "size", "run"])

    def word_runs(self, whole: bool):
        names = self.words.names
        if not whole and len(names) <= KEPT_WORDS:
            return
        for lang, counts in self.counts.items():
            counts[0] = 0
            found = np.flatnonzero(counts).tolist()
            run = sorted(zip(map(names.__getitem__, found), counts[found].tolist()))
            for low in range(0, len(run), 50_000):
                part = run[low : low + 50_000]
                yield self._batch(lang, [w for w, _ in part], [n for _, n in part])
        self.clear()

    def runs(self, whole: bool):
        """Batches of sorted runs, of all subtrees or of the largest of tries that have grown too far."""
        if whole or len(self.words.names) > KEPT_WORDS:
            tries = [(lang, trie, list(trie.roots)) for lang, trie in self.tries.items()]
        else:
            held = sum(map(len, self.tries.values()))
            if held <= HELD:
                return
            tries = [(lang, trie, trie.largest(len(trie) // 2 + 1)) for lang, trie in self.tries.items()]
        names = self.words.names
        for lang, trie, heads in tries:
            phrases, counts = [], []
            for head in sorted(heads, key=names.__getitem__):
                run = []
                for rest, count in trie.take(head):
                    parts = [names[head]]
                    while rest:
                        parts.append(names[rest >> HatTrie.SHIFT])
                        rest = (rest & HatTrie.REST) << ID_BITS
                    run.append((b" ".join(parts), count))
                run.sort()
                phrases.extend(p for p, _ in run)
                counts.extend(c for _, c in run)
                if len(phrases) > 50_000:
                    yield self._batch(lang, phrases, counts)
                    phrases, counts = [], []
            if phrases:
                yield self._batch(lang, phrases, counts)
        if whole or len(names) > KEPT_WORDS:
            self.clear()

    @staticmethod
    def _batch(lang, phrases, counts):
        text = pa.array(phrases, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), text, pa.array(counts, pa.int64())], names=["lang", "phrase", "n"])


def _added(runs: list) -> tuple[np.ndarray, np.ndarray]:
    """Runs of numbers and counts as one sorted run."""
    values = np.concatenate([v for v, _ in runs])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], np.concatenate([c for _, c in runs])[order]
    first = np.flatnonzero(np.diff(values, prepend=values[:1] + np.uint64(1)) != 0) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def _tasks(docs: DataFrame, schema: str, give, fields=(), **settings) -> DataFrame:
    """Rows of a task's counter over all texts; ``give`` takes it and whether the task ends."""

    def run(batches):
        counter = _Counter([(np.frombuffer(f.value[0], np.uint8), f.value[1]) for f in fields], **settings)
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                counter.add(part)
                yield from give(counter, False)
        yield from give(counter, True)
        give_back_memory()

    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE))
    return bounded_batches(docs).select(lang.alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _summed(runs: DataFrame) -> DataFrame:
    dealt = runs.withColumn("_prefix", F.substring_index("phrase", " ", 2)).repartition("lang", "_prefix")
    return dealt.groupBy("lang", "_prefix", "phrase").agg(F.sum("n").alias("n")).drop("_prefix")


def _field_of(parts: DataFrame, bits: int):
    """A broadcast bit field of ``2 ** bits`` bits from its parts ``(chunk, field)``, all of one size."""
    whole = bytearray(1 << (bits - 3))
    for row in parts.toLocalIterator():
        whole[row["chunk"] * len(row["field"]) : (row["chunk"] + 1) * len(row["field"])] = row["field"]
    return parts.sparkSession.sparkContext.broadcast((bytes(whole), bits))


def _packed_bits(places: np.ndarray, size: int) -> bytes:
    field = np.zeros(size, np.uint8)
    field[places] = 1
    return np.packbits(field, bitorder="little").tobytes()


def word_field(words: DataFrame, bits: int, chunk_bits: int):
    """The bit field of the hashes of frequent ``words (lang, phrase)``."""
    rest = bits - chunk_bits

    def places(batches):
        hasher = _hasher()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            known = {lang: _language_hash(lang) for lang in set(langs)}
            with np.errstate(over="ignore"):
                hashes = mix(hasher(batch.column(1))[0] + np.array([known[lang] for lang in langs], np.uint64))
            place = (hashes >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place >> rest), pa.array((place & ((1 << rest) - 1)).astype(np.int32))], names=["chunk", "place"])

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [key[0]], "field": [_packed_bits(rows["place"].to_numpy(), 1 << rest)]})

    placed = words.select("lang", "phrase").mapInArrow(places, "chunk long, place int")
    return _field_of(placed.groupBy("chunk").applyInPandas(pack, "chunk long, field binary"), bits)


def phrase_field(docs: DataFrame, size: int, fields: list, minimum: int, bits: int, chunk_bits: int):
    """The bit field of the hashes that pairs or triples with ``minimum`` occurrences have."""
    shift = HASH_BITS - chunk_bits

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        runs = []
        for count, packed in zip(rows["size"].tolist(), rows["run"]):
            raw = np.frombuffer(zlib.decompress(packed), np.uint8)
            steps = np.ascontiguousarray(raw[: 4 * count].reshape(4, count).T).view("<u4")[:, 0]
            counts = raw[4 * count :] if minimum < 256 else raw[4 * count :].view("<u4")
            runs.append((np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)))
        values, counts = _added(runs)
        places = values[counts >= minimum] >> np.uint64(HASH_BITS - bits)
        return pd.DataFrame({"chunk": [key[0]], "field": [_packed_bits(places.astype(np.int64), 1 << (bits - chunk_bits))]})

    runs = _tasks(docs, "chunk long, size int, run binary", _Counter.hash_runs, fields, hashed=size, chunk_bits=chunk_bits, minimum=minimum)
    return _field_of(runs.groupBy("chunk").applyInPandas(merge, "chunk long, field binary"), bits)


def frequent_phrases(docs: DataFrame, minimum: int = MINIMUM) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to four words that occur ``minimum`` times, and the words of each language."""
    words = settle(_summed(_tasks(docs, COUNTS, _Counter.word_runs)))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    ones = words.where(F.col("n") >= minimum)
    count = words.agg(F.sum("n")).first()[0] or 0
    # So many ranges of hashes that none holds more than a merge should.
    chunk_bits = min(24, max(8, (count // HELD_HASHES).bit_length()))
    bits = min(MOST_BITS, max(chunk_bits + 3, count.bit_length()))
    fields = [word_field(ones, bits, chunk_bits)]
    fields.append(phrase_field(docs, 2, fields, minimum, bits, chunk_bits))
    fields.append(phrase_field(docs, 3, fields, minimum, bits, chunk_bits))
    longer = settle(_summed(_tasks(docs, COUNTS, _Counter.runs, fields)).where(F.col("n") >= minimum))
    return ones.unionByName(longer), totals


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, minimum: int = MINIMUM, top: int = TOP, nested_percent: int = NESTED_PERCENT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of every language.

    ``a`` counts the phrase, ``l`` and ``r`` the parts at its worst cut.  A phrase goes if a longer
    one holds it that occurs at least ``nested_percent`` as often.
    """
    phrases, totals = frequent_phrases(docs, minimum)
    listed = phrases.withColumn("words", F.split("phrase", " "))
    candidates = listed.where(F.size("words") > 1).withColumnRenamed("n", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1))).select(
        "lang", "phrase", "a", "k", _part(F.col("words"), F.lit(1), F.col("k")).alias("left"), _part(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")).alias("right")
    )
    scored = cuts.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(
        phrases.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]
    )
    score = F.expr(f"(cast({SCALE} as decimal(7, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.transform(F.sequence(F.lit(2), F.size("words")), lambda s: F.struct(i.alias("i"), s.alias("s"))))),
        lambda p: (p["i"] + p["s"] - 1 <= F.size("words")) & (p["s"] < F.size("words")),
    )
    longer = candidates.where(F.size("words") > 2).withColumn("at", F.explode(inner)).select("lang", _part(F.col("words"), F.col("at.i"), F.col("at.s")).alias("phrase"), "a")
    around = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    nested = F.expr(f"cast(100 as decimal(3, 0)) * cast(most as decimal(19, 0)) >= cast({nested_percent} as decimal(3, 0)) * cast(a as decimal(19, 0))")
    kept = worst.join(around, ["lang", "phrase"], "left").where(~F.coalesce(nested, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(broadcast_if_small(totals), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score")
    )
