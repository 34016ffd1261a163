"""Packing token pieces into training sequences: shortest-pack-first over the length histogram.

Documents are tokenized once, in Arrow batches.  Only the histogram of piece lengths, at most
``size`` rows whatever the corpus, reaches the driver; packing patterns are made from it and
pieces join them by their rank among the pieces of the same length.

Defined cases: a null or empty text is the end token alone; repeated rows are packed as often as
they occur; a null ``doc_id`` is kept; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections import defaultdict
from operator import itemgetter
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import bounded_batches
from lectern.llm.words import TOKEN_CACHE, give_back_memory, text_bytes
from lectern.operators.ranking import blocked_row_number
from lectern.session import settle

SEQUENCE = 4096
END_TOKEN = 2
RANK_BLOCK = 8192
CACHE_WORDS = 550_000
ENCODED_AT_ONCE = 10_000
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of texts as little-endian bytes, with the ids of each distinct word kept.

    White space ends every pre-token, so a text's ids are those of its words one after another.
    Words of simple letters, perhaps with one full stop or comma, are encoded many at a time: each
    ends in the one token that carries the end-of-word mark.  Between others stands a rare letter
    whose tokens mark the ends; words that hold this letter are encoded one by one.
    """

    BETWEEN = "ꙮ"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.final[number] = token.endswith("</w>")
        self.between = np.array(self.model.encode(self.BETWEEN, add_special_tokens=False).ids, np.uint32)
        self.known: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str], at_once: int):
        """Ids of each text; few at once, as what the library returns for a text is far larger."""
        for low in range(0, len(texts), at_once):
            for found in self.model.encode_batch_fast(texts[low : low + at_once], add_special_tokens=False):
                yield found.ids

    def _one_by_one(self, words: list[bytes]) -> None:
        for word, ids in zip(words, self._ids([w.decode() for w in words], ENCODED_AT_ONCE)):
            self.known[word] = array("I", ids).tobytes()

    def _with_marks(self, words: list[bytes]) -> None:
        mark, size = self.BETWEEN.encode(), len(self.between)
        alone = [w for w in words if mark in w]
        words = [w for w in words if mark not in w]
        runs = [words[i : i + 500] for i in range(0, len(words), 500)]
        texts = [b"".join([w + b" " + mark + b" " for w in r]).decode() for r in runs]
        for run, found in zip(runs, self._ids(texts, ENCODED_AT_ONCE // 500)):
            ids = np.array(found, np.uint32)
            hit = np.ones(len(ids) - size + 1, bool)
            for at in range(size):
                hit &= ids[at : len(ids) - size + 1 + at] == self.between[at]
            starts = np.flatnonzero(hit)
            if len(starts) != len(run):
                alone.extend(run)
                continue
            raw, ends = ids.tobytes(), (4 * starts).tolist()
            begins = [0, *(e + 4 * size for e in ends)]
            self.known.update(zip(run, (raw[a:b] for a, b in zip(begins, ends))))
        self._one_by_one(alone)

    def _together(self, words: list[bytes]) -> None:
        runs = [words[i : i + 500] for i in range(0, len(words), 500)]
        found = self._ids([b" ".join(r).decode() for r in runs], ENCODED_AT_ONCE // 500)
        for run, ids in zip(runs, (np.array(f, np.uint32) for f in found)):
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) != len(run):
                self._one_by_one(run)
                continue
            raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.known.update(zip(run, (raw[a:b] for a, b in zip(cuts, cuts[1:]))))

    @staticmethod
    def _plain(word: bytes) -> bool:
        """Letters that stay one letter each in lower case; ASCII ones are settled before."""
        text = word.decode()
        return text.isalpha() and max(text) < "İ"

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = words.difference(self.known)
        simple, pointed, other = set(), [], []
        for word in new:
            bare = word[:-1] if word[-1] in b",." else word
            if bare.isalpha() or self._plain(bare):
                simple.add(bare)
                if bare is not word:
                    pointed.append(word)
            else:
                other.append(word)
        simple = list(simple.difference(self.known))
        if simple:
            self._together(simple)
        self._with_marks(list({*other, b",", b"."}.difference(self.known)))
        for word in pointed:
            self.known[word] = self.known[word[:-1]] + self.known[word[-1:]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # Lower case first makes fewer distinct words; markers of special tokens are case-sensitive.
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        self.learn(set().union(*split))
        ids = self.known
        # One call looks up all words of a text; it gives a tuple from two words on.
        return [b"".join(itemgetter(*words)(ids)) if len(words) > 1 else b"".join(map(ids.__getitem__, words)) for words in split]


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; later tasks of the worker find its words known."""
    store = sys.modules.setdefault(TOKEN_CACHE, ModuleType(TOKEN_CACHE))
    if path not in store.__dict__:
        store.__dict__[path] = WordEncoder(path)
    return store.__dict__[path]


def tokenize(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end: int = END_TOKEN) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens``."""

    def pieces(batches):
        encoder, tail = None, int(end).to_bytes(4, "little")
        for batch in batches:
            if encoder is None:
                encoder = worker_encoder(tokenizer)
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                data, offsets = text_bytes(part.column(1))
                raw, at = data.tobytes(), offsets.tolist()
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode([raw[a:b] for a, b in zip(at, at[1:])])):
                    ids += tail
                    total = len(ids) // 4
                    for start in range(0, total, size):
                        piece = ids[4 * start : 4 * (start + size)]
                        rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), total))
                doc, start, length, crc, total = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )
            give_back_memory()

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)


def packing_patterns(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns ``(how often, lengths)``: longest lengths first, each into the pack with most room.

    Packs of one content are counted, not listed, so the work depends on the number of distinct
    lengths and not on the number of pieces.
    """
    room: dict[int, list] = defaultdict(list)  # by free space: [how many, lengths]
    widest = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while widest and not room[widest]:
                widest -= 1
            if widest < length:
                room[size - length].append([left, (length,)])
                widest = max(widest, size - length)
                left = 0
                continue
            count, lengths = room[widest].pop()
            used = min(count, left)
            if count > used:
                room[widest].append([count - used, lengths])
            room[widest - length].append([used, (*lengths, length)])
            left -= used
    return [(count, lengths) for free in sorted(room) for count, lengths in room[free]]


def slot_table(patterns) -> dict[str, np.ndarray]:
    """For each length, in order of rank: from which rank on, the sequence of that rank, the offset."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), columns))


def place(pieces: DataFrame, size: int = SEQUENCE, rank_block: int = RANK_BLOCK) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces; ``length`` is from 1 to ``size``.

    The rank within a length is counted in blocks, so a length that many pieces share is not
    numbered in one task.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slot_table(packing_patterns(histogram, size))
    blocks = F.create_map(*[F.lit(x) for n, c in sorted(histogram.items()) if c > rank_block for x in (n, -(-c // rank_block))]) if any(
        c > rank_block for c in histogram.values()
    ) else None
    parts = F.lit(1) if blocks is None else F.coalesce(F.try_element_at(blocks, F.col("length")), F.lit(1))
    keyed = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), parts))
    ranked = blocked_row_number(keyed, ["length"], ["_block"], ["doc_id", "start", "ids_crc32"], "_rank")

    def look_up(batches):
        bits = 40
        starts = (slots["length"] << bits) + slots["rank"]
        for batch in batches:
            rank = batch.column("_rank").to_numpy().astype(np.int64) - 1
            length = batch.column("length").to_numpy().astype(np.int64)
            at = np.searchsorted(starts, (length << bits) + rank, side="right") - 1
            sequence = slots["sequence"][at] + rank - slots["rank"][at]
            kept = [batch.column(c).cast(pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(slots["offset"][at])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_rank").mapInArrow(look_up, PLACED)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, end: int = END_TOKEN) -> DataFrame:
    """Tokenize ``docs`` (``doc_id, text``), cut at ``size`` tokens and place every piece."""
    return place(settle(tokenize(docs, tokenizer or default_tokenizer(), size, end)), size)
