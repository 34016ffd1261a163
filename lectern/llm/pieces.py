"""Subword pieces of merge type: exact encoding by backtracking, and decoding.

A merge-type encoder joins the neighbouring pieces whose union has the best score until none is
left.  Its result for a text is the one row of pieces of which every neighbouring pair is
compatible: merging the two pieces' letters again gives just these two.  So a text is read once by
an Aho-Corasick automaton that notes the longest piece starting at every letter; pieces are then
laid from left to right, longest first, as long as they are compatible with the piece before.
Where none fits, the last piece gives way to a shorter one, and the place it ended at is marked in
a bit field as failed, for as the row before a place is unique, no later way through it can work.

Where no piece of a vocabulary goes across a kind of place, as behind a word or between a letter and
a mark, no merge does either.  Texts are cut there, and a worker keeps the ids of the runs it met.

Defined cases: a null text is an empty one and has the end id alone; repeated rows and null ids are
kept as they are; texts of any length are read whole; letters without a piece become byte pieces;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import re
import sys
from array import array
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import bounded_batches
from lectern.llm.words import byte_slices, free_token_cache, give_back_memory, text_bytes

# Fixed value: the letter that stands for a space inside pieces.
SPACE = "▁"
# Ways to cut a text, the finest first; a cut depends on the two neighbouring characters alone.
POWERS = "²³¹¼½¾"
CUTS = (rf" *(?:[^\W\d_{POWERS}]+|(?:(?! )[\W\d_{POWERS}])+)| +", r" *[^ ]+| +", r"(?s:.+)")
END_ID = 2
KEPT_RUNS = 500_000
KEPT_LETTERS = 64
KEPT_PAIRS = 1 << 20
SLICE_BYTES = 1 << 20
STORE = "_piece_encoders"
ENCODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, ids array<int>, text string"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _each_bad_byte(error):
    return "�", error.start + 1


codecs.register_error("each-bad-byte", _each_bad_byte)


class PieceModel:
    """Vocabulary of a merge-type model file: ids, scores, byte pieces and the automaton."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        held = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [held.unk_id()] * 256
        surfaces = []
        self.control = np.zeros(held.get_piece_size(), bool)
        self.marked = np.zeros(held.get_piece_size(), bool)
        for number in range(held.get_piece_size()):
            piece = held.id_to_piece(number)
            if held.is_byte(number):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = number
                surfaces.append(bytes([value]))
            elif held.is_control(number):
                self.control[number] = True
                surfaces.append(b"")
            elif held.is_unknown(number):
                surfaces.append(" ⁇ ".encode())
            else:
                shown = piece.replace(SPACE, " ")
                self.ids[shown], self.scores[shown] = number, held.get_score(number)
                self.marked[number] = piece.startswith(SPACE)
                surfaces.append(shown.encode())
        self.surfaces = np.frombuffer(b"".join(surfaces), np.uint8)
        self.lengths = np.array([len(s) for s in surfaces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1:
                self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.runs = next(c for c in map(re.compile, CUTS) if all(len(c.findall(p)) == 1 for p in self.ids))
        self.shorter = {p: self.next_shorter(p) for p in self.ids if len(p) > 1}
        self.compatible: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: best score first, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether merging both pieces' letters again gives these two; no left one asks for the right alone."""
        if len(self.compatible) >= KEPT_PAIRS:
            self.compatible.clear()
        verdict = self.merged(left + right) == ([left, right] if left else [right])
        self.compatible[left, right] = verdict
        return verdict

    def next_shorter(self, piece: str) -> str:
        """The longest piece that starts ``piece`` and is shorter; a letter always is one, and nothing is left of it."""
        for size in range(len(piece) - 1, 1, -1):
            if piece[:size] in self.ids:
                return piece[:size]
        return piece[:1] if len(piece) > 1 else ""

    def split(self, run: str) -> list[str]:
        """The pieces of a run by backtracking."""
        longest = bytearray(b"\x01" * len(run))
        for end, size in self.automaton.iter(run):
            # Ends only grow, so the last entry of a start is its longest piece.
            longest[end - size + 1] = size
        compatible, fits, shorter = self.compatible, self.fits, self.shorter
        pieces, before, at, total, failed = [], "", 0, len(run), None
        piece = run[: longest[0]] if run else ""
        while at < total:
            while piece:
                end = at + len(piece)
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    fit = compatible.get((before, piece))
                    if fit or fit is None and fits(before, piece):
                        break
                piece = shorter[piece] if len(piece) > 1 else ""
            if piece:
                pieces.append(piece)
                before, at = piece, end
                if at < total:
                    piece = run[at : at + longest[at]]
            else:
                if failed is None:
                    failed = bytearray((total >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                piece = pieces.pop()
                at -= len(piece)
                before = pieces[-1] if pieces else ""
                piece = shorter[piece] if len(piece) > 1 else ""
        return pieces

    def _numbers(self, run: str) -> bytes:
        pieces = self.split(run)
        numbers = list(map(self.ids.get, pieces))
        if None in numbers:
            numbers = [n for p, i in zip(pieces, numbers) for n in ((i,) if i is not None else (self.byte_ids[b] for b in p.encode()))]
        return array("i", numbers).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit integers."""
        if not text:
            return b""
        runs, known = self.runs.findall(" " + text.replace(SPACE, " ")), self.known
        found = list(map(known.get, runs))
        if None in found:
            if len(known) >= KEPT_RUNS:
                known.clear()
            for at, (run, ids) in enumerate(zip(runs, found)):
                if ids is None:
                    ids = known.get(run)
                    if ids is None:
                        ids = self._numbers(run)
                        if len(run) <= KEPT_LETTERS:
                            known[run] = ids
                    found[at] = ids
        return b"".join(found)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """Texts of rows of ids; row ``n`` has the ids from ``first[n]`` on.

        The space that encoding put before a text goes again, if its first piece has one, and every
        byte that is part of no letter becomes U+FFFD.
        """
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            raise ValueError("an id lies outside the vocabulary")
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1] if len(ends) else 0)
        raw = self.surfaces[place + np.repeat(self.starts[ids] - ends + sizes, sizes)].tobytes()
        edges = np.concatenate([[0], ends])
        silent = np.append(np.flatnonzero(self.control[ids]), len(ids))
        inside = np.searchsorted(silent, first)
        texts = []
        for low, high, a, b in zip(first[:-1].tolist(), first[1:].tolist(), inside.tolist(), inside[1:].tolist()):
            # Control ids show nothing, but the bytes before and behind them are no letter together.
            cuts = [low - 1, *silent[a:b].tolist(), high]
            parts = [(x + 1, y) for x, y in zip(cuts, cuts[1:]) if y > x + 1]
            text = "".join([raw[edges[x] : edges[y]].decode("utf-8", "each-bad-byte") for x, y in parts])
            texts.append(text[1:] if parts and self.marked[ids[parts[0][0]]] else text)
        return texts


def worker_model(path: str) -> PieceModel:
    """The model of this Python worker; later tasks of the worker find its runs known."""
    store = sys.modules.setdefault(STORE, ModuleType(STORE))
    if path not in store.__dict__:
        free_token_cache()
        store.__dict__[path] = PieceModel(path)
    return store.__dict__[path]


def encode(docs: DataFrame, model: str | None = None, end: int | None = END_ID, text: str = "text") -> DataFrame:
    """``doc_id, ids`` for every row of ``docs (doc_id, text)``, with the id ``end`` behind each text."""
    path = model or default_model()

    def run(batches):
        codes, tail = worker_model(path), b"" if end is None else array("i", [end]).tobytes()
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                data, offsets = text_bytes(part.column(1))
                raw, at = data.tobytes(), offsets.tolist()
                rows = [codes.encode(raw[a:b].decode("utf-8", "replace")) + tail for a, b in zip(at, at[1:])]
                ends = np.cumsum([0, *map(len, rows)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])
            give_back_memory()

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).mapInArrow(run, ENCODED)


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, ids, text``: the texts of ``rows (doc_id, ids)``; null ids are an empty row."""
    path = model or default_model()

    def run(batches):
        codes = worker_model(path)
        for batch in batches:
            sizes = np.array([0 if s is None else s for s in pa.compute.list_value_length(batch.column(1)).to_pylist()], np.int64)
            # Rows that together hold about a slice of ids, one row at least.
            group = np.cumsum(sizes) // (SLICE_BYTES // 4)
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                part = batch.slice(low, high - low)
                ids = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(sizes[low:high])])
                texts = codes.decode(ids, first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return bounded_batches(rows).select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, DECODED)
