"""Words, shingles and their 64-bit hashes, computed for a whole Arrow batch at once.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``; no byte of a multi-byte
UTF-8 letter is one of these, so splitting bytes is splitting characters.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The white space of the word rule, and odd constants of the mixing functions.
WHITE_SPACE = (9, 10, 11, 12, 13, 32)
GOLDEN = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB
BASE = 0xD6E8FEB86659FD93

SLICE_BYTES = 1 << 20
# Where packing keeps the token cache of a Python worker.
TOKEN_CACHE = "_word_encoders"


def give_back_memory() -> None:
    """Return freed memory of this worker to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def free_token_cache() -> None:
    """Give back the memory of a token cache that an earlier stage left in this worker."""
    sys.modules.pop(TOKEN_CACHE, None)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_A)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows with about ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1), batch.num_rows]
    for low, high in zip(edges, edges[1:]):
        if high > low:
            yield batch.slice(low, high - low)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; a null row is empty."""
    held = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    if len(held) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(held) + 1, np.int64)
    return np.frombuffer(held.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class WordHasher:
    """Splits and hashes words; the tables are built once per task."""

    def __init__(self, lower: bool = False, block: int = 1 << 16, classes: np.ndarray | None = None):
        """``classes`` gives each byte a class; a change of class ends a word and class 0 is white space."""
        free_token_cache()
        if classes is None:
            classes = np.ones(256, np.uint8)
            classes[list(WHITE_SPACE)] = 0
        self.classes = classes
        codes = np.arange(256)
        if lower:
            codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
        with np.errstate(over="ignore"):
            self.table = mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN))
        self.block = block
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.power) < size:
            def powers(base):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                return np.multiply.accumulate(steps)

            self.power, self.inverse = powers(BASE), powers(pow(BASE, -1, 1 << 64))

    def spans(self, column: pa.Array):
        """Bytes, word starts and ends, and each row's first word (one entry more than rows)."""
        data, offsets = text_bytes(column)
        if not len(data):
            return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        kind = self.classes[data]
        edge = np.ones(len(kind) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[offsets] = True
        solid = kind > 0
        starts = np.flatnonzero(solid & edge[:-1])
        return data, starts, np.flatnonzero(solid & edge[1:]) + 1, np.searchsorted(starts, offsets)

    def hashes(self, data, starts, ends) -> np.ndarray:
        """64-bit hash of every word, in blocks of words so that long texts stay bounded."""
        out = np.empty(len(starts), np.uint64)
        for low in range(0, len(starts), self.block):
            a, b = starts[low : low + self.block], ends[low : low + self.block]
            origin = a[0]
            part = self.table[data[origin : b[-1]]]
            self._grow(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * self.power[: len(part)], out=total[1:])
            raw = (total[b - origin] - total[a - origin]) * self.inverse[a - origin]
            out[low : low + self.block] = mix(raw + (b - a).astype(np.uint64) * np.uint64(GOLDEN))
        return out

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all rows and each row's first word."""
        data, starts, ends, first = self.spans(column)
        return self.hashes(data, starts, ends), first


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, also of those that cross rows."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for at in range(size):
        total = total * np.uint64(BASE) + hashes[at : at + n]
    return mix(total)


def row_shingles(hashes: np.ndarray, first: np.ndarray, size: int):
    """For each row the hashes of its word runs; a row of fewer words is one run, an empty row none."""
    runs = windows(hashes, size)
    for low, high in zip(first[:-1], first[1:]):
        if high - low >= size:
            yield runs[low : high - size + 1]
        elif high > low:
            yield windows(hashes[low:high], int(high - low))
        else:
            yield runs[:0]
