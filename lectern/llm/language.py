"""Language identification in two steps: the family first, then the language within it.

A text is a bag of hashed byte 3-grams and 4-grams over its whole length.  A linear support vector
machine per family separates it from the others; within a family one machine per pair of languages
votes.  The machines are fitted on the driver by dual coordinate descent, on a sample of at most
``TRAIN_ROWS`` labelled rows with equal numbers per language, chosen by a hash of the id.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if
nothing could be learned; a language without a known family is a family of its own; repeated rows
are judged alike; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import bounded_batches
from lectern.llm.words import GOLDEN, byte_slices, text_bytes
from lectern.session import settle

UNKNOWN = "und"
BITS = 12
TRAIN_ROWS = 4000
PASSES = 12
PENALTY = 4.0
# Families of common languages.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "pt": "romance", "it": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sk": "slavic", "hr": "slavic", "sr": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic",
    "hi": "indic", "bn": "indic", "mr": "indic", "ur": "indic",
    "ar": "semitic", "he": "semitic",
    "tr": "turkic", "az": "turkic", "kk": "turkic",
}


def gram_features(texts: list[np.ndarray], bits: int = BITS, block: int = 1 << 20) -> np.ndarray:
    """Unit-length square roots of hashed 3-gram and 4-gram counts, one row per text."""
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += 32
    lower[[9, 10, 11, 12, 13]] = 32
    out = np.zeros((len(texts), 1 << bits), np.float32)
    shift, factor = np.uint64(64 - bits), np.uint64(GOLDEN)
    for at, text in enumerate(texts):
        counts = np.zeros(1 << bits, np.int64)
        for low in range(0, len(text), block):
            codes = lower[text[low : low + block + 3]]
            if len(codes) < 3:
                continue
            three = (codes[:-2] << np.uint64(16)) | (codes[1:-1] << np.uint64(8)) | codes[2:]
            four = (three[:-1] << np.uint64(8)) | codes[3:] | np.uint64(1 << 32)
            for grams in (three[:block], four[:block]):
                counts += np.bincount(((grams * factor) >> shift).astype(np.int64), minlength=1 << bits)
        row = np.sqrt(counts)
        length = np.sqrt((row * row).sum())
        out[at] = row / length if length else row
    return out


def _byte_rows(column: pa.Array) -> list[np.ndarray]:
    data, offsets = text_bytes(column)
    return [data[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def fit_machine(rows: np.ndarray, signs: np.ndarray, passes: int = PASSES, penalty: float = PENALTY) -> np.ndarray:
    """Weights and bias of a linear support vector machine with squared hinge loss."""
    rows = np.hstack([rows, np.ones((len(rows), 1), np.float32)])
    weights, dual = np.zeros(rows.shape[1]), np.zeros(len(rows))
    soft = 0.5 / penalty
    squares = (rows * rows).sum(axis=1) + soft
    draw = np.random.default_rng(3)
    for _ in range(passes):
        for i in draw.permutation(len(rows)):
            slope = signs[i] * (rows[i] @ weights) - 1 + soft * dual[i]
            new = max(0.0, dual[i] - slope / squares[i])
            if new != dual[i]:
                weights += (new - dual[i]) * signs[i] * rows[i]
                dual[i] = new
    return weights


class LanguageModel:
    """Machines between families and between the languages of each family."""

    def __init__(self, rows: np.ndarray, langs: list[str], families: dict[str, str] = FAMILIES):
        labels = np.array(langs, object)
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(families.get(lang, lang), []).append(lang)
        names = sorted(self.families)
        family = np.array([families.get(lang, lang) for lang in langs], object)
        self.between = np.array([fit_machine(rows, np.where(family == n, 1.0, -1.0)) for n in names]) if len(names) > 1 else None
        self.names, self.pairs = names, {}
        for members in self.families.values():
            for a, b in itertools.combinations(members, 2):
                both = (labels == a) | (labels == b)
                self.pairs[a, b] = fit_machine(rows[both], np.where(labels[both] == a, 1.0, -1.0))

    @staticmethod
    def _margins(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return rows @ weights[..., :-1].T + weights[..., -1]

    def predict(self, rows: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return [UNKNOWN] * len(rows), np.zeros(len(rows))
        if self.between is None:
            chance = np.ones((len(rows), 1))
        else:
            margins = 3 * self._margins(rows, self.between)
            chance = np.exp(margins - margins.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
        family = chance.argmax(axis=1)
        best, score = [""] * len(rows), np.zeros(len(rows))
        for number, name in enumerate(self.names):
            mine = np.flatnonzero(family == number)
            members = self.families[name]
            votes = np.zeros((len(mine), len(members)))
            if len(members) == 1:
                votes += 1
            for (i, a), (j, b) in itertools.combinations(enumerate(members), 2):
                won = 1 / (1 + np.exp(-3 * self._margins(rows[mine], self.pairs[a, b])))
                votes[:, i] += won
                votes[:, j] += 1 - won
            if len(mine):
                votes /= votes.sum(axis=1, keepdims=True)
                for at, pick in zip(mine, votes.argmax(axis=1)):
                    best[at] = members[pick]
                score[mine] = chance[mine, number] * votes.max(axis=1)
        return best, np.clip(score, 0.0, 1.0)


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, bits: int = BITS) -> LanguageModel:
    """Learn from ``labelled (doc_id, text, lang)``; rows without a language or a text are left out."""
    rows = bounded_batches(labelled).where("lang is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    shares = rows.select("lang").distinct().count()
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    chosen = rows.select("doc_id", "lang").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(1, train_rows // max(1, shares)))
    chosen = settle(chosen.select(F.col("doc_id").alias("_d"), F.col("lang").alias("_l")).distinct().limit(train_rows))
    sample = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_d")) & (F.col("lang") == F.col("_l"))).drop("_d", "_l").dropDuplicates(["doc_id", "lang"])

    def prepared(batches):
        for batch in batches:
            for part in byte_slices(batch, "text"):
                raw = [r.astype(np.float16).tobytes() for r in gram_features(_byte_rows(part.column("text")), bits)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(raw, pa.binary())], names=["doc_id", "lang", "row"])

    held = sample.mapInArrow(prepared, "doc_id long, lang string, row binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    raw = held.column("row").to_pylist()
    features = np.frombuffer(b"".join(raw), np.float16).reshape(len(raw), 1 << bits).astype(np.float32)
    return LanguageModel(features, held.column("lang").to_pylist())


def identify(docs: DataFrame, model: LanguageModel, bits: int = BITS) -> DataFrame:
    """``doc_id, lang_pred, score``, one row per row of ``docs``; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch in batches:
            for part in byte_slices(batch, "text"):
                lettered = [any(map(str.isalpha, t or "")) for t in part.column("text").to_pylist()]
                langs, scores = shared.value.predict(gram_features(_byte_rows(part.column("text")), bits))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([lang if ok else UNKNOWN for lang, ok in zip(langs, lettered)]),
                        pa.array([float(s) if ok else 0.0 for s, ok in zip(scores, lettered)]),
                    ],
                    names=["doc_id", "lang_pred", "score"],
                )

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(predict, "doc_id long, lang_pred string, score double")


def remainder(parts: int):
    return F.crc32(F.col("doc_id").cast("string")) % parts


def held_out_languages(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose remainder by 3 is not 1, predict all, and mark those held out."""
    model = fit(docs.where(remainder(3) != 1))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
