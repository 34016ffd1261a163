"""Quality rules: word counts of a text, and bands of its perplexity under a model of its language.

The model is an interpolated modified Kneser-Ney model over the bytes of words, one per language,
counted by Spark over all documents.  Words are counted first, so n-grams are cut from distinct
words only; lower orders, discounts and probabilities are joins and sums of small tables.  The
model is held as sorted arrays of 64-bit keys (an n-gram's bytes, so different n-grams never
collide) and is broadcast while it has at most ``model_rows`` entries; a larger one is joined.

A document fails if its log perplexity lies outside the band of its language: the median of the
documents that pass the counting rules, plus and minus ``width`` robust deviations.  A quoted
passage, a table or a key of ``PASSAGE_WORDS`` words may lift a clean short text by up to ``SLACK``,
so the upper limit is raised by ``SLACK`` times the share such a passage has in the text.

Defined cases: a null or empty text has no words and fails; a null language is a language of its
own; a language without passing documents has no band; repeated rows are judged alike and counted
as often as they occur; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import bounded_batches
from lectern.llm.words import free_token_cache, give_back_memory
from lectern.session import settle

ORDER = 4
WIDTH = 6.0
LEAST_WIDTH = 0.1
PASSAGE_WORDS = 64
SLACK = 1.5
BIN = 0.001
MIN_WORDS = 50
REPEAT_PERCENT = 50
MODEL_ROWS = 8_000_000
TASK_WORDS = 250_000
# The symbols that are counted, and the bytes that stand for a word's start and end.
SYMBOLS = b"#*$%&|<>"
START, END = b"\x02", b"\x03"


def base_counts(text: bytes) -> tuple[list[bytes], int, int, int, int]:
    """The words, and ``word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    words = text.split()
    white = len(text) - sum(map(len, words))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    runs = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(runs)) < len(runs):
        often = Counter(runs)
        reach = 0
        for at, run in enumerate(runs):
            if often[run] > 1:
                repeated += at + 3 - max(reach, at)
                reach = at + 3
    return words, len(text.decode()) - white, symbols, len(lines) - len(set(lines)), repeated


def _keys(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of padded words, one per byte and word end, and where each word's begin."""
    head = START * (order - 1)
    data = np.frombuffer(b"".join([head + w + END for w in words]), np.uint8)
    steps = np.fromiter(map(len, words), np.int64, len(words)) + 1
    first = np.concatenate([[0], np.cumsum(steps)[:-1]])
    packed = np.zeros(len(data) - order + 1, np.int64)
    for at in range(order):
        packed = (packed << 8) | data[at : at + len(packed)]
    return packed[np.arange(steps.sum()) + np.repeat(np.arange(len(words)) * (order - 1), steps)], first


def _texts(batch: pa.RecordBatch, rows: int = 1000):
    for low in range(0, batch.num_rows, rows):
        part = batch.slice(low, rows)
        yield part, [(t or "").encode() for t in part.column("text").to_pylist()], part.column("lang").to_pylist()


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, gram, n`` over all words of all documents."""

    def count(batches):
        free_token_cache()
        held: dict = {}

        def out():
            for lang, words in held.items():
                keys, _ = _keys(list(words), order)
                times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(w) + 1 for w in words])
                grams, inverse = np.unique(keys, return_inverse=True)
                total = np.bincount(inverse, times).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(total)], names=["lang", "gram", "n"])
            held.clear()
            give_back_memory()

        for batch in batches:
            for _, texts, langs in _texts(batch):
                for text, lang in zip(texts, langs):
                    if words := text.split():
                        held.setdefault(lang, Counter()).update(words)
                if sum(map(len, held.values())) > TASK_WORDS:
                    yield from out()
        yield from out()

    found = bounded_batches(docs).select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(count, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, k, kind, key, value``: log probabilities (kind 0) and log back-off weights (kind 1)."""
    levels = {order: settle(counts)}
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))
        levels[k] = levels[k + 1].select("lang", suffix.alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    rows, lower = None, None
    for k in range(1, order + 1):
        level = levels[k]
        of = [F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        ratio = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        usable = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)

        def discount(i: int) -> Column:
            estimate = i - (i + 1) * ratio * F.col(f"n{i + 1}") / F.when(F.col(f"n{i}") > 0, F.col(f"n{i}"))
            return F.when(usable, F.greatest(F.lit(0.01), F.least(F.lit(i - 0.01), estimate))).otherwise(i / 2).alias(f"d{i}")

        discounts = level.groupBy("lang").agg(*of).select(F.col("lang").alias("_lang"), *[discount(i) for i in (1, 2, 3)])
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = Window.partitionBy("lang", "context")
        scored = (
            level.join(discounts, F.col("lang").eqNullSafe(F.col("_lang")))
            .withColumn("context", F.shiftright("gram", 8))
            .withColumn("total", F.sum("n").over(context))
            .withColumn("off", off)
            .withColumn("back", F.sum("off").over(context) / F.col("total"))
        )
        if lower is None:
            below = F.lit(1 / 256)
        else:
            scored = scored.join(
                lower, F.col("lang").eqNullSafe(F.col("_lower_lang")) & (F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1)) == F.col("_lower"))
            )
            below = F.col("_p")
        scored = settle(scored.select("lang", "gram", "context", "back", ((F.col("n") - F.col("off")) / F.col("total") + F.col("back") * below).alias("p")))
        lower = scored.select(F.col("lang").alias("_lower_lang"), F.col("gram").alias("_lower"), F.col("p").alias("_p"))
        mine = scored.select("lang", F.lit(k).alias("k"), F.lit(0).alias("kind"), F.col("gram").alias("key"), F.log("p").cast("float").alias("value")).union(
            scored.groupBy("lang", "context").agg(F.first("back").alias("back")).select("lang", F.lit(k), F.lit(1), "context", F.log("back").cast("float"))
        )
        rows = mine if rows is None else rows.union(mine)
    return rows


class SortedModel:
    """The model of one language as sorted key arrays with their values."""

    def __init__(self, tables: dict, order: int):
        self.tables, self.order = tables, order

    def _look_up(self, k: int, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, values = self.tables[k, kind]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return known[at] == keys, values[at]

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        total, open_rows = np.zeros(len(keys)), np.arange(len(keys))
        for k in range(self.order, 0, -1):
            grams = keys[open_rows] & ((1 << (8 * k)) - 1)
            hit, value = self._look_up(k, 0, grams)
            total[open_rows[hit]] += value[hit]
            open_rows, grams = open_rows[~hit], grams[~hit]
            if not len(open_rows):
                return total
            hit, value = self._look_up(k, 1, grams >> 8)
            total[open_rows] += np.where(hit, value, 0.0)
        total[open_rows] -= np.log(256)
        return total

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        keys, first = _keys(words, self.order)
        return np.add.reduceat(self.log_probabilities(keys), first)


def sorted_models(model: DataFrame, order: int) -> dict:
    """Language to ``SortedModel``; the caller has checked the number of rows."""
    held = model.toArrow()
    coded = held.column("lang").combine_chunks().dictionary_encode()
    number = coded.indices.fill_null(-1).to_numpy()
    place = {lang: i for i, lang in enumerate(coded.dictionary.to_pylist())} | ({None: -1} if coded.null_count else {})
    names = sorted(place, key=lambda x: (x is None, x))
    columns = [held.column(c).to_numpy() for c in ("k", "kind", "key", "value")]
    out = {}
    for lang in names:
        tables = {}
        for k in range(1, order + 1):
            for kind in (0, 1):
                rows = (number == place[lang]) & (columns[0] == k) & (columns[1] == kind)
                by_key = np.argsort(columns[2][rows])
                tables[k, kind] = columns[2][rows][by_key], columns[3][rows][by_key].astype(np.float32)
        out[lang] = SortedModel(tables, order)
    return out


FEATURES = "doc_id long, lang string, mark long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, symbols_scored long, log_sum double"


def _measured(docs: DataFrame, models: dict | None, order: int) -> DataFrame:
    """Counts of every row; with ``models`` also the log probability of its words."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(models) if models is not None else None

    def measure(batches):
        free_token_cache()
        scores: dict = {}
        for batch in batches:
            for part, texts, langs in _texts(batch):
                counted = [base_counts(t) for t in texts]
                if shared is not None:
                    new: dict = {}
                    for lang, (words, *_) in zip(langs, counted):
                        new.setdefault(lang, set()).update(words)
                    for lang, words in new.items():
                        known = scores.setdefault(lang, {})
                        if len(known) > 2 * TASK_WORDS:
                            known.clear()
                        fresh = list(words - known.keys())
                        if fresh and lang in shared.value:
                            known.update(zip(fresh, shared.value[lang].word_scores(fresh).tolist()))
                sums = [
                    sum(map(scores[lang].__getitem__, words)) if shared is not None and words and lang in shared.value else None
                    for lang, (words, *_) in zip(langs, counted)
                ]
                columns = [[len(c[0]) for c in counted], *([c[i] for c in counted] for i in (1, 2, 3, 4)), [sum(map(len, c[0])) + len(c[0]) for c in counted]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), part.column("mark"), *(pa.array(c, pa.int64()) for c in columns), pa.array(sums, pa.float64())],
                    names=[f.split()[0] for f in FEATURES.split(", ")],
                )
        scores.clear()
        give_back_memory()

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.xxhash64("text").alias("mark"), F.col("text").cast("string")).mapInArrow(measure, FEATURES)


def _joined_sums(docs: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """``_doc, _lang, _mark, log_sum`` by joins with the model, for one that is too large to broadcast."""

    def grams(batches):
        for batch in batches:
            for part, texts, langs in _texts(batch, 100):
                for doc, mark, lang, text in zip(part.column("doc_id").to_pylist(), part.column("mark").to_pylist(), langs, texts):
                    if words := text.split():
                        found, times = np.unique(_keys(words, order)[0], return_counts=True)
                        n = len(found)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([doc] * n, pa.int64()), pa.array([lang] * n, pa.string()), pa.array([mark] * n, pa.int64()), pa.array(found), pa.array(times)],
                            names=["_doc", "_lang", "_mark", "gram", "times"],
                        )

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.xxhash64("text").alias("mark"), F.col("text").cast("string")).distinct()
    listed = settle(rows.mapInArrow(grams, "_doc long, _lang string, _mark long, gram long, times long"))
    known = listed.select("_lang", "gram").distinct()
    value, back = None, F.lit(0.0)
    for k in range(order, 0, -1):
        gram = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))
        for kind, key in ((0, gram), (1, F.shiftright(gram, 8))):
            side = model.where((F.col("k") == k) & (F.col("kind") == kind)).select(F.col("lang").alias("_l"), F.col("key").alias("_k"), F.col("value").alias(f"v{k}_{kind}"))
            known = known.join(side, F.col("_lang").eqNullSafe(F.col("_l")) & (key == F.col("_k")), "left").drop("_l", "_k")
        here = back + F.col(f"v{k}_0")
        value = here if value is None else F.coalesce(value, here)
        back = back + F.coalesce(F.col(f"v{k}_1"), F.lit(0.0))
    known = known.select(F.col("_lang").alias("_l"), F.col("gram").alias("_g"), F.coalesce(value, back - float(np.log(256))).alias("value"))
    scored = listed.join(known, F.col("_lang").eqNullSafe(F.col("_l")) & (F.col("gram") == F.col("_g")))
    return scored.groupBy("_doc", "_lang", "_mark").agg(F.sum(F.col("value") * F.col("times")).alias("_log_sum"))


def measured(docs: DataFrame, order: int = ORDER, model_rows: int = MODEL_ROWS) -> DataFrame:
    """Counts and ``log_perplexity`` of every row of ``docs`` under models of ``docs`` themselves."""
    model = settle(kneser_ney(gram_counts(docs, order), order))
    if model.count() <= model_rows:
        rows = _measured(docs, sorted_models(model, order), order)
    else:
        sums = _joined_sums(docs, model, order)
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("mark") == F.col("_mark"))
        rows = _measured(docs, None, order).join(sums, same, "left").withColumn("log_sum", F.col("_log_sum")).drop("_doc", "_lang", "_mark", "_log_sum")
    return settle(rows.withColumn("log_perplexity", -F.col("log_sum") / F.col("symbols_scored")))


def _middle(binned: DataFrame) -> DataFrame:
    """Per language the median of ``bin``, by counting: one row per language and bin meets in a window."""
    counts = binned.groupBy("lang", "bin").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    return counts.withColumn("_upto", upto).withColumn("_total", total).where("2 * _upto >= _total").groupBy("lang").agg(F.min("bin").alias("middle"))


def bands(rows: DataFrame, width: float = WIDTH) -> DataFrame:
    """``_band_lang, lower, upper`` of the log perplexity, from rows that pass the counting rules."""
    binned = rows.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull()).select("lang", F.floor(F.col("log_perplexity") / BIN).alias("bin"))
    middle = settle(_middle(binned)).select(F.col("lang").alias("_l"), "middle")
    apart = binned.join(middle, F.col("lang").eqNullSafe(F.col("_l"))).select("lang", F.abs(F.col("bin") - F.col("middle")).alias("bin"))
    spread = _middle(apart).select(F.col("lang").alias("_band_lang"), F.col("middle").alias("spread"))
    reach = F.greatest(F.lit(LEAST_WIDTH), width * 1.4826 * BIN * F.col("spread"))
    centre = BIN * (F.col("middle") + 0.5)
    return spread.join(middle, F.col("_band_lang").eqNullSafe(F.col("_l"))).select("_band_lang", (centre - reach).alias("lower"), (centre + reach).alias("upper"))


def judge(docs: DataFrame, order: int = ORDER, width: float = WIDTH, model_rows: int = MODEL_ROWS) -> DataFrame:
    """One row per row of ``docs`` with its counts, ``base_failed``, ``perplexity`` and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = measured(docs, order, model_rows).withColumn("base_failed", failed)
    judged = rows.join(settle(bands(rows, width)), F.col("lang").eqNullSafe(F.col("_band_lang")), "left")
    slack = SLACK * F.least(F.lit(1.0), PASSAGE_WORDS / F.col("n_words"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper") + slack), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & inside).withColumn("perplexity", F.exp("log_perplexity"))


def good_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects."""
    bad = judge(docs, **options).where("not kept").select(F.col("doc_id").alias("_d"), F.col("lang").alias("_l"), F.col("mark").alias("_m")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & F.col("lang").cast("string").eqNullSafe(F.col("_l")) & (F.xxhash64("text") == F.col("_m"))
    return docs.join(bad, same, "left_anti")
