"""Vector columns: codec, normalisation, identity and the feature-hash embedding."""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as tx

VECTOR = T.ArrayType(T.FloatType())

# The hash model's weights and personalisation tag.
WORD_WEIGHT = 1.0
PAIR_WEIGHT = 0.55
PAIR_JOINER = "\x1f"
HASH_TAG = b"papers-vector-v1"


def norm(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def _finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def normalized(vector: Column) -> Column:
    """Unit-length double vector; empty, non-finite or zero vectors are errors."""
    checked = F.when(_finite(vector), norm(vector)).otherwise(F.raise_error(F.lit("vector must be finite and not empty")).cast("double"))
    length = F.when(checked == 0, F.raise_error(F.lit("zero-length vectors cannot be normalized")).cast("double")).otherwise(checked)
    return F.transform(vector, lambda x: x.cast("double") / length)


def cosine(left: Column, right: Column) -> Column:
    """Cosine in double precision; 0 for a zero vector, an error for unequal sizes."""
    dot = F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda t, x: t + x
    )
    scale = norm(left) * norm(right)
    sized = F.when(F.size(left) != F.size(right), F.raise_error(F.lit("vectors must have equal dimensions")).cast("double"))
    return F.coalesce(sized, F.when(scale == 0, F.lit(0.0)).otherwise(dot / scale))


@F.pandas_udf(VECTOR)
def decode_float32(blobs: pd.Series, dimensions: pd.Series) -> pd.Series:
    def decode(blob, size):
        if size <= 0 or len(blob) != 4 * size:
            raise ValueError(f"float32 blob of {len(blob)} bytes does not hold {size} values")
        return np.frombuffer(blob, dtype="<f4")

    return pd.Series([decode(b, n) for b, n in zip(blobs, dimensions)])


@F.pandas_udf(T.BinaryType())
def encode_float32(vectors: pd.Series) -> pd.Series:
    return pd.Series([np.asarray(v, dtype="<f4").tobytes() for v in vectors])


def model_fingerprint(model: str, provider: str = "", dimensions: int | None = None, revision: str = "",
                      profile: str = "", normalized: bool = True) -> str:
    """SHA-256 of the canonical JSON that names one vector set."""
    identity = {"model": model, "provider": provider, "dimensions": dimensions, "revision": revision,
                "profile": profile, "normalized": normalized}
    text = json.dumps(identity, ensure_ascii=True, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def _features(tokens: Column) -> Column:
    words = F.transform(tokens, lambda t: F.concat(F.lit("word:"), t))
    before = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.zip_with(before, F.slice(tokens, 2, F.size(tokens)), lambda a, b: F.concat(F.lit("bigram:"), a, F.lit(PAIR_JOINER), b))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def feature_counts(tokens: Column) -> Column:
    """The distinct features of one text as ``array<struct<feature, n>>``, counted in its row: equal ones lie together when sorted."""

    def counted(held):
        # A sequence up to -1 would count down.
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(held) - 1, F.lit(0))), lambda i: i < F.size(held))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(held, i) != F.get(held, i - 1)))
        return tx.once(starts, lambda at: F.zip_with(
            at, F.slice(F.concat(at, F.array(F.size(held))), 2, F.size(at)),
            lambda a, b: F.struct(F.get(held, a).alias("feature"), (b - a).cast("long").alias("n")),
        ))

    return tx.once(F.sort_array(tx.once(tokens, _features)), counted)


def feature_weight(feature: Column, n: Column) -> Column:
    return F.when(feature.startswith("word:"), WORD_WEIGHT).otherwise(PAIR_WEIGHT) * (1 + F.ln(n))


def hash_identity(dimensions: int) -> tuple[str, str]:
    name = f"hash-v1:{dimensions}"
    return name, model_fingerprint(name, provider="hash", dimensions=dimensions)


def hash_slots_of(features, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and sign of each feature from its tagged 16-byte hash."""
    start = hashlib.blake2b(digest_size=16, person=HASH_TAG)
    digests = []
    for feature in features:
        state = start.copy()
        state.update(feature.encode())
        digests.append(state.digest())
    halves = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return (halves[:, 0] % np.uint64(dimensions)).astype(np.int64), np.where(halves[:, 1] & np.uint64(1), 1.0, -1.0)


def hash_vector(tokens: list[str], dimensions: int) -> np.ndarray:
    words = Counter("word:" + t for t in tokens)
    pairs = Counter("bigram:" + a + PAIR_JOINER + b for a, b in zip(tokens, tokens[1:]))
    if not tokens:
        return np.zeros(dimensions, dtype=np.float32)
    slots, signs = hash_slots_of([*words, *pairs], dimensions)
    weights = np.repeat([WORD_WEIGHT, PAIR_WEIGHT], [len(words), len(pairs)])
    counts = np.array([*words.values(), *pairs.values()], dtype=np.float64)
    values = signs * weights * (1.0 + np.log(counts))
    vector = np.bincount(slots, weights=values, minlength=dimensions)
    length = float(np.linalg.norm(vector))
    return (vector / length if length else vector).astype(np.float32)


def hash_embedding(dimensions: int):
    """``array<string>`` of feature tokens to a unit float vector, one row at a time.

    The tokens are cut in the JVM and sent as one text, joined by blanks, which none holds; no
    shuffle is needed as each text is one row.
    """

    @F.pandas_udf(VECTOR)
    def embed(tokens: pd.Series) -> pd.Series:
        return pd.Series([hash_vector(t.split(" ") if t else [], dimensions) for t in tokens])

    return lambda tokens: embed(F.array_join(tokens, " "))


def hash_slots(dimensions: int):
    """Slot and sign of each feature."""

    @F.pandas_udf(T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("sign", T.DoubleType())]))
    def place(features: pd.Series) -> pd.DataFrame:
        slots, signs = hash_slots_of(features, dimensions)
        return pd.DataFrame({"slot": slots, "sign": signs})

    return place


def md5_slots(dimensions: int):
    """Slot and sign of each feature from its MD5 digest: a variant that stays in the JVM."""

    def place(feature: Column) -> Column:
        # Eight digits give the slot and the next one the sign.
        head = F.conv(F.substring(F.md5(feature), 1, 9), 16, 10).cast("bigint")
        slot = (F.shiftright(head, 4) % dimensions).cast("int")
        sign = F.when(head % 2 == 1, 1.0).otherwise(-1.0)
        return F.struct(slot.alias("slot"), sign.alias("sign"))

    return place


def scatter(dimensions: int):
    """Unit vector from the slots and values of one row."""

    @F.pandas_udf(VECTOR)
    def fill(slots: pd.Series, values: pd.Series) -> pd.Series:
        rows = []
        for slot, value in zip(slots, values):
            vector = np.bincount(slot, weights=value, minlength=dimensions)
            length = float(np.linalg.norm(vector))
            rows.append((vector / length if length else vector).astype(np.float32))
        return pd.Series(rows)

    return fill
