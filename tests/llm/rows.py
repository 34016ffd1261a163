"""Rows that every operator has to take: nulls, empty and long texts, repeats and clashing columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(name, T.StringType()) for name in ("mark", "key", "size", "rows", "component", "weight", "kept", "_block")],
])
CLASH = ("x",) * 8
PROSE = " ".join(f"word{i % 97} and thing{i % 89}" for i in range(60))


def odd_rows():
    return [
        (1, PROSE, "en", "a", 1, *CLASH),
        (1, PROSE, "en", "a", 1, *CLASH),
        (2, PROSE, "en", None, None, *CLASH),
        (3, None, "en", "b", 1, *CLASH),
        (4, "", None, "b", 0, *CLASH),
        (5, " \t\r\n\x0b\x0c ", "fr", "b", 7, *CLASH),
        (None, "a null id with a few words in it", "en", "c", 1, *CLASH),
        (None, None, None, None, None, *([None] * 8)),
        (7, "one", "fr", "c", 3, *CLASH),
        (8, "Çà et là, l'été — ñandú 日本語   x", "fr", "c", 3, *CLASH),
        (9, " ".join(f"long{i * 7919 % 10007}" for i in range(60_000)), "en", "c", 1, *CLASH),
        (-5, "w" * 300_000, "de", "a", 1, *CLASH),
    ]


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, rows):
    """Rows ``(doc_id, text)`` or ``(doc_id, text, lang, source)``."""
    full = [(*r, *(None,) * (4 - len(r))) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
