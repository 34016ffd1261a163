"""Secret scans: patterns propose findings, a random forest removes the false ones.

Everything is DataFrame work in the JVM.  A finding is a value assigned to a telling name, or a long
run of letters and digits.  The forest looks at its length, its changes between kinds of characters,
the share of it that corpus words cover (words counted by document, outside of findings, so
that a secret with many copies does not make words of itself), the path of the document and the words around it.  It is trained from labelled findings: those of the corpus that
their form settles (at most ``TRAIN_ROWS``, by hash), and rows made by rule so that both labels are
always there.  Callers with reviewed findings pass them to ``fit`` instead.

Defined cases: a text that is null or empty has no finding; a null ``doc_id`` is kept; rows equal in
id, source and text are reported once; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import settle

TRAIN_ROWS = 5000
TREES = 20
DEPTH = 6
THRESHOLD = 0.5
DICTIONARY_COUNT = 5
MASK = "[SECRET]"

# Names that announce a secret, forms of vendor keys, and telling words.
NAMES = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credential)s?"
ASSIGNED = NAMES + r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
VALUE = r"[^\s\"'`,;<>]{8,}"
LONG_RUN = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+={0,2}"
FINDING = rf"\b{ASSIGNED}{VALUE}|{LONG_RUN}"
VENDOR = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk[_-][A-Za-z0-9_-]{20,}$|^eyJ[A-Za-z0-9_-]{20,}$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
HARMLESS_WORDS = r"(?i)\b(commit|sha1|sha256|md5|checksum|digest|uuid|guid|revision|isbn|order|invoice|phone|card)\b"
TEST_PATHS = r"(?i)test|example|sample|fixture|mock|demo"

FEATURES = ("length", "digits", "capitals", "changes", "variety", "hexadecimal", "coverage", "assigned", "quoted", "harmless_words", "in_path", "test_path")


def _words_at(text: Column, end: bool) -> Column:
    pattern = r"(?:\S+\s+){0,2}\S*\s*$" if end else r"^\s*(?:\S+\s+){0,2}\S*"
    edge = F.right(text, F.lit(80)) if end else F.left(text, F.lit(80))
    return F.regexp_extract(edge, pattern, 0)


def findings(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, no, path, found, before, after``: proposals with the words around them."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    some = rows.where(F.col("text").rlike(FINDING)).withColumns({
        "mark": F.xxhash64("text"), "all": F.regexp_extract_all("text", F.lit(FINDING), F.lit(0)), "between": F.split("text", FINDING, -1),
    })
    each = some.select("doc_id", "mark", "path", "between", F.posexplode("all").alias("no", "found"))
    around = each.select(
        "doc_id", "mark", "path", "no", "found",
        _words_at(F.get("between", F.col("no")), True).alias("before"), _words_at(F.coalesce(F.get("between", F.col("no") + 1), F.lit("")), False).alias("after"),
    )
    return around.dropDuplicates(["doc_id", "mark", "path", "no"])


def described(found: DataFrame) -> DataFrame:
    """Add ``value`` and all features except ``coverage``."""
    value = F.regexp_replace("found", "^" + ASSIGNED, "")
    size = F.greatest(F.length("value"), F.lit(1))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0"), "[^aB0]", "-")

    def share(pattern: str) -> Column:
        return F.regexp_count("value", F.lit(pattern)) / size

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("double")

    return found.withColumn("value", value).withColumns({
        "length": F.length("value").cast("double"),
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "changes": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / size,
        "variety": F.size(F.array_distinct(F.split("value", ""))) / size,
        "hexadecimal": flag(F.col("value").rlike("^[0-9a-fA-F]+$")),
        "assigned": flag(F.col("found").rlike("^" + ASSIGNED)),
        "quoted": flag(F.col("found").rlike("[\"']") | F.col("before").rlike("[\"']$")),
        "harmless_words": flag(F.concat_ws(" ", "before", "after").rlike(HARMLESS_WORDS)),
        "in_path": flag(F.col("value").rlike("/.*/") | F.col("before").rlike("[/.]$")),
        "test_path": flag(F.col("path").rlike(TEST_PATHS)),
    })


def with_coverage(found: DataFrame, docs: DataFrame, least: int = DICTIONARY_COUNT) -> DataFrame:
    """Add ``coverage``: the share of the value in runs of letters that are words of the corpus.

    A word stands in ``least`` documents outside of proposed findings; counts are combined before
    they are shuffled.
    """
    runs = found.select("value").distinct().select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    outside = F.array_distinct(F.split(F.lower(F.regexp_replace("text", FINDING, " ")), "[^a-z]+"))
    words = docs.select(F.explode(outside).alias("word")).where(F.length("word") >= 3).groupBy("word").agg(F.count("*").alias("n"))
    known = words.where(F.col("n") >= least).join(runs.select("word").distinct(), "word", "left_semi").select("word", F.lit(True).alias("known"))
    held = runs.join(known, "word").groupBy("value").agg(F.sum(F.length("word")).alias("held"))
    return found.join(held, "value", "left").withColumn("coverage", F.coalesce("held", F.lit(0)) / F.greatest(F.length("value"), F.lit(1))).drop("held")


def settled_labels(found: DataFrame) -> DataFrame:
    """Findings whose form settles them, with ``label`` 1 or 0; the form of a vendor's key comes first."""
    digits_only = F.col("digits") >= 0.999
    wordy = (F.col("coverage") >= 0.6) | ((F.col("digits") == 0) & (F.col("capitals") < 0.1) & (F.col("coverage") >= 0.3))
    false = digits_only | wordy | F.col("value").rlike(UUID) | ((F.col("harmless_words") == 1) & (F.col("assigned") == 0))
    true = (F.col("assigned") == 1) & (F.col("digits") > 0.1) & (F.col("changes") > 0.2)
    return found.withColumn("label", F.when(F.col("value").rlike(VENDOR), 1.0).when(false, 0.0).when(true, 1.0)).where("label is not null")


def rule_made(spark: SparkSession, rows: int = 400) -> DataFrame:
    """Labelled findings made by rule: keys as hash digests, harmless values as numbers, ids and words."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    kind = F.col("id") % 8
    upper = F.upper(F.translate(F.substring(digest, 1, 16), "0189", "ghjk"))
    mixed = F.translate(F.base64(F.unhex(F.substring(digest, 1, 48))), "+/=", "abc")
    word = F.concat(*[F.element_at(F.array(*[F.lit(w) for w in ("there", "house", "under", "water", "light", "north")]), (F.shiftright("id", 3 + s) % 6 + 1).cast("int")) for s in (0, 2, 4)])
    found = (
        F.when(kind == 0, F.concat(F.lit('token = "'), F.substring(digest, 1, 40)))
        .when(kind == 1, F.concat(F.lit("password="), F.substring(digest, 1, 18)))
        .when(kind == 2, F.concat(F.lit("AKIA"), upper))
        .when(kind == 3, F.concat(F.lit("api_key: "), mixed))
        .when(kind == 4, F.substring(F.regexp_replace(F.concat(F.conv(F.substring(digest, 1, 12), 16, 10), F.conv(F.substring(digest, 13, 12), 16, 10)), "[^0-9]", ""), 1, 16))
        .when(kind == 5, F.concat(word, F.lit("20"), F.col("id")))
        .when(kind == 6, F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12)))
        .otherwise(F.substring(digest, 1, 40))
    )
    before = F.when(kind == 7, F.lit("in commit ")).otherwise(F.lit("and then "))
    made = spark.range(rows).select("id", found.alias("found"), before.alias("before"), F.lit(" after that").alias("after"), F.lit("made").alias("path"), (kind < 4).cast("double").alias("label"), (kind == 5).alias("_wordy"))
    return described(made).withColumn("coverage", F.when(F.col("_wordy"), 15 / F.length("value")).otherwise(0.0)).select("label", "value", *FEATURES)


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH):
    """A forest over ``labelled``: the columns of ``FEATURES``, ``value`` and ``label``."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled.orderBy("value", *FEATURES, "label").coalesce(1))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=17, labelCol="label", featuresCol="features").fit(rows.select("features", "label"))


def scan(docs: DataFrame, model=None, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, mark, no, value, length, assigned, chance, is_secret``: every finding, judged."""
    proposed = settle(described(findings(docs)))
    found = settle(with_coverage(proposed, docs))
    if model is None:
        settled = settled_labels(found).select("label", "value", *FEATURES).distinct()
        chosen = settled.orderBy(F.md5("value"), *FEATURES, "label").limit(train_rows)
        model = fit(settle(chosen.union(rule_made(docs.sparkSession).select("label", "value", *FEATURES))))
    judged = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
    chance = vector_to_array("probability")[1]
    return judged.select(
        "doc_id", "mark", "path", "no", "value", F.col("length").cast("int").alias("length"), (F.col("assigned") == 1).alias("assigned"), "coverage", chance.alias("chance")
    ).withColumn("is_secret", F.col("chance") >= threshold)


def masked(docs: DataFrame, mask: str = MASK, **options) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; all rows and columns stay."""
    held = scan(docs, **options).where("is_secret").groupBy("doc_id", "mark", "path").agg(F.collect_set("value").alias("_values"))
    held = held.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), F.col("path").alias("_p"), F.sort_array("_values").alias("_values"))
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & F.col("source").cast("string").eqNullSafe(F.col("_p")) & (F.xxhash64("text") == F.col("_m"))
    )
    # Longer values first, so that a secret within another is not left in parts.
    ordered = F.array_sort("_values", lambda a, b: F.length(b) - F.length(a))
    clean = F.aggregate(ordered, F.col("text"), lambda text, value: F.replace(text, value, F.lit(mask)))
    return docs.join(held, same, "left").withColumn("text", F.when(F.col("_values").isNotNull(), clean).otherwise(F.col("text"))).select(*docs.columns)
