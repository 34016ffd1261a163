"""Ranked lists to one result list: fusion, blending, diversification, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.session import broadcast_if_small, computed_once

FUSED_DIGITS = 12
BLEND_DIGITS = 9
# Shares of the reranker and of the fused score, and bonuses.
RERANK_SHARE = 0.85
FUSED_SHARE = 0.15
PHRASE_BONUS = 0.1
EXACT_BONUS = 2.0


def rank_lists(lists: DataFrame) -> DataFrame:
    """1-based rank of each key in its list; only a key's best place in a list counts.

    ``lists`` has ``(query_id, list_no, place, key)``; places order one list.  A later
    entry keeps the rank of its own place, as duplicates still occupy theirs.
    """
    first = Window.partitionBy("query_id", "list_no", "key").orderBy("place")
    return lists.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("rank", F.col("place"))


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60, carry: tuple[str, ...] = ()) -> DataFrame:
    """Sum of ``weight / (k + rank)`` per query and key.

    ``lists`` has ``(query_id, list_no, weight, rank, key, routing_note, *carry)``.
    The carried columns come from the first list that holds the key, the note from
    the first that has one.  ``first_seen`` orders equal scores.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    seen = F.struct("list_no", "rank")
    share = F.col("weight") / (F.lit(k) + F.col("rank"))
    return lists.groupBy("query_id", "key").agg(
        F.round(F.sum(share), FUSED_DIGITS).alias("score"),
        F.min(seen).alias("first_seen"),
        F.min_by("routing_note", F.when(F.col("routing_note").isNotNull(), seen)).alias("routing_note"),
        *[F.min_by(c, seen).alias(c) for c in carry],
    )


def merge_texts(lists: DataFrame) -> DataFrame:
    """Text of each fused key: the first list's, plus later texts it does not contain.

    A key occurs at most once per list, so one group has no more rows than lists.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("list_no", "rank", "text"))), lambda r: tx.strip(r["text"]))

    def add(held, new):
        rest = F.when((held != "") & new.startswith(held), tx.strip(F.substr(new, F.length(held) + 1))).otherwise(new)
        joined = F.when((held == "") | (rest == ""), F.concat(held, rest)).otherwise(F.concat_ws("\n\n", held, rest))
        return F.when((new == "") | F.contains(held, new), held).otherwise(joined)

    return lists.groupBy("query_id", "key").agg(F.aggregate(ordered, F.lit(""), add).alias("text"))


def top_pool(fused: DataFrame, size: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("first_seen"))
    return fused.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size).drop("_n", "first_seen")


def min_max(column: str, partition: str = "query_id") -> Column:
    """Scale to 0..1 within a query; nearly equal values all become 1."""
    over = Window.partitionBy(partition)
    low, high = F.min(column).over(over), F.max(column).over(over)
    close = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(low), F.abs(high))
    return F.when(close, F.lit(1.0)).otherwise((F.col(column) - low) / (high - low))


def lexical_f1(pool: DataFrame, queries: DataFrame, document: Column) -> DataFrame:
    """Token-overlap F1 of each pooled document with its query, as ``rerank_score``.

    Shared tokens are counted by joining exploded tokens with the query's counts, so
    work grows with the text and not with text times query length.
    """
    asked = broadcast_if_small(queries.select("query_id", tx.feature_tokens(F.col("text")).alias("asked")))
    wanted = broadcast_if_small(
        asked.select("query_id", F.size("asked").alias("asked_size"), F.explode("asked").alias("token"))
        .groupBy("query_id", "asked_size", "token")
        .agg(F.count("*").alias("wanted"))
    )
    texts = computed_once(pool.join(asked, "query_id"), tokens=tx.feature_tokens(document)).drop("text", "routing_note")
    sized = texts.select(
        "query_id", "key", F.size("tokens").alias("size"), F.size("asked").alias("asked_size"),
        F.when((F.size("asked") > 0) & F.contains(F.array_join("tokens", " "), F.array_join("asked", " ")), PHRASE_BONUS)
        .otherwise(0.0).alias("bonus"),
    )
    shared = (
        texts.select("query_id", "key", F.explode("tokens").alias("token"))
        .join(wanted, ["query_id", "token"])
        .groupBy("query_id", "key", "token", "wanted")
        .agg(F.count("*").alias("found"))
        .groupBy("query_id", "key")
        .agg(F.sum(F.least("wanted", "found")).alias("overlap"))
    )
    precision = F.col("overlap") / F.col("size")
    recall = F.col("overlap") / F.col("asked_size")
    f1 = F.when(F.col("overlap").isNull(), 0.0).otherwise(2.0 * precision * recall / (precision + recall))
    score = F.when((F.col("size") == 0) | (F.col("asked_size") == 0), 0.0).otherwise(F.least(F.lit(1.0), f1 + F.col("bonus")))
    return sized.join(shared, ["query_id", "key"], "left").select("query_id", "key", score.alias("rerank_score"))


def rerank_document() -> Column:
    # The labels of the parts of a document.
    note = F.col("routing_note")
    return F.concat(
        F.lit("DOCUMENT: "), F.col("title"), F.lit("\nSECTION: "), F.col("section_path"), F.lit("\nCONTENT:\n"),
        F.col("text"),
        F.when(note.isNotNull() & (note != ""), F.concat(F.lit("\n\nCURATED ROUTING NOTE:\n"), F.col("routing_note"))).otherwise(""),
    )


def blend(pool: DataFrame, scores: DataFrame) -> DataFrame:
    """0.85 of the scaled reranker score and 0.15 of the scaled fused score."""
    rows = pool.join(scores, ["query_id", "key"])
    value = RERANK_SHARE * min_max("rerank_score") + FUSED_SHARE * min_max("score")
    return rows.withColumn("score", F.round(value, BLEND_DIGITS))


def keep_exact(pool: DataFrame, queries: DataFrame) -> DataFrame:
    """Pooled rows that contain the math-normalised query; each gains a fixed bonus."""
    needle = queries.select("query_id", tx.casefold(tx.normalize_math(F.col("text"))).alias("needle"))
    head = F.when(F.col("kind") == "paper", F.col("title")).otherwise(F.col("section_path"))
    body = tx.casefold(tx.normalize_math(F.concat_ws("\n", head, F.col("text"))))
    return (
        pool.join(needle, "query_id")
        .where((F.col("needle") != "") & F.contains(body, F.col("needle")))
        .withColumn("score", F.col("score") + EXACT_BONUS)
        .drop("needle")
    )


def diversify(ranked: DataFrame, top_k: int, per_paper, order=None) -> DataFrame:
    """At most ``per_paper`` rows of one paper, then the best ``top_k`` per query."""
    order = order or [F.desc("score"), F.asc("key")]
    owner = F.coalesce("paper_id", "key")
    in_paper = Window.partitionBy("query_id", owner).orderBy(*order)
    in_query = Window.partitionBy("query_id").orderBy(*order)
    return (
        ranked.withColumn("_n", F.row_number().over(in_paper))
        .where(F.col("_n") <= per_paper)
        .withColumn("rank", F.row_number().over(in_query))
        .where(F.col("rank") <= top_k)
        .drop("_n")
    )


def snippet(text: Column, query: Column, max_words: int) -> Column:
    """Up to ``max_words`` words around the first match, with their own spacing."""
    words = F.regexp_extract_all(text, F.lit(r"\S+\s*"), F.lit(0))
    needle = tx.casefold(tx.normalize_math(query))
    at = tx.once(needle, lambda n: F.when(n != "", F.instr(tx.casefold(tx.normalize_math(text)), n)).otherwise(0))

    def center(read):
        before = F.when(read["at"] > 0, F.regexp_count(F.substr(text, F.lit(1), F.greatest(read["at"] - 1, F.lit(0))), F.lit(r"\S+")))
        return tx.once(before, lambda n: F.when(n < F.size(read["words"]), n).otherwise(0))

    def shown(read, start):
        body = tx.strip(F.array_join(F.slice(read["words"], start + 1, F.lit(max_words)), ""))
        cut = F.concat(
            F.when(start > 0, "… ").otherwise(""), body, F.when(start + max_words < F.size(read["words"]), " …").otherwise("")
        )
        return F.when(F.size(read["words"]) <= max_words, tx.strip(text)).otherwise(cut)

    # The text is cut, folded and searched once each.
    return tx.once(F.struct(words.alias("words"), at.alias("at")), lambda read: tx.once(
        F.greatest(center(read) - max_words // 3, F.lit(0)), lambda start: shown(read, start)
    ))
