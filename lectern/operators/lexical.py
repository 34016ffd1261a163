"""BM25 over written postings, with phrases, field restriction and paper scope.

Posting blocks are made once at ingest.  A search reads the blocks of its terms, in just
their buckets, and every shard answers with the best rows of each query; document
frequencies and lengths come with the index, so no search scans the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators.postings import GONE, RUN_ROWS, best_of_shards, cut_to_rows, merged_positions, posting_blocks, row_bits, row_numbers, shard_of
from lectern.session import broadcast_if_small, settle

# BM25 constants and the floor for terms in over half of the rows.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
SCORE_DIGITS = 9
# Queries that meet a shard in one task: at most the first, and no fewer than the second only to give every core some work.
QUERY_PART, LEAST_PART = 32768, 2048


def tokenized(entities: DataFrame) -> DataFrame:
    """Add the index tokens of the matchable fields and the length over all fields.

    ``match_fields`` and ``extra_fields`` are arrays; an empty token parts fields so
    that no phrase spans two of them.  Tokens are joined by blanks, which none holds: one text
    takes a fraction of the room of an array of them.
    """
    per_field = F.transform("match_fields", lambda f: F.concat(tx.index_tokens(f), F.array(F.lit(""))))
    extra = F.aggregate("extra_fields", F.lit(0), lambda n, f: n + F.size(tx.index_tokens(f)))
    tokens = F.flatten(per_field)
    return (
        entities.withColumn("tokens", tokens)
        .withColumn("dl", F.size("tokens") - F.size("match_fields") + extra)
        .withColumn("tokens", F.array_join("tokens", " "))
        .drop("match_fields", "extra_fields")
    )


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(entities: DataFrame, buckets: int, dealt: bool = False) -> DataFrame:
    """Posting blocks of numbered entities, with the bucket of their term and the number of rows."""
    blocks = posting_blocks(entities, dealt)
    return blocks.select("*", F.size("rows").cast("long").alias("n"), term_bucket(F.col("term"), buckets).alias("bucket"))


def level_stats(entities: DataFrame) -> DataFrame:
    return entities.groupBy("kind").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_stats(posting_rows: DataFrame) -> DataFrame:
    return posting_rows.groupBy("kind", "bucket", "term").agg(F.sum("n").alias("df"))


def idf(n: Column, df: Column) -> Column:
    value = F.ln((n - df + 0.5) / (df + 0.5))
    return F.when(value <= 0, F.lit(IDF_FLOOR)).otherwise(value)


def saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def query_terms(queries: DataFrame, exact: bool) -> DataFrame:
    """One row per query phrase: ``(query_id, scope, phrase, terms)``.

    A loose query has one phrase per distinct folded token, an exact query just one.
    """
    if exact:
        whole = queries.select("query_id", "scope", F.lit("").alias("phrase"), tx.index_tokens(F.col("text")).alias("terms"))
        return whole.where(F.size("terms") > 0)
    return phrase_terms(queries.select("query_id", "scope", F.explode(tx.query_words(F.col("text"))).alias("phrase")))


def phrase_terms(words: DataFrame) -> DataFrame:
    return words.withColumn("terms", tx.index_tokens(F.col("phrase"))).where(F.size("terms") > 0)


def _plain_saturation(tf, dl, avgdl):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _weighted_terms(index, words: DataFrame) -> DataFrame:
    """``query_id, scope, kind, bucket, term, avgdl, weight``: the asked terms that occur, with their idf."""
    placed = words.withColumn("bucket", term_bucket(F.col("term"), index.buckets))
    # A frequency may come in parts, which add up; two words of a query may be one term.
    known = index.terms.join(placed.select("bucket", "term").distinct(), ["bucket", "term"]).groupBy("kind", "bucket", "term").agg(F.sum("df").alias("df")).where("df > 0")
    return (
        placed.join(known, ["bucket", "term"])
        .join(F.broadcast(index.levels), "kind")
        .select("query_id", "scope", "kind", "bucket", "term", "avgdl", idf(F.col("n"), F.col("df")).alias("weight"))
    )


def _blocks_in(index, buckets: DataFrame) -> DataFrame:
    """Posting blocks of the given buckets, which are at most those of the layout."""
    wanted = [r["bucket"] for r in buckets.select("bucket").distinct().collect()]
    return index.postings.where(F.col("bucket").isin(wanted))


def phrase_hits(index, phrases: DataFrame) -> DataFrame:
    """``query_id, phrase, kind, shard, row_no, tf, dl``: entities holding a whole phrase.

    Only the rows that hold a phrase's rarest term are looked at. Posting blocks are cut to these rows
    where they lie, so postings of other rows are not moved however common a term is.
    """
    known = (
        phrases.withColumn("term", F.explode(F.array_distinct("terms")))
        .withColumn("bucket", term_bucket(F.col("term"), index.buckets))
        .join(index.terms, ["bucket", "term"])
        .groupBy("query_id", "phrase", "kind", "term")
        .agg(F.first("terms").alias("terms"), F.sum("df").alias("df")).where("df > 0")
        .groupBy("query_id", "phrase", "kind")
        .agg(F.first("terms").alias("terms"), F.count("*").alias("known"), F.min_by("term", F.struct("df", "term")).alias("term"))
        .where(F.col("known") == F.size(F.array_distinct("terms")))
        .select("query_id", "phrase", "kind", "terms", "term", term_bucket(F.col("term"), index.buckets).alias("bucket"))
    )
    rare = broadcast_if_small(known)
    runs = _blocks_in(index, rare).select("kind", "bucket", "term", "shard", "run", "rows").join(rare, ["kind", "bucket", "term"])
    runs = settle(runs.select("query_id", "phrase", "terms", "kind", "shard", "run", "rows"))
    # A term may have several blocks in a run.
    asked = runs.drop("rows").dropDuplicates(["query_id", "phrase", "kind", "shard", "run"])
    held = runs.select("kind", "shard", "run", F.explode(row_numbers(F.col("rows"))).alias("row_no"))
    # At most the rows of a run.
    wanted = held.groupBy("kind", "shard", "run").agg(F.collect_set("row_no").alias("wanted"))
    wanted = broadcast_if_small(wanted.select("kind", "shard", "run", row_bits("wanted").alias("wanted")))
    needed = rare.select("kind", F.explode("terms").alias("term")).distinct().withColumn("bucket", term_bucket(F.col("term"), index.buckets))
    needed = broadcast_if_small(needed)
    blocks = _blocks_in(index, needed).join(needed, ["kind", "bucket", "term"]).join(wanted, ["kind", "shard", "run"])
    hits = merged_positions(cut_to_rows(blocks), asked)
    return hits if index.dead is None else hits.join(index.dead, ["kind", "shard", "row_no"], "left_anti").select(*hits.columns)


def _weighted_phrases(index, hits: DataFrame) -> DataFrame:
    """Each phrase of a query with the idf of the phrase in each level."""
    frequency = hits.groupBy("query_id", "phrase", "kind").agg(F.count("*").alias("df"))
    return frequency.join(F.broadcast(index.levels), "kind").select("query_id", "phrase", "kind", "avgdl", idf(F.col("n"), F.col("df")).alias("weight"))


def with_ids(index, rows: DataFrame) -> DataFrame:
    """``rows`` with the ids of their entities; only id columns are read."""
    names = index.placed.select("kind", "shard", "row_no", "entity_id", "paper_id")
    shards = [r["shard"] for r in rows.select("shard").distinct().collect()]
    return names.where(F.col("shard").isin(shards)).join(broadcast_if_small(rows), ["kind", "shard", "row_no"]).drop("row_no")


def _allowed_rows(index, scopes: DataFrame) -> DataFrame:
    """``scope, kind, shard, allowed``: the rows of each scoped paper, at most those of a shard."""
    inside = index.placed.select("kind", "shard", "row_no", F.col("paper_id").alias("scope"))
    return inside.join(broadcast_if_small(scopes), "scope").groupBy("scope", "kind", "shard").agg(F.collect_list("row_no").alias("allowed"))


def entity_key(kind: Column, entity_id: Column) -> Column:
    return F.concat_ws(":", kind, entity_id)


def top_per_list(hits: DataFrame, limit: int) -> DataFrame:
    """Rank per query and level by score, ties by key; at most ``limit`` rows each."""
    order = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), F.asc("key"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _as_blocks(rows: DataFrame) -> DataFrame:
    """Posting blocks of rows ``(kind, shard, term, row_no, tf, dl)``."""
    run = F.floor(F.col("row_no") / RUN_ROWS)
    gathered = rows.groupBy("kind", "shard", "term", run.alias("run")).agg(F.array_sort(F.collect_list(F.struct("row_no", "tf", "dl"))).alias("held"))
    steps = F.transform("held", lambda h, i: h["row_no"] - F.when(i == 0, 0).otherwise(F.get("held.row_no", i - 1)))
    return gathered.select(
        "kind", "shard", "term", F.array_min("held.row_no").alias("first_row"), F.array_max("held.row_no").alias("last_row"),
        steps.alias("rows"), F.col("held.tf").alias("tfs"), F.col("held.dl").alias("dls"), F.array_max("held.tf").alias("max_tf"), F.array_min("held.dl").alias("min_dl"),
    )


def best_of_all(found: DataFrame, limit: int | None) -> DataFrame:
    """Rows of all shards that may be among the best ``limit`` of a query and level, with those that tie with the last.

    So ids are fetched for about as many rows as are wanted, however many shards gave some.
    """
    if limit is None:
        return found
    order = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"))
    return found.withColumn("_n", F.rank().over(order)).where(F.col("_n") <= limit).drop("_n")


def query_parts(queries: int, shards: int, cores: int) -> int:
    """Parts that the queries are dealt to; the blocks of a shard are sent once for each of them."""
    spread = min(-(-queries // LEAST_PART), -(-4 * cores // shards))
    return max(1, -(-queries // QUERY_PART), spread)


def score_phrases(scoped, phrases: DataFrame, limit: int | None = None) -> DataFrame:
    """BM25 of the entities that hold at least one phrase of a query.

    With a ``limit`` every shard gives at most so many rows to a query and level, the best ones.
    """
    words = phrases.where(F.size("terms") == 1).select("query_id", "scope", F.get("terms", F.lit(0)).alias("term"))
    weighted = settle(_weighted_terms(scoped, words))
    blocks = _blocks_in(scoped, weighted).join(broadcast_if_small(weighted.select("kind", "bucket", "term").distinct()), ["kind", "bucket", "term"])
    columns = ["kind", "shard", "term", "first_row", "last_row", "rows", "tfs", "dls", "max_tf", "min_dl"]
    blocks, terms = blocks.select(*columns), weighted.drop("bucket")
    joined = phrases.where(F.size("terms") > 1)
    if not joined.isEmpty():
        # A phrase of several tokens is a term of its query alone, with the postings just found.
        hits = settle(phrase_hits(scoped, joined).withColumn("term", F.concat_ws("\x1f", F.lit(""), "query_id", "phrase")))
        named = _weighted_phrases(scoped, hits).withColumn("term", F.concat_ws("\x1f", F.lit(""), "query_id", "phrase"))
        terms = terms.unionByName(named.join(joined.select("query_id", "scope").distinct(), "query_id").select(*terms.columns))
        blocks = blocks.unionByName(_as_blocks(hits))
    terms = settle(terms)
    parts = query_parts(terms.select("query_id").distinct().count(), scoped.all_shards, terms.sparkSession.sparkContext.defaultParallelism)
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
    # A query's terms are bounded by its text.
    nested = terms.groupBy("query_id", "scope", "kind").agg(F.collect_list(F.struct("term", "weight")).alias("terms"), F.first("avgdl").alias("avgdl")).withColumn("part", part)
    free = nested.where(F.col("scope").isNull()).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(scoped.all_shards - 1))).alias("shard"), F.lit(None).cast("array<int>").alias("allowed")
    )
    asked, scopes = free, nested.where(F.col("scope").isNotNull()).select("scope").distinct()
    if not scopes.isEmpty():
        # Scoped queries go only to the shards that hold rows of their paper.
        asked = free.unionByName(nested.join(_allowed_rows(scoped, scopes), ["scope", "kind"]).select(*free.columns))
    dealt = blocks
    if parts > 1:
        dealt = blocks.join(terms.select("kind", "term", part.alias("part")).distinct(), ["kind", "term"])
    else:
        dealt = blocks.withColumn("part", F.lit(0))
    if scoped.dead is not None:
        gone = _as_blocks(scoped.dead.select("*", F.lit(GONE).alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("dl")))
        dealt = dealt.unionByName(gone.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(*dealt.columns))
    found = settle(best_of_all(best_of_shards(dealt, asked, limit, _plain_saturation, SCORE_DIGITS), limit))
    # Rounding makes the order independent of the order in which parts were added.
    return with_ids(scoped, found).select(
        "query_id", "kind", "entity_id", "paper_id", F.round("score", SCORE_DIGITS).alias("score"), entity_key(F.col("kind"), F.col("entity_id")).alias("key")
    )


def search_lexical(index, queries: DataFrame, kinds, limit: int, exact: bool = False) -> DataFrame:
    """Best ``limit`` entities per query and level.

    ``queries`` has ``(query_id, text, scope)``; a scope keeps one paper's rows while
    all statistics stay those of the whole corpus.
    """
    scoped = index.only(kinds)
    if not exact:
        return top_per_list(score_phrases(scoped, query_terms(queries, exact), limit), limit)
    scored = settle(score_phrases(scoped, query_terms(queries, exact)))
    # A row whose text holds the query itself gains 1; rows that this cannot bring among the best need no text.
    order = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"))
    last = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") == limit).select("query_id", "kind", F.col("score").alias("last"))
    fetched = scored.join(last, ["query_id", "kind"], "left").where(F.col("last").isNull() | (F.col("score") + 1 >= F.col("last"))).drop("last")
    fetched = broadcast_if_small(fetched.withColumn("entity_bucket", shard_of(F.col("entity_id"), scoped.shards)))
    buckets = [r["entity_bucket"] for r in fetched.select("entity_bucket").distinct().collect()]
    # Texts that are not asked for stay where they are also when the rows are too many to be broadcast.
    keys = broadcast_if_small(fetched.select("kind", "entity_bucket", "entity_id").distinct())
    shown = scoped.entities.where(F.col("entity_bucket").isin(buckets)).join(keys, ["kind", "entity_bucket", "entity_id"], "left_semi").select("kind", "entity_bucket", "entity_id", "title", "section_path", F.col("text").alias("body"))
    own_text = F.concat_ws("\n", F.when(F.col("kind") == "paper", F.col("title")).otherwise(F.col("section_path")), F.col("body"))
    bonus = F.when(F.contains(tx.casefold(own_text), tx.casefold(F.col("text"))), 1.0).otherwise(0.0)
    boosted = (
        fetched.join(shown, ["kind", "entity_bucket", "entity_id"])
        .join(queries.select("query_id", "text"), "query_id")
        .withColumn("score", F.col("score") + bonus)
        .select("query_id", "kind", "entity_id", "paper_id", "score", "key")
    )
    return top_per_list(boosted, limit)
