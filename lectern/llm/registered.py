"""The registered queries of this subpackage and their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.llm import classifier, graph, hyperplanes, language, licenses, mixing, neardup, packing, phrases, pieces, quality, secrets, substrings
from lectern.llm.sql import HARD_NEGATIVE_SQL, MIX_SQL, NEAR_DUPLICATE_SQL, PHRASE_SQL
from lectern.sources.tables import table


def op1_perplexity_bands(spark, folder):
    judged = quality.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")


def op2_robust_pruned_graph(spark, folder):
    return graph.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_collinear_chains(spark, folder):
    return substrings.repeated_passages(table(spark, folder, "documents"))


def op4_weighted_fair_queueing(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_license_windows(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


def op6_language_families(spark, folder):
    return language.held_out_languages(table(spark, folder, "documents"))


def op7_secret_forest(spark, folder):
    found = secrets.scan(table(spark, folder, "documents"))
    return found.select("doc_id", "no", F.sha2("value", 256).alias("value_sha256"), "length", "assigned", "coverage", "chance", "is_secret")


def op8_hamming_near_duplicates(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents"))


def op9_random_indexing(spark, folder):
    return classifier.held_out_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_shortest_pack_first(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


def op11_hyperplane_negatives(spark, folder):
    rows = hyperplanes.quantised(table(spark, folder, "embeddings"))
    return hyperplanes.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_hat_trie_phrases(spark, folder):
    return phrases.collocations(table(spark, folder, "documents"))


def op13_backtracking_pieces(spark, folder):
    read = pieces.decode(pieces.encode(table(spark, folder, "documents")))
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return read.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_perplexity_bands": (op1_perplexity_bands, None),
    "op2_robust_pruned_graph": (op2_robust_pruned_graph, None),
    "op3_collinear_chains": (op3_collinear_chains, None),
    "op4_weighted_fair_queueing": (op4_weighted_fair_queueing, MIX_SQL),
    "op5_license_windows": (op5_license_windows, None),
    "op6_language_families": (op6_language_families, None),
    "op7_secret_forest": (op7_secret_forest, None),
    "op8_hamming_near_duplicates": (op8_hamming_near_duplicates, NEAR_DUPLICATE_SQL),
    "op9_random_indexing": (op9_random_indexing, None),
    "op10_shortest_pack_first": (op10_shortest_pack_first, None),
    "op11_hyperplane_negatives": (op11_hyperplane_negatives, HARD_NEGATIVE_SQL),
    "op12_hat_trie_phrases": (op12_hat_trie_phrases, PHRASE_SQL),
    "op13_backtracking_pieces": (op13_backtracking_pieces, None),
}


def llm_queries() -> dict:
    return QUERIES
