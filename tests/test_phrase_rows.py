"""A phrase search moves the postings of the rows that hold a phrase's rarest term, and no others."""

from pyspark.sql import functions as F

from lectern.operators import lexical, postings
from lectern.plans.registered.searching import LiveIndex


def _index(spark, texts):
    rows = spark.createDataFrame([(f"e{n:04d}", t) for n, t in enumerate(texts)], "entity_id string, text string")
    return LiveIndex(rows.select(F.lit("section").alias("kind"), "entity_id", F.col("entity_id").alias("paper_id"), F.array("text").alias("match_fields"), F.array().cast("array<string>").alias("extra_fields")))


def test_postings_of_other_rows_are_not_moved(spark, monkeypatch):
    texts = [f"the cat of the house saw dog {n % 9}" + (" rareword of the house" if n % 40 == 3 else "") + (" of the rareword" if n % 120 == 3 else "") for n in range(400)]
    index = _index(spark, texts)
    moved = []
    plain = lexical.merged_positions
    monkeypatch.setattr(lexical, "merged_positions", lambda blocks, asked: moved.append(blocks) or plain(blocks, asked))
    asked = ("rareword of the house", "dog 3 rareword", "the cat of the house", "of the rareword", "house of dog")
    for phrases in (asked[:2], asked):
        parts = [p.split() for p in phrases]
        phrases = spark.createDataFrame([(str(n), None, "", p) for n, p in enumerate(parts)], "query_id string, scope string, phrase string, terms array<string>")
        names = index.placed.select("shard", "row_no", "entity_id")
        hits = lexical.phrase_hits(index, phrases).join(names, ["shard", "row_no"])
        found = {(r["query_id"], r["entity_id"]): (r["tf"], r["dl"]) for r in hits.collect()}
        want = {}
        for n, t in enumerate(texts):
            for q, p in enumerate(parts):
                words = t.split()
                count = sum(words[i : i + len(p)] == p for i in range(len(words)))
                if count:
                    want[(str(q), f"e{n:04d}")] = (count, len(words))
        assert found == want
    # Ten rows of 400 hold the rare word of the first two phrases.
    assert moved[0].agg(F.sum(F.size("rows"))).first()[0] <= 10 * 6


def test_blocks_are_cut_to_the_wanted_rows(spark):
    blocks = spark.createDataFrame(
        [("k", 0, 0, "a", [2, 3, 4], [1, 2, 1], [9, 8, 7], [5, 1, 2, 6], [5, 9, 40]), ("k", 0, 1, "b", [3], [1], [4], [0], [4]), ("k", 1, 0, "a", [0, 1], [1, 1], [2, 3], [0, 1], [0])],
        "kind string, shard int, run int, term string, rows array<int>, tfs array<int>, dls array<int>, positions array<int>, wanted array<int>",
    )
    held = sorted(tuple(r) for r in postings.cut_to_rows(blocks.coalesce(1)).collect())
    assert held == [("k", 0, 0, "a", [5, 4], [2, 1], [8, 7], [1, 2, 6]), ("k", 1, 0, "a", [0], [1], [2], [0])]
    assert blocks.select(postings.row_numbers(F.col("rows")).alias("r")).first()["r"] == [2, 5, 9]
