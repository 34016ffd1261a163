"""Phrases are found by looking up the places of their rarest term, whatever the other terms' number of places."""

import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lectern.operators import postings


def _blocks(texts, first=0):
    """Posting blocks of one run as the writer codes them."""
    run = postings._Run()
    for n, words in texts:
        run.add(n, len(words), words)
    return run.blocks("k", 0, first).to_pandas()


def test_places_agree_with_a_scan_of_the_texts_also_in_overlapping_blocks():
    random.seed(5)
    texts = [(1024 + n, [random.choice("aaaabbcde") for _ in range(random.randint(1, 30))]) for n in range(60)]
    odd, even = texts[1::2], texts[::2]
    for held in (_blocks(texts), pd.concat([_blocks(odd), _blocks(even)], ignore_index=True)):
        places = postings._Places(held)
        for length in (1, 2, 3, 4):
            for _ in range(40):
                phrase = [random.choice("abcdex") for _ in range(length)]
                counts = {n: sum(w[i : i + length] == phrase for i in range(len(w))) for n, w in texts}
                want = {(n, c, len(dict(texts)[n])) for n, c in counts.items() if c}
                found = places.holding(phrase)
                assert (set() if found is None else set(zip(*(f.tolist() for f in found)))) == want


def test_a_common_term_is_not_sorted_anew_for_every_phrase():
    common = [(n, ["the"] * 999 + [f"rare{n}"]) for n in range(1000)]
    places = postings._Places(_blocks(common))
    began = time.process_time()
    for _ in range(4):
        for n in range(1000):
            rows, counts, lengths = places.holding(["the", "the", f"rare{n}"])
            assert (rows.tolist(), counts.tolist(), lengths.tolist()) == ([n], [1], [1000])
    # Sorting a million places for each of 4,000 phrases takes minutes.
    assert time.process_time() - began < 10


def test_wanted_rows_may_be_bits_of_the_run(spark):
    rows = [("k", 0, 1, "a", [1026, 3, 4], [1, 2, 1], [9, 8, 7], [5, 1, 2, 6], [1029, 1033, 2047])]
    blocks = spark.createDataFrame(rows, "kind string, shard int, run int, term string, rows array<int>, tfs array<int>, dls array<int>, positions array<int>, wanted array<int>")
    bits = blocks.withColumn("wanted", postings.row_bits("wanted"))
    assert bits.select(F.octet_length("wanted")).first()[0] == postings.RUN_ROWS // 8
    assert [tuple(r) for r in postings.cut_to_rows(bits).collect()] == [("k", 0, 1, "a", [1029, 4], [2, 1], [8, 7], [1, 2, 6])]
    assert np.frombuffer(bits.first()["wanted"], np.uint8).any()
