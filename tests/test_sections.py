"""Section parser and chunker on literal Markdown."""

import re

import pytest
from pyspark.sql import functions as F

from lectern.config import ChunkSettings
from lectern.functions import folds
from lectern.functions import text as tx
from lectern.operators.sections import chunk_sections, number_chunks, parse_sections


def sections_of(spark, markdown, title="Title"):
    df = spark.createDataFrame([("p", title, markdown)], "paper_id string, title string, markdown string")
    return [r.asDict() for r in parse_sections(df).orderBy("section_order").collect()]


def chunks_of(spark, text, target, low, high, pages=(None, None)):
    df = spark.createDataFrame([("p", 0, "H", *pages, text)], "paper_id string, section_order int, heading_path string, page_start int, page_end int, text string")
    return [r.asDict() for r in number_chunks(chunk_sections(df, ChunkSettings(target, low, high))).orderBy("chunk_index").collect()]


def test_tree_pages_and_fences(spark):
    md = "<!-- page: 1 -->\n# Alpha\nfirst\n<!-- page: 2 -->\n\n## Beta\n$$\n# inside\n$$\n```\n## code\n```\n<!-- page: 3 -->\n## Gamma\nend"
    rows = sections_of(spark, md)
    assert [r["heading_path"] for r in rows] == ["Alpha", "Alpha > Beta", "Alpha > Gamma"]
    assert (rows[0]["page_start"], rows[0]["page_end"]) == (1, 3)
    assert "# inside" in rows[1]["text"] and "## code" in rows[1]["text"]
    assert rows[1]["text"].startswith("<!-- page: 2 -->") and rows[2]["page_start"] == 3


def test_preamble_shifts_parents(spark):
    rows = sections_of(spark, "before\n# One\n## Two\nx", "Doc")
    assert [r["heading"] for r in rows] == ["Doc", "One", "Two"]
    assert [r["parent_order"] for r in rows] == [None, None, 1]


def test_numbered_headings_nest(spark):
    rows = sections_of(spark, "# T\n## 1 A\n## 1.1 B\n## 1.2 C\n## 2 D\n")
    assert [r["parent_order"] for r in rows] == [None, 0, 1, 1, 0]


def test_pages_without_headings(spark):
    rows = sections_of(spark, "<!-- page: 4 -->\none\n<!-- page: 5 -->\ntwo")
    assert [(r["heading"], r["page_start"]) for r in rows] == [("Page 4", 4), ("Page 5", 5)]
    assert sections_of(spark, "plain", "")[0]["heading"] == "Document"


@pytest.mark.parametrize("md", ["", "   \n\n"])
def test_empty_text_has_no_sections(spark, md):
    assert sections_of(spark, md) == []


def test_emphasis_unclosed_fence_and_bare_bracket(spark):
    rows = sections_of(spark, "# **Bold** title\n[\n## math\n]\n## **Next**\n```\n# kept")
    assert [r["heading"] for r in rows] == ["**Bold** title", "Next"]
    assert "# kept" in rows[1]["text"]


def test_equation_keeps_its_prose(spark):
    tail = " ".join(f"word{n}" for n in range(60)) + "."
    rows = chunks_of(spark, f"Intro sentence here.\n\n$$\nx = y\n$$\n\nwhere y is given.\n\n{tail}", 45, 15, 70)
    assert all(part in rows[0]["text"] for part in ("Intro", "x = y", "where y"))


def test_code_and_table_stay_whole(spark):
    code = "```\n" + "\n".join(f"line {n}" for n in range(25)) + "\n```"
    rows = chunks_of(spark, f"{code}\n\na | b\nc | d\n", 20, 8, 30)
    assert sum("line 0" in r["text"] and "line 24" in r["text"] for r in rows) == 1
    assert sum("a | b\nc | d" in r["text"] for r in rows) == 1


def test_long_prose_is_bounded_and_complete(spark):
    words = [f"w{n}" for n in range(130)]
    rows = chunks_of(spark, " ".join(words), 30, 10, 40)
    assert len(rows) >= 3 and all(r["token_count"] <= 40 for r in rows)
    assert " ".join(r["text"] for r in rows).split() == words
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))


def test_theorem_takes_its_proof(spark):
    rows = chunks_of(spark, "Theorem 1. All is one.\n\nProof. Clear.\n\n" + "Other text follows. " * 10, 6, 1, 12)
    assert "Theorem" in rows[0]["text"] and "Proof" in rows[0]["text"]


def test_pages_of_chunks_and_marker_only_sections(spark):
    text = "<!-- page: 7 -->\n" + "one two three four five six seven eight. " * 2 + "\n<!-- page: 8 -->\n" + "nine ten. " * 8
    rows = chunks_of(spark, text, 16, 5, 24, (7, 8))
    assert rows[0]["page_start"] == 7 and rows[-1]["page_end"] == 8
    assert chunks_of(spark, "<!-- page: 3 -->", 10, 2, 20) == []


def test_oversized_atomic_block_is_cut(spark):
    table = "\n".join(f"a{n} | b{n}" for n in range(400))
    rows = chunks_of(spark, table, 20, 5, 30)
    assert len(rows) == 3 and all(r["token_count"] <= 512 for r in rows)
    assert sum(r["token_count"] for r in rows) == 1200


def test_token_estimate(spark):
    row = spark.range(1).select(tx.token_count(F.lit("<!-- page: 2 -->words and symbols $x_i$"))).head()
    assert row[0] == 6


def test_packing_against_simple_loop():
    import random

    rng = random.Random(3)
    for _ in range(200):
        counts = [rng.randint(0, 30) for _ in range(rng.randint(0, 20))]
        groups, current = [], []
        for c in counts:
            if current and sum(current) + c > 40:
                groups.append(current)
                current = []
            current.append(c)
            if sum(current) >= 25:
                groups.append(current)
                current = []
        groups += [current] if current else []
        if len(groups) > 1 and sum(groups[-1]) < 10 and sum(groups[-2] + groups[-1]) <= 40:
            groups[-2:] = [groups[-2] + groups[-1]]
        want = [n for n, g in enumerate(groups) for _ in g]
        assert folds.pack(counts, [0] * len(counts), 25, 40, 10) == want


def test_bounded_pieces_keep_every_token():
    text = "alpha beta gamma. " * 50 + "x" * 30
    pieces = folds.bounded_pieces(text, 17)
    count = lambda t: len(re.findall(r"\w+|[^\w\s]", t))
    assert all(count(p) <= 17 for p in pieces) and sum(map(count, pieces)) == count(text)
