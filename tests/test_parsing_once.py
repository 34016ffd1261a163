"""Parsing looks closely only at lines with a mark, and counts and cuts texts once."""

from pyspark.sql import functions as F

from lectern.functions import folds
from lectern.functions import text as tx
from lectern.operators import sections
from lectern.sources import tables

LINES = [
    "", "  \t", "plain words only", "# Head", " ## Two ##", "#no", "####### seven", "```", "  ~~~ py", "```x```", "[", " ] ", "\\[", "\\[ x \\]", "y \\]", "$$", "a $$ b $$ c", "x | y",
    "Theorem 1. x", "  LEMMA", "## Definition 2", "theorems", "Proof. y", "**proof** z", "<!-- page: 7 -->", "<!-- page : x -->", "<b>", "a [1] b", "Σ ς ß", "end  ",
]


def _reference(line, flags):
    bare = F.regexp_replace(line, r"^\s+|\s+$", "")
    return sections._bits(flags(line, bare))


def test_events_of_marked_lines_are_those_of_every_line(spark, monkeypatch):
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(LINES)], "n int, line string")
    quick = rows.select("n", sections._heading_events(F.col("line")).alias("h"), sections._block_events(F.col("line")).alias("b")).collect()
    monkeypatch.setattr(sections, "_events", lambda line, mark, flags: _reference(line, flags))
    whole = rows.select("n", sections._heading_events(F.col("line")).alias("h"), sections._block_events(F.col("line")).alias("b")).collect()
    assert sorted(quick) == sorted(whole)
    assert {r["n"]: r["h"] for r in quick}[1] == folds.BLANK


def test_quick_text_functions_equal_their_patterns(spark):
    texts = ["", " a ", "\t\n a b\r\n ", "a  ", " b\u0085", "x \n ", " a", "one two three four five six", " one two three four five ", "É ç ς ß", "abc", "C ² x", "a\x1bb\r\nc\x16"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    got = rows.select(
        "t", tx.strip(F.col("t")).alias("strip"), F.regexp_replace("t", r"^\s+|\s+$", "").alias("strip_"), tx.more_words(F.col("t"), 5).alias("more"), (tables._words(F.col("t")) > 5).alias("more_"),
        tx.fold_marks(F.col("t")).alias("fold"), F.translate(F.lower("t"), *tx._accent_table()).alias("fold_"), tx.casefold(F.col("t")).alias("case"),
        F.translate(F.replace(F.lower("t"), F.lit("ß"), F.lit("ss")), "ς", "σ").alias("case_"),
        sections._lines(F.col("t")).alias("lines"), F.split("t", sections.LINE_END).alias("lines_"), tx.clean_markdown(F.col("t")).alias("clean"),
    ).collect()
    for r in got:
        for name in ("strip", "more", "fold", "case", "lines"):
            assert r[name] == r[f"{name}_"], (name, r["t"])
    assert [r["clean"] for r in got][-1] == "affb\nc—\n"


def test_a_line_is_stripped_once_for_its_events(spark):
    plan = spark.createDataFrame([("x",)], "line string").select(sections._block_events(F.col("line")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") <= 2


def test_a_chunk_counts_a_unit_once(spark):
    rows = spark.createDataFrame([("p", 0, "h", None, None, "a b. c")], "paper_id string, section_order int, heading_path string, page_start int, page_end int, text string")
    chunked = sections.chunk_sections(rows)
    assert [(r["text"], r["token_count"]) for r in chunked.collect()] == [("a b. c", 4)]
    # Pieces are measured against their bounds by the count they came with.
    oversized = [line for line in chunked._jdf.queryExecution().analyzed().toString().split("\n") if "struct(oversized," in line]
    assert oversized and not any("regexp_count(" in line for line in oversized)
