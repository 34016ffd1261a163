"""Cases that once lost rows, ended a job or cut a text."""

import json

import pytest
from pyspark.sql import functions as F

from lectern import cli
from lectern.config import ChunkSettings, EmbeddingSettings, LayoutSettings, Settings
from lectern.functions import text as tx
from lectern.operators import dense, fusion, identity, metadata, quality, sections
from lectern.plans.corpus import Corpus, envelope
from lectern.plans.index import Index, embed_parts
from lectern.plans.ingest import ingest
from lectern.streaming.follow import follow_folder


@pytest.fixture(scope="module")
def settings():
    return Settings(chunks=ChunkSettings(30, 5, 80), embedding=EmbeddingSettings(dimensions=64), layout=LayoutSettings(3, 5, 2))


def column(spark, expression, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in rows.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_slugs_keep_compatibility_forms(spark):
    assert column(spark, tx.slug, "𝐀bc ½ ™ ĳ trade", "ﬁne ﬂow", "Müller  café", "日本") == ["abc-12-tm-ij-trade", "fine-flow", "muller-cafe", ""]


def test_emphasis_is_removed_to_the_last_mark(spark):
    assert column(spark, tx.strip_emphasis, "*" * 14 + "deep" + "*" * 14, "**_`x`_**", "plain", "*open", "", "** a ** b **") == ["deep", "x", "plain", "*open", "", "a ** b"]


def test_metadata_reads_whole_texts_and_odd_digits(spark):
    filler = "word " * 5000
    texts = [f"# T\n{filler} 10.1234/late.doi and 2019 end", "the year 20٢٣ is odd", "in 1987 already"]
    found = column(spark, metadata.text_metadata, *texts)
    assert (found[0]["doi"], found[0]["year"]) == ("10.1234/late.doi", 2019)
    assert found[1]["year"] is None and found[2]["year"] == 1987
    long = column(spark, metadata.abstract_of, f"## Abstract\n\n{'long ' * 4000}end")[0]
    assert long.endswith("end") and len(long) > 12000


def test_fallback_titles(spark):
    assert column(spark, metadata.fallback_title, "a/x3d_model.md", "one-two.md", "été.md") == ["X3D Model", "One Two", "Été"]


def test_a_huge_page_number_does_not_end_the_job(spark):
    papers = spark.createDataFrame([("p", "P", "<!-- page: 99999999999 -->\n\n# Head\n\ntext here\n")], "paper_id string, title string, markdown string")
    assert [r["heading"] for r in sections.parse_sections(papers).collect()] == ["Head"]


def test_whole_documents_are_reranked(spark):
    pool = spark.createDataFrame([("q", "a", "T", "", "filler " * 4000 + "needle", None), ("q", "b", "T", "", "filler " * 4000, None)],
                                 "query_id string, key string, title string, section_path string, text string, routing_note string")
    queries = spark.createDataFrame([("q", "needle")], "query_id string, text string")
    scores = {r["key"]: r["rerank_score"] for r in fusion.lexical_f1(pool, queries, fusion.rerank_document()).collect()}
    assert scores["a"] > scores["b"] == 0


def test_cycles_in_long_chains(spark):
    chain = spark.range(100_000).selectExpr("'long' AS paper_id", "cast(id AS int) AS section_order", "cast(CASE WHEN id > 0 THEN id - 1 END AS int) AS parent_order")
    odd = spark.createDataFrame([("ring", 0, 2), ("ring", 1, 0), ("ring", 2, 1), ("ring", 3, 0), ("ring", 4, None), ("ring", 5, 4), ("gone", 0, 7)],
                                "paper_id string, section_order int, parent_order int")
    found = {(r["paper_id"], r["section_order"]) for r in quality.cyclic_sections(chain.unionByName(odd)).collect()}
    assert found == {("ring", 0), ("ring", 1), ("ring", 2), ("ring", 3), ("gone", 0)}


def test_held_ids_stay_with_their_holder(spark):
    schema = "source_path string, content_hash string, candidate_id string, held_id string"
    rows = spark.createDataFrame([("a/new.md", "aa" * 20, "x", None), ("z/old.md", "bb" * 20, "x", "x"), ("b/two.md", "cc" * 20, "y", None)], schema)
    taken = spark.createDataFrame([("y",), ("y",)], "paper_id string")
    assert {r["source_path"]: r["paper_id"] for r in identity.unique_ids(rows, taken).collect()} == {"a/new.md": "x-aaaaaaaa", "z/old.md": "x", "b/two.md": "y-cccccccc"}


def test_a_second_run_keeps_every_paper(spark, tmp_path, settings):
    root = tmp_path / "s"
    (root / "a").mkdir(parents=True)
    (root / "b").mkdir()
    (root / "a" / "spline-notes.md").write_text("# First title here\n\nAlpha walrus text.\n")
    first, _ = ingest(spark, str(root), None, str(tmp_path / "index"), 1, settings)
    (root / "b" / "spline-notes.md").write_text("# Second title here\n\nBeta walnut text.\n")
    second, _ = ingest(spark, str(root), None, str(tmp_path / "index"), 2, settings, previous=first)
    ids = {r["source_path"]: r["paper_id"] for r in second.papers.collect()}
    assert ids["a/spline-notes.md"] == "spline-notes" and ids["b/spline-notes.md"].startswith("spline-notes-")
    assert second.sections.select("paper_id").distinct().count() == 2
    assert second.entities.groupBy("kind", "entity_id").count().where("count > 1").isEmpty()
    found = Corpus(second).search_papers("walnut", "precision", 3, "bm25").collect()
    assert [r["paper_id"] for r in found] == [ids["b/spline-notes.md"]]
    reopened = Index.open(spark, str(tmp_path / "index"), 2)
    assert reopened.settings == settings and reopened.buckets == 3


def test_headings_without_text_show_what_lies_below(spark, tmp_path, settings):
    root = tmp_path / "s"
    root.mkdir()
    (root / "one.md").write_text("# Some paper about nothing\n\nIntro words.\n\n## Zebra methods\n\n### Details\n\nStripes are counted here.\n")
    index, _ = ingest(spark, str(root), None, str(tmp_path / "index"), 1, settings)
    rows = Corpus(index).search_papers("zebra methods", "discovery", 5, "bm25").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    bare = [r for r in rows if r["kind"] == "section" and r["section_path"].endswith("Zebra methods")]
    assert bare and "Stripes are counted" in bare[0]["snippet"]


def test_limits_are_errors_and_not_clamps(spark, tmp_path, settings):
    root = tmp_path / "s"
    root.mkdir()
    (root / "one.md").write_text("# A title of it\n\nSome text.\n")
    corpus = Corpus(ingest(spark, str(root), None, str(tmp_path / "index"), 1, settings)[0])
    assert envelope(corpus.search_papers, "text", top_k=21)["error"]["code"] == "invalid_argument"
    assert envelope(corpus.read_section, "one", 0, max_tokens=12001)["error"]["code"] == "invalid_argument"
    asked = tmp_path / "q.json"
    asked.write_text(json.dumps([{"query": "some text", "relevant_papers": ["one"], "mode": "exact"}, {"query": "title of", "relevant_papers": ["one"]}]))
    assert cli.main(["--index", str(tmp_path / "index"), "--revision", "1", "evaluate", str(asked)]) == 0
    asked.write_text(json.dumps([{"query": "some text", "relevant_papers": ["one"], "mode": "nonsense"}]))
    assert cli.main(["--index", str(tmp_path / "index"), "--revision", "1", "evaluate", str(asked)]) == 2


def test_streams_keep_files_of_one_name_apart(spark, tmp_path, settings):
    root = tmp_path / "in"
    for folder, word in (("a", "Apple"), ("b", "Birch")):
        (root / folder).mkdir(parents=True)
        (root / folder / "notes.md").write_text(f"# {word}\n\n{word} text.\n")
    query = follow_folder(spark, str(root), str(tmp_path / "out"), str(tmp_path / "progress"), settings.chunks)
    query.processAllAvailable()
    query.stop()
    rows = spark.read.parquet(str(tmp_path / "out" / "sections")).collect()
    assert sorted((r["source_path"][0], r["heading"]) for r in rows) == [("a", "Apple"), ("b", "Birch")]
    chunks = spark.read.parquet(str(tmp_path / "out" / "chunks")).collect()
    assert sorted((r["source_path"][0], "Apple" in r["text"]) for r in chunks) == [("a", True), ("b", False)]


def test_parts_of_one_place_are_embedded_in_order_of_id(spark):
    def parts(order):
        rows = [("p", (3, 7, i), t) for i, t in order]
        return spark.createDataFrame(rows, "paper_id string, place struct<part:int,n:int,id:string>, text string")

    one = embed_parts(parts([("a", "red green"), ("b", "blue grey"), ("c", "pink")]), 64).head()["vector"]
    two = embed_parts(parts([("c", "pink"), ("b", "blue grey"), ("a", "red green")]).repartition(3), 64).head()["vector"]
    assert one == two


def test_scanned_pages_are_harmless(spark):
    text = "a $$ b\n[\n\\begin{x}\r\n# Head\n\n  ```\nTheorem 1\n<!-- Page: 3 -->\n\\[ y"
    rows = spark.createDataFrame([(4, text), (5, "")], "page int, t string")
    found = [r["v"] for r in rows.select("page", tx.scanned_page(F.col("t"), F.col("page")).alias("v")).orderBy("page").collect()]
    assert found[0] == "# OCR page 4\n\na $ $ b\nOCR symbol: [\nbegin{x}\nOCR text: # Head\n\nOCR text: ```\nOCR text: Theorem 1\nOCR text: <!-- Page: 3 -->\n[ y"
    assert found[1] == "# OCR page 5"


def test_vector_upsert_guards(spark):
    schema = "kind string, entity_id string, paper_id string, vector array<double>, model_name string, model_fingerprint string, dimensions int, normalized boolean, created_at timestamp, updated_at timestamp"
    stored = spark.createDataFrame([("paper", "a", "a", [1.0, 0.0], "m", "f", 2, True, None, None)], schema)

    def rows(*given):
        return spark.createDataFrame([(k, e, e, v) for k, e, v in given], "kind string, entity_id string, paper_id string, vector array<double>")

    merged = {r["entity_id"]: r["vector"] for r in dense.upsert_vectors(stored, rows(("paper", "a", [0.0, 2.0]), ("chunk", "b", [3.0, 4.0])), "m", "f").collect()}
    assert merged == {"a": [0.0, 1.0], "b": [0.6, 0.8]}
    for bad, model in ((rows(("paper", "a", [1.0]), ("paper", "b", [1.0, 2.0])), "m"), (rows(("paper", "a", [1.0])), "m"), (rows(("paper", "a", [1.0, 1.0])), "other"), (rows(("odd", "a", [1.0, 1.0])), "m")):
        with pytest.raises(ValueError):
            dense.upsert_vectors(stored, bad, model, "f")
    assert dense.upsert_vectors(stored, rows(), "m", "f").count() == 1
