"""End to end: a small corpus is written, searched, read and checked."""

import pytest
from pyspark.sql import functions as F

from lectern.config import ChunkSettings, EmbeddingSettings, Settings
from lectern.operators import quality
from lectern.plans.corpus import Corpus, StaleResult, envelope, snapshot_checks
from lectern.plans.index import IndexWriter
from lectern.plans.ingest import ingest
from lectern.streaming.follow import follow_folder

PAPERS = {
    "one.md": "# Curvature of discrete surfaces\n\n**Authors:** Ann Lee; Bo Ray\n\n## Abstract\n\nWe study curvature flow on meshes.\n\n## 1 Introduction\n\nDiscrete curvature needs care.\n\n### 1.1 Setting\n\n$$\nk = 1 / r\n$$\n\nwhere r is the radius of the circle.\n",
    "two.md": "# Spline fitting with constraints\n\n## Abstract\n\nSplines with tangent constraints.\n\n## Methods\n\nWe fit splines by least squares and curvature penalties.\n",
}
CATALOG = "# Works\n\n| Name | Note | File |\n| --- | --- | --- |\n| Surfaces | zebra topics of meshes | one.md |\n| Splines | zebra fits | two.md |\n\n- unlinked walrus remark\n"


@pytest.fixture(scope="module")
def settings():
    return Settings(chunks=ChunkSettings(30, 5, 80), embedding=EmbeddingSettings(dimensions=64))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory, settings):
    root = tmp_path_factory.mktemp("sources")
    for name, text in PAPERS.items():
        (root / name).write_text(text)
    (root / "catalog.txt").write_text(CATALOG)
    index, report = ingest(spark, str(root), str(root / "catalog.txt"), str(tmp_path_factory.mktemp("index")), 3, settings)
    assert {r["state"]: r["paths"] for r in report.collect()} == {"new": 2}
    return Corpus(index)


def test_papers_and_metadata(corpus):
    rows = {r["paper_id"]: r for r in corpus.index.papers.collect()}
    assert set(rows) == {"surfaces", "splines"}
    assert rows["surfaces"]["authors"] == ["Ann Lee", "Bo Ray"] and rows["surfaces"]["abstract"] == "We study curvature flow on meshes."


def test_exact_search_and_reading(corpus):
    top = corpus.search_papers("radius of the circle", mode="exact", pipeline="bm25").head()
    assert top["paper_id"] == "surfaces" and top["kind"] == "chunk" and top["result_id"].startswith("r3:chunk:")
    shown = corpus.expand_context(top["result_id"]).head()
    assert "k = 1 / r" in shown["text"] and "Discrete curvature" in shown["text"]
    assert "Discrete" not in corpus.expand_context(top["result_id"], "subsection").head()["text"]


def test_modes_and_pipelines_agree_on_the_paper(corpus):
    for mode, pipeline in (("precision", "dense"), ("precision", "hybrid"), ("discovery", "hybrid_rerank")):
        assert corpus.search_papers("tangent constraints splines", mode, 5, pipeline).orderBy("rank").head()["paper_id"] == "splines"


def test_notes_route_to_papers(corpus):
    rows = corpus.search_papers("zebra topics", "discovery", 5, "bm25").orderBy("rank").collect()
    assert rows[0]["paper_id"] == "surfaces" and "zebra" in rows[0]["routing_note"] and "zebra" not in rows[0]["snippet"]
    lone = corpus.search_papers("walrus remark", "discovery", 5, "bm25").head()
    assert lone["kind"] == "curated" and lone["paper_id"] is None


def test_outline_find_related_research(corpus):
    outline = corpus.paper_outline("surfaces").collect()
    assert [r["parent_order"] for r in outline] == [None, 0, 0, 2]
    assert {r["paper_id"] for r in corpus.find_in_paper("splines", "curvature").collect()} == {"splines"}
    assert [r["paper_id"] for r in corpus.related_papers("surfaces").collect()] == ["splines"]
    corpus.model = lambda q: '["least squares"]'
    assert corpus.research_search("tangent fits").orderBy("rank").head()["paper_id"] == "splines"


def test_errors(corpus):
    with pytest.raises(StaleResult):
        corpus.expand_context("r1:chunk:surfaces#c0")
    assert envelope(corpus.paper_outline, "nobody")["error"]["code"] == "not_found"
    assert envelope(corpus.search_papers, " ")["error"]["code"] == "invalid_argument"
    assert envelope(corpus.search_papers, "x", "wrong")["error"]["code"] == "invalid_argument"
    assert envelope(corpus.read_section, "surfaces", 0, max_tokens=True)["error"]["code"] == "invalid_argument"
    assert corpus.status()["counts"]["papers"] == 2


def test_snapshot_is_sound(corpus):
    assert all(r["passed"] for r in quality.readiness(snapshot_checks(corpus.index)).collect())


def test_second_run_changes_only_what_changed(spark, tmp_path, settings):
    root = tmp_path / "s"
    root.mkdir()
    for name, text in PAPERS.items():
        (root / name).write_text(text)
    (root / "copy.md").write_text(PAPERS["one.md"])
    catalog = tmp_path / "catalog.txt"
    catalog.write_text(CATALOG + "- copy.md too\n")
    first, _ = ingest(spark, str(root), str(catalog), str(tmp_path / "index"), 1, settings)
    (root / "two.md").write_text(PAPERS["two.md"] + "\n## New\n\nA fresh walnut paragraph.\n")
    (root / "one.md").unlink()
    second, report = ingest(spark, str(root), str(catalog), str(tmp_path / "index"), 2, settings, previous=first)
    assert {r["state"]: r["paths"] for r in report.collect()} == {"changed": 1, "unchanged": 1, "removed": 1}
    assert Corpus(second).search_papers("walnut", "precision", 3, "bm25").head()["paper_id"] == "splines"
    assert {r["source_path"] for r in second.papers.collect()} == {"copy.md", "two.md"}
    assert first.papers.count() == 2


def test_follow_folder(spark, tmp_path, settings):
    root = tmp_path / "in"
    root.mkdir()
    (root / "one.md").write_text(PAPERS["one.md"])
    query = follow_folder(spark, str(root), str(tmp_path / "out"), str(tmp_path / "progress"), settings.chunks)
    query.processAllAvailable()
    (root / "two.md").write_text(PAPERS["two.md"])
    query.processAllAvailable()
    query.stop()
    rows = spark.read.parquet(str(tmp_path / "out" / "sections"))
    assert rows.select("source_path").distinct().count() == 2 and rows.where("heading = 'Methods'").count() == 1
