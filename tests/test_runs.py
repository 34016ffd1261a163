"""Runs over sources that fail, change or are missing: the rest is indexed and the last good data stays."""

import os

import pytest
from pyspark.sql import functions as F

from lectern.config import ChunkSettings, EmbeddingSettings, LayoutSettings, Settings
from lectern.plans import ingest as runs
from lectern.plans.index import Index
from lectern.sources.listing import FilesReader, list_files, read_files

SETTINGS = Settings(chunks=ChunkSettings(30, 5, 80), embedding=EmbeddingSettings(dimensions=16), layout=LayoutSettings(1, 1, 1))
TEXT = "# {0}\n\n## Method\n\n{0} evidence.\n"


def sources(folder, *names):
    folder.mkdir(exist_ok=True)
    for name in names:
        (folder / name).write_text(TEXT.format(name.split(".")[0].upper()))
    return folder


def run(spark, root, target, revision, previous=None, **more):
    return runs.ingest(spark, str(root), None, str(target), revision, SETTINGS, previous, **more)


def state(index):
    return {r["source_path"]: r["content_hash"] for r in index.papers.collect()}, {r["source_path"]: (r["stage"], r["error"]) for r in index.table("failures").collect()}


def test_listing_follows_links_once_and_collects_errors(spark, tmp_path):
    root = sources(tmp_path / "s", "one.md", "TWO.MD", "three.txt")
    sources(root / "deep", "four.md")
    outside = sources(tmp_path / "elsewhere", "five.md")
    os.symlink(root / "one.md", root / "deep" / "again.md")
    os.symlink(root / "deep", root / "linked")
    os.symlink(root, root / "deep" / "round")
    os.symlink(outside / "five.md", root / "five.md")
    os.symlink(root / "gone.md", root / "dangling.md")
    rows = list_files(spark, str(root)).collect()
    assert {r["source_path"] for r in rows if r["error"] is None} == {"one.md", "TWO.MD", "deep/four.md"}
    assert {r["source_path"].split("/")[-1] for r in rows if r["error"]} == {"dangling.md"}
    assert all(r["length"] > 0 and r["modified"] > 0 for r in rows if r["error"] is None)
    files = list_files(spark, str(root)).where("error IS NULL")
    (root / "TWO.MD").unlink()
    held = {r["source_path"]: (r["content"], r["error"]) for r in read_files(files.unionByName(spark.createDataFrame([("lost.md", str(root / "lost.md"), 0.0, 0, None)], files.schema))).collect()}
    assert held["one.md"][0] == (root / "one.md").read_bytes() and held["lost.md"][0] is None and "FileNotFoundError" in held["lost.md"][1]


def test_wide_trees_are_dealt_to_parts(tmp_path):
    root = tmp_path / "s"
    for n in range(90):
        (root / f"d{n}").mkdir(parents=True)
        (root / f"d{n}" / "x.md").write_text("x")
    reader = FilesReader(str(root), (".md",))
    parts = reader.partitions()
    assert len(parts) > 60
    assert len({row[0] for part in parts for row in reader.read(part)}) == 90


def test_a_missing_root_is_an_error_and_retires_nothing(spark, tmp_path):
    root = sources(tmp_path / "s", "one.md")
    first, _ = run(spark, root, tmp_path / "i", 1)
    root.rename(tmp_path / "offline")
    with pytest.raises(Exception, match="missing or unreadable"):
        run(spark, root, tmp_path / "i", 2, first)
    assert Index.open(spark, str(tmp_path / "i"), 1).papers.count() == 1


def test_bad_sources_cost_only_themselves(spark, tmp_path):
    """An emptied source and one that cannot be read are failures, keep their last good paper, and recover."""
    root = sources(tmp_path / "s", "x.md", "y.md", "z.md")
    first, _ = run(spark, root, tmp_path / "i", 1)
    papers, failures = state(first)
    assert set(papers) == {"x.md", "y.md", "z.md"} and failures == {}
    before = (root / "x.md").read_bytes()
    (root / "x.md").write_text("")
    (root / "y.md").unlink()
    os.symlink(root / "nowhere", root / "y.md")
    sources(root, "new.md")
    (root / "blank.md").write_text(" \n<!-- nothing -->\n")
    second, report = run(spark, root, tmp_path / "i", 2, first)
    now, failures = state(second)
    assert now.keys() == {"x.md", "y.md", "z.md", "new.md"} and {p: now[p] for p in papers} == papers
    assert failures["x.md"] == ("parse", "no readable text") and failures["blank.md"][0] == "parse" and failures["y.md"][0] == "scan" and len(failures) == 3
    assert {r["state"]: r["paths"] for r in report.collect()}["failed"] == 2
    assert second.only(("chunk",)).entities.where(F.col("text").contains("Y evidence")).count() == 1
    (root / "x.md").write_bytes(before)
    (root / "y.md").unlink()
    sources(root, "y.md")
    (root / "blank.md").unlink()
    third, _ = run(spark, root, tmp_path / "i", 3, second)
    assert state(third) == (now, {})


def test_an_incomplete_scan_retires_nothing(spark, tmp_path):
    """The scan's own errors say that it was incomplete; nobody has to tell the run."""
    root = sources(tmp_path / "s", "one.md", "two.md")
    first, _ = run(spark, root, tmp_path / "i", 1)
    (root / "two.md").unlink()
    os.symlink(root / "no-such-folder", root / "sub")
    second, report = run(spark, root, tmp_path / "i", 2, first)
    assert {r["state"]: r["paths"] for r in report.collect()} == {"unchanged": 1, "kept": 1}
    assert set(state(second)[0]) == {"one.md", "two.md"} and state(second)[1]["sub"][0] == "scan"
    (root / "sub").unlink()
    third, _ = run(spark, root, tmp_path / "i", 3, second)
    assert set(state(third)[0]) == {"one.md"} and state(third)[1] == {}


def test_a_source_that_changes_during_the_run_keeps_its_last_good_data(spark, tmp_path, monkeypatch):
    root = sources(tmp_path / "s", "one.md", "two.md")
    first, _ = run(spark, root, tmp_path / "i", 1)
    papers, _ = state(first)
    (root / "one.md").write_text("# One\n\nA second text.\n")
    (root / "two.md").write_text("# Two\n\nA second text of two.\n")
    real, calls = runs.changed_since, []

    def moving(scan):
        if not calls:
            (root / "one.md").write_text("# One\n\nA third text, written while the run went on.\n")
        calls.append(1)
        return real(scan)

    monkeypatch.setattr(runs, "changed_since", moving)
    second, _ = run(spark, root, tmp_path / "i", 2, first)
    now, failures = state(second)
    assert len(calls) == 2 and now["one.md"] == papers["one.md"] and now["two.md"] != papers["two.md"]
    assert failures == {"one.md": ("verify", "the file changed while it was read")}
    assert Index.open(spark, str(tmp_path / "i"), 2).root == second.root
    # The next run reads what it has become.
    third, _ = run(spark, root, tmp_path / "i", 3, second)
    assert state(third)[0]["one.md"] != papers["one.md"] and state(third)[1] == {}


def test_a_run_that_never_settles_commits_nothing(spark, tmp_path, monkeypatch):
    root = sources(tmp_path / "s", "one.md")
    monkeypatch.setattr(runs, "changed_since", lambda scan: scan.listing.sparkSession.createDataFrame([("one.md",)], "source_path string"))
    with pytest.raises(RuntimeError, match="kept changing"):
        run(spark, root, tmp_path / "i", 1, attempts=1)
    assert not (tmp_path / "i" / "committed").exists() and not (tmp_path / "i" / "rev=1").exists()


def test_a_row_of_several_files_links_each_paper(spark, tmp_path):
    root = sources(tmp_path / "s", "a.md", "b.md")
    (root / "copy.md").write_bytes((root / "b.md").read_bytes())
    (tmp_path / "catalog.txt").write_text("# Works\n\n| Name | Note | File |\n| --- | --- | --- |\n| combo | shared walrus note | a.md; b.md; copy.md |\n")
    index, _ = runs.ingest(spark, str(root), str(tmp_path / "catalog.txt"), str(tmp_path / "i"), 1, SETTINGS)
    assert {r["source_path"]: r["paper_id"] for r in index.papers.collect()} == {"a.md": "a", "b.md": "b"}
    assert {r["paper_id"] for r in index.links.collect()} == {"a", "b"}
