"""Identity, catalog, hierarchy, incremental and integrity operators on literals."""

import pytest
from pyspark.sql import functions as F

from lectern.config import ChunkSettings, RetrievalSettings, Settings, load_settings
from lectern.functions import text as tx
from lectern.operators import catalog, digests, entities, expansion, hierarchy, identity, incremental, metadata, quality
from lectern.operators.ranking import blocked_carry, blocked_row_number, blocked_running_sum
from lectern.sources import files


def values(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column(F.col("t"))).collect()]


def test_slugs(spark):
    assert values(spark, tx.slug, "Élan vital – x²", "ﬁne", "--") == ["elan-vital-x2", "fine", ""]
    assert values(spark, tx.record_slug, "[Name](http://x) `one`") == ["name-one"]
    assert values(spark, tx.stem, "a/b.tar.gz", ".hidden", "x") == ["b.tar", ".hidden", "x"]
    assert values(spark, tx.artifact_path, r".\a\b.md", "././x.pdf") == ["a/b.md", "x.pdf"]


def test_authors(spark):
    assert values(spark, tx.split_authors, "Ann Lee and Bo Ray; Cy Fox", "Ann Lee, Bo Ray", "Lee, Ann", None) == [["Ann Lee", "Bo Ray", "Cy Fox"], ["Ann Lee", "Bo Ray"], ["Lee, Ann"], []]


def test_paper_ids(spark):
    schema = "source string, catalog string, title string, authors array<string>, year int, hash string"
    rows = [("x/main.pdf", "Cat ID", "T", [], None, "ab" * 32), ("x/nice-name.pdf", None, "T", ["A B"], 2001, "ab" * 32),
            ("x/paper.pdf", None, "On Things", ["Lovelace, Ada"], 1843, "ab" * 32), ("x/1234.pdf", None, "", [], None, "ab" * 32)]
    got = spark.createDataFrame(rows, schema).select(identity.stable_id(F.col("source"), F.col("catalog"), F.col("title"), F.col("authors"), F.col("year"), F.col("hash")))
    assert [r[0] for r in got.collect()] == ["cat-id", "nice-name", "lovelace-1843-on-things", "paper-" + "ab" * 6]


def test_colliding_ids_get_a_suffix(spark):
    rows = spark.createDataFrame([("a", "s", "1" * 64), ("b", "s", "2" * 64), ("c", "t", "3" * 64)], "source_path string, candidate_id string, content_hash string")
    taken = spark.createDataFrame([("t",)], "paper_id string")
    assert {r["source_path"]: r["paper_id"] for r in identity.unique_ids(rows, taken).collect()} == {"a": "s", "b": "s-22222222", "c": "t-33333333"}


def test_dedup_prefers_shallow_paths(spark):
    rows = spark.createDataFrame([("deep/er/a.md", "h1"), ("B.md", "h1"), ("a/z.md", "h1"), ("q.md", "h2")], "source_path string, content_hash string").withColumn("source_kind", F.lit("pdf"))
    assert sorted(r["source_path"] for r in identity.deduplicate(rows).collect()) == ["B.md", "q.md"]
    assert {r["source_path"]: r["canonical_path"] for r in identity.alias_rows(rows).collect()} == {"deep/er/a.md": "B.md", "a/z.md": "B.md"}


CATALOG = """# Index
## Part
| Name | Note | File |
| --- | --- | --- |
| Alpha | a \\| b | `x/alpha.pdf` |
| Beta |  | |
text
- see x/alpha.pdf
  for more
- plain note

| Title | File |
|---|---|
| Later | alpha2.md |
"""


def test_catalog(spark):
    lines = spark.createDataFrame([("c", n, t) for n, t in enumerate(CATALOG.split("\n"), 1)], "catalog_id string, line_no bigint, line string")
    rows = catalog.parse_catalog(lines).orderBy("line_no").collect()
    assert [(r["line_no"], r["entry_type"], r["record_id"], r["artifacts"]) for r in rows] == [
        (5, "table_row", "alpha", ["x/alpha.pdf"]), (6, "table_row", "beta", []), (8, "bullet", None, ["x/alpha.pdf"]), (10, "bullet", None, []), (14, "table_row", "alpha2", ["alpha2.md"]),
    ]
    assert all(r["heading_path"] == "Index > Part" for r in rows)
    assert "see x/alpha.pdf for more" in rows[2]["text"] and "note: a \\| b" in rows[0]["text"]
    entries = catalog.parse_catalog(lines)
    known = spark.createDataFrame([("X/Alpha.pdf",), ("y/alpha2.md",), ("z/alpha2.md",)], "source_path string")
    aliases = {r["alias"]: r["paper_id"] for r in catalog.publish_aliases(catalog.artifact_ids(entries), known).collect()}
    assert aliases["X/Alpha.pdf"] == "alpha" and aliases["alpha.pdf"] == "alpha" and "alpha2.md" not in aliases
    links = {(r["line_no"], r["paper_id"]) for r in catalog.link_entries(entries, catalog.publish_aliases(catalog.artifact_ids(entries), known)).collect()}
    assert links == {(5, "alpha"), (8, "alpha")}


def test_match_order(spark):
    refs = spark.createDataFrame([("a/one.md",), ("A/Two.md",), ("three.md",), ("four.md",)], "artifact string")
    known = spark.createDataFrame([("a/one.md",), ("a/two.md",), ("q/three.md",), ("p/four.md",), ("r/four.md",)], "source_path string")
    got = {r["source_path"]: r["artifact"] for r in catalog.match_artifacts(refs, known).collect()}
    assert got == {"a/one.md": "a/one.md", "a/two.md": "A/Two.md", "q/three.md": "three.md", "p/four.md": None, "r/four.md": None}


def test_blocked_positions(spark):
    rows = [("g", n, n % 7) for n in range(500)] + [("h", 3, 1)]
    df = spark.createDataFrame(rows, "g string, n int, v int").withColumn("b", F.floor(F.col("n") / 16))
    assert all(r["position"] == r["n"] + 1 for r in blocked_row_number(df, ["g"], ["b"], ["n"]).where("g = 'g'").collect())
    sums = {r["n"]: r["before"] for r in blocked_running_sum(df, ["g"], "n", "v", "before", span=16).where("g = 'g'").collect()}
    assert sums == {n: sum(k % 7 for k in range(n)) for n in range(500)}
    carried = blocked_carry(df, ["g"], "n", {"last": F.when(F.col("v") == 6, F.col("n"))}, span=16).where("g = 'g'").collect()
    assert {r["n"]: r["last"] for r in carried} == {n: max((k for k in range(n) if k % 7 == 6), default=None) for n in range(500)}


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(0, None, 1, "T", 1, 1), (1, 0, 2, "1 Intro", 1, 2), (2, 1, 3, "1.1 Sub", 2, 3), (3, 2, 4, "Deep", 3, 4), (4, 0, 2, "Plain", 5, 5)]
    return spark.createDataFrame([("p", *r, f"text {r[0]} here.") for r in rows], "paper_id string, section_order int, parent_order int, level int, heading string, page_start int, page_end int, text string")


def test_parents_from_levels(spark, tree):
    got = hierarchy.attach_parents(tree.drop("parent_order"))
    assert {r["section_order"]: r["parent_order"] for r in got.collect()} == {0: None, 1: 0, 2: 1, 3: 2, 4: 0}


def test_closure_pages_and_logical_parent(spark, tree):
    requests = tree.select(F.col("section_order").cast("string").alias("request_id"), "paper_id", F.col("section_order").alias("target_order"))
    assert hierarchy.descendants(requests, tree).count() == tree.count() + 3 + 2 + 1 + 1
    spans = {r["section_order"]: (r["page_start"], r["page_end"]) for r in hierarchy.page_roll_up(tree).collect()}
    assert spans[0] == (1, 5) and spans[1] == (1, 4) and spans[3] == (3, 4)
    logical = {r["section_order"]: r["logical_order"] for r in hierarchy.logical_parents(tree).collect()}
    assert logical == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4}


def test_reading_pages_cover_the_text(spark, tree):
    request = lambda offset: spark.createDataFrame([("r", "p", 1, offset)], "request_id string, paper_id string, target_order int, offset bigint")
    full = "text 1 here.\n\n### 1.1 Sub\n\ntext 2 here.\n\n#### Deep\n\ntext 3 here."
    whole = hierarchy.read_sections(request(0), tree, 1000).head()
    assert whole["text"] == full and whole["next_offset"] is None and whole["included_sections"] == 3
    offset, pieces = 0, []
    while offset is not None:
        page = hierarchy.read_sections(request(offset), tree, 5).head()
        pieces.append(page["text"])
        offset = page["next_offset"]
    assert "".join("".join(pieces).split()) == "".join(full.split())
    assert hierarchy.read_sections(request(999), tree, 5).head()["text"] == ""


def test_cycles_are_found(spark):
    rows = spark.createDataFrame([("p", 0, 2), ("p", 1, 0), ("p", 2, 1), ("q", 0, None), ("q", 1, 0)], "paper_id string, section_order int, parent_order int")
    assert {(r["paper_id"], r["section_order"]) for r in quality.cyclic_sections(rows).collect()} == {("p", 0), ("p", 1), ("p", 2)}


def test_source_states(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2x"), ("c", "9"), ("d", "1")], "source_path string, content_hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("gone", "3")], "source_path string, content_hash string")
    assert {r["source_path"]: r["state"] for r in incremental.classify_sources(new, old).collect()} == {"a": "unchanged", "b": "changed", "c": "new", "d": "copy", "gone": "removed"}


def test_upsert_and_failures(spark):
    old = spark.createDataFrame([(1, "x", 10), (2, "y", 20)], "k int, v string, created int")
    new = spark.createDataFrame([(2, "z", 99), (3, "w", 99)], "k int, v string, created int")
    assert {r["k"]: (r["v"], r["created"]) for r in incremental.upsert(old, new, ["k"], ("created",)).collect()} == {1: ("x", 10), 2: ("z", 20), 3: ("w", 99)}
    log = spark.createDataFrame([("p", "s", "first", 1, 1), ("p", "s", "last", 2, 2), ("q", "s", "e", 1, 1)], "source_path string, stage string, error string, created_at int, updated_at int")
    cleared = spark.createDataFrame([("q",)], "source_path string")
    assert [(r["source_path"], r["error"]) for r in incremental.latest_failures(log, cleared).collect()] == [("p", "last")]


def test_empty_chunks_and_mirror(spark):
    chunks = spark.createDataFrame([("p", 0, 5), ("p", 1, 0), ("p", 2, 7)], "paper_id string, chunk_index int, token_count int")
    once = quality.compact_chunks(chunks)
    assert [(r["chunk_index"], r["token_count"]) for r in once.orderBy("chunk_index").collect()] == [(0, 5), (1, 7)]
    assert quality.mirror_differences(once, once).isEmpty()
    left, right = digests.unequal_rows(once, once)
    assert left.isEmpty() and right.isEmpty()
    assert quality.mirror_differences(once, once.unionByName(once.limit(1))).count() == 1


@pytest.mark.parametrize("md,want", [
    ("# T\n## Abstract\nline one\nline two\n## Next\nx", "line one\nline two"), ("# T\n**Abstract**: inline text\nmore\n# N", "inline text\nmore"), ("Abstract\nplain\n# N\nx", "plain"), ("# T\nnothing", ""),
])
def test_abstract(spark, md, want):
    assert values(spark, metadata.abstract_of, md) == [want]


def test_text_metadata(spark):
    row = values(spark, metadata.text_metadata, "# *Title*\n**Authors:** Ann Lee; Bo Ray\nDOI 10.1234/ab.c). In 2019.")[0]
    assert (row["title"], row["authors"], row["doi"], row["year"]) == ("Title", ["Ann Lee", "Bo Ray"], "10.1234/ab.c", 2019)
    assert values(spark, tx.find_year, "report_2014_final", "12014") == [2014, None]


def test_usable_metadata(spark):
    assert values(spark, lambda t: metadata.usable_title(t, F.lit("x/file.pdf")), "A Study of Graphs", "(E,,) becomes", "Untitled", "file") == [True, False, False, False]
    got = spark.createDataFrame([(["Ann Lee"],), (["bob"],), (["Adobe Acrobat"],), ([],)], "a array<string>").select(metadata.usable_authors(F.col("a"))).collect()
    assert [r[0] for r in got] == [True, False, False, False]


def test_catalog_fields(spark):
    df = spark.createDataFrame([({"citation": "Lee & Ray (2001) On X · extra", "other": "y"},)], "f map<string,string>")
    row = df.select(metadata.catalog_title(F.col("f")), metadata.catalog_authors(F.col("f"))).head()
    assert row[0] == "Lee & Ray (2001) On X" and row[1] == ["Lee", "Ray"]


def test_text_density(spark):
    rows = spark.createDataFrame([("ok", "a" * 200, 2), ("sparse", "a" * 50, 1), ("corrupt", "�" * 40 + "b" * 200, 1)], "name string, markdown string, page_count int")
    assert all(r["name"] == r["verdict"] for r in quality.text_density(rows).collect())


def test_expansions():
    assert expansion.parse_variants('```json\n["One two", "one  TWO", "three"]\n```', "orig") == ["One two", "three"]
    assert expansion.parse_variants("Sure:\n- first\n2) second\nprose", "FIRST") == ["second"]
    assert expansion.parse_variants('{"expansions": ["a", "b", "c", "d", "e"]}', "x") == ["a", "b", "c", "d"]
    assert expansion.expand("q", lambda q: 1 / 0) == []


def test_settings(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text("[chunks]\ntarget_tokens = 100\nmin_tokens = 10\nmax_tokens = 200\n[retrieval]\nrrf_k = 30\n")
    assert load_settings(path).chunks.max_tokens == 200 and load_settings(path).retrieval.rrf_k == 30
    for bad in (lambda: ChunkSettings(10, 20, 30), lambda: RetrievalSettings(rrf_k=0), lambda: Settings(chunks=ChunkSettings(850, 250, 4000))):
        with pytest.raises(ValueError):
            bad()


def test_file_sources(spark, tmp_path):
    for name, text in {"a/One.PDF": "x", "skip/two.pdf": "y", "b/notes.md": "# T\n\nbody", "README.md": "no"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    refs = spark.createDataFrame([("notes.md",), ("readme.md",)], "artifact string")
    found = files.scan_sources(spark, str(tmp_path), refs, ("skip",))
    assert sorted(r["source_path"] for r in found.collect()) == ["a/One.PDF", "b/notes.md"]
    row = files.markdown_text(found.where("source_kind = 'markdown_reference'")).head()
    assert row["title"] == "T" and row["markdown"] == "# T\n\nbody\n"
    (tmp_path / "q.json").write_text('{"queries": [{"query": "x y", "relevant_papers": ["p"]}]}')
    row = files.evaluation_queries(spark, str(tmp_path / "q.json")).head()
    assert (row["text"], row["relevant_papers"], row["mode"]) == ("x y", ["p"], "precision")
    assert values(spark, files.separators_to_markers, "{0}" + "-" * 30 + "\nfirst\n\n{1}" + "-" * 30 + "\nsecond")[0].split("\n")[0] == "<!-- page: 1 -->"


def test_digest_trees_tell_nulls_and_repeats_apart(spark):
    schema = "a string, b string, n int, v array<double>"
    rows = [("x", None, 1, [1.0]), (None, "x", 1, [1.0]), ("x", "y", 2, None), ("x", "y", 2, None)] + [(str(n), "z", n, [0.5]) for n in range(500)]
    base = spark.createDataFrame(rows, schema)
    changed = spark.createDataFrame([(None, "x", 1, [1.0]), (None, "x", 1, [1.0]), ("x", "y", 2, None)] + rows[4:], schema).repartition(3)
    found = sorted((r["side"], r["a"] or "", r["b"] or "") for r in digests.differences(base, changed).collect())
    assert found == [("base", "x", ""), ("base", "x", "y"), ("mirror", "", "x")]
    left, _ = digests.unequal_rows(base, changed)
    assert left.count() < 10
    none = base.limit(0)
    assert digests.differences(none, none).isEmpty() and digests.differences(base, none).count() == len(rows)


def test_components_of_chains_and_stars(spark):
    edges = [(f"c{n:03d}", f"c{n + 1:03d}") for n in range(120)] + [("hub", f"s{n}") for n in range(50)] + [("z", "z"), ("m", "a")]
    held = {}
    for r in entities.components(spark.createDataFrame(edges, "a string, b string")).collect():
        held.setdefault(r["component"], set()).add(r["node"])
    assert {k: len(v) for k, v in held.items()} == {"c000": 121, "hub": 51, "z": 1, "a": 2}
    assert entities.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_rows_that_name_several_files(spark):
    """Three files of one row, two of them equal, are two papers; a bare name shared by two files joins nothing."""
    listing = spark.createDataFrame([("a.md", "1"), ("x/b.md", "2"), ("copy.md", "2"), ("one/s.md", "3"), ("two/s.md", "4"), ("solo.md", "5"), ("other.md", "6")], "source_path string, content_hash string")
    rows = [("c", 1, "combo", ["a.md", "x/b.md", "copy.md"]), ("c", 2, "shared", ["s.md"]), ("c", 3, "solo-work", ["solo.md"]), ("c", 4, "twice", ["copy.md", "x/b.md"]), ("c", 5, None, ["one/s.md"]), ("c", 6, "late", ["solo.md"])]
    found = {r["source_path"]: r["paper_id"] for r in entities.resolve(spark.createDataFrame(rows, "catalog_id string, line_no int, record_id string, artifacts array<string>"), listing).collect()}
    assert found == {"a.md": "a", "x/b.md": "twice", "copy.md": "twice", "solo.md": "solo-work", "one/s.md": "s"}
