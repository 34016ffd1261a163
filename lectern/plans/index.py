"""Building the searchable snapshot and reading it back.

A snapshot is a folder of Parquet tables named by its revision.  It is written
once, never changed, and holds every table a search needs.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import KINDS, Settings, settings_from
from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.operators import lexical
from lectern.operators.postings import numbered
from lectern.operators.ranking import blocked_carry, blocked_row_number
from lectern.operators.sections import chunk_sections, number_chunks, parse_sections
from lectern.session import settle

TABLES = ("papers", "blocks", "sections", "chunks", "notes", "links", "entities", "postings", "terms", "levels", "vectors")
# Texts and posting blocks take a third less room than with Spark's default.
CODEC = "zstd"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists on whatever storage the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _pointers(root: str) -> str:
    return f"{root}/committed"


def set_pointer(spark: SparkSession, root: str, revision: int, place: str) -> None:
    """Commit a revision: one small file says where it lies, written only when the rest is."""
    rows = spark.createDataFrame([(revision, place)], "revision int, place string")
    rows.coalesce(1).write.mode("append").json(_pointers(root))


def write_rows(rows: DataFrame, path: str, partition=(), mode: str = "errorifexists", within=()) -> None:
    """Write rows as Parquet; those of a partition lie in the order of the columns ``within``."""
    if partition:
        # The rebalance hint splits hot partitions and joins small ones.
        rows = rows.hint("rebalance", *partition)
    if within:
        rows = rows.sortWithinPartitions(*partition, *within)
    rows.write.mode(mode).option("compression", CODEC).partitionBy(*partition).parquet(path)


def write_in_place(rows: DataFrame, path: str, partition, mode: str = "errorifexists") -> None:
    """Write rows to the folders of their partitions from where they lie, without a shuffle."""
    rows.write.mode(mode).option("compression", CODEC).partitionBy(*partition).parquet(path)


def write_blocks(entities: DataFrame, buckets: int, path: str, mode: str = "errorifexists") -> None:
    """Posting blocks of written entities in the folders of their terms' buckets; a shard's blocks are written where its rows lie."""
    blocks = lexical.postings(entities, buckets, dealt=True).sortWithinPartitions("kind", "bucket", "term", "shard", "run")
    write_in_place(blocks, path, ("kind", "bucket"), mode)


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    root: str
    revision: int
    settings: Settings
    kinds: tuple[str, ...] = KINDS

    @classmethod
    def open(cls, spark: SparkSession, root: str, revision: int) -> "Index":
        """The snapshot with the settings it was written with, which its layout depends on.

        A run's revision is where its pointer says; one that was never committed has none.
        """
        pointers = spark.read.schema("revision int, place string").json(_pointers(root)) if exists(spark, _pointers(root)) else None
        # One row: a revision is committed once.
        held = pointers and pointers.where(F.col("revision") == revision).first()
        place = held["place"] if held else f"{root}/rev={revision}"
        held = spark.read.text(f"{place}/settings").first()["value"]
        return cls(spark, place, revision, settings_from(json.loads(held)))

    def has(self, name: str) -> bool:
        return exists(self.spark, f"{self.root}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def only(self, kinds) -> "Index":
        unknown = set(kinds) - set(KINDS)
        if unknown:
            raise ValueError(f"unsupported result kinds: {', '.join(sorted(unknown))}")
        return replace(self, kinds=tuple(k for k in KINDS if k in set(kinds)))

    def _levelled(self, name: str) -> DataFrame:
        rows = self.table(name)
        return rows if self.kinds == KINDS else rows.where(F.col("kind").isin(list(self.kinds)))

    buckets = property(lambda self: self.settings.layout.term_buckets)
    shards = property(lambda self: self.settings.layout.entity_buckets)
    all_shards = shards
    # Rows of a snapshot are never replaced.
    dead = None
    papers = property(lambda self: self.table("papers"))
    sections = property(lambda self: self.table("sections"))
    chunks = property(lambda self: self.table("chunks"))
    notes = property(lambda self: self.table("notes"))
    links = property(lambda self: self.table("links"))
    entities = property(lambda self: self._levelled("entities"))
    placed = property(lambda self: self.entities.withColumn("shard", F.col("entity_bucket")))
    postings = property(lambda self: self._levelled("postings"))
    terms = property(lambda self: self._levelled("terms"))
    levels = property(lambda self: self._levelled("levels"))
    vectors = property(lambda self: self._levelled("vectors"))


def entity_id(paper_id: Column, mark: str, order: Column) -> Column:
    return F.concat(paper_id, F.lit(f"#{mark}"), order)


def paper_entities(papers: DataFrame) -> DataFrame:
    return papers.select(
        F.lit("paper").alias("kind"), F.col("paper_id").alias("entity_id"), "paper_id", F.lit(None).cast("int").alias("section_order"),
        "title", "authors", "year", F.lit("").alias("section_path"),
        F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), "source_kind",
        F.when(F.col("abstract") == "", F.col("title")).otherwise(F.col("abstract")).alias("text"),
        F.array("title", F.array_join("authors", " "), "abstract").alias("match_fields"),
        F.array().cast("array<string>").alias("extra_fields"),
    )


def child_entities(kind: str, rows: DataFrame, papers: DataFrame) -> DataFrame:
    mark, order = ("s", "section_order") if kind == "section" else ("c", "chunk_index")
    owner = papers.select("paper_id", "title", "authors", "year", "source_kind")
    return rows.join(owner, "paper_id").select(
        F.lit(kind).alias("kind"), entity_id(F.col("paper_id"), mark, F.col(order)).alias("entity_id"), "paper_id", "section_order",
        "title", "authors", "year", F.col("heading_path").alias("section_path"), "page_start", "page_end", "source_kind", "text",
        F.array("heading_path", "text").alias("match_fields"), F.array("title").alias("extra_fields"),
    )


def note_entities(notes: DataFrame, links: DataFrame, papers: DataFrame) -> DataFrame:
    first = links.groupBy("entry_id").agg(F.min("paper_id").alias("paper_id"))
    owner = papers.select("paper_id", "title", "authors", "year", "source_kind")
    return (
        notes.join(first, "entry_id", "left").join(owner, "paper_id", "left").select(
            F.lit("curated").alias("kind"), F.col("entry_id").alias("entity_id"), "paper_id", F.lit(None).cast("int").alias("section_order"),
            F.coalesce("title", F.when(F.col("heading_path") != "", F.col("heading_path")), F.lit("Curated index")).alias("title"),
            F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), "year",
            F.col("heading_path").alias("section_path"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"),
            F.coalesce("source_kind", F.lit("curated_index")).alias("source_kind"), "text",
            F.array("heading_path", "entry_type", "text").alias("match_fields"), F.array().cast("array<string>").alias("extra_fields"),
        )
    )


def without_fields(rows: DataFrame) -> DataFrame:
    """Entities without the fields that :func:`with_fields` gives back, so that a text is moved once."""
    given = F.col("kind").isin("paper", "section", "chunk")
    bare = F.when(F.col("kind") == "paper", F.get("match_fields", F.lit(2)) == "")
    return rows.withColumn("bare", bare).withColumn("match_fields", F.when(~given, F.col("match_fields")))


def with_fields(rows: DataFrame) -> DataFrame:
    paper = F.array("title", F.array_join("authors", " "), F.when(F.col("bare"), "").otherwise(F.col("text")))
    match = F.when(F.col("kind") == "paper", paper).when(F.col("kind").isin("section", "chunk"), F.array("section_path", "text")).otherwise(F.col("match_fields"))
    return rows.withColumn("match_fields", match).drop("bare")


def context_text(kind: Column) -> Column:
    """Text that stands for a section, chunk or note when it is embedded."""
    # The labels of the parts.
    child = F.concat(F.lit("DOCUMENT:\n"), "title", F.lit("\n\nSECTION:\n"), "section_path", F.lit("\n\nCONTENT:\n"), "text")
    note = F.concat(F.lit("CURATED INDEX PATH:\n"), "section_path", F.lit("\n\nNOTE:\n"), "text")
    return F.when(kind == "curated", note).otherwise(child)


def paper_context_parts(papers: DataFrame, sections: DataFrame, notes: DataFrame, links: DataFrame) -> DataFrame:
    """The parts of each paper's embedding text in order, one row each.

    A paper may have any number of notes, so the parts are never joined to one text.
    """
    # The labels of the parts.
    head = papers.select(
        "paper_id", F.struct(F.lit(0).alias("part"), F.lit(0).alias("n"), F.lit("").alias("id")).alias("place"),
        F.concat_ws(
            "\n\n", F.concat(F.lit("DOCUMENT:\n"), "title"),
            F.when(F.size("authors") > 0, F.concat(F.lit("AUTHORS:\n"), F.array_join("authors", ", "))),
            F.when(F.col("abstract") != "", F.concat(F.lit("ABSTRACT:\n"), "abstract")),
            F.lit("SECTIONS:"),
        ).alias("text"),
    )
    headings = sections.select(
        "paper_id", F.struct(F.lit(1).alias("part"), F.col("section_order").alias("n"), F.lit("").alias("id")).alias("place"),
        F.col("heading_path").alias("text"),
    )
    label = papers.select(
        "paper_id", F.struct(F.lit(2).alias("part"), F.lit(0).alias("n"), F.lit("").alias("id")).alias("place"),
        F.lit("CURATED RESEARCH NOTES:").alias("text"),
    )
    noted = links.select("entry_id", "paper_id").join(notes, "entry_id").select(
        "paper_id", F.struct(F.lit(3).alias("part"), F.coalesce("source_line", F.lit(2147483647)).alias("n"), F.col("entry_id").alias("id")).alias("place"),
        "text",
    )
    return head.unionByName(headings).unionByName(label).unionByName(noted)


def embed_parts(parts: DataFrame, dimensions: int) -> DataFrame:
    """Feature-hash vector of each paper from its parts, by counting features."""
    slots = embed_slots(parts, vx.hash_slots(dimensions))
    # At most one row per slot and paper.
    filled = slots.groupBy("paper_id").agg(F.collect_list("slot").alias("slots"), F.collect_list("value").alias("values"))
    return filled.select("paper_id", vx.scatter(dimensions)("slots", "values").alias("vector"))


def embed_slots(parts: DataFrame, place_feature) -> DataFrame:
    """``paper_id, slot, value``: summed weights of the features of ``parts (paper_id, place, text)``.

    ``place_feature`` gives the slot and sign of a feature.  Equals the embedding of the joined
    text: pairs across neighbouring parts are added from the last token before each part.
    """
    tokens = parts.select("paper_id", "place", tx.feature_tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    # Parts of one place are told apart by their id.
    spaced = tokens.select("*", F.col("place.part").alias("_part"), F.floor(F.col("place.n") / 65536).alias("_run"))
    placed = blocked_row_number(spaced, ["paper_id"], ["_part", "_run"], ["place"], "position")
    carried = blocked_carry(placed, ["paper_id"], "position", {"previous": F.element_at("tokens", -1)})
    pairs = F.zip_with(F.slice("tokens", 1, F.size("tokens") - 1), F.slice("tokens", 2, F.size("tokens")),
                       lambda a, b: F.concat(F.lit("bigram:"), a, F.lit(vx.PAIR_JOINER), b))
    bridge = F.when(F.col("previous").isNotNull(), F.array(F.concat(F.lit("bigram:"), "previous", F.lit(vx.PAIR_JOINER), F.get("tokens", F.lit(0)))))
    features = F.concat(
        F.transform("tokens", lambda t: F.concat(F.lit("word:"), t)),
        F.when(F.size("tokens") > 1, pairs).otherwise(F.array().cast("array<string>")),
        F.coalesce(bridge, F.array().cast("array<string>")),
    )
    counted = carried.select("paper_id", F.explode(features).alias("feature")).groupBy("paper_id", "feature").agg(F.count("*").alias("n"))
    # Rounding makes sums independent of the order in which they were added.
    return (
        counted.select("paper_id", place_feature(F.col("feature")).alias("at"), vx.feature_weight(F.col("feature"), F.col("n")).alias("weight"))
        .groupBy("paper_id", "at.slot")
        .agg(F.round(F.sum(F.col("at.sign") * F.col("weight")), 9).alias("value"))
    )


class IndexWriter:
    """Writes the tables of one snapshot; its steps run in the order of their inputs."""

    def __init__(self, spark: SparkSession, root: str, revision: int, settings: Settings | None = None, attempt: int | None = None):
        place = f"{root}/rev={revision}" if attempt is None else f"{root}/attempts/rev={revision}/{attempt}-{uuid.uuid4().hex[:8]}"
        self.index = Index(spark, place, revision, settings or Settings())
        self.spark = spark

    def _path(self, name: str) -> str:
        return f"{self.index.root}/{name}"

    def write(self, name: str, rows: DataFrame, partition=(), mode: str = "errorifexists", within=()) -> DataFrame:
        """Write a table; rows of a partition lie in the order of the columns ``within``."""
        write_rows(rows, self._path(name), partition, mode, within)
        return self.spark.read.parquet(self._path(name))

    def papers(self, papers: DataFrame) -> DataFrame:
        """Papers, and the id range each falls in, which later orders link lists; the settings go with them."""
        written = self.write("papers", papers)
        held = json.dumps(self.index.settings.as_dict())
        self.spark.createDataFrame([(held,)], "value string").coalesce(1).write.mode("errorifexists").text(self._path("settings"))
        ids = written.select("paper_id").repartitionByRange(self.index.settings.layout.paper_blocks, "paper_id")
        self.write("blocks", ids.withColumn("block", F.spark_partition_id()))
        return written

    def sections(self) -> None:
        self.write("sections", parse_sections(self.index.papers.select("paper_id", "title", "markdown")))

    def chunks(self) -> None:
        self.write("chunks", number_chunks(chunk_sections(self.index.sections, self.index.settings.chunks)))

    def hierarchy(self, previous: Index | None = None, kept: DataFrame | None = None) -> None:
        """Sections and chunks; those of kept papers come from the previous snapshot."""
        if previous is None:
            self.sections()
            self.chunks()
            return
        papers = self.index.papers.select("paper_id", "title", "markdown")
        fresh = papers.join(kept, "paper_id", "left_anti")
        self.write("sections", previous.sections.join(kept, "paper_id", "left_semi").unionByName(parse_sections(fresh)))
        same_budget = previous.settings.chunks == self.index.settings.chunks
        sections = self.index.sections if not same_budget else self.index.sections.join(kept, "paper_id", "left_anti")
        chunks = number_chunks(chunk_sections(sections, self.index.settings.chunks))
        if same_budget:
            chunks = previous.chunks.join(kept, "paper_id", "left_semi").unionByName(chunks)
        self.write("chunks", chunks)

    def entities(self, rows: DataFrame, mode: str = "errorifexists") -> None:
        """Entities numbered in their shard; a shard's files hold them in the order of their ids."""
        held = lexical.tokenized(with_fields(numbered(without_fields(rows), self.index.shards)))
        write_in_place(held, self._path("entities"), ("kind", "entity_bucket"), mode)

    def level(self, kind: str) -> None:
        """Entities of one level."""
        index = self.index
        if kind == "paper":
            rows = paper_entities(index.papers)
        elif kind == "curated":
            rows = note_entities(index.notes, index.links, index.papers)
        else:
            rows = child_entities(kind, index.sections if kind == "section" else index.chunks, index.papers)
        self.entities(rows, mode="append")

    def postings(self, kinds, mode: str = "errorifexists") -> None:
        scoped = self.index.only(kinds)
        write_blocks(scoped.entities, self.index.buckets, self._path("postings"), mode)
        self.write("terms", lexical.term_stats(scoped.postings), ("kind",), mode)

    def level_sizes(self, kinds, mode: str = "errorifexists") -> None:
        self.write("levels", lexical.level_stats(self.index.only(kinds).entities), mode=mode)

    def lexical_tables(self, kinds, mode: str = "errorifexists") -> None:
        self.postings(kinds, mode)
        self.level_sizes(kinds, mode)

    def child_levels(self) -> None:
        papers = self.index.papers
        self.entities(
            paper_entities(papers)
            .unionByName(child_entities("section", self.index.sections, papers))
            .unionByName(child_entities("chunk", self.index.chunks, papers))
        )
        self.lexical_tables(("paper", "section", "chunk"))

    def links(self, links: DataFrame | None = None, kind: str = "section") -> None:
        """Links of notes; without given ones, the papers that quote a note whole."""
        if links is None:
            links = quoting_papers(self.index, self.index.notes, kind)
        known = self.index.table("blocks")
        self.write("links", links.select("entry_id", "paper_id").distinct().join(known, "paper_id"))

    def notes(self, notes: DataFrame, links: DataFrame | None = None, kind: str = "section") -> None:
        self.write("notes", notes)
        self.links(links, kind)
        self.entities(note_entities(self.index.notes, self.index.links, self.index.papers), mode="append")
        self.lexical_tables(("curated",), mode="append")

    def vectors(self, kinds=KINDS, mode: str = "errorifexists") -> None:
        index, dimensions = self.index, self.index.settings.embedding.dimensions
        name, fingerprint = vx.hash_identity(dimensions)
        children, parts = [k for k in kinds if k != "paper"], []
        if children:
            rows = index.only(children).entities
            parts.append(rows.select("kind", "entity_id", "paper_id", vx.hash_embedding(dimensions)(tx.feature_tokens(context_text(F.col("kind")))).alias("vector")))
        if "paper" in kinds:
            papers = embed_parts(paper_context_parts(index.papers, index.sections, index.notes, index.links), dimensions)
            parts.append(papers.select(F.lit("paper").alias("kind"), F.col("paper_id").alias("entity_id"), "paper_id", "vector"))
        rows = reduce(DataFrame.unionByName, parts).select(
            "*", F.lit(name).alias("model_name"), F.lit(fingerprint).alias("model_fingerprint"), F.lit(dimensions).alias("dimensions"),
            F.lit(True).alias("normalized"), F.current_timestamp().alias("updated_at"),
        )
        write_in_place(rows, self._path("vectors"), ("kind",), mode)

    def build(self, papers: DataFrame, notes: DataFrame, links: DataFrame | None = None, vectors: bool = True) -> Index:
        self.papers(papers)
        self.hierarchy()
        self.child_levels()
        self.notes(notes, links)
        if vectors:
            self.vectors()
        return self.index


def quoting_papers(index: Index, notes: DataFrame, kind: str) -> DataFrame:
    """Links from each note to the papers with a row of the level that holds its whole text."""
    phrases = notes.select(
        F.col("entry_id").alias("query_id"), F.lit(None).cast("string").alias("scope"), F.lit("").alias("phrase"),
        tx.index_tokens(F.col("text")).alias("terms"),
    ).where(F.size("terms") > 0)
    scoped = index.only((kind,))
    hits = lexical.phrase_hits(scoped, phrases).select("query_id", "kind", "shard", "row_no")
    return lexical.with_ids(scoped, settle(hits)).select(F.col("query_id").alias("entry_id"), "paper_id").distinct()
