"""Markdown documents to section rows and section rows to chunk rows.

Both work inside one row per document or section: regular expressions code each
line, a small fold lays the codes out, and array functions put the text together.
No text leaves the JVM (but for pieces beyond the hard limit) and nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import ChunkSettings
from lectern.functions import folds
from lectern.functions import text as tx
from lectern.session import computed_once

# Markdown and LaTeX line patterns.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]"
ODD_LINE_END = r"[\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]"
HEADING_LINE = r"^ {0,3}(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$"
SECTION_NUMBER = r"^\s*(\d+(?:\.\d+)*)(?:\.|\s)"
MATH_BEGIN = (
    r"\\begin\{(equation\*?|align\*?|aligned|gather\*?|multline\*?|cases|split|array|matrix|pmatrix|bmatrix)\}"
)
MATH_END = r"\\end\{([^}]+)\}"
THEOREM_LINE = r"(?i)^\s*(?:#{1,6}\s*)?(?:theorem|lemma|proposition|corollary|definition)\b"
PROOF_LINE = r"(?i)^\s*(?:\*\*)?proof\b"
# A line without any of these marks is prose to the parser, and to the chunker.
HEADING_MARK = r"[<`~\[\]$#]"
BLOCK_MARK = r"[<`~\[\]$|]|^\s*(?:[#*]|(?i:theorem|lemma|proposition|corollary|definition|proof))"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9\[])|\n+(?=\S)"
SMALLEST_ATOMIC_LIMIT = 512


def _lines(text: Column) -> Column:
    """Lines of a text; one with plain line ends only is cut without a pattern."""
    return tx.once(text, lambda held: F.when(held.rlike(ODD_LINE_END), F.split(held, LINE_END)).otherwise(F.split(held, "\n")))


def _bits(flags: list[tuple[Column, int]]) -> Column:
    value = F.lit(0)
    for condition, bit in flags:
        value = value.bitwiseOR(F.when(condition, F.lit(bit)).otherwise(F.lit(0)))
    return value


def _page_number(line: Column) -> Column:
    def number(found):
        return F.when(found != "", F.coalesce(found.try_cast("int"), F.lit(folds.NO_PAGE))).otherwise(F.lit(folds.NO_PAGE))

    return F.when(line.contains("<!--"), tx.once(F.regexp_extract(line, tx.PAGE_LINE, 1), number)).otherwise(F.lit(folds.NO_PAGE))


def _events(line: Column, mark: str, flags) -> Column:
    """Event bits of a line; only a line with a mark is looked at closely."""
    close = tx.once(tx.strip(line), lambda bare: _bits(flags(line, bare)))
    return F.when(~line.rlike(r"\S"), F.lit(folds.BLANK)).when(line.rlike(mark), close).otherwise(F.lit(0))


def _heading_events(line: Column) -> Column:
    return _events(line, HEADING_MARK, lambda line, bare:
        [
            (line.rlike(tx.PAGE_LINE), folds.PAGE),
            (line.rlike(r"^\s*`{3,}"), folds.TICK),
            (line.rlike(r"^\s*~{3,}"), folds.TILDE),
            (bare == "[", folds.BARE_OPEN),
            (bare == "]", folds.BARE_CLOSE),
            (bare.startswith("\\[") & ~bare.endswith("\\]"), folds.BRACKET_OPEN),
            (bare.endswith("\\]"), folds.BRACKET_END),
            (F.regexp_count(line, F.lit(r"\$\$")) % 2 == 1, folds.ODD_DOLLARS),
            (bare == "", folds.BLANK),
            (line.rlike(HEADING_LINE), folds.HEADING),
        ]
    )


def _block_events(line: Column) -> Column:
    dollars = F.regexp_count(line, F.lit(r"\$\$"))
    return _events(line, BLOCK_MARK, lambda line, bare:
        [
            (line.rlike(tx.PAGE_LINE), folds.PAGE),
            (line.rlike(r"^\s*`{3,}"), folds.TICK),
            (line.rlike(r"^\s*~{3,}"), folds.TILDE),
            (line.rlike(r"^\s*(?:`{3}.*`{3}|~{3}.*~{3})"), folds.FENCE_PAIR),
            (bare == "[", folds.BARE_OPEN),
            (bare == "]", folds.BARE_CLOSE),
            (bare.startswith("\\["), folds.BRACKET_OPEN),
            (bare.contains("\\]"), folds.BRACKET_END),
            (F.substring(bare, 3, 1 << 30).contains("\\]"), folds.BRACKET_INLINE),
            (bare.startswith("$$"), folds.DOLLAR_START),
            (dollars % 2 == 1, folds.ODD_DOLLARS),
            (dollars >= 2, folds.DOLLAR_PAIR),
            (bare == "", folds.BLANK),
            (bare.contains("|"), folds.TABLE),
            (line.rlike(THEOREM_LINE), folds.THEOREM),
            (line.rlike(PROOF_LINE), folds.PROOF),
        ]
    )


def _known_page(page: Column) -> Column:
    return F.when(page != folds.NO_PAGE, page)


def parse_sections(documents: DataFrame) -> DataFrame:
    """``(paper_id, title, markdown)`` to one row per section, in document order."""
    lines = _lines(F.replace(F.col("markdown"), F.lit("\x00"), F.lit("")))
    coded = (
        documents.where(F.col("markdown").rlike(r"\S"))
        .select("paper_id", "title", lines.alias("lines"))
        .withColumn("events", F.transform("lines", _heading_events))
        .withColumn("pages", F.transform("lines", _page_number))
        .withColumn("levels", F.transform("lines", lambda s: F.when(s.contains("#"), F.length(F.regexp_extract(s, HEADING_LINE, 1))).otherwise(0)))
        .withColumn(
            "names",
            F.transform("lines", lambda s: F.when(s.contains("#") & s.rlike(HEADING_LINE), tx.clean_heading(F.regexp_extract(s, HEADING_LINE, 2))).otherwise("")),
        )
        .withColumn("numbers", F.transform("names", lambda s: F.when(s == "", "").otherwise(F.regexp_extract(s, SECTION_NUMBER, 1))))
    )
    laid = coded.withColumn("plan", folds.lay_out_lines("events", "pages", "levels", "numbers")).select(
        "paper_id", "title", "lines", "levels", "names", "plan.*"
    )
    several = (F.size("heads") > 1) | F.exists("first_page", lambda p: p != folds.NO_PAGE)
    headed = F.exists("heads", lambda h: h >= 0)

    def part_name(head, at):
        first, last = F.get("first_page", at), F.get("last_page", at)
        by_page = F.when(first == last, F.concat(F.lit("Page "), first)).otherwise(
            F.concat(F.lit("Pages "), first, F.lit("–"), last)
        )
        untitled = (
            F.when((at == 0) & (F.col("title") != ""), F.col("title"))
            .when(at == 0, F.when(headed, F.lit("Preamble")).otherwise(F.lit("Document")))
            .otherwise(F.concat(F.lit("Document part "), at + 1))
        )
        own = F.get("names", head)
        return (
            F.when(head >= 0, F.when(own == "", F.lit("Untitled section")).otherwise(own))
            .when(~headed & several & (first != folds.NO_PAGE), by_page)
            .otherwise(untitled)
        )

    named = computed_once(laid, headings=F.transform("heads", part_name), kept=F.transform("keep", lambda i: F.get("lines", i)))
    section = F.transform(
        "heads",
        lambda head, at: F.struct(
            at.alias("section_order"),
            F.get(F.get("trails", at), F.size(F.get("trails", at)) - 2).alias("parent_order"),
            F.when(head >= 0, F.get("levels", head)).otherwise(1).alias("level"),
            F.get("headings", at).alias("heading"),
            F.array_join(F.transform(F.get("trails", at), lambda i: F.get("headings", i)), " > ").alias("heading_path"),
            _known_page(F.get("first_page", at)).alias("page_start"),
            _known_page(F.get("last_page", at)).alias("page_end"),
            tx.strip(
                F.array_join(F.slice("kept", F.get("starts", at) + 1, F.get("sizes", at)), "\n")
            ).alias("text"),
            F.get("enters", at).cast("long").alias("enter"),
            F.get("leaves", at).cast("long").alias("leave"),
        ),
    )
    return named.select("paper_id", F.inline(section))


def _sentences(text: Column, limit: int) -> Column:
    """Sentences with their token count and wall; a sentence over the limit becomes words."""
    parts = F.filter(F.split(text, SENTENCE_END), lambda s: s.rlike(r"\S"))
    sized = F.transform(parts, lambda s: F.struct(s.alias("text"), tx.token_count(s).alias("tokens")))

    def atoms(item, at):
        words = F.filter(F.split(item["text"], r"\s+"), lambda w: w != "")
        return F.when(
            item["tokens"] > limit,
            F.transform(words, lambda w: F.struct(w.alias("text"), tx.token_count(w).alias("tokens"), (at + 1).alias("wall"))),
        ).otherwise(F.array(F.struct(item["text"].alias("text"), item["tokens"].alias("tokens"), F.lit(0).alias("wall"))))

    return F.flatten(F.transform(sized, atoms))


def chunk_sections(sections: DataFrame, settings: ChunkSettings | None = None) -> DataFrame:
    """Token-bounded chunks of each section; formulas, tables and proofs stay whole.

    Chunk order within a paper is ``(section_order, chunk_order)``; ``chunk_index``
    makes it contiguous and is added by :func:`number_chunks`.
    """
    settings = settings or ChunkSettings()
    limit = settings.max_tokens
    atomic_limit = max(limit, SMALLEST_ATOMIC_LIMIT)
    coded = (
        sections.where(F.col("text") != "")
        .select("paper_id", "section_order", "heading_path", "page_start", "page_end", _lines(F.col("text")).alias("lines"))
        .withColumn("events", F.transform("lines", _block_events))
        .withColumn("pages", F.transform("lines", _page_number))
        .withColumn("begins", F.transform("lines", lambda s: F.when(s.contains("\\begin{"), F.regexp_extract(s, MATH_BEGIN, 1)).otherwise("")))
        .withColumn("ends", F.transform("lines", lambda s: F.when(s.contains("\\end{"), F.array_join(F.regexp_extract_all(s, F.lit(MATH_END), F.lit(1)), " ")).otherwise("")))
    )
    spans = coded.select("*", F.inline(F.array(folds.unit_spans("events", "pages", "begins", "ends"))))

    def unit_text(at):
        firsts, lasts = F.get("first", at), F.get("last", at)
        return F.array_join(
            F.transform(
                firsts,
                lambda first, b: tx.strip(F.array_join(F.slice("lines", first + 1, F.get(lasts, b) - first + 1), "\n")),
            ),
            "\n\n",
        )

    def is_long(at):
        return ~F.get("atomic", at) & (F.get("counts", at) > limit)

    no_atoms = F.slice(_sentences(F.lit(""), limit), 1, 0)
    units = computed_once(spans, texts=F.transform("kind", lambda kind, at: unit_text(at)))
    units = computed_once(units, counts=F.transform("texts", tx.token_count))
    # Only long prose reaches the packing fold; other units pass as empty lists.
    atoms = computed_once(
        units,
        atoms=F.transform("texts", lambda text, at: F.when(is_long(at), _sentences(text, limit)).otherwise(no_atoms)),
    )
    # Sections without long prose send nothing.
    some = F.exists("atoms", lambda a: F.size(a) > 0)
    grouped = computed_once(
        atoms,
        groups=folds.nested_packer(limit)(
            F.when(some, F.transform("atoms", lambda a: a["tokens"])), F.when(some, F.transform("atoms", lambda a: a["wall"]))
        ),
    )

    def joined(at, group):
        chosen = F.filter(F.get("atoms", at), lambda a, n: F.get(F.get("groups", at), n) == group)
        return F.array_join(F.transform(chosen, lambda a: a["text"]), " ")

    def with_span(text, at, atomic, tokens):
        return F.struct(
            text.alias("text"),
            F.get("first_page", at).alias("first_page"),
            F.get("last_page", at).alias("last_page"),
            atomic.alias("atomic"),
            tokens.alias("tokens"),
        )

    pieces = F.flatten(
        F.transform(
            "texts",
            lambda text, at: F.when(
                F.size(F.get("groups", at)) > 0,
                F.transform(
                    F.array_distinct(F.get("groups", at)),
                    lambda group: tx.once(tx.strip(joined(at, group)), lambda cut: with_span(cut, at, F.lit(False), tx.token_count(cut))),
                ),
            ).otherwise(F.array(with_span(text, at, F.get("atomic", at), F.get("counts", at)))),
        )
    )

    def bounds(piece):
        return F.when(piece["atomic"], F.lit(atomic_limit)).otherwise(F.lit(limit))

    whole = computed_once(grouped, pieces=pieces).drop("lines", "atoms", "texts", "groups")
    oversized = computed_once(
        whole,
        oversized=F.transform("pieces", lambda p: F.when(p["tokens"] > bounds(p), p["text"])),
    )
    bounded = computed_once(
        oversized,
        cuts=folds.bounded_texts(
            F.when(F.exists("oversized", lambda t: t.isNotNull()), F.col("oversized")), F.transform("pieces", bounds)
        ),
    )
    final = F.flatten(
        F.transform(
            "uncut",
            lambda p, at: F.transform(
                F.coalesce(F.get("cuts", at), F.array(p["text"])),
                lambda text: F.struct(
                    text.alias("text"), p["first_page"].alias("first_page"), p["last_page"].alias("last_page"),
                    F.when(F.get("cuts", at).isNull(), p["tokens"]).otherwise(tx.token_count(text)).alias("tokens"),
                ),
            ),
        )
    )
    sized = computed_once(bounded.withColumnRenamed("pieces", "uncut"), pieces=final).drop("uncut", "cuts")
    packed = computed_once(
        sized,
        groups=folds.packer(settings.target_tokens, limit, settings.min_tokens)(
            F.transform("pieces", lambda p: p["tokens"])
        ),
    )

    def chunk(group):
        members = F.filter("pieces", lambda p, n: F.get("groups", n) == group)
        known = F.filter(
            F.flatten(F.transform(members, lambda p: F.array(p["first_page"], p["last_page"]))),
            lambda p: p != folds.NO_PAGE,
        )
        return F.struct(
            group.alias("chunk_order"),
            tx.strip(F.array_join(F.transform(F.filter(members, lambda p: p["text"] != ""), lambda p: p["text"]), "\n\n")).alias("text"),
            F.aggregate(members, F.lit(0), lambda total, p: total + p["tokens"]).alias("token_count"),
            F.coalesce(F.array_min(known), F.col("page_start")).alias("page_start"),
            F.coalesce(F.array_max(known), F.col("page_end")).alias("page_end"),
        )

    return (
        packed.select(
            "paper_id", "section_order", "heading_path",
            F.explode(F.transform(F.array_distinct("groups"), chunk)).alias("chunk"),
        )
        .select("paper_id", "section_order", "heading_path", "chunk.*")
        .where("token_count > 0")
    )


def number_chunks(chunks: DataFrame) -> DataFrame:
    """Contiguous ``chunk_index`` from 0 in each paper; a paper comes from one source row."""
    from pyspark.sql import Window

    order = Window.partitionBy("paper_id").orderBy("section_order", "chunk_order")
    return chunks.withColumn("chunk_index", F.row_number().over(order) - 1).drop("chunk_order")
