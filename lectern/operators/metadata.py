"""Paper metadata from text and from catalog fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx

# Patterns, titles and words that decide what counts as metadata.
DOI = r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+"
TOPIC_WORD = r"[A-Za-z][A-Za-z0-9+^-]{2,}"
GENERIC_TITLES = ("", "untitled", "document", "article", "paper", "full text", "microsoft word")
AUTHOR_TOOLS = ("microsoft word", "adobe acrobat", "anonymous", "unknown author")
YEAR = r"\b(?:19|20)[0-9]{2}\b"
CITED_YEAR = r"\((?:19|20)[0-9]{2}\)"
ABSTRACT_NAMES = ("abstract", "summary")
NAMED = "(?:" + "|".join(ABSTRACT_NAMES) + ")"
ABSTRACT_HEADING = rf"(?i)^{NAMED}$"
BOLD_LABEL = rf"(?:\*\*|__)\s*{NAMED}\s*(?:\*\*|__)\s*(?:[:.\-–—]\s*)?(.*)"
PLAIN_LABEL = rf"{NAMED}\s*(?:[:.\-–—]\s*(.*))?"
ABSTRACT_LABEL = rf"(?i)^\s*(?:{BOLD_LABEL}|{PLAIN_LABEL})$"
STOP_WORDS = (
    "about", "after", "also", "among", "and", "are", "based", "been", "being", "between", "can", "could", "does", "each", "for",
    "from", "have", "into", "its", "more", "most", "not", "only", "other", "paper", "results", "section", "should", "such", "than",
    "that", "the", "their", "then", "these", "this", "through", "using", "was", "were", "which", "with",
)


def text_metadata(markdown: Column) -> Column:
    """Title, authors, DOI and year found in the text, as one struct; the text is searched once for each."""
    found = F.struct(
        F.regexp_extract(markdown, r"(?m)^#\s+(.+?)\s*$", 1).alias("title"),
        F.regexp_extract(markdown, r"(?im)^\*\*Authors?:?\*\*\s*:?\s*(.+?)\s*$", 1).alias("authors"),
        F.regexp_replace(F.regexp_extract(markdown, DOI, 0), r"[.,;)]+$", "").alias("doi"),
        F.regexp_extract(markdown, "(?U)" + YEAR, 0).alias("year"),
    )
    return tx.once(found, lambda f: F.struct(
        tx.strip_emphasis(f["title"]).alias("title"), tx.split_authors(F.when(f["authors"] != "", f["authors"])).alias("authors"),
        F.when(f["doi"] != "", f["doi"]).alias("doi"), F.when(f["year"] != "", f["year"].cast("int")).alias("year"),
    ))


def abstract_of(markdown: Column) -> Column:
    """Text after an abstract heading or label, up to the next heading.

    Lines are cut at the first such label; the rest ends at the first heading.
    """
    from lectern.operators.sections import HEADING_LINE, LINE_END

    lines = F.split(markdown, LINE_END)

    def is_start(line):
        label = F.regexp_replace(F.regexp_extract(line, HEADING_LINE, 2), r"[`*_~]", "")
        label = F.regexp_replace(F.regexp_replace(label, r"\s+\{#[^}]+\}\s*$", ""), r"^[ :.–—-]+|[ :.–—-]+$", "")
        return F.when(line.rlike(HEADING_LINE), label.rlike(ABSTRACT_HEADING)).otherwise(line.rlike(ABSTRACT_LABEL))

    starts = F.transform(lines, lambda line, at: F.when(is_start(line), at))
    start = F.array_min(starts)
    first = F.get(lines, start)
    inline = F.when(first.rlike(HEADING_LINE), "").otherwise(
        F.concat(F.regexp_extract(first, ABSTRACT_LABEL, 1), F.regexp_extract(first, ABSTRACT_LABEL, 2))
    )
    after = F.slice(lines, start + 2, F.size(lines))
    stop = F.array_min(F.transform(after, lambda line, at: F.when(line.rlike(HEADING_LINE), at)))
    body = F.array_join(F.slice(after, 1, F.coalesce(stop, F.size(after))), "\n")
    joined = F.concat(tx.strip(inline), F.when(tx.strip(inline) != "", "\n").otherwise(""), body)
    return F.when(start.isNull(), "").otherwise(tx.strip(F.regexp_replace(joined, tx.PAGE_MARKER, "")))


def usable_title(title: Column, source: Column) -> Column:
    normal = tx.squeeze(tx.casefold(title))
    return (
        ~normal.isin(*GENERIC_TITLES) & (F.length(normal) >= 4) & (normal != tx.casefold(tx.stem(source)))
        & ~normal.startswith("microsoft word") & (F.regexp_count(title, F.lit(r"\p{L}{2,}")) >= 3)
    )


def usable_authors(authors: Column) -> Column:
    cleaned = F.filter(F.transform(authors, tx.squeeze), lambda a: a != "")
    joined = tx.casefold(F.array_join(cleaned, " "))
    only = F.get(cleaned, 0)
    letters = F.length(F.regexp_replace(only, r"[^\p{L}]", ""))
    weak = (F.size(cleaned) == 1) & ((letters < 4) | ((only == tx.casefold(only)) & ~F.contains(only, F.lit(" "))))
    return (F.size(cleaned) > 0) & ~joined.rlike("|".join(AUTHOR_TOOLS)) & ~F.coalesce(weak, F.lit(False))


def fallback_title(source: Column) -> Column:
    """The file stem in title case: every run of letters begins with a capital."""
    words = tx.strip(F.regexp_replace(tx.stem(source), r"[_-]+", " "))
    runs = F.regexp_extract_all(words, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def catalog_title(fields: Column) -> Column:
    """First filled title-like field, without what follows a separator dot or bar."""
    values = [F.when(tx.strip(F.try_element_at(fields, F.lit(k))) != "", tx.strip(F.try_element_at(fields, F.lit(k)))) for k in ("title", "citation", "paper", "name")]
    return F.coalesce(tx.strip(F.regexp_replace(F.coalesce(*values), r"\s*[·|]\s*.*$", "")), F.lit(""))


def catalog_authors(fields: Column) -> Column:
    """Names before the year of the first citation field that has one."""
    cited = F.filter(F.map_entries(fields), lambda e: F.contains(tx.casefold(e["key"]), F.lit("citation")) & e["value"].rlike(CITED_YEAR))
    prefix = F.regexp_replace(F.regexp_extract(F.get(cited, 0)["value"], r"^(.*?)" + CITED_YEAR, 1), r"[`*_~]", "")
    prefix = F.regexp_replace(prefix, r"^[ ,;·]+|[ ,;·]+$", "")
    names = F.filter(F.transform(F.split(prefix, r"(?i)\s*(?:&|\band\b|,)\s*"), tx.strip), lambda n: n != "")
    return F.coalesce(names, F.array().cast("array<string>"))


def topics(texts: DataFrame, limit: int = 16) -> DataFrame:
    """Most frequent words of each text but stop words, ties by first place.

    ``texts`` has ``(paper_id, text)``, one row per paper.
    """
    words = F.transform(F.regexp_extract_all("text", F.lit(TOPIC_WORD), F.lit(0)), lambda w: F.lower(w))
    counted = (
        texts.select("paper_id", F.posexplode(words).alias("place", "topic"))
        .where(~F.col("topic").isin(*STOP_WORDS))
        .groupBy("paper_id", "topic")
        .agg(F.count("*").alias("uses"), F.min("place").alias("place"))
    )
    order = Window.partitionBy("paper_id").orderBy(F.desc("uses"), F.asc("place"))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("place")
