"""Text functions as Column expressions: folding, tokens, slugs and clean-up.

Everything here stays in the JVM.  Character tables are derived from Unicode by
rule rather than listed.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide what a token is.
INDEX_TOKEN = r"[\p{L}\p{N}]+"
QUERY_TOKEN = r"[\p{L}\p{N}]+(?:[_'’\-][\p{L}\p{N}]+)*"
FEATURE_TOKEN = r"[\p{L}\p{N}_]+(?:[-+][\p{L}\p{N}_]+)*"
COUNT_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
PAGE_MARKER = r"(?i)<!--\s*page\s*:\s*\d+\s*-->"
PAGE_LINE = r"(?i)^\s*<!--\s*page\s*:\s*(\d+)\s*-->\s*$"
NOT_ASCII = r"[^\x00-\x7F]"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
DIGITS = "0123456789"


@lru_cache(maxsize=None)
def _accent_table() -> tuple[str, str]:
    """Latin letters that decompose to a bare letter plus marks, and those letters."""
    source, target = [], []
    for low, high in ((0xC0, 0x250), (0x1E00, 0x1F00)):
        for code in range(low, high):
            char = chr(code)
            base, *marks = unicodedata.normalize("NFD", char)
            if marks and all(unicodedata.combining(m) for m in marks) and char == char.lower():
                source.append(char)
                target.append(base)
    marks = "".join(chr(code) for code in range(0x300, 0x370))
    return "".join(source) + marks, "".join(target)


@lru_cache(maxsize=None)
def _ascii_forms() -> tuple[tuple[str, str], ...]:
    """Characters of all planes whose compatibility form keeps ASCII characters, with those."""
    pairs = []
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x20000)):
        kept = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if kept.strip():
            pairs.append((chr(code), kept))
    return tuple(pairs)


@lru_cache(maxsize=None)
def _ascii_table() -> tuple[str, str]:
    """Those of the first plane that keep one character."""
    single = [(c, kept) for c, kept in _ascii_forms() if len(kept) == 1 and c < "\U00010000"]
    return "".join(c for c, _ in single), "".join(kept for _, kept in single)


@lru_cache(maxsize=None)
def _long_forms() -> tuple[tuple[str, str], ...]:
    """The others: several characters, or a letter of another plane."""
    return tuple((c, kept) for c, kept in _ascii_forms() if len(kept) > 1 or c >= "\U00010000")


def _ranges(characters) -> str:
    """A character class of the given characters."""
    out, codes = [], sorted(map(ord, characters))
    first = last = codes[0]
    for code in [*codes[1:], None]:
        if code != last + 1:
            out.append(f"\\x{{{first:x}}}-\\x{{{last:x}}}")
            first = code
        last = code
    return "[" + "".join(out) + "]"


def once(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def casefold(text: Column) -> Column:
    """Lower case with the two foldings that differ in European text."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def fold_marks(text: Column) -> Column:
    """Lower case without diacritics: the form the full-text index stores."""
    # Only texts beyond ASCII are looked through letter by letter.
    return once(F.lower(text), lambda low: F.when(low.rlike(NOT_ASCII), F.translate(low, *_accent_table())).otherwise(low))


def index_tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold_marks(text), F.lit(INDEX_TOKEN), F.lit(0))


def query_words(text: Column) -> Column:
    """Distinct folded query tokens; a joined token later becomes a phrase of its parts."""
    return F.array_distinct(F.regexp_extract_all(casefold(text), F.lit(QUERY_TOKEN), F.lit(0)))


def feature_tokens(text: Column) -> Column:
    return F.regexp_extract_all(casefold(text), F.lit(FEATURE_TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """Word and punctuation tokens outside page markers."""
    unmarked = once(text, lambda held: F.when(held.contains("<!--"), F.regexp_replace(held, PAGE_MARKER, "")).otherwise(held))
    return F.regexp_count(unmarked, F.lit(COUNT_TOKEN))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def strip(text: Column) -> Column:
    """Text without white space at its ends; like ``$``, the end may lie before a last line break beyond ASCII."""
    def cut(held):
        odd = held.endswith("\u0085") | held.endswith("\u2028") | held.endswith("\u2029")
        return F.when(odd, F.regexp_replace(held, r"^\s+|\s+$", "")).otherwise(F.btrim(held, F.lit(" \t\n\x0b\f\r")))

    return once(text, cut)


def more_words(text: Column, count: int) -> Column:
    """Whether a text has more than so many words; no word after the next one is looked at."""
    return text.rlike(rf"^\s*+(?:\S++\s++){{{count}}}\S")


def normalize_math(text: Column) -> Column:
    """``G^{1}``, ``C 1`` and superscripts become ``G1`` and ``C1``; spaces collapse."""
    value = once(text, lambda held: F.when(held.rlike(f"[{SUPERSCRIPTS}]"), F.translate(held, SUPERSCRIPTS, DIGITS)).otherwise(held))
    value = F.regexp_replace(value, r"(?iU)\b([CG])\s*\^\s*\{?([0-9])\}?\b", "$1$2")
    value = F.regexp_replace(value, r"(?iU)\b([CG])\s+([0-9])\b", "$1$2")
    return squeeze(value)


def clean_markdown(text: Column) -> Column:
    """Repair TeX control glyphs, drop other control characters, unify line ends."""
    def repaired(value):
        value = F.translate(value, "\x15\x16", "–—")
        # TeX T1 ligature slots.
        for slot, letters in (("\x1b", "ff"), ("\x1c", "fi"), ("\x1d", "fl"), ("\x1e", "ffi"), ("\x1f", "ffl")):
            value = F.replace(value, F.lit(slot), F.lit(letters))
        value = F.regexp_replace(value, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
        return F.regexp_replace(value, r"\r\n?", "\n")

    clean = once(text, lambda held: F.when(held.rlike(r"[\x00-\x08\x0B-\x1F]"), repaired(held)).otherwise(held))
    return F.concat(strip(clean), F.lit("\n"))


# What plain text of a scanned page may not begin with, and the label put before it.
SCAN_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SCAN_MARKUP = r"(?i)^(?:#{1,6}\s|`{3,}|~{3,}|<!--\s*page\s*:)"
SCAN_STATEMENT = r"(?i)^(?:theorem|lemma|proposition|corollary|definition|proof)\b"
SCAN_LABEL = "OCR text: "
SCAN_SYMBOL = "OCR symbol: "


def scanned_page(text: Column, page: Column) -> Column:
    """Plain text of one scanned page as a section that no later page can fall into."""
    def safe(line):
        value = F.replace(strip(line), F.lit("$$"), F.lit("$ $"))
        value = F.regexp_replace(F.regexp_replace(value, r"^\\\[", "["), r"^\\begin\{", "begin{")
        value = F.when(value.isin("[", "]"), F.concat(F.lit(SCAN_SYMBOL), value)).otherwise(value)
        value = F.when(value.rlike(SCAN_MARKUP), F.concat(F.lit(SCAN_LABEL), value)).otherwise(value)
        return F.when(value.rlike(SCAN_STATEMENT), F.concat(F.lit(SCAN_LABEL), value)).otherwise(value)

    body = F.array_join(F.transform(F.split(text, SCAN_LINE_END), safe), "\n")
    return strip(F.concat(F.lit("# OCR page "), page.cast("string"), F.lit("\n\n"), strip(body)))


def to_ascii(text: Column) -> Column:
    """What compatibility forms keep of a text in ASCII; texts without long forms skip their table."""
    forms = _long_forms()
    table = F.map_from_arrays(F.split(F.lit("\n".join(c for c, _ in forms)), "\n"), F.split(F.lit("\n".join(kept for _, kept in forms)), "\n"))
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    value = F.when(text.rlike(_ranges(c for c, _ in forms)), spelled).otherwise(text)
    value = F.translate(value, *_ascii_table())
    return F.regexp_replace(value, r"[^\x00-\x7F]", "")


def slug(text: Column, max_length: int = 96) -> Column:
    if max_length < 12:
        raise ValueError("max_length must be at least 12")
    value = F.regexp_replace(F.lower(to_ascii(text)), r"[^a-z0-9]+", "-")
    value = F.regexp_replace(value, r"^-+|-+$", "")
    return F.regexp_replace(F.substring(value, 1, max_length), r"-+$", "")


def clean_cell(text: Column) -> Column:
    value = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")
    value = F.regexp_replace(value, r"<br(?:/| /)?>", "; ")
    value = F.regexp_replace(value, r"[`*~]", "")
    return squeeze(value)


def record_slug(text: Column) -> Column:
    value = F.regexp_replace(casefold(clean_cell(text)), r"[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(value, r"^-+|-+$", ""), 1, 120)


def artifact_path(text: Column) -> Column:
    value = F.regexp_replace(F.trim(text), r"\\", "/")
    value = F.regexp_replace(value, r"^(?:\./)+", "")
    return F.regexp_replace(F.regexp_replace(value, r"/(?:\./)+", "/"), r"/{2,}", "/")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is not a suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def page_label(start: Column, end: Column) -> Column:
    return (
        F.when(start.isNull(), F.lit("unknown"))
        .when(end.isNull() | (end == start), start.cast("string"))
        .otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))
    )


def split_authors(text: Column) -> Column:
    """``;`` and ``and`` always separate; commas only between full names."""
    parts = F.split(text, r"(?i)\s*(?:;|\band\b)\s*")
    commas = F.filter(F.transform(F.split(text, ","), strip), lambda p: p != "")
    full_names = (F.size(commas) > 1) & F.forall(commas, lambda p: F.regexp_count(p, F.lit(r"\S+")) >= 2)
    chosen = F.when((F.size(parts) == 1) & full_names, commas).otherwise(parts)
    cleaned = F.filter(F.transform(chosen, strip), lambda p: p != "")
    return F.coalesce(cleaned, F.array().cast("array<string>"))


def strip_emphasis(text: Column) -> Column:
    """Remove balanced outer emphasis, as many rounds as there are marks at the start."""
    value = strip(text)
    marks = F.regexp_extract(value, r"^[*_`\s]*", 0)
    rounds = F.sequence(F.lit(0), F.length(marks))
    return F.aggregate(rounds, value, lambda held, _: strip(F.regexp_replace(held, r"^(\*\*|__|`|\*|_)(.+)\1$", "$2")))


def clean_heading(text: Column) -> Column:
    value = strip(F.regexp_replace(text, r"\s+#+\s*$", ""))
    value = strip(F.regexp_replace(value, r"\s+\{#[^}]+\}\s*$", ""))
    return strip_emphasis(value)


def find_year(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1)
    return F.when(found != "", found.cast("int"))


def family_slug(authors: Column) -> Column:
    """Slug of the first author that has a family name."""
    names = F.transform(
        authors,
        lambda a: F.try_element_at(
            F.regexp_extract_all(F.split(a, ",")[0], F.lit("[A-Za-zÀ-ÖØ-öø-ÿ0-9]+"), F.lit(0)), F.lit(-1)
        ),
    )
    return F.coalesce(slug(F.get(F.filter(names, lambda n: n.isNotNull()), 0), 32), F.lit(""))
