"""Predicates and classifiers on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import rx


def is_header(c: Column) -> Column:
    return rx.has(c, P.HEADERS, "iu")


def is_section(c: Column) -> Column:
    return rx.has(c, P.SECTIONS, "iu")


def is_reference_section(c: Column) -> Column:
    return rx.has(c, P.REF_SECTION_START, "iu")


def has_invalid_phrase(c: Column) -> Column:
    def any_of(upper: Column) -> Column:
        found = F.lit(False)
        for phrase in P.INVALID_PHRASES:
            found = found | upper.contains(phrase)
        return found

    return rx.let(F.upper(c), any_of)


def is_excluded_title(c: Column) -> Column:
    return rx.has(c, P.EXCLUDED_TITLES, "iu")


def only_numbers(c: Column) -> Column:
    return rx.has(c, P.ONLY_NUMBERS)


def only_short_upper(c: Column) -> Column:
    return rx.has(c, P.ONLY_UPPERCASE_SHORT)


def has_concatenated_words(c: Column) -> Column:
    return rx.has(c, P.HAS_CONCAT_WORDS)


def has_year(c: Column) -> Column:
    return rx.has(c, P.YEAR_FULL)


def is_reference(c: Column) -> Column:
    """Long enough, an author, a year with 20 characters behind it, and no other section."""
    return rx.let(rx.strip(c), _is_reference)


def _is_reference(c: Column) -> Column:
    behind = F.length(rx.strip(rx.after(c, P.YEAR_FULL)))
    author = rx.has(c, P.AUTHOR_SEARCH) | rx.has(c, P.AUTHOR_NO_COMMA)
    other = is_header(c) | is_section(c) | is_reference_section(c) | only_numbers(c) | only_short_upper(c)
    return (
        (F.length(c) >= 50) & has_year(c) & author & ~other & ~has_invalid_phrase(c) & (F.coalesce(behind, F.lit(0)) >= 20)
    )


def is_accepted_split(c: Column) -> Column:
    return (F.length(c) >= 50) & has_year(c) & ~has_invalid_phrase(c)


# What gives footers away in place of an abstract.
FOOTERS = [
    r"www\.\w+\.(org|com|edu|net|mx)",
    r"http[s]?://",
    r"Proyecto académico",
    r"sin fines de lucro",
    r"desarrollado bajo",
    r"redalyc",
    r"ArtPdfRed",
    r"\.(org|com|edu|net|mx)\s",
    r"^[A-Z][a-z]+\s+www\.",
]
# A part of each in letters that have no other case forms than their own two, as in small letters.
FOOTER_PARTS = ["www.", "http", "royecto acad", "de lucro", "arrollado bajo", "redalyc", "artpdfred", ".org", ".com", ".edu", ".net", ".mx"]


def is_abstract(c: Column) -> Column:
    """Ten words or more, no footer, few words that look like addresses."""
    return rx.let(c, _is_abstract)


def _is_abstract(c: Column) -> Column:
    def few(words: Column) -> Column:
        dotted = F.filter(words, lambda w: w.contains(".") & (F.length(w) < 20))
        return F.size(dotted) <= F.size(words) * 0.3

    def in_footer(low: Column) -> Column:
        found = F.lit(False)
        for part in FOOTER_PARTS:
            found = found | low.contains(part)
        return found & rx.has(c, "|".join(f"(?:{p})" for p in FOOTERS), "iu")

    ten = rx.has(c, rf"\A{rx.SPACE}*+(?:{rx.WORD}++{rx.SPACE}++){{9}}{rx.WORD}")
    # Ten words or more may have three with dots, so texts with three dots need no count.
    dots = F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    words = F.filter(F.split(c, rx.pattern(rx.SPACE + "+")), lambda w: w != "")
    good = (F.length(rx.strip(c)) >= 10) & ten & ~rx.let(F.lower(c), in_footer) & ((dots <= 3) | rx.let(words, few))
    return F.coalesce(good, F.lit(False))


def is_minimal_record(title: Column, authors: Column) -> Column:
    return title.isNotNull() | authors.isNotNull()


def llm_eligible(kind: Column, enabled: dict[str, bool]) -> Column:
    """Whether a document type goes to the model: reports, theses, books, chapters, each by
    its switch."""
    found = F.lit(False)
    for name in (P.REPORT, P.THESIS, P.BOOK, P.CHAPTER):
        if enabled.get(name, False):
            found = found | (kind == name)
    return F.coalesce(found, F.lit(False))


def zero_reference_message(text: Column, n_references: Column) -> Column:
    """Why a document gave no references; null where it gave some."""
    return F.when(
        n_references == 0,
        F.when(F.coalesce(rx.strip(text), F.lit("")) == "", "no text")
        .when(~rx.has(text, r"\b(?:references|referencias|bibliography|bibliografía|literature cited|works cited)\b", "iu"), "no references section")
        .when(~has_year(text), "no years")
        .otherwise("no reference accepted"),
    )
