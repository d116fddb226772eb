"""Fields of a whole document's text and of its first page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import extract, normalize, predicates, rx
from . import patterns as P

HEAD = 2000  # characters in which a journal's running head is looked for
TITLE_LINES = 30
_NAME = f"[{P.UPPER}][{P.LOWER}]+"
# What a title line can't be, how author sections begin and end, author shapes.
NO_TITLE = r"^Vol\.?\s*\d+|^\d+:\s*\d+-\d+|MARINE ECOLOGY|JOURNAL OF|PROGRESS SERIES|PLOS ONE|©\s+|@.*\.(com|edu|org)|^RESEARCH ARTICLE|^REVIEW ARTICLE"
NO_AUTHOR = r"@.*\.(com|edu|org|ca|uk)|©\s+|Copyright|Inter-Research|Fisheries and Oceans"
AUTHOR_LABELS = [
    r"Author[s]?",
    r"Autores?",
    r"Equipo\s+de\s+Trabajo",
    r"Equipo",
    r"Investigador\s+Responsable",
    r"Investigador",
    r"Responsable",
    r"Coordinador",
    r"Director",
]
# Parts of the labels in letters that have no other case forms than their own two: a text without
# the part has no such label, and the whole text need not be searched by the label's expression.
AUTHOR_PARTS = ["author", "autor", "equ", "equ", "gador", "gador", "pon", "coord", "rector"]
ABSTRACT_PARTS = ["tract", "umen", "ummary"]
SECTION_END = r"\n\n|\nAbstract|\nSummary|\nKeywords|^Abstract|^Summary|\nResumen"
AUTHOR_LINES = [
    rf"^{_NAME}(?:\s+{_NAME})?,\s*[A-Z]\.",
    rf"^{_NAME}(?:\s+{_NAME})?,\s*[A-Z]",
    rf"^{_NAME}\s+[A-Z]\.",
    rf"^{_NAME}\s+[A-Z](?:\s|,|$)",
    rf"^{_NAME},\s*[A-Z]\.?\s*,\s*[A-Z]",
]
TITLE_WORDS = "ecosystem|case of|impact|study|analysis|evaluation"
ABSTRACTS = [
    r"Abstract[:\s]+(.+?)(?:\n\n|\nKeywords|\nIntroduction|\nResumen|\n1\.\s|^Keywords|^Introduction)",
    r"Resumen[:\s]+(.+?)(?:\n\n|\nPalabras|\nIntroducción|\n1\.\s|^Palabras|^Introducción)",
    r"SUMMARY[:\s]+(.+?)(?:\n\n|\nKeywords|\nIntroduction|\n1\.\s|^Keywords|^Introduction)",
]
KEYWORDS = [
    r"Keywords?[:\s]+(.+?)(?:\n\n|Abstract|Introduction|1\.|$)",
    r"Palabras\s+clave[:\s]+(.+?)(?:\n\n|Resumen|Introducción|1\.|$)",
    r"Palabras\s+claves?[:\s]+(.+?)(?:\n\n|Resumen|Introducción|1\.|$)",
    r"(?:\.|;)\s*(?:Palabras\s+claves?|Keywords?)[:\s]+(.+?)(?:\.|$)",
]
_JOURNAL, _PLACE = r"([A-Z][a-zA-ZáéíóúÁÉÍÓÚÑñ\s\.]+?)", r"([A-Z][a-zA-ZáéíóúÁÉÍÓÚÑñ\s]+?)"
JOURNAL_HEADS = [
    rf"^{_JOURNAL},\s*{_PLACE},\s*\d+:\s*\d+[{P.DASHES}]\d+,\s*\d{{4}}",
    rf"^{_JOURNAL}\s*,\s*{_PLACE}\s*,\s*\d+:",
]
JOURNAL_LABELS = [r"Published\s+in[:\s]+(.+?)(?:\n|,|\.)", r"Journal\s+of[:\s]+(.+?)(?:\n|,|\.)", r"Revista[:\s]+(.+?)(?:\n|,|\.)"]


def kind(first_page: Column) -> Column:
    """Report, thesis, book or chapter, article; null if no word gives it away."""
    return rx.let(F.struct(first_page.alias("t"), F.lower(first_page).alias("low")), _kind)


def _kind(s: Column) -> Column:
    low = s["low"]
    report = rx.has_one(low, ["informe", "report"], r"\b(?:informe\s+final|informe\s+técnico|technical\s+report|report\s+final)")
    report = report | rx.has_one(s["t"], ["INFORME"], r"INFORME\s+FINAL|INFORME\s+TÉCNICO")
    book = rx.has_one(low, ["libro", "book", "editorial", "publisher"], r"\b(?:libro|book|editorial|publisher)")
    return (
        F.when(report, P.REPORT)
        .when(rx.has_one(low, ["tesis", "thesis", "dissertation", "doctoral", "ph"], r"\b(?:tesis|thesis|dissertation|doctoral|ph\.?d\.?)"), P.THESIS)
        .when(book & rx.has(s["t"], P.IN_BOOK, "iu"), P.CHAPTER)
        .when(book, P.BOOK)
        .when(rx.has_one(low, ["journal", "revista", "article", "vol"], r"\b(?:journal|revista|article|vol\.|volume)"), P.ARTICLE)
    )


def _may_go_on(line: Column) -> Column:
    """Whether a line below a title can belong to it."""
    other = rx.has(line, P.AUTHOR_FULL) | rx.has(line, P.YEAR_SHORT) | line.contains("@")
    return (F.length(line) > 10) & ~other & ~F.lower(line).contains("doi:") & ~predicates.is_excluded_title(line)


def title(meta_title: Column, first_page: Column) -> Column:
    """The metadata's title, else the first line that can be one and the line it goes on in."""
    lines = F.transform(F.slice(F.split(F.coalesce(first_page, F.lit("")), "\n"), 1, TITLE_LINES), rx.strip)

    def good(x: Column) -> Column:
        other = x.contains("@") | rx.has(x, P.AUTHOR_FULL) | rx.has(x, P.YEAR_SHORT) | rx.has(x, NO_TITLE, "iu")
        short_doi = F.lower(x).contains("doi:") & (F.length(x) < 50)
        return F.length(x).between(31, 600) & ~other & ~short_doi & ~predicates.is_excluded_title(x)

    def joined(s: Column) -> Column:
        line = F.when(predicates.has_concatenated_words(s["x"]), normalize.spacing(s["x"])).otherwise(s["x"])
        return F.concat(line, F.when(_may_go_on(s["next"]), F.concat(F.lit(" "), s["next"])).otherwise(""))

    placed = rx.let(lines, lambda ls: F.zip_with(ls, F.slice(ls, 2, TITLE_LINES), lambda x, n: F.struct(x.alias("x"), n.alias("next"))))
    found = rx.let(F.get(F.filter(placed, lambda s: good(s["x"])), F.lit(0)), joined)
    return F.when(F.length(meta_title) > 10, meta_title).otherwise(found)


def authors_section(text: Column) -> Column:
    """Authors behind a label such as ``Authors:``, ten lines at most."""
    return normalize.text(rx.let(F.struct(text.alias("t"), F.lower(text).alias("low")), _behind_labels))


def _behind_labels(s: Column) -> Column:
    tiers = []
    for k, (label, part) in enumerate(zip(AUTHOR_LABELS, AUTHOR_PARTS)):
        end = SECTION_END if k < 2 else SECTION_END + r"|\nIntroducción"
        t = F.when(s["low"].contains(part), rx.strip(rx.first(s["t"], rf"{label}[:\s]+(.+?)(?:{end})", 1, "imsu")))
        t = F.array_join(F.slice(F.split(t, "\n"), 1, 10), "\n")
        t = rx.let(t, lambda x: F.when(~rx.has(x, NO_AUTHOR, "iu"), normalize.one_space(x)))
        tiers.append(rx.let(t, lambda x: F.when((F.length(x) > 5) & ~F.lower(x).startswith("abstract"), x)))
    return F.coalesce(*tiers)


def authors_lines(text: Column) -> Column:
    """Lines above the abstract that have the shape of authors."""
    above = rx.before(text, r"\n\s*Abstract|\n\s*Summary", "iu")

    def good(x: Column) -> Column:
        shape = rx.has(x, "|".join(AUTHOR_LINES))
        other = x.contains("@") | F.lower(x).contains("doi:") | rx.has(x, P.YEAR_SHORT) | predicates.is_excluded_title(x)
        titled = (F.length(x) > 50) & rx.has(F.lower(x), TITLE_WORDS)
        return F.length(x).between(11, 499) & shape & ~other & ~titled & ~rx.has(x, NO_AUTHOR, "iu")

    found = F.filter(F.transform(F.split(above, "\n"), rx.strip), good)
    return normalize.text(rx.strip_right(normalize.one_space(F.array_join(found, " ")), ",. "))


def authors(text: Column) -> Column:
    return F.coalesce(authors_section(text), authors_lines(text))


def abstract(text: Column) -> Column:
    """The first labelled abstract that is none of a footer; long ones are cut."""
    return normalize.text(rx.let(F.struct(text.alias("t"), F.lower(text).alias("low")), _labelled_abstract))


def _labelled_abstract(s: Column) -> Column:
    tiers = []
    for p, part in zip(ABSTRACTS, ABSTRACT_PARTS):
        found = normalize.one_space(F.when(s["low"].contains(part), rx.first(s["t"], p, 1, "imsu")))
        cut = rx.let(found, lambda x: F.when(predicates.is_abstract(x), normalize.truncated(x)))
        tiers.append(rx.let(cut, lambda x: F.when((F.length(x) > 50) & (F.length(x) <= 5020), x)))
    return F.coalesce(*tiers)


def keywords(text: Column) -> Column:
    tiers = []
    for p in KEYWORDS:
        found = normalize.keywords(rx.strip(rx.first(text, p, 1, "imsu")))
        tiers.append(rx.let(found, lambda x: F.when((F.length(x) > 5) & (F.length(x) < 500), x)))
    return F.coalesce(*tiers)


def journal(text: Column) -> Column:
    """``Journal, Place`` of a running head, else what follows a label."""
    head = F.substring(text, 1, HEAD)
    tiers = []
    for p in JOURNAL_HEADS:
        name, place = rx.strip(rx.first(head, p, 1, "m")), rx.strip(rx.first(head, p, 2, "m"))
        both = rx.let(
            F.struct(name.alias("name"), place.alias("place")),
            lambda s: F.when((F.length(s["name"]) < 100) & (F.length(s["place"]) < 100), F.concat(s["name"], F.lit(", "), s["place"])),
        )
        tiers.append(both)
    return normalize.text(F.coalesce(*tiers, *[rx.first(text, p, 1, "iu") for p in JOURNAL_LABELS]))


def pages(text: Column) -> Column:
    head, span = F.substring(text, 1, HEAD), rf"(\d+[{P.DASHES}]\d+)"
    return F.coalesce(
        rx.first(head, rf"\d+:\s*{span},\s*\d{{4}}"),
        rx.first(head, rf"pp\.?\s*{span}"),
        rx.first(head, rf"p\.?\s*{span}"),
        rx.first(text, rf"Pages?[:\s]+(\d+[{P.DASHES}]\d+|\d+)", 1, "iu"),
    )


def volume(text: Column) -> Column:
    head = F.substring(text, 1, HEAD)
    return F.coalesce(
        rx.first(head, rf"(\d+):\s*\d+[{P.DASHES}]\d+,\s*\d{{4}}"),
        rx.first(head, r"Vol\.?\s*(\d+)"),
        rx.first(text, r"Volume[:\s]+(\d+)", 1, "iu"),
        rx.first(text, r"Volumen[:\s]+(\d+)", 1, "iu"),
    )


def year_from_header(text: Column, as_of_year: int) -> Column:
    return extract.year_from_header(text, as_of_year)
