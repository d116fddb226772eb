"""Fields of one citation string.

``compat`` (the default of every function that has it) keeps three habits of the results to
match: apostrophes quote titles, authors end at the first full stop with a space, and a title
after ``YYYY. `` or ``YYYY, `` loses its first sentence. ``compat=False`` mends them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract, normalize, predicates, rx
from . import patterns as P

FIELDS = [
    "doi",
    "ano",
    "isbn_issn",
    "autores",
    "titulo_original",
    "tipo_documento",
    "lugar_publicacion_entrega",
    "paginas",
    "volumen_edicion",
    "link",
]
MAX_YEAR = 2030
# Words before a year that make it part of the content.
_CONTENT_YEAR = r"(?:(?<=\A.{0,5})|(?<!(?i:año.{0,7}|year.{0,6}|desde.{0,5}|between.{0,3})))"


def clean(c: Column) -> Column:
    """The citation without outer white space and a leading heading."""
    return normalize.without_references_header(rx.strip(c))


def year_stated(c: Column) -> Column:
    """The year by its punctuation: ``(Y)``, ``Y;``, ``Y. X``, ``Y.``, ``Y,``; the first match
    of each form, if it is from 1900 to 2030."""
    tiers = []
    for p in (P.YEAR_PARENTHESIS, P.YEAR_SEMICOLON, P.YEAR_DOT_SPACE, P.YEAR_DOT, P.YEAR_COMMA):
        tiers.append(rx.let(rx.first(c, p).cast("int"), lambda y: F.when(y.between(1900, MAX_YEAR), y)))
    return F.coalesce(*tiers)


def year_anywhere(c: Column) -> Column:
    """The first year that no word such as ``year`` or ``between`` stands close before."""
    return rx.first(c, _CONTENT_YEAR + P.YEAR_FULL, 1, "s").cast("int")


def year(c: Column, as_of_year: int) -> Column:
    return F.coalesce(year_stated(c), year_anywhere(c), extract.year(c, as_of_year))


def _by_year(c: Column, patterns: list[str], cut) -> Column:
    """``cut(c, pattern)`` for the first of the patterns that matches."""
    return F.coalesce(*[cut(c, p) for p in patterns])


def authors_text(c: Column, compat: bool = True) -> Column:
    """What stands before the year, as far as it names authors."""
    order = [P.YEAR_PARENTHESIS, P.YEAR_SEMICOLON, P.YEAR_DOT, P.YEAR_COMMA, P.YEAR_FULL]
    end = r"\.\s+" if compat else rf"(?<![{P.UPPER}])\.\s+"

    def short(t: Column) -> Column:
        head = F.substring(t, 1, 150)
        comma = F.lit(150) - F.locate(",", F.reverse(F.rpad(head, 150, "."))) + 1
        return F.when((F.length(t) > 200) & (F.locate(",", head) > 1), rx.strip(F.substring(t, F.lit(1), comma))).otherwise(t)

    def first_sentence(t: Column) -> Column:
        other = predicates.is_reference_section(t) | predicates.is_section(t)
        return F.when(~other, F.coalesce(rx.strip(rx.before(t, end)), t))

    t = rx.let(rx.strip(_by_year(c, order, rx.before)), first_sentence)
    return normalize.author_connectors(rx.let(t, short))


def authors_named(t: Column) -> Column:
    """Authors in an author text: ``Name, I.`` forms, else ``Name I`` forms, else the text."""
    return normalize.text(rx.let(t, _named))


def _named(t: Column) -> Column:
    plain = F.transform(rx.every(t, P.AUTHOR_PLAIN), lambda a: rx.sub(a, "([a-z]+)\\s+([A-Z])", "$1, $2"))
    found = rx.let(rx.every(t, P.AUTHOR), lambda formal: F.when(F.size(formal) > 0, formal).otherwise(plain))
    listed = normalize.one_space(F.array_join(found, ", "))
    whole = normalize.one_space(normalize.without_references_header(rx.strip_right(t, ",. ")))
    loose = (F.locate(",", t) > 0) & (F.length(t) < 150) & rx.has(t, r"[A-Z][a-z]+,?\s*[A-Z]")
    whole = F.when(loose, rx.let(whole, lambda w: F.when(F.length(w) > 3, w)))
    return F.coalesce(rx.let(listed, lambda x: F.when(F.length(x) > 3, x)), whole)


def authors(c: Column, compat: bool = True) -> Column:
    return authors_named(authors_text(normalize.without_references_header(c), compat))


def title_place(c: Column, compat: bool = True) -> Column:
    """The text from where the title starts, by the year; null without a year."""
    order = [P.YEAR_PARENTHESIS, P.YEAR_SEMICOLON, P.YEAR_DOT_SPACE, P.YEAR_DOT, P.YEAR_COMMA]
    if not compat:
        order[2] = r"(\d{4})\.\s+(?=[A-Z])"

    def start(t: Column) -> Column:
        skipped = rx.sub(t, r"\A.*?\.\s", "", "s")
        if not compat:
            skipped = F.when(rx.has(c, P.YEAR_PARENTHESIS) | rx.has(c, P.YEAR_SEMICOLON), skipped).otherwise(t)
        return F.when(t.startswith("."), F.ltrim(t, F.lit(". "))).otherwise(skipped)

    return rx.let(rx.strip(_by_year(c, order, rx.after)), start)


def title_after_year(t: Column) -> Column:
    """The title at the start of a text: up to a journal with its volume, else a full stop."""
    found = rx.let(t, lambda x: rx.strip(F.coalesce(rx.before(x, P.JOURNAL_VOLUME), rx.before(x, r"\.\s"))))
    return rx.let(found, lambda x: F.when(F.length(x) > 10, x))


def title_quoted(c: Column, compat: bool = True) -> Column:
    return rx.first(c, P.TITLE_QUOTED if compat else '"(.+?)"')


def title(c: Column, compat: bool = True) -> Column:
    """As found, before normalisation."""
    return F.coalesce(title_quoted(c, compat), title_after_year(title_place(c, compat)))


def journal(c: Column, found_title: Column) -> Column:
    """Behind the title: ``. Name NN``; 4 to 59 characters without trailing punctuation."""
    behind = rx.strip(rx.let(found_title, lambda t: _behind(c, t)))
    name = rx.strip_right(rx.strip(rx.first(behind, P.JOURNAL_VOLUME)), ".,")
    return rx.let(name, lambda x: F.when((F.length(x) > 3) & (F.length(x) < 60), x))


def _behind(c: Column, found: Column) -> Column:
    at = F.position(found, c)
    return F.when(at > 0, F.substring(c, at + F.length(found), F.length(c)))


def pages(c: Column) -> Column:
    span = rf"(\d+[{P.DASHES}]\d+)"
    return F.coalesce(rx.first(c, r"pp?\.\s*" + span), rx.first(c, span), rx.first(c, r"pp?\.\s*(\d+)"))


def volume(c: Column) -> Column:
    n, issue = rx.first(c, r"(\d+)\((\d+)\)", 1), rx.first(c, r"(\d+)\((\d+)\)", 2)
    return F.coalesce(
        rx.first(c, r"[Vv]ol\.?\s*(\d+)"),
        rx.first(c, r"[Vv]olume\s*(\d+)"),
        rx.first(c, r"v\.\s*(\d+)"),
        F.concat(n, F.lit("("), issue, F.lit(")")),
    )


def book_title(c: Column) -> Column:
    """Of a chapter: what follows ``In: ... (Eds.)`` up to pages, place and year, or a number."""
    behind = rx.strip(rx.after(rx.after(c, P.IN_BOOK, "iu"), P.EDITORS, "iu"))
    return rx.let(rx.sub(behind, r"^[,\s]+", ""), _book_title)


def _book_title(c: Column) -> Column:
    tiers = [rx.before(c, p, "iu") for p in P.BOOK_TITLE_ENDS] + [rx.first(c, r"^(.+?)(?:\.\s+[A-Z]|pp\.)")]
    tiers = [rx.let(rx.strip_right(rx.strip(t), "."), lambda x: F.when(F.length(x) > 10, x)) for t in tiers]
    return F.coalesce(*tiers)


def is_chapter(c: Column) -> Column:
    return rx.has(c, P.IN_BOOK, "iu")


def parse_citations(df: DataFrame, column: str, as_of_year: int, compat: bool = True, prefix: str = "") -> DataFrame:
    """``df`` with the citation fields of ``column``; shared pieces are computed in stages."""
    t, place, found, named = (f"{prefix}__{x}" for x in ("text", "place", "title", "authors"))
    c = F.col(t)
    df = df.withColumn(t, clean(F.col(column)))
    df = df.withColumns({named: authors_text(c, compat), place: title_place(c, compat)})
    df = df.withColumn(found, F.coalesce(title_quoted(c, compat), title_after_year(F.col(place))))
    df = df.withColumn(f"{prefix}__journal", journal(c, F.col(found)))
    chapter, name = is_chapter(c), F.col(f"{prefix}__journal")
    df = df.withColumns(
        {
            prefix + "doi": extract.doi(c),
            prefix + "ano": year(c, as_of_year),
            prefix + "isbn_issn": extract.isbn_issn(c),
            prefix + "autores": authors_named(F.col(named)),
            prefix + "titulo_original": normalize.text(F.col(found)),
            prefix + "tipo_documento": F.when(chapter, P.CHAPTER).when(name.isNotNull(), P.ARTICLE),
            prefix + "lugar_publicacion_entrega": normalize.text(F.when(chapter, book_title(c)).otherwise(name)),
            prefix + "paginas": pages(c),
            prefix + "volumen_edicion": volume(c),
            prefix + "link": extract.link(c),
        }
    )
    return df.drop(t, place, found, named, f"{prefix}__journal")
