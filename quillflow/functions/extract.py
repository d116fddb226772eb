"""Identifiers and years in any text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import rx

#: A year may lie at most so many years after ``as_of_year``.
YEARS_AHEAD = 2


def _checked(doi: Column) -> Column:
    """A DOI without trailing punctuation; null unless its suffix has five characters."""
    return rx.let(rx.strip_right(doi, ".,;:)"), lambda d: F.when(d.rlike(r"^10\.\d{4,}/[^/]{5}"), d))


def doi_from_url(c: Column) -> Column:
    return F.coalesce(_checked(rx.first(c, P.DOI_URL, 1, "i")), _checked(rx.first(c, P.DOI_HOST, 1, "i")))


def doi_from_label(c: Column) -> Column:
    return _checked(rx.first(c, P.DOI_LABEL, 1, "i"))


def doi_bare_longest(c: Column) -> Column:
    """The longest bare DOI with a dotted or an eight-character suffix; ties by text."""
    found = F.transform(rx.every(c, P.DOI_BARE, 1, "i"), lambda d: rx.strip_right(d, ".,;:)"))
    tail = lambda d: F.element_at(F.split(d, "/"), 2)
    good = F.filter(
        found,
        lambda d: (F.length(tail(d)) >= 5) & (tail(d).contains(".") | (F.length(tail(d)) >= 8)),
    )
    return F.array_max(F.transform(good, lambda d: F.struct(F.length(d).alias("n"), d.alias("d"))))["d"]


def doi_bare_raw(c: Column) -> Column:
    """The first longest bare match, if a suffix is left without its punctuation."""
    found = rx.every(c, P.DOI_BARE, 1, "i")
    best = F.array_max(F.transform(found, lambda d, i: F.struct(F.length(d).alias("n"), (-i).alias("i"), d.alias("d"))))
    return rx.let(rx.strip_right(best["d"], ".,;:)"), lambda d: F.when(d.rlike(r"^10\.\d{4,}/."), d))


def doi(c: Column) -> Column:
    def any_form(x: Column) -> Column:
        found = F.coalesce(doi_from_url(x), doi_from_label(x), doi_bare_longest(x), doi_bare_raw(x))
        return F.when(rx.has(x, r"10\.\d{4,}/"), found)  # a part of every form

    return rx.let(c, any_form)


def _last_year(c: Column, patterns: list[str], as_of_year: int) -> Column:
    """Of each pattern the year of the last match, the first that is plausible."""
    tiers = []
    for p in patterns:
        year = F.try_element_at(rx.every(c, p, 1, "m"), F.lit(-1)).cast("int")
        most = min(2100, as_of_year + YEARS_AHEAD)
        tiers.append(rx.let(year, lambda y: F.when(y.between(1900, most), y)))
    return F.coalesce(*tiers)


HEADER_YEARS = [rf":\s*\d+[{P.DASHES}]\d+,\s*(\d{{4}})", r",\s*(\d{4})\s*$"]


def year_from_header(c: Column, as_of_year: int) -> Column:
    """The year of a journal's running head anywhere in the text."""
    return _last_year(c, HEADER_YEARS, as_of_year)


def year(c: Column, as_of_year: int) -> Column:
    """The running head's year in the first 2000 characters, else the latest plausible year
    of the text, else its latest."""
    head = _last_year(F.substring(c, 1, 2000), [*HEADER_YEARS, r"Vol\.?\s*\d+[,\s]+(\d{4})"], as_of_year)
    years = F.transform(rx.every(c, r"\b(19\d{2}|20\d{2})\b"), lambda y: y.cast("int"))
    known = lambda ys: F.array_max(F.filter(ys, lambda y: y <= as_of_year + YEARS_AHEAD))
    return F.coalesce(head, rx.let(years, lambda ys: F.coalesce(known(ys), F.array_max(ys))))


def isbn_issn(c: Column) -> Column:
    issn = F.translate(rx.first(c, P.ISSN, 1, "i"), " -", "")
    found = F.coalesce(rx.first(c, P.ISBN, 1, "i"), rx.first(c, P.ISBN, 2, "i"))
    return F.when(rx.has(c, P.ISBN, "i"), found).otherwise(issn)


def link(c: Column) -> Column:
    return rx.first(c, P.URL, 0)
