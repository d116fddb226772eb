"""From a document's text to its single references.

Matches are marked with a character that texts don't hold and the text is split there, so a
document's references are one array, without self-joins, and become rows by one explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize, predicates, rx, tei
from ..functions import patterns as P

MARK = "\x01"


def reference_section(text: Column, pages: Column | None = None) -> Column:
    """The normalised text behind the first heading word; if under 100 characters are there,
    the last three pages, else the whole text."""
    enough = lambda c: rx.let(c, lambda x: F.when(F.length(rx.strip(x)) >= 100, x))
    heading = r"\breferences\b"
    tail = normalize.text_spacing(text)
    if pages is not None:
        last = F.array_join(F.slice(pages, F.greatest(F.size(pages) - 2, F.lit(1)), 3), "\n")
        tail = F.when(F.size(pages) > 2, normalize.text_spacing(last)).otherwise(tail)
    return F.coalesce(
        enough(rx.after(normalize.text_spacing(text), heading, "iu")),
        enough(normalize.text_spacing(rx.after(text, heading, "iu"))),
        tail,
    )


def without_end_sections(c: Column) -> Column:
    """Cut at the earliest closing section; a text that starts with one stays whole."""
    return rx.let(c, _cut)


def _cut(c: Column) -> Column:
    def first(upper: Column) -> Column:
        places = F.array(*[F.locate(k, upper) for k in P.END_SECTIONS])
        return F.array_min(F.filter(places, lambda p: p > 0))

    at = rx.let(F.upper(c), first)
    return rx.let(at, lambda n: F.when(n > 1, F.substring(c, F.lit(1), n - 1)).otherwise(c))


def _by_starts(c: Column, p: str) -> Column:
    """Pieces from each start to the next, over 50 characters; null below two starts."""

    def kept(pieces: Column) -> Column:
        behind = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), rx.strip)
        return F.when(F.size(pieces) > 2, F.filter(behind, lambda x: F.length(x) > 50))

    found = rx.let(F.split(rx.sub(c, p, f"$1{MARK}$2"), MARK), kept)
    return rx.let(found, lambda x: F.when(F.size(x) > 0, x))


def by_full_start(c: Column) -> Column:
    return _by_starts(c, P.REF_START_FULL)


def by_simple_start(c: Column) -> Column:
    return _by_starts(c, P.REF_START_SIMPLE)


def by_year(c: Column) -> Column:
    """Pieces that end in a year, over 50 characters; what is behind the last year goes."""
    pieces = F.split(rx.sub(c, P.REF_SPLIT_YEAR, f"$1{MARK}"), MARK)
    ended = rx.let(pieces, lambda x: F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))))
    return F.filter(F.transform(ended, rx.strip), lambda x: F.length(x) > 50)


def starts_reference(line: Column) -> Column:
    """Whether a line begins a new reference: author and year, several authors and a year, or
    a number."""
    author = rx.has(line, P.AUTHOR_SEARCH)
    full = predicates.has_year(line) & ~rx.has(line, P.AUTHOR_YEAR_RANGE) & rx.has(line, P.AUTHOR_COMMA_INITIAL)
    several = rx.has(line, P.AUTHOR_MULTIPLE_COMMA)
    return F.when(author, full).when(several, predicates.has_year(line)).otherwise(rx.has(line, P.REF_NUMBERED))


def by_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, reference): lines gathered to references over 50 characters.

    A blank line, a heading or a line that begins a reference closes the one before. Groups
    are one document's lines.
    """
    lines = df.select(key, F.posexplode(F.transform(F.split(normalize.line_breaks(F.col(text)), "\n"), rx.strip)).alias("pos", "line"))
    line = F.col("line")
    blank = (line == "") | predicates.is_reference_section(line)
    noise = predicates.is_header(line) | predicates.is_section(line)
    lines = lines.where(~(noise & (line != ""))).select(
        key, "pos", "line", blank.alias("blank"), (blank | F.coalesce(starts_reference(line), F.lit(False))).alias("opens")
    )
    order = Window.partitionBy(key).orderBy("pos")
    grouped = lines.withColumn("part", F.sum(F.col("opens").cast("int")).over(order)).where("not blank and length(line) > 3")
    found = grouped.groupBy(key, "part").agg(
        F.min("pos").alias("pos"),
        normalize.one_space(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), " ")).alias("reference"),
    )
    return found.where("length(reference) > 50").select(key, "pos", "reference")


#: An author, more of them, and the year behind the last.
_ONE = r"\p{Lu}[\p{L}'’-]+,? (?:\p{Lu}\.[ -]?)+"
_LIST = rf"(?=\p{{Lu}})(?:^|(?<=[\s.;]))((?:{_ONE}(?:(?:, ?|,? ?(?:and|&|y) ){_ONE})*),? ?(?:\((?:19|20)\d\d[a-z]?\)|(?:19|20)\d\d[a-z]?\b))"


def by_author_year(c: Column) -> Column:
    """Pieces that start with a list of authors and their year, over 50 characters; null
    where none does. What is before the first is no reference."""
    pieces = F.split(rx.sub(c, _LIST, f"{MARK}$1"), MARK)
    behind = rx.let(pieces, lambda x: F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))))
    found = F.filter(F.transform(behind, rx.strip), lambda x: F.length(x) > 50)
    return rx.let(found, lambda x: F.when(F.size(x) > 0, x))


def split_references(c: Column, compat: bool = True) -> Column:
    """The single references in a section's text as an array.

    With ``compat`` running heads go to the end of the (single) line and references are found
    by the starts known there, as the results to match have it; a reference whose end no start
    fits is then cut at its year. Without, heads go before lines are joined and each reference
    is whole, from its authors and year to the next; texts without such starts take the others.
    """
    c = normalize.line_breaks(c)
    flat = normalize.without_running_heads(normalize.text_spacing(c)) if compat else normalize.text_spacing(normalize.without_running_heads(c))

    def parts(x: Column) -> Column:
        if not compat:
            return F.coalesce(by_author_year(x), compat_parts(x))
        return compat_parts(x)

    def compat_parts(x: Column) -> Column:
        whole = F.when(F.length(x) > 50, F.array(x)).otherwise(F.expr("cast(array() as array<string>)"))
        return F.when(F.length(x) > 500, F.coalesce(by_full_start(x), by_simple_start(x), by_year(x))).otherwise(whole)

    return rx.let(flat, parts)


def accepted(refs: Column, from_author: bool = True) -> Column:
    """References from their first author on that have a year and no excluded phrase."""
    starts = F.transform(refs, normalize.reference_start) if from_author else refs
    return F.filter(starts, predicates.is_accepted_split)


def extract_references(df: DataFrame, key: str, text: str, tei_refs: str | None = None, compat: bool = True) -> DataFrame:
    """(key, pos, reference): from TEI if its quality is good, else from the text."""
    section = without_end_sections(reference_section(F.col(text)))
    staged = df.withColumn("__section", section)
    refs = accepted(split_references(F.col("__section"), compat), compat)
    if tei_refs is not None:
        refs = F.when(tei.good_quality(F.col(tei_refs)), F.transform(F.col(tei_refs), tei.as_text)).otherwise(refs)
    return staged.select(key, F.posexplode(refs).alias("pos", "reference"))
