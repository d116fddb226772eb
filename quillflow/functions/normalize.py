"""Text normalisation: columns in, columns out, null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import rx


def spacing(c: Column) -> Column:
    """Spaces between a small and a capital letter, and between digits and letters."""
    return rx.sub(c, rf"([{P.LOWER}](?=[{P.UPPER}\d])|[{P.UPPER}](?=\d)|\d(?=[{P.UPPER}{P.LOWER}]))", "$1 ")


def author_comma(c: Column) -> Column:
    return rx.sub(c, f"([{P.UPPER}][{P.LOWER}]{{2,}}),([{P.UPPER}])", "$1, $2")


def author_list(c: Column) -> Column:
    return rx.sub(c, f"([{P.LOWER}]),([{P.UPPER}][{P.LOWER}]{{2,}})", "$1, $2")


def initials(c: Column) -> Column:
    return rx.sub(c, r"([A-Z])\.([A-Z])", "$1. $2")


def concatenated_words(c: Column) -> Column:
    return rx.sub(c, f"([{P.LOWER}])([{P.UPPER}][{P.LOWER}]{{3,}})", "$1 $2")


def one_space(c: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return rx.strip(rx.sub(c, rx.SPACE + "+", " "))


def text_spacing(c: Column) -> Column:
    """All of the above; ``spacing`` leaves no words that ``concatenated_words`` would part."""
    def commas(x: Column) -> Column:
        return F.when(rx.has(x, f",[{P.UPPER}]"), author_list(author_comma(x))).otherwise(x)

    return one_space(initials(rx.let(spacing(c), commas)))


def line_breaks(c: Column) -> Column:
    return rx.sub(c, r"\r\n?", "\n")


def without_running_heads(c: Column) -> Column:
    return rx.let(c, _without_running_heads)


def _without_running_heads(c: Column) -> Column:
    found = rx.let(F.lower(c), lambda low: low.contains("front") | low.contains("volume ") | low.contains("cle "))
    without = c
    for p in P.RUNNING_HEADS:
        without = rx.sub(without, p, "", "i")
    return F.when(found, without).otherwise(c)


def without_references_header(c: Column) -> Column:
    return rx.strip(rx.sub(c, r"^references\s+", "", "i"))


def without_garbage(c: Column) -> Column:
    for p in P.GARBAGE_PREFIXES:
        c = rx.strip(rx.sub(c, p, "", "i"))
    return c


def _decoded(c: Column, p: str) -> Column:
    """Each match's hexadecimal group as the character of that number."""
    parts = F.split(c, rx.pattern(p), -1)
    made = F.transform(
        rx.every(c, p), lambda h: F.decode(F.unhex(F.lpad(h, 4, "0")), "UTF-16BE")
    )
    joined = F.array_join(F.zip_with(parts, made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(rx.has(c, p), joined).otherwise(c)


def _text(c: Column) -> Column:
    def decoded(x: Column) -> Column:
        once = rx.let(x, lambda y: _decoded(y, "#_#x00([A-Fa-f0-9]{2})"))
        return F.when(x.contains("#x"), rx.let(once, lambda y: _decoded(y, "#x([A-Fa-f0-9]{2,4})"))).otherwise(x)

    c = rx.let(c, decoded)
    return rx.strip(rx.sub(one_space(c), r"[\x00-\x08\x0B-\x1F]", ""))


def text(c: Column) -> Column:
    """Decoded character codes, single spaces, no control characters; empty becomes null."""
    return rx.empty_to_null(_text(c))


def authors(c: Column) -> Column:
    """``family, I.`` of each author with a family name, comma-joined; null if none."""
    def one(a: Column) -> Column:
        given = F.filter(F.split(rx.strip(F.coalesce(a["given"], F.lit(""))), rx.pattern(r"\s+")), lambda x: x != "")
        short = F.array_join(F.transform(given, lambda x: F.concat(F.substring(x, 1, 1), F.lit("."))), "")
        return rx.strip(F.concat(a["family"], F.lit(", "), short))

    named = F.filter(c, lambda a: F.coalesce(a["family"], F.lit("")) != "")
    return rx.empty_to_null(F.array_join(F.transform(named, one), ", "))


def without_tags(c: Column) -> Column:
    return one_space(rx.sub(c, "<[^>]+>", ""))


def accents(c: Column) -> Column:
    """An accented letter that a semicolon follows, without it."""
    return rx.sub(c, "([áéíóúñÁÉÍÓÚÑ]);", "$1")


def truncated(c: Column, limit: int = 5000) -> Column:
    """Texts over the limit cut there, at the last space if it is in the last tenth."""
    return rx.let(c, lambda x: _truncated(x, limit))


def _truncated(c: Column, limit: int) -> Column:
    """Characters of a long text are counted once, to the limit; all else goes by bytes."""
    least = int(limit * 0.9)  # characters before a last space are more than these

    def shortened(cut: Column) -> Column:
        def at_space(behind: Column) -> Column:
            kept = F.octet_length(cut) - F.octet_length(behind) - 1
            short = F.substring(cut.cast("binary"), F.lit(1), kept).cast("string")
            return F.when(F.length(behind) < limit - 1 - least, short).otherwise(cut)

        ended = F.concat(rx.let(F.substring_index(cut, " ", -1), at_space), F.lit(P.TRUNCATED))
        return F.when(F.octet_length(cut) < F.octet_length(c), ended).otherwise(c)

    return rx.let(F.substring(c, 1, limit), shortened)


def cell(c: Column) -> Column:
    """A text that a spreadsheet cell can hold; empty becomes null."""
    c = rx.let(c.cast("string"), lambda x: F.when(F.length(x) > 32000, F.concat(F.substring(x, 1, 32000), F.lit(P.TRUNCATED))).otherwise(x))
    c = rx.sub(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    c = rx.sub(rx.sub(c, r"\r\n?", "\n"), r"\n{3,}", "\n\n")
    c = F.array_join(F.transform(F.split(c, "\n"), rx.strip), "\n")
    return rx.empty_to_null(rx.strip(rx.sub(c, " {3,}", "  ")))


def keywords(c: Column) -> Column:
    return rx.sub(one_space(rx.strip_right(c, ".,;")), r",\s*", ", ")


def author_connectors(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit(" and "), F.lit(", ")), F.lit(" y "), F.lit(", "))
    return rx.sub(c, r",?\s*et\s+al\.?", "")


def reference_start(c: Column) -> Column:
    """A reference from its first author on, without what stands before."""
    c = without_garbage(c)
    return rx.strip(rx.sub(c, f"^.*?(?={P.AUTHOR_SEARCH})", "", "s"))
