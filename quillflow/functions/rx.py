"""Regular-expression helpers with one dialect for all operators.

``(?Ud)`` gives ``\\s``, ``\\w``, ``\\d`` and ``\\b`` their Unicode meaning and makes only a line
feed end a line. No match is null, not the empty string.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space, with the four separators that Java leaves out.
SPACE = r"[\s\x1C-\x1F]"
WORD = r"[^\s\x1C-\x1F]"
#: The same characters one by one.
BLANKS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def pattern(p: str, flags: str = "") -> str:
    return f"(?Ud{flags}){p}"


def first(c: Column, p: str, group: int = 1, flags: str = "") -> Column:
    """Group of the first match, null if there is none or it is empty."""
    return empty_to_null(F.regexp_extract(c, pattern(p, flags), group))


def every(c: Column, p: str, group: int = 1, flags: str = "") -> Column:
    """Group of all matches from left to right."""
    return F.regexp_extract_all(c, F.lit(pattern(p, flags)), F.lit(group))


def has(c: Column, p: str, flags: str = "") -> Column:
    return c.rlike(pattern(p, flags))


def has_one(c: Column, parts: list[str], p: str, flags: str = "") -> Column:
    """``has``, for a pattern whose every match holds one of the parts: they are looked for first."""
    found = F.lit(False)
    for part in parts:
        found = found | c.contains(part)
    return found & has(c, p, flags)


def sub(c: Column, p: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(c, pattern(p, flags), by)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def strip_right(c: Column, chars: str) -> Column:
    return F.rtrim(c, F.lit(chars))


def let(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then(c)`` with ``c`` computed once, so that long chains don't grow with each use."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def before(c: Column, p: str, flags: str = "") -> Column:
    """The text before the first match; null if there is none (empty at the start)."""
    return F.get(every(c, rf"\A(.*?)(?:{p})", 1, "s" + flags), F.lit(0))


def after(c: Column, p: str, flags: str = "") -> Column:
    """The text after the first match; null if there is none."""
    group = re.compile(p).groups + 1
    return F.get(every(c, rf"\A.*?(?:{p})(.*)\z", group, "s" + flags), F.lit(0))


def empty_to_null(c: Column) -> Column:
    """``nullif`` computes its text twice wherever it can't be put in a projection of its own, so
    in branches and lambdas, and twice again at each level of them."""
    return let(c, lambda x: F.when(x != "", x))
