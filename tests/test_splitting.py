"""Splitting one long line into references against a walk over the matches in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillflow.functions import patterns as P
from quillflow.operators import split

PARTS = [
    "Perez, J.", "Gómez, A.", "Li, B.", "Ñato,C.", "O'Brien, M.", " (2009). ", " (1998) ", ", 1997. ", " 2003, ", ". ", ") ", "). ",
    "doi:10.1/ab.c ", ".doi:10.2/x  ", "12–19. ", "347–360 ", "12-19. ", "2004).", " and ", " A study of the catch of many stocks in the cold southern waters ",
    "Title of it", " J. Mar. Syst. 3", "  ",
]


def texts(n=150, seed=8):
    rng = random.Random(seed)
    made = ["".join(rng.choices(PARTS, k=rng.randint(1, 70))) for _ in range(n)]
    return [*made, "", None, "Perez, J.", "x" * 51, "x" * 50, "word " * 120, "word " * 98 + " 1999. tail", " (1999)" * 80]


def by_starts(text, pattern):
    at = [m.start(2) for m in re.finditer(pattern, text)]
    if len(at) < 2:
        return None
    found = [text[a:b].strip() for a, b in zip(at, [*at[1:], len(text)])]
    return [f for f in found if len(f) > 50] or None


def by_year(text):
    found, last = [], 0
    for m in re.finditer(P.REF_SPLIT_YEAR, text):
        found.append(text[last : m.end()].strip())
        last = m.end()
    return [f for f in found if len(f) > 50]


@pytest.mark.parametrize(
    "make,want",
    [
        (split.by_full_start, lambda t: by_starts(t, P.REF_START_FULL)),
        (split.by_simple_start, lambda t: by_starts(t, P.REF_START_SIMPLE)),
        (split.by_year, by_year),
    ],
)
def test_pieces(spark, make, want):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "k long, t string")
    got = {r["k"]: r["p"] for r in df.select("k", make(F.col("t")).alias("p")).collect()}
    assert got == {i: None if t is None else want(t) for i, t in enumerate(texts())}
    assert sum(bool(p) for p in got.values()) > 20


def test_compat_split(spark):
    """One line: starts, then simple starts, then years; short lines whole if over 50."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(200, 9))], "k long, t string")
    flat = df.select("k", "t", split.normalize.without_running_heads(split.normalize.text_spacing(split.normalize.line_breaks(F.col("t")))).alias("flat"), split.split_references(F.col("t")).alias("p"))
    tried = set()
    for r in flat.collect():
        line = r["flat"]
        if line is None:
            assert r["p"] == []
            continue
        if len(line) > 500:
            ways = [("full", by_starts(line, P.REF_START_FULL)), ("simple", by_starts(line, P.REF_START_SIMPLE)), ("year", by_year(line))]
            way, want = next((w, p) for w, p in ways if p is not None)
            tried.add(way)
        else:
            want = [line] if len(line) > 50 else []
        assert r["p"] == want, r["t"]
    assert {"full", "year"} <= tried
