"""Quality rules: base rules for each document and cross-document line frequency.

Lines are normalised (lower case, one space for white space, digits as 0, trimmed) and hashed;
for every host the distinct documents with a line are counted. Documents with the same whole
text count as one, so exact copies of a document don't make its own text look like a frame that
many documents share. A line above the limit is removed from its host's documents, and a document
left with too few words is rejected. DataFrame functions only.

A line is above the limit at more than ``min_docs`` documents of its host, one of ``LONG_WORDS``
words or more already at more than ``min_docs_long``; neither depends on the host's size.

A table of each row's figures and line hashes is written, and the counting and the search for
lines above the limit run on hashes alone. Texts are shuffled only where the texts without those
lines are asked for, once, by host and text hash; hot groups of copies are left to Spark's split of
skewed joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, free_name, words_of, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_DOCS = 50
LONG_WORDS = 30
MIN_DOCS_LONG = 3
MIN_WORDS_LEFT = 10


def normalised(line: Column) -> Column:
    spaced = F.regexp_replace(F.lower(line), SPACE + "+", " ")
    return F.trim(F.regexp_replace(spaced, "[0-9]", "0"))


def lines_of(text: Column) -> Column:
    """The lines of a text that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))


def hashed_lines(text: str) -> Column:
    """(line_hash, n_words) of each line of a text that has a word, in order."""
    one = lambda x: F.struct(F.xxhash64(x).alias("line_hash"), F.size(F.split(x, " ")).alias("n_words"))
    return F.transform(F.transform(lines_of(F.col(f"`{text}`")), normalised), one)


def _above(rows: DataFrame, min_docs: int, share: float, min_docs_long: int) -> DataFrame:
    """(host, line_hash, n_docs) above the limit of rows with host, document and lines."""
    found = (
        rows.select("host", "document", F.explode(F.array_distinct("lines")).alias("line"))
        .select("host", "document", "line.line_hash", (F.col("line.n_words") >= LONG_WORDS).alias("is_long"))
        .groupBy("host", "line_hash", "is_long")
        .agg(F.count_distinct("document").alias("n_docs"))
        .where(F.col("n_docs") > F.when(F.col("is_long"), min(min_docs, min_docs_long)).otherwise(min_docs))
    )
    if share:
        totals = rows.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("total"))
        found = found.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n_docs") > share * F.col("total"))
    return found.select("host", "line_hash", "n_docs")


def frequent_lines(
    docs: DataFrame, text: str, host: str, min_docs: int = MIN_DOCS, share: float = 0, min_docs_long: int = MIN_DOCS_LONG
) -> DataFrame:
    """(host, line_hash, n_docs) of the lines above the limit.

    ``share`` asks for more than that part of the host's rows as well (0: no such limit).
    """
    rows = docs.select(
        F.col(f"`{host}`").alias("host"), F.xxhash64(F.col(f"`{text}`")).alias("document"), hashed_lines(text).alias("lines")
    )
    return _above(rows, min_docs, share, min_docs_long)


def measured(docs: DataFrame, text: str, host: str, keep: list[str]) -> DataFrame:
    """One row for each row: its number, the columns kept as a struct (if any), host, document
    (hash of the text), the base rules' figures and line hashes; a written table."""
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept_columns")] if keep else []
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        *kept,
        F.col(f"`{host}`").alias("host"),
        F.xxhash64(F.col(f"`{text}`")).alias("document"),
        F.col(f"`{text}`").alias("t"),
        hashed_lines(text).alias("lines"),
    )
    rows = rows.withColumns({"words": words_of(F.col("t")), "plain": lines_of(F.col("t"))})
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("hashes")
    grams = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))
    rows = rows.withColumn("grams", F.when(n >= WINDOW, grams))
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    placed = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(repeats, placed))
    same = F.filter(
        "placed",
        lambda x, k: ((k > 0) & (F.get("placed", k - 1)["g"] == x["g"]))
        | F.coalesce(F.get("placed", k + 1)["g"] == x["g"], F.lit(False)),
    )
    rows = rows.withColumn("at", F.sort_array(F.transform(same, lambda x: x["i"])))
    covered = F.zip_with(
        "at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(0))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))
    )
    return written(
        rows.select(
            "row",
            *(["kept_columns"] if keep else []),
            "host",
            "document",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.coalesce(F.regexp_count("t", F.lit("[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
            (F.size("plain") - F.size(F.array_distinct("plain"))).cast("long").alias("n_dup_lines"),
            F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
            "lines",
        ),
        "quality-rows",
    )


def assess(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    min_docs: int = MIN_DOCS,
    share: float = 0,
    min_words_left: int = MIN_WORDS_LEFT,
    keep: list[str] | None = None,
    min_docs_long: int = MIN_DOCS_LONG,
    with_text: bool = True,
) -> DataFrame:
    """The columns ``keep`` (all by default) of every row with n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, n_removed_lines, n_words_left, clean_text (the
    text without lines above the limit; left out, and no text shuffled, unless ``with_text``)
    and kept.

    Null texts have no words (and clean_text null); rows without a host are one host; repeated
    rows come back repeated and count as one document; an empty table gives no rows. Result
    columns whose name is taken get underscores in front.
    """
    keep = docs.columns if keep is None else keep
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    names = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_removed_lines", "n_words_left", *(["clean_text"] if with_text else []), "kept",
    ]
    out = {n: free_name(kept, n) for n in names}
    rows = measured(docs, text, host, [] if with_text else keep)
    found = written(_above(rows, min_docs, share, min_docs_long), "frequent-lines")
    found = found.select(F.col("host").alias("of"), F.col("line_hash").alias("hash"))
    hits = (
        rows.select(F.col("row").alias("hit"), "host", F.explode("lines").alias("line"))
        .select("hit", "host", "line.*")
        .join(found, F.col("host").eqNullSafe(F.col("of")) & (F.col("line_hash") == F.col("hash")))
        .groupBy("hit")
        .agg(
            F.count("*").alias("n_removed"),
            F.sum("n_words").alias("words_removed"),
            *([F.collect_set("hash").alias("frequent")] if with_text else []),
        )
    )
    rows = rows.drop("lines").join(hits, F.col("row") == F.col("hit"), "left")
    removed = F.coalesce("n_removed", F.lit(0))
    rows = rows.withColumns(
        {
            "n_removed_lines": removed.cast("long"),
            "n_words_left": (F.col("n_words") - F.coalesce("words_removed", F.lit(0))).cast("long"),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        }
    )
    depleted = (F.col("n_removed_lines") > 0) & (F.col("n_words_left") < min_words_left)
    rows = rows.withColumn("kept", ~F.col("base_failed") & ~depleted)
    if with_text:  # all figures are those of a host's text; the plan is the same at every size
        of_text = [c for c in rows.columns if c not in ("row", "hit", "host", "document")]
        figures = rows.groupBy("host", "document").agg(*[F.first(c).alias(c) for c in of_text])
        texts = docs.select(
            F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept_columns"),
            F.col(f"`{host}`").alias("h"),
            F.xxhash64(F.col(f"`{text}`")).alias("d"),
            F.col(f"`{text}`").alias("t"),
        )
        same_text = F.col("h").eqNullSafe(F.col("host")) & (F.col("d") == F.col("document"))
        rows = texts.join(figures.hint("shuffle_hash"), same_text)
        is_frequent = lambda x: F.array_contains("frequent", F.xxhash64(normalised(x)))
        left = F.filter(F.split("t", "\n"), lambda x: ~(x.rlike(WORD) & is_frequent(x)))
        rows = rows.withColumn("clean_text", F.when(F.col("frequent").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("t")))
    return rows.select("kept_columns.*", *[F.col(x).alias(out[x]) for x in names])


def apply_rules(docs: DataFrame, text: str = "text", host: str = "source", n_chars: str | None = None, **limits) -> DataFrame:
    """The documents kept, without the lines above the limit; the columns are those of docs.

    ``n_chars`` names a column that holds the length of the text and follows it.
    """
    judged = assess(docs, text, host, **limits)
    extra = judged.columns[len(docs.columns) :]
    kept, clean = extra[-1], extra[-2]
    columns = [F.col(f"`{clean}`").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if n_chars:
        columns = [
            F.length(F.col(f"`{clean}`")).cast(docs.schema[n_chars].dataType).alias(c) if c == n_chars else x
            for c, x in zip(docs.columns, columns)
        ]
    return judged.where(F.col(f"`{kept}`")).select(*columns)
