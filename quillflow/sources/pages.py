"""Texts of documents: files, citation lines, and pages as arrays of words or texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import rx

MAX_FILE = 10 << 20


def pdf_files(spark: SparkSession, path: str, max_bytes: int = MAX_FILE) -> DataFrame:
    """path, length, content of the PDF files below a folder, none over the limit; the length
    is checked on the listing, before a file is read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.pdf")
        .option("recursiveFileLookup", "true")
        .load(path)
        .where(F.col("length") <= max_bytes)
        .select("path", "length", "content")
    )


def pdf_names(df: DataFrame, column: str, ignore_case: bool = False) -> DataFrame:
    """Rows whose file name ends in ``.pdf``."""
    name = F.lower(F.col(column)) if ignore_case else F.col(column)
    return df.where(name.endswith(".pdf"))


def upload_keys(df: DataFrame, column: str) -> DataFrame:
    """``uploads/<uuid>.<extension>`` for each file name."""
    extension = F.coalesce(rx.first(F.col(column), r"\.([^.]*)\z"), F.lit("pdf"))
    return df.withColumn("file_key", F.concat(F.lit("uploads/"), F.uuid(), F.lit("."), extension))


def _has_reference_shape(line: Column) -> Column:
    return rx.has(line, r"\b(19|20)\d{2}\b") & (F.length(rx.strip(line)) > 30)


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), rx.strip), lambda x: x != "")


def plausible_line(c: Column) -> Column:
    """Of several lines the first with a year and over 30 characters, else the whole text."""
    lines = _lines(c)
    return F.when(F.size(lines) > 1, F.coalesce(F.get(F.filter(lines, _has_reference_shape), F.lit(0)), c)).otherwise(c)


def is_multiple(c: Column) -> Column:
    """Whether a text holds several references, one a line."""
    lines = _lines(c)
    return (F.size(lines) > 1) & F.exists(lines, _has_reference_shape)


def whole_text(pages: Column) -> Column:
    """The texts of all pages that have one, each closed by a line feed."""
    texts = F.filter(F.transform(pages, lambda p: p["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.array_join(F.transform(texts, lambda t: F.concat(t, F.lit("\n"))), "")


def first_page(pages: Column) -> Column:
    return F.coalesce(F.get(pages, F.lit(0))["text"], F.lit(""))


def first_pages(pages: Column, n: int) -> Column:
    """The first pages, each under a numbered heading; empty ones are left out."""
    some = F.filter(F.slice(pages, 1, n), lambda p: F.coalesce(p["text"], F.lit("")) != "")
    return F.array_join(F.transform(some, lambda p: F.concat(F.lit("--- PÁGINA "), p["page_no"].cast("string"), F.lit(" ---\n"), p["text"], F.lit("\n"))), "")


def llm_input(text: Column, least: int = 100, most: int = 10000) -> Column:
    """What a model is asked about: null below ``least`` characters, cut above ``most``."""
    cut = F.concat(F.substring(text, 1, most), F.lit("\n" + P.TRUNCATED))
    return F.when(F.length(text) > most, cut).when(F.length(text) >= least, text)


def column_text(words: Column, width: Column, fallback: Column | None = None) -> Column:
    """A page's words in reading order.

    With over 50 words and over 20 on each side of the middle, the left column from top to
    bottom and then the right one; with over 50 words otherwise by line and place; else the
    plain text. Words of equal place keep their order.
    """
    def ordered(ws: Column, by_x: bool) -> Column:
        keyed = F.transform(
            ws,
            lambda w, i: F.struct(w["top"].alias("a"), (w["x0"] if by_x else F.lit(0.0)).alias("b"), i.alias("i"), w["text"].alias("t")),
        )
        return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["t"]), " ")

    left, right = F.filter(words, lambda w: w["x0"] < width / 2), F.filter(words, lambda w: w["x0"] >= width / 2)
    two = (F.size(left) > 20) & (F.size(right) > 20)
    both = F.concat(ordered(left, False), F.lit("\n"), ordered(right, False))
    found = F.when(F.size(words) > 50, F.when(two, both).otherwise(ordered(words, True)))
    return F.coalesce(rx.empty_to_null(found), fallback) if fallback is not None else rx.empty_to_null(found)


def without_blank_items(c: Column) -> Column:
    return F.filter(c, lambda x: F.length(rx.strip(x)) > 0)


def explode_references(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, pos, reference) of an array of references, blank ones left out."""
    return df.select(key, F.posexplode(without_blank_items(F.col(column))).alias("pos", "reference"))
