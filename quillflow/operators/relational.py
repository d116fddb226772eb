"""Relational operators on the bibliographic table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rx
from ..sources.schema import DOCUMENT, EXPORT_NAMES
from ..sources.shared import written


def page(df: DataFrame, skip: int = 0, limit: int = 1000, order: str = "id") -> DataFrame:
    """Rows of one page in a fixed order."""
    return df.orderBy(order).offset(skip).limit(limit)


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def largest(df: DataFrame, column: str = "numero_doc") -> DataFrame:
    return df.agg(F.max(column).alias(column))


def assign_numbers(new: DataFrame, existing: DataFrame, order: list[str], column: str = "numero_doc") -> DataFrame:
    """New rows with consecutive numbers above the largest existing one, in order.

    Rows are range-partitioned, sorted and written once with their range and place there, so
    that counts and numbers stand on the same ranges; a range's numbers start behind the sum of
    those before it, and no task holds more than its range. Of the ranges alone, a row for
    each, are sums made in one task and broadcast. Rows equal in ``order`` get numbers in any
    order, nulls come first; an empty table gives no rows; ``column`` replaces one of that name.
    """
    own = [c for c in new.columns if c != column]
    part, at = (next(n for n in ("_" * k + x for k in range(1, 99)) if n not in own) for x in ("range", "at"))
    keys = [F.col(f"`{c}`") for c in order]
    ranged = new.select(*[F.col(f"`{c}`") for c in own]).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(ranged.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "numbered-ranges")
    counts = placed.groupBy(F.col(part).alias("r")).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("r"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    top = existing.agg(F.coalesce(F.max(column), F.lit(0)).alias("top"))
    shifts = starts.join(top).select(F.col("r").alias(part), (F.col("shift") + F.col("top")).alias(f"{at}_shift"))
    numbered = placed.join(F.broadcast(shifts), part)
    number = (F.col(at) + F.col(f"{at}_shift")).cast(existing.schema[column].dataType)
    return numbered.select(*[F.col(f"`{c}`") for c in own], number.alias(column))


def job_documents(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Every job with its document, if it has one."""
    docs = documents.select(*[F.col(c).alias(f"doc_{c}") for c in documents.columns])
    return jobs.join(docs, F.col("document_id") == F.col("doc_numero_doc"), "left")


def unreferenced(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Jobs whose document does not exist."""
    return jobs.where("document_id is not null").join(documents, F.col("document_id") == F.col("numero_doc"), "left_anti")


def count_rows(**tables: DataFrame) -> DataFrame:
    """(name, n) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def cleared(df: DataFrame) -> DataFrame:
    """An empty table of the same columns, to overwrite with."""
    return df.where(F.lit(False))


def without_blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.length(rx.strip(F.col(column))) > 0)


def partitioned(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that succeeded and rows that did not."""
    good = F.coalesce(ok, F.lit(False))
    return df.where(good), df.where(~good)


def aligned(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The listed columns in order; missing ones are null."""
    kinds = {f.name: f.dataType for f in DOCUMENT.fields}
    names = columns or DOCUMENT.fieldNames()
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names])


def export_frame(df: DataFrame) -> DataFrame:
    """The 20 export columns under their headings, by document number."""
    ordered = aligned(df, list(EXPORT_NAMES)).orderBy("numero_doc")
    return ordered.select(*[F.col(c).alias(h) for c, h in EXPORT_NAMES.items()])


def length_violations(df: DataFrame) -> DataFrame:
    """(numero_doc, column_name, n) of texts longer than their column may hold."""
    from ..sources.schema import MAX_LENGTHS

    checks = F.array(*[F.struct(F.lit(c).alias("column_name"), F.length(c).alias("n"), F.lit(m).alias("most")) for c, m in MAX_LENGTHS.items()])
    return df.select("numero_doc", F.explode(checks).alias("x")).where("x.n > x.most").select("numero_doc", "x.column_name", "x.n")
