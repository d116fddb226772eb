"""Stored tables that several jobs change by key, and numbers that several jobs draw.

A change is a folder of rows; renaming it to the next version is the commit, and only one writer
gets a version. Readers take the last compacted table and, for each key, the last change after
it. Nothing that a broken writer leaves is read, and older versions stay readable.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import assign_numbers
from .shared import dropped, folders, publish, written

DELETED = "deleted"


class Conflict(RuntimeError):
    """The table has changed since the version that a change was made from."""


def latest(spark: SparkSession, path: str) -> int:
    """The number of the last change; 0 where there is none."""
    return max(folders(spark, path, "version"), default=0)


def _committed(rows: DataFrame, path: str, name: str, number: Callable[[], int | None]) -> int | None:
    """Writes rows once and renames them to the number that is next, until one is free; None, and
    nothing left, where there is no number to take."""
    spark, temporary = rows.sparkSession, f"{path}/_temporary-{uuid.uuid4().hex}"
    rows.write.parquet(temporary)
    while (n := number()) is not None:
        if publish(spark, temporary, f"{path}/{name}={n}"):
            return n
    dropped(spark, temporary)
    return None


def change(rows: DataFrame, path: str, deleted: bool = False, expect: int | None = None) -> int:
    """Commits rows that replace those of their keys (or delete them); gives the new version.

    Without ``expect`` a later commit wins; with it the change counts only as the one after that
    version, else Conflict is raised and nothing is left. Of rows with one key in one change the
    greatest counts; an empty change is a version of its own. All changes have the same columns.
    """
    spark = rows.sparkSession

    def number() -> int | None:
        n = latest(spark, path) + 1
        return n if expect is None or n == expect + 1 else None

    version = _committed(rows.withColumn(DELETED, F.lit(deleted)), path, "version", number)
    if version is None:
        raise Conflict(f"{path} has changed since version {expect}")
    return version


def read(spark: SparkSession, path: str, key: str, version: int | None = None) -> DataFrame:
    """The table as of a version (the last one): one row for each key, null keys being one.

    Rows of the compacted table that no later change names pass as they are, so only what
    changed since is grouped; that side is broadcast only where Spark measures it small.
    """
    last = latest(spark, path) if version is None else version
    base = max((b for b in folders(spark, path, "base") if b <= last), default=0)
    numbers = [v for v in folders(spark, path, "version") if base < v <= last]
    if not numbers and not base:
        raise FileNotFoundError(f"{path} has no version {last}")
    kept = spark.read.parquet(f"{path}/base={base}") if base else None
    if not numbers:
        return kept
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/version={v}" for v in numbers])
    columns = [c for c in rows.columns if c not in ("version", DELETED)]
    newest = F.max(F.struct(F.col("version").cast("long"), DELETED, *[F.col(f"`{c}`") for c in columns])).alias("newest")
    changed = rows.groupBy(F.col(f"`{key}`").alias("changed key")).agg(newest)
    alive = changed.where(~F.col(f"newest.{DELETED}")).select(*[F.col(f"newest.`{c}`") for c in columns])
    if kept is None:
        return alive
    same = F.col(f"`{key}`").eqNullSafe(F.col("changed key"))
    return kept.join(changed.select("changed key"), same, "left_anti").unionByName(alive)


def update(changes: DataFrame, path: str, key: str, tries: int = 20) -> int:
    """Sets the stated columns of rows that are there; nulls and unknown keys change nothing.

    The new rows are made from one version and committed only as the next; where another writer
    comes between, they are made again from its result, so no writer's columns are lost.
    """
    spark = changes.sparkSession
    names = [c for c in changes.columns if c != key]
    stated = changes.groupBy(F.col(f"`{key}`").alias("stated key")).agg(*[F.max(f"`{c}`").alias(f"stated {c}") for c in names])
    for _ in range(tries):
        version = latest(spark, path)
        table = read(spark, path, key, version)
        met = table.join(stated, F.col(f"`{key}`").eqNullSafe(F.col("stated key")))
        rows = met.select(*[F.coalesce(F.col(f"`stated {c}`"), F.col(f"`{c}`")).alias(c) if c in names else F.col(f"`{c}`") for c in table.columns])
        try:
            return change(rows, path, expect=version)
        except Conflict:
            continue
    raise Conflict(f"{path} changed {tries} times meanwhile")


def compact(spark: SparkSession, path: str, key: str) -> int:
    """Writes the table of the last version whole, beside the changes; gives that version. Changes
    committed meanwhile come after it, and of two jobs that compact one version one's folder stays."""
    version = latest(spark, path)
    numbers = iter([version] if version not in folders(spark, path, "base") else [])
    _committed(read(spark, path, key, version), path, "base", lambda: next(numbers, None))
    return version


def reserve(spark: SparkSession, path: str, n: int, least: int = 1) -> int:
    """The first of ``n`` numbers that no other job gets: a range behind all that were drawn.

    Ranges are folders ``range=<k>`` taken in turn; a job that breaks off leaves a gap.
    """
    if n <= 0:
        return least
    while True:
        taken = folders(spark, path, "range")
        first = least
        if taken:
            first = max(least, spark.read.parquet(f"{path}/range={taken[-1]}").first()["last"] + 1)
        temporary = f"{path}/_temporary-{uuid.uuid4().hex}"
        spark.createDataFrame([(first, first + n - 1)], "first long, last long").coalesce(1).write.parquet(temporary)
        if publish(spark, temporary, f"{path}/range={max(taken, default=0) + 1}"):
            return first
        dropped(spark, temporary)


def numbered(new: DataFrame, existing: DataFrame, order: list[str], path: str, column: str = "numero_doc") -> DataFrame:
    """As ``assign_numbers``, for several jobs at once: the numbers are reserved below ``path``
    before rows get them, above the largest of ``existing`` and all that were ever reserved."""
    spark = new.sparkSession
    rows = written(new, "unnumbered")
    top = existing.agg(F.max(column)).first()[0] or 0
    first = reserve(spark, path, rows.count(), top + 1)
    below = spark.range(1).select(F.lit(first - 1).cast(existing.schema[column].dataType).alias(column))
    return assign_numbers(rows, below, order, column)
