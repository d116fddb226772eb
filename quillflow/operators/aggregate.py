"""Summaries of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_summary(df: DataFrame, ok: Column, blank: Column, *keys: str) -> DataFrame:
    """total, processed and failed; blank items are in the total alone."""
    good = F.coalesce(ok, F.lit(False))
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(good & ~blank).alias("processed"),
        F.count_if(~good & ~blank).alias("failed"),
    )


def error_counts(df: DataFrame, error: str, *keys: str) -> DataFrame:
    """Errors by kind, no row where there are none; lists would grow with the batch."""
    return df.where(F.col(error).isNotNull()).groupBy(*keys, error).agg(F.count("*").alias("n"))


def error_list(df: DataFrame, key: str, error: str) -> DataFrame:
    """(key, errors): of a small batch its errors in order, null when there are none."""
    found = F.array_sort(F.collect_list(F.when(F.col(error).isNotNull(), F.col(error))))
    return df.groupBy(key).agg(F.when(F.size(found) > 0, found).alias("errors"))


def upload_limits(files: DataFrame, key: str, most_files: int = 10, most_bytes: int = 50 << 20, most_each: int = 10 << 20) -> DataFrame:
    """(key, n_files, n_bytes, ok) of upload batches; sizes in ``length``."""
    return files.groupBy(key).agg(
        F.count("*").alias("n_files"),
        F.sum("length").alias("n_bytes"),
        ((F.count("*") <= most_files) & (F.sum("length") <= most_bytes) & (F.max("length") <= most_each)).alias("ok"),
    )


def ratio(condition: Column, name: str = "ratio") -> Column:
    return F.avg(condition.cast("int")).alias(name)
