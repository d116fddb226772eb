"""Stored layouts for look-ups that come again and again: pages of a sorted table, keys in buckets.

Both pay one shuffle when the table is written and none of the table when it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64
#: Columns of a paged table beside its own.
RANGE, PLACE = "page_range", "page_place"


def write_paged(df: DataFrame, path: str, order: list[str], ranges: int | None = None) -> None:
    """Rows in sorted ranges, a folder each, and beside them how many rows stand before each.

    Without a number of ``ranges`` Spark cuts them by the size of the data.
    Nulls come first; rows equal in ``order`` stand in any order, but in that one from then on.
    The ranks are one row for each range, summed in one task.
    """
    keys = [F.col(f"`{c}`") for c in order]
    ranged = df.repartitionByRange(*([ranges] if ranges else []), *keys).sortWithinPartitions(*keys)
    placed = ranged.withColumns({RANGE: F.spark_partition_id(), PLACE: F.monotonically_increasing_id()})
    placed.write.partitionBy(RANGE).parquet(f"{path}/rows")
    placed.limit(0).write.parquet(f"{path}/columns")  # an empty table has no other file
    rows = df.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows")
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col(f"`{order[0]}`")
    counts = rows.groupBy(RANGE).agg(F.count("*").alias("n"), F.min(first).alias("low"), F.max(first).alias("high"))
    counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/ranks")


def _ranges(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns")
    if not numbers:
        return columns
    return spark.read.schema(columns.schema).option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/{RANGE}={n}" for n in numbers])


def read_page(spark: SparkSession, path: str, skip: int = 0, limit: int = 1000) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` of the sorted table, in order; only the ranges that hold
    them are read, however far behind the page is."""
    ranks = spark.read.parquet(f"{path}/ranks")
    held = ranks.where((F.col("before") < skip + limit) & (F.col("before") + F.col("n") > skip)).orderBy("before").select(RANGE, "before").collect()
    page = _ranges(spark, path, [r[0] for r in held]).orderBy(PLACE).offset(skip - held[0]["before"] if held else 0).limit(limit)
    return page.drop(RANGE, PLACE)


def rows_between(spark: SparkSession, path: str, column: str, low, high) -> DataFrame:
    """Rows whose first sort column lies between two values, from the ranges that can hold them."""
    ranks = spark.read.parquet(f"{path}/ranks").where((F.col("low") <= F.lit(high)) & (F.col("high") >= F.lit(low)))
    held = [r[0] for r in ranks.select(RANGE).collect()]
    return _ranges(spark, path, held).where(F.col(f"`{column}`").between(low, high)).drop(RANGE, PLACE)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int = BUCKETS, least: str | None = None) -> None:
    """One row for each key (null keys go) as a table in sorted buckets of the key, with Bloom
    filters on it. Of several rows that with the smallest ``least`` stays, or the smallest row."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    by = F.struct(*([F.col(f"`{least}`").isNull(), F.col(f"`{least}`")] if least else []), *columns)
    one = df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("bucket key")).agg(F.min_by(F.struct(*columns), by).alias("row"))
    writer = one.select("row.*").repartition(buckets, F.col(f"`{key}`")).write.mode("overwrite").format("parquet")
    writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def with_stored(df: DataFrame, table: str, key: str, on, name: str = "found") -> DataFrame:
    """``df`` with a struct of the stored row whose ``key`` equals ``on``, null where there is
    none. Only ``df`` is dealt to the table's buckets; the table is read as it lies."""
    stored = df.sparkSession.table(table)
    row = F.struct(*[F.col(f"`{c}`") for c in stored.columns]).alias(name)
    right = stored.select(F.col(f"`{key}`").alias("stored key"), row)
    return df.join(right.hint("merge"), on == F.col("stored key"), "left").drop("stored key")
