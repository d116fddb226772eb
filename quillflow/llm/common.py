"""What the corpus operators share: written tables, the test tables, word lists."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import new_path, scratch, shared_dir, spread, written  # noqa: F401

#: Java regular expression of what separates words: space and U+0009 to U+000D.
SPACE = "[ \\t-\\r]"
WORD = "[^ \\t-\\r]"


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package also where it is not installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE + "+")
    return F.filter(parts, lambda w: w != "")


def mapped(df: DataFrame, keep: list[str], inputs: list[Column], run: Callable, outputs: StructType) -> DataFrame:
    """``mapInArrow`` over the columns ``keep`` and the inputs behind them; ``run`` gives back
    the first and the outputs. Inside columns are numbered, as names with dots don't pass."""
    ship(df.sparkSession)
    kept = [F.col(f"`{c}`").alias(f"kept {i}") for i, c in enumerate(keep)]
    source = df.select(*kept, *[c.alias(f"input {i}") for i, c in enumerate(inputs)])
    schema = StructType([*df.select(*kept).schema.fields, *outputs.fields])
    return source.mapInArrow(run, schema).toDF(*keep, *outputs.fieldNames())


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is so called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
