"""Written tables in the shared folder, and small inputs spread over the cores.

Rows are only ever cut from their lineage by writing a Parquet table below the folder the
session names in ``spark.checkpoint.dir`` (all executors see it, a lost executor loses
nothing); what is written there is deleted when the driver's JVM ends.
"""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset a local session gets a temporary
    one; on a cluster that is an error, as executors would not see the driver's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package also where it is not installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def publish(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a finished folder to a name that no other has taken; False, and the folder left
    where it is, if another writer came first. Readers see all of a folder or nothing of it."""
    fs, final = _fs(spark, target)
    path = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(final):
        return False
    done = bool(fs.rename(path(source), final))
    nested = path(f"{target}/{source.rstrip('/').rsplit('/', 1)[1]}")
    if fs.exists(nested):  # the other's folder came between, and the rename went below it
        fs.rename(nested, path(source))
        return False
    return done


def dropped(spark: SparkSession, path: str) -> None:
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)


def folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the folders ``name=<number>`` below a path, in order."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return []
    found = [str(s.getPath().getName()) for s in fs.listStatus(jpath)]
    return sorted(int(f.split("=", 1)[1]) for f in found if f.startswith(f"{name}=") and f.split("=", 1)[1].isdigit())


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    fs, jpath = _fs(spark, path)
    fs.deleteOnExit(jpath)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[None]:
    """Tables written meanwhile are dropped at the end, but for those that stay."""
    path = new_path(spark, label)
    token = _SCRATCH.set(path)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        fs, jpath = _fs(spark, path)
        fs.delete(jpath, True)


def written(df: DataFrame, label: str, stays: bool = False) -> DataFrame:
    """``df`` as a table written to the shared folder and read again."""
    base = None if stays else _SCRATCH.get()
    path = f"{base}/{label}-{uuid.uuid4().hex}" if base else new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a narrow table's files that one task's share of the texts made from it may stand for.
SHARE_BYTES = 512 << 10


def dealt(df: DataFrame, source: DataFrame) -> DataFrame:
    """Narrow rows in equal shares, so many that each stands for ``SHARE_BYTES`` of ``source`` at
    most: what is made of a row takes far longer than its bytes let Spark expect, and after a
    join it would leave few tasks of many rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, -(-size // SHARE_BYTES)))


#: Tables beyond this are never dealt anew: their scan is cut by ``maxPartitionBytes`` alone.
SPREAD_BYTES = 4 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small table's scan, dealt to all cores where its files fill fewer partitions than those."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
