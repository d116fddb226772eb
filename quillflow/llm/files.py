"""Files that tasks write: temporary names, then one commit by renames and a manifest.

Tasks write below ``<dir>/_temporary`` under names no other attempt uses and report them;
the driver renames the reported files, writes ``manifest.json`` under a temporary name,
renames it last and drops the rest. A reader takes only what the manifest lists, so a lost
or repeated task leaves nothing behind. The driver handles one row for each file.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MOST_TASKS = 20_000


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def temporary(directory: str) -> str:
    return f"{directory}/_temporary/{uuid.uuid4().hex}"


def prepare(directory: str) -> None:
    fs, path = open_fs(directory)
    fs.create_dir(f"{path}/_temporary", recursive=True)


def commit(directory: str, files: list[dict]) -> list[dict]:
    """Renames each file's ``temp`` to its ``name`` and publishes the manifest.

    Files already renamed by an earlier, broken commit are left as they are.
    """
    fs, base = open_fs(directory)

    def move(f: dict) -> None:
        source, target = open_fs(f["temp"])[1], f"{base}/{f['name']}"
        if fs.get_file_info(source).type != pafs.FileType.NotFound:
            fs.move(source, target)

    with ThreadPoolExecutor(32) as pool:
        list(pool.map(move, files))
    listed = [{k: v for k, v in f.items() if k != "temp"} for f in files]
    with fs.open_output_stream(f"{base}/_temporary/manifest.json") as out:
        out.write(json.dumps(listed).encode())
    fs.move(f"{base}/_temporary/manifest.json", f"{base}/manifest.json")
    fs.delete_dir(f"{base}/_temporary")
    return listed


def manifest(directory: str) -> list[dict]:
    fs, base = open_fs(directory)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        return json.loads(f.read())


def join(directory: str, name: str) -> str:
    return posixpath.join(directory, name)


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A row for each file, each in a partition of its own (in order, where there are more files
    than MOST_TASKS some next to each other)."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, min(len(rows), MOST_TASKS)), schema)


def integer_ids(df: DataFrame, column: str) -> None:
    """Raises TypeError unless the ids are integers, as file formats and readers need."""
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        raise TypeError(f"{column} must hold integers, not {df.schema[column].dataType.simpleString()}")
