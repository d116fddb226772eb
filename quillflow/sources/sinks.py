"""Where tables go: the store, exports, inboxes.

Exports are Spark writes, one part for each partition. A single CSV or JSON file is put together
from such parts; a spreadsheet, whose format holds few rows, is written by the driver.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize
from ..operators.relational import aligned, export_frame
from .schema import DOCUMENT, NARROW
from .shared import new_path

BOM = "﻿"


def append(df: DataFrame, path: str, narrow: bool = False) -> None:
    """Adds rows in the table's columns; others are left out, missing ones are null."""
    columns = NARROW if narrow else DOCUMENT.fieldNames()
    aligned(df.select(*[c for c in df.columns if c in columns]), DOCUMENT.fieldNames()).write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts under export headings; every part has a heading line."""
    export_frame(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_objects(df: DataFrame) -> DataFrame:
    """One JSON object for each document, in order, with null keys."""
    rows = aligned(df).orderBy("numero_doc")
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_objects(df).write.mode("overwrite").text(path)


def _checked(df: DataFrame, most: int) -> DataFrame:
    if df.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows: export parts instead of one file")
    return df


def _assembled(parts: DataFrame, file: str, head: str, between: str, tail: str) -> None:
    """One file of the lines of ``parts`` in order, with ``between`` between them.

    Lines are written in parallel by Spark, one part for each sorted range, and the parts' bytes
    are then copied one behind the other under a temporary name, which is renamed last: the
    driver's JVM holds one buffer, and no row leaves the executors.
    """
    spark = parts.sparkSession
    folder = new_path(spark, "export")
    parts.write.option("lineSep", between).text(folder)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    path, temporary = hadoop.fs.Path(file), hadoop.fs.Path(f"{file}.{uuid.uuid4().hex}")
    source, target = hadoop.fs.Path(folder), path.getFileSystem(conf)
    fs = source.getFileSystem(conf)
    found = [f for f in fs.listStatus(source) if f.getPath().getName().startswith("part-") and f.getLen() > 0]
    found = sorted(found, key=lambda f: f.getPath().getName())
    out = target.create(temporary, True)
    try:
        out.write(bytearray(head.encode()))
        for i, f in enumerate(found):
            ends = len(between.encode()) if i == len(found) - 1 else 0  # none behind the last line
            copied = fs.open(f.getPath())
            try:
                part = spark._jvm.org.apache.commons.io.input.BoundedInputStream(copied, f.getLen() - ends)
                hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            finally:
                copied.close()
        out.write(bytearray((tail if found or tail != between else "").encode()))
    finally:
        out.close()
    target.delete(path, False)
    target.rename(temporary, path)
    fs.delete(source, True)


def _csv_cell(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def csv_file(df: DataFrame, file: str) -> None:
    """One CSV file of any size in the documents' order, with headings and a byte order mark."""
    frame = export_frame(df)
    head = ",".join(f'"{n}"' if "," in n else n for n in frame.columns)
    lines = frame.select(F.concat_ws(",", *[_csv_cell(F.col(f"`{c}`")) for c in frame.columns]).alias("value"))
    _assembled(lines, file, f"{BOM}{head}\n", "\n", "\n")


def json_file(df: DataFrame, file: str) -> None:
    """One JSON array of any size in the documents' order, indented by two."""
    rows = aligned(df).orderBy("numero_doc")

    def entry(c: str) -> Column:
        one = F.to_json(F.struct(F.col(f"`{c}`")), {"ignoreNullFields": "false"})
        key = len(json.dumps(c, ensure_ascii=False)) + 2  # the brace, the key and the colon
        return F.concat(F.lit(f"\n    {json.dumps(c, ensure_ascii=False)}: "), F.substr(one, F.lit(key + 1), F.length(one) - key - 1))

    body = F.concat(F.lit("\n  {"), F.concat_ws(",", *[entry(c) for c in rows.columns]), F.lit("\n  }"))
    _assembled(rows.select(body.alias("value")), file, "[", ",", "\n]")


def sheet_frame(df: DataFrame) -> DataFrame:
    """The export with cells a spreadsheet can hold, headings cut at 255, nulls empty."""
    frame = export_frame(df)
    cells = [normalize.cell(F.col(f"`{n}`")).alias(n[:255]) if t == "string" else F.col(f"`{n}`").alias(n[:255]) for n, t in frame.dtypes]
    return frame.select(*cells).na.fill("")


def excel_file(df: DataFrame, file: str, most: int = 1_048_575) -> None:
    """The sheet ``Documentos``; needs openpyxl."""
    try:
        from openpyxl import Workbook
    except ImportError as e:
        raise RuntimeError("spreadsheets need openpyxl") from e
    frame = _checked(sheet_frame(df), most)
    book = Workbook(write_only=True)
    sheet = book.create_sheet("Documentos")
    sheet.append(frame.columns)
    for r in frame.toLocalIterator():
        sheet.append(list(r))
    book.save(file)


def send(df: DataFrame, inbox: str) -> None:
    """Queue messages as JSON lines in an inbox that a stream reads."""
    df.select("job_id", "file_key", "filename").write.mode("append").json(inbox)


def clear(spark: SparkSession, confirm: bool = False, **paths: str) -> DataFrame:
    """Empties the named tables, jobs before documents; rows before and after. Nothing happens
    without ``confirm``."""
    if not confirm:
        raise PermissionError("clearing tables needs confirm=True")
    rows = []
    for name in sorted(paths, key=lambda n: n != "jobs"):
        before = spark.read.parquet(paths[name])
        n, schema = before.count(), before.schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(paths[name])
        rows.append((name, n, spark.read.parquet(paths[name]).count()))
    return spark.createDataFrame(rows, "name string, before long, after long")
