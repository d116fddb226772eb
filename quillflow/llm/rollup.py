"""Token counts as rollups kept by deltas.

A store is a folder with one table of additive deltas for each committed batch: documents and
tokens by source, language and tokenizer version. Inserts count up, deletes count down, a
revised count is both. A batch is aggregated (map-side first, so no key can be hot), written
under a temporary name and published by one rename to the name of its id: a batch that is
committed again, or by two writers, counts once. Totals are sums over the published batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import bpe
from .common import WORD, mapped

KEYS = ["source", "lang", "tokenizer"]
COUNTS = ["n_tokens", "n_revised"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def bpe_counts(
    docs: DataFrame,
    version: str = "byte_bpe_50k",
    tokenizer: str | None = None,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id", "source", "lang"),
    revision: Column | None = None,
) -> DataFrame:
    """The columns ``keep`` with tokenizer (its version) and n_tokens of the whole text.

    With a ``revision`` of the text there is n_revised too, counted in the same pass over the
    texts (only where the two differ). Null and empty texts have no tokens.
    """
    path = tokenizer or bpe.default_path()
    at, twice = len(keep), revision is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path)

        def counted(texts: list[str | None]) -> list[int]:
            return [len(x) for lo in range(0, len(texts), 256) for x in enc.encode(texts[lo : lo + 256])]

        for batch in batches:
            counts = [pa.array(counted(batch.column(at).to_pylist()), pa.int64())]
            if twice:
                changed = np.flatnonzero(batch.column(at + 2).to_numpy(zero_copy_only=False))
                revised = counts[0].to_numpy().copy()
                revised[changed] = counted(batch.column(at + 1).take(pa.array(changed)).to_pylist())
                counts.append(pa.array(revised))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array([version] * batch.num_rows, pa.string()), *counts],
                [*batch.schema.names[:at], "tokenizer", *COUNTS[: len(counts)]],
            )

    t = F.col(f"`{text}`")
    outputs = StructType().add("tokenizer", "string").add("n_tokens", "long")
    if not twice:
        return mapped(docs, list(keep), [t], run, outputs)
    differs = ~t.eqNullSafe(revision)
    return mapped(docs, list(keep), [t, F.when(differs, revision), differs], run, outputs.add("n_revised", "long"))


def word_counts(
    docs: DataFrame,
    version: str = "words",
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id", "source", "lang"),
    revision: Column | None = None,
) -> DataFrame:
    """As ``bpe_counts`` for words between white space, by built-in functions."""
    words = lambda t: F.coalesce(F.regexp_count(t, F.lit(WORD + "+")), F.lit(0)).cast("long")
    counts = [words(F.col(f"`{text}`"))] + ([] if revision is None else [words(revision)])
    return docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.lit(version).alias("tokenizer"),
        *[c.alias(n) for c, n in zip(counts, COUNTS)],
    )


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counts as changes: sign 1 inserts them, -1 deletes them."""
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (sign * F.col("n_tokens")).alias("n_tokens"))


def revised(counts: DataFrame) -> DataFrame:
    """Changes that replace n_tokens by n_revised; the documents stay."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), (F.col("n_revised") - F.col("n_tokens")).alias("n_tokens"))


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def commit(spark: SparkSession, store: str, batch: str, changes: DataFrame) -> bool:
    """Publishes a batch of changes; False where a batch of that id is there already, whatever
    it holds: ids name batches, contents are not compared.

    Null keys are keys of their own, null counts are 0, keys whose sums are all 0 are left
    out, an empty batch is published empty. A commit that breaks leaves nothing that counts.
    """
    if not batch or set(batch) - set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_."):
        raise ValueError(f"not a batch id: {batch!r}")
    target = f"{store}/batch-{batch}"
    fs, final = _fs(spark, target)
    if fs.exists(final):
        return False
    temp = f"{store}/_temporary-{uuid.uuid4().hex}"
    (
        changes.groupBy(*KEYS)
        .agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
        .where("n_docs != 0 or n_tokens != 0")
        .write.parquet(temp)
    )
    return _publish(spark, temp, target)


def _publish(spark: SparkSession, temp: str, target: str) -> bool:
    """Renames a finished folder; False, and the folder dropped, where the name is taken."""
    fs, final = _fs(spark, target)
    source = spark._jvm.org.apache.hadoop.fs.Path(temp)
    published = not fs.exists(final) and fs.rename(source, final)
    nested = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{temp.rsplit('/', 1)[1]}")
    if fs.exists(nested):  # another writer came first and the rename went below its folder
        fs.delete(nested, True)
        published = False
    if not published:
        fs.delete(source, True)
    return bool(published)


def _published(spark: SparkSession, store: str, prefix: str) -> list[str]:
    """The published folders of a prefix, by name."""
    fs, root = _fs(spark, store)
    if not fs.exists(root):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(root)]
    return sorted(p for p in found if p.rsplit("/", 1)[1].startswith(prefix))


def _parts(spark: SparkSession, store: str) -> tuple[str | None, list[str]]:
    """The newest compacted table and the batches that it does not hold."""
    bases = _published(spark, store, "base-")
    batches = _published(spark, store, "batch-")
    if not bases:
        return None, batches
    held = {r["value"] for r in spark.read.text(f"{bases[-1]}/batches").collect()}
    return bases[-1], [b for b in batches if b.rsplit("/", 1)[1] not in held]


def _deltas(spark: SparkSession, store: str) -> DataFrame:
    base, batches = _parts(spark, store)
    paths = ([f"{base}/totals"] if base else []) + batches
    return spark.read.schema(DELTA).parquet(*paths) if paths else spark.createDataFrame([], DELTA)


def totals(spark: SparkSession, store: str) -> DataFrame:
    """source, lang, tokenizer, n_docs, n_tokens over all published batches; keys whose
    totals are all 0 are left out."""
    return (
        _deltas(spark, store)
        .groupBy(*KEYS)
        .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        .where("n_docs != 0 or n_tokens != 0")
    )


def compact(spark: SparkSession, store: str) -> bool:
    """Sums the newest compacted table and the batches after it to the next one, published by
    one rename; False where there is nothing new or another writer came first.

    It lists the batches that it holds (a name for each, as many as were ever committed), whose
    folders stay as the marks of their ids. A reader sees the old parts or the new one.
    """
    base, batches = _parts(spark, store)
    if not batches:
        return False
    held = [r["value"] for r in spark.read.text(f"{base}/batches").collect()] if base else []
    held += [b.rsplit("/", 1)[1] for b in batches]
    number = int(base.rsplit("-", 1)[1]) + 1 if base else 0
    temp = f"{store}/_temporary-{uuid.uuid4().hex}"
    paths = ([f"{base}/totals"] if base else []) + batches
    summed = spark.read.schema(DELTA).parquet(*paths).groupBy(*KEYS)
    summed.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{temp}/totals")
    spark.createDataFrame([(h,) for h in held], "value string").coalesce(1).write.text(f"{temp}/batches")
    return _publish(spark, temp, f"{store}/base-{number:09d}")


def without_repeated_lines(text: str = "text") -> Column:
    """A text with every line once; an example of a revision."""
    return F.array_join(F.array_distinct(F.split(F.col(f"`{text}`"), "\n")), "\n")
