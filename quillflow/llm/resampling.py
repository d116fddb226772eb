"""Importance resampling towards a target text by hashed word n-grams.

A task numbers the words of a batch of texts and sorts the suffixes of the word ids. Runs of
the common-prefix lengths are the repeated n-grams: each is hashed once, and its bucket is
scattered back to all places of the run. A document becomes the list of its buckets; all that
is gathered over the corpus is one count for each bucket.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import assign_numbers
from .common import free_name, mapped, written

#: Words after ASCII lower-casing, on UTF-8 bytes: whatever is not 0x00-0x2F, 0x3A-0x60, 0x7B-0x7F.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GROUP_BYTES = 1 << 23
_NONE = -1


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``ids`` sorted by their first ``depth`` ids, by prefix doubling; beyond the
    end stands 0."""
    rank, known = ids, 1
    while known < depth:
        behind = np.concatenate([rank[known:], np.zeros(min(known, len(rank)), rank.dtype)])
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + behind, return_inverse=True)[1] + 1
        known *= 2
    return np.argsort(rank, kind="stable")


def common_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in order, the ids it shares with the one before, up to ``depth`` and never
    across a 0; the first shares none."""
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    lcp = np.zeros(len(order), np.int64)
    same = np.ones(max(len(order) - 1, 0), bool)
    for j in range(depth):
        a, b = padded[order[:-1] + j], padded[order[1:] + j]
        same &= (a == b) & (a != 0)
        lcp[1:] += same
    return lcp


def bucket_lists(texts: list[bytes], n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, features of each text, all buckets in the order of texts)."""
    numbers: dict[bytes, int] = {}
    ids: list[int] = []
    n_words = []
    for text in texts:
        words = WORD.findall(text.lower())
        n_words.append(len(words))
        ids += [numbers.setdefault(w, len(numbers) + 1) for w in words]
        ids.append(0)
    sequence, names = np.array(ids, np.int64), list(numbers)
    order = suffix_order(sequence, n)
    lcp = common_prefixes(sequence, order, n)
    places = np.full((len(sequence), n), _NONE, np.int32)
    padded = np.concatenate([sequence, np.zeros(n, np.int64)])
    whole = np.ones(len(order), bool)
    for k in range(1, n + 1):
        whole &= padded[order + k - 1] != 0  # the suffix has k words of its text
        starts = np.flatnonzero(lcp < k)
        hashed = np.full(len(starts), _NONE, np.int32)
        for run in np.flatnonzero(whole[starts]).tolist():
            at = order[starts[run]]
            hashed[run] = zlib.crc32(b" ".join(names[i - 1] for i in sequence[at : at + k].tolist())) % buckets
        places[order, k - 1] = np.repeat(hashed, np.diff(starts, append=len(order)))
    valid = places != _NONE
    ends = np.cumsum(np.array(n_words, np.int64) + 1)
    features = np.concatenate([[0], np.cumsum(valid.sum(axis=1))])[ends]
    return np.array(n_words, np.int64), np.diff(features, prepend=0), places[valid]


def _groups(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a batch in groups of some megabytes, each of one text at least."""
    group, size = [], 0
    for value in column.cast(pa.large_binary()):
        text = value.as_py() or b""
        if group and size + len(text) > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def features(docs: DataFrame, keep: list[str], n: int = 1, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """Columns ``keep``, then n_words, n_features and the array of buckets of every row's n-grams
    of 1 to ``n`` words, repeats included; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in _groups(batch.column(batch.num_columns - 1)):
                n_words, n_features, values = bucket_lists(group, n, buckets)
                offsets = np.concatenate([[0], np.cumsum(n_features)]).astype(np.int32)
                part = batch.slice(at, len(group))
                at += len(group)
                made = [pa.array(n_words), pa.array(n_features), pa.ListArray.from_arrays(offsets, pa.array(values))]
                names = [*part.schema.names[:-1], "n_words", "n_features", "buckets"]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names)

    outputs = T.StructType(
        [T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("buckets", T.ArrayType(T.IntegerType()))]
    )
    return mapped(docs, keep, [F.col(f"`{text}`")], run, outputs)


def bucket_counts(lists: DataFrame, buckets: int) -> list[int]:
    """How often each bucket occurs over all rows: one number for each bucket, nothing else."""
    counts = [0] * buckets
    for bucket, n in lists.select(F.explode("buckets").alias("b")).groupBy("b").count().collect():
        counts[bucket] = n
    return counts


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and corpus, floored."""
    buckets, s_all, t_all = len(corpus), sum(corpus), sum(target)
    return np.array(
        [math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(corpus, target)],
        np.int64,
    )


def noise(seed: int, doc_id: object) -> int:
    """Gumbel noise of an id in thousandths, floored; the null id's name is empty."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    keep: list[str] | None = None,
    n: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    percent: int = 10,
    least_words: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every row with its weight and, if drawn, its rank: columns ``keep`` (all), then n_features,
    weight, score, rank.

    A document's weight is the sum of its features' gains, its score the weight with the noise of
    its id. Of the N rows of at least ``least_words`` words the ``percent * N // 100`` of highest
    score are drawn, which is a draw without replacement in proportion to the weights; equal scores
    go to the smaller id, null ids first, and of rows equal in both any goes first.

    Null and empty texts have no features and weight 0; repeated rows count and are drawn each;
    an empty target makes rare features gain most; empty tables give no rows. Added columns get
    underscores in front where they clash. The driver holds one count for each bucket; ranks come
    from sorted ranges, so no task holds more than its range.
    """
    names = docs.columns if keep is None else keep
    source = docs.select(F.col(f"`{doc_id}`").alias("id"), *[F.col(f"`{c}`").alias(f"kept {i}") for i, c in enumerate(names)], F.col(f"`{text}`").alias("body"))
    kept = [f"kept {i}" for i in range(len(names))]
    lists = written(features(source, ["id", *kept], n, buckets, "body"), "bucket-lists")
    gain = gains(bucket_counts(lists, buckets), bucket_counts(features(target.select(F.col(f"`{text}`").alias("body")), [], n, buckets, "body"), buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.num_columns - 1)
            sums = np.concatenate([[0], np.cumsum(gain[found.flatten().to_numpy()])])
            ends = np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy())])
            weight = np.diff(sums[ends])
            score = weight + np.array([noise(seed, i) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(weight), pa.array(score)], [*batch.schema.names[:-1], "weight", "score"]
            )

    outputs = T.StructType([T.StructField("weight", T.LongType()), T.StructField("score", T.LongType())])
    scored = mapped(lists, ["id", *kept, "n_words", "n_features"], [F.col("buckets")], run, outputs)
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored-rows")
    able = scored.where(F.col("n_words") >= least_words).select((-F.col("score")).alias("lack"), "id", "row")
    nobody = docs.sparkSession.createDataFrame([], "rank long")
    drawn = percent * able.count() // 100
    ranks = assign_numbers(able, nobody, ["lack", "id", "row"], "rank").where(F.col("rank") <= drawn).select("row", "rank")
    out = scored.join(ranks, "row", "left").select(*[F.col(f"`{c}`") for c in kept], "n_features", "weight", "score", "rank")
    plain = docs.select(*[F.col(f"`{c}`") for c in names])
    return out.toDF(*names, *[free_name(plain, c) for c in ("n_features", "weight", "score", "rank")])
