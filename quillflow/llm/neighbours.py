"""Linked pairs within shards, found without ever gathering an unbounded shard in one task.

Members are rows (key, item, weight): items (longs or binaries) that share a key have to be compared. Shards of one
item are dropped, and of shards that hold the same items one stays. A shard of at most ``limit`` weight goes to a task whole. A larger one is dealt
to subshards; its vantage item (the least one) visits each of them, so that what lies in the
vantage's ball is joined over all subshards. What is then not in the shard's largest component
is compared with the whole shard, a part with a part in each task; components found so far come
along, and pairs within one are skipped. A task sees at most two parts, no pair is lost, and
tasks return forests, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written
from .components import connected_components

#: Of one task's items, payloads, initial labels and left side (at least one end of a pair is
#: left): the positions of the ends of a forest's edges.
Search = Callable[[np.ndarray, list, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def sizes_of(members: DataFrame) -> DataFrame:
    """(key, n, total weight, mark of its items) of the shards of two members or more."""
    mark = F.bit_xor(F.xxhash64("item")).alias("mark")
    return members.groupBy("key").agg(F.count("*").alias("n"), F.sum("weight").alias("total"), mark).where("n > 1")


def _searched(shards: DataFrame, payload: DataFrame | None, search: Search) -> DataFrame:
    """Edges of shards (key, i, j, item, component, is_left)."""
    if payload is None:
        shards = shards.withColumn("payload", F.lit(None).cast("binary"))
    else:
        shards = shards.join(payload.hint("merge"), "item")
    ship(shards.sparkSession)
    kind = shards.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            items = whole.column("item").to_numpy()
            labels = pa.concat_arrays(whole.column("component").chunks).dictionary_encode().indices.to_numpy()
            left = whole.column("is_left").to_numpy(zero_copy_only=False)
            a, b = search(items, whole.column("payload").to_pylist(), labels, left)
            ends = [pa.array(items[e], whole.schema.field("item").type) for e in (a, b)]
            return pa.RecordBatch.from_arrays(ends, ["a", "b"])

        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            ids = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = [0, *(np.flatnonzero((np.diff(ids) != 0).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                key = ids[:, lo].tolist()
                if key != current and held:
                    yield found(held)
                    held = []
                current = key
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield found(held)

    return (
        shards.select("key", "i", "j", "item", "component", "is_left", "payload")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "item")
        .mapInArrow(run, f"a {kind}, b {kind}")
    )


def _part(parts, salt: int):
    return F.pmod(F.xxhash64(F.lit(salt), "item"), parts)


def plain_forest(members: DataFrame, search: Search) -> DataFrame:
    """``forest`` for members whose shards are all known to be small; nothing is written but the edges."""
    zero = F.lit(0).cast("long")
    shards = members.select("key", zero.alias("i"), zero.alias("j"), "item", F.col("item").alias("component"), F.lit(True).alias("is_left"))
    return written(_searched(shards, None, search), "shard-edges")


def forest(members: DataFrame, search: Search, limit: int, payload: DataFrame | None = None) -> DataFrame:
    """(a, b): a forest that joins just the items that pairs within a shard join.

    ``payload`` has item and payload (binary) of every item; without it payloads are null.
    """
    different = sizes_of(members).groupBy("n", "total", "mark").agg(F.min("key").alias("key"))
    rows = written(members.join(different.select("key", "total"), "key"), "shard-members")
    parts = F.ceil(F.col("total") / limit).cast("long")
    zero = F.lit(0).cast("long")
    plain = [F.col("item").alias("component"), F.lit(True).alias("is_left")]
    large = rows.where(F.col("total") > limit)
    is_large = large.limit(1).count() > 0
    shards = rows.where(F.col("total") <= limit).select("key", zero.alias("i"), zero.alias("j"), "item", *plain)
    if not is_large:
        return written(_searched(shards, payload, search), "shard-edges")
    visits = large.groupBy("key").agg(F.min("item").alias("item"), F.max(parts).alias("parts"))
    visits = visits.select("key", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("i"), zero.alias("j"), "item", *plain)
    dealt = large.select("key", _part(parts, 1).alias("i"), zero.alias("j"), "item", *plain)
    first = written(_searched(shards.unionByName(dealt.unionByName(visits).distinct()), payload, search), "shard-edges")

    known = connected_components(first)
    placed = written(
        large.join(known, F.col("item") == F.col("node"), "left").select(
            "key", "item", "weight", F.coalesce("component", "item").alias("component")
        ),
        "shard-components",
    )
    most = (
        placed.groupBy("key", "component")
        .agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
        .groupBy("key")
        .agg(
            F.max_by("component", F.struct("n", "component")).alias("largest"),
            F.sum("w").alias("all_weight"),
            (F.sum("w") - F.max_by("w", F.struct("n", "component"))).alias("rest_weight"),
        )
        .where("rest_weight > 0")
    )
    split = placed.join(most, "key")
    n_left, n_right = (F.ceil(F.col(c) / limit).cast("long") for c in ("rest_weight", "all_weight"))
    every = lambda n: F.explode(F.sequence(zero, n - 1))
    left = split.where("component != largest").select(
        "key", _part(n_left, 2).alias("i"), every(n_right).alias("j"), "item", "component", F.lit(True).alias("is_left")
    )
    right = split.select(
        "key", every(n_left).alias("i"), _part(n_right, 3).alias("j"), "item", "component", F.lit(False).alias("is_left")
    )
    both = left.unionByName(right).groupBy("key", "i", "j", "item", "component").agg(F.bool_or("is_left").alias("is_left"))
    return first.unionByName(written(_searched(both, payload, search), "shard-edges"))
