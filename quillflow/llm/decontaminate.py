"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items are windows of ``window`` words (shorter items: one window), windows are sets
of word shingles. Documents are read once: of a document only those runs of words come
through whose shingles all pass a bitmap of the benchmark's shingles (16 bits for each, 32 MB
at most) and that are long enough for a window. Equal runs are one from there on. Shingles are then ordered
by how often they occur in the runs of all documents; a window contained in a run must have
its rarest shingle there, so that prefix alone is joined. A candidate survives if its position
leaves room for the whole window in the run, and counts if its words are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, mapped, ship, written

SHINGLE = 3
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28  # of a bitmap: 128 KB to 32 MB
#: Everything that is no word character becomes a space, A-Z become a-z.
_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
RUNS = T.ArrayType(
    T.StructType()
    .add("start", T.IntegerType())
    .add("words", T.ArrayType(T.StringType()))
    .add("shingles", T.ArrayType(T.LongType()))
)
_RUN_TYPE = pa.list_(
    pa.struct([("start", pa.int32()), ("words", pa.list_(pa.string())), ("shingles", pa.list_(pa.int64()))])
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` word hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        total = (total ^ hashes[i : len(hashes) - n + 1 + i]) * _MIX[i % 3]
        total ^= total >> np.uint64(29)
    return total


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint64, len(words))


def windows_of(benchmark: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """(item_id, words, shingles): the windows of every item, each once for its item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(t)
                size = min(window, len(words))
                if not size:
                    continue
                every = shingles_of(hashes_of(words), min(SHINGLE, size)).view(np.int64)
                n = size - min(SHINGLE, size) + 1
                seen = {}
                for i in range(len(words) - size + 1):
                    seen.setdefault(tuple(words[i : i + size]), every[i : i + n].tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item] * len(seen), batch.schema.field(0).type),
                        pa.array([[w.decode("utf-8", "surrogatepass") for w in k] for k in seen], pa.list_(pa.string())),
                        pa.array(list(seen.values()), pa.list_(pa.int64())),
                    ],
                    ["item_id", "words", "shingles"],
                )

    kind = benchmark.schema[item_id].dataType.simpleString()
    return benchmark.select(F.col(f"`{item_id}`"), F.col(f"`{text}`")).mapInArrow(
        run, f"item_id {kind}, words array<string>, shingles array<bigint>"
    )


def _bitmaps(windows: DataFrame) -> tuple[dict[int, np.ndarray], int]:
    """A packed bitmap for each shingle length, and the least run of full shingles a window needs.

    Each task sends the driver one bitmap for each length; there are as many tasks as the
    benchmark's windows fill, at most 64, and the driver takes them one by one.
    """
    n = windows.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n - 1).bit_length() if n else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        need = 1 << 30
        for batch in batches:
            for size, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = min(size, SHINGLE)
                at = np.array(shingles, np.int64).view(np.uint64) & np.uint64(bits - 1)
                packed = made.setdefault(n, np.zeros(bits // 8, np.uint8))
                np.bitwise_or.at(packed, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
                if n == SHINGLE:
                    need = min(need, len(shingles))
        for n, packed in made.items():
            yield pa.RecordBatch.from_pydict({"n": [n], "need": [need], "bits": [packed.tobytes()]})

    parts = (
        windows.select(F.size("words"), "shingles")
        .coalesce(64)
        .mapInArrow(run, "n long, need long, bits binary")
        .toLocalIterator()
    )
    bitmaps: dict[int, np.ndarray] = {}
    need = 1 << 30
    for r in parts:
        packed = np.frombuffer(r["bits"], np.uint8)
        bitmaps[r["n"]] = bitmaps[r["n"]] | packed if r["n"] in bitmaps else packed
        need = min(need, r["need"])
    return bitmaps, need


def _in_bitmap(packed: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    at = shingles & np.uint64(8 * len(packed) - 1)
    return ((packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def scan(docs: DataFrame, windows: DataFrame, text: str, keep: list[str], names: dict[str, str]) -> DataFrame:
    """The columns ``keep`` of every row with a row id, its word count and candidate runs."""
    spark: SparkSession = docs.sparkSession
    bitmaps, need = _bitmaps(windows)
    shared = spark.sparkContext.broadcast(bitmaps)  # MOST_BITS for each of SHINGLE lengths
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = shared.value
        row = TaskContext.get().partitionId() << 33

        def runs_of(words: list[bytes], hashes: np.ndarray) -> list[dict]:
            found = []
            for n, bits in maps.items():
                shingles = shingles_of(hashes, n)
                good = _in_bitmap(bits, shingles)
                if not good.any():
                    continue
                edges = np.flatnonzero(np.diff(good, prepend=False, append=False)).reshape(-1, 2)
                if n < SHINGLE:
                    edges = [(i, i + 1) for i in np.flatnonzero(good)]
                else:
                    edges = edges[edges[:, 1] - edges[:, 0] >= need]
                for lo, hi in edges:
                    found.append(
                        {
                            "start": int(lo),
                            "words": [w.decode("utf-8", "surrogatepass") for w in words[lo : hi + n - 1]],
                            "shingles": shingles[lo:hi].view(np.int64).tolist(),
                        }
                    )
            return found

        for batch in batches:
            counts, runs = [], []
            for t in batch.column(at).to_pylist():
                words = words_of(t)
                counts.append(len(words))
                runs.append(runs_of(words, hashes_of(words)) if words and maps else [])
            ids = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(ids), pa.array(counts, pa.int64()), pa.array(runs, _RUN_TYPE)],
                [*batch.schema.names[:at], names["row"], names["n_words"], names["runs"]],
            )

    outputs = T.StructType().add(names["row"], "long").add(names["n_words"], "long").add(names["runs"], RUNS)
    return mapped(docs, keep, [F.col(f"`{text}`")], run, outputs)


def match(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """Of distinct runs (run, words, shingles, n) those that hold a window: run, spans
    (array of start, end in the run) and items (array)."""
    distinct = windows.withColumn("window", F.md5(F.concat_ws(" ", "words")))
    items = distinct.groupBy("window").agg(F.collect_set("item_id").alias("items"))
    texts = distinct.groupBy("window").agg(F.first("words").alias("words"), F.first("shingles").alias("shingles"))
    at = runs.select("run", "n", F.size("words").alias("run_words"), F.posexplode("shingles").alias("pos", "shingle"))
    often = at.groupBy("shingle").agg(F.sum("n").alias("often"))
    prefix = (
        texts.select("window", F.size("words").alias("size"), F.posexplode("shingles").alias("offset", "shingle"))
        .join(often.hint("merge"), "shingle", "left")
        .groupBy("window", "size")
        .agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "shingle", "offset")).alias("p"))
        .where("p.often > 0")
        .select("window", "size", "p.shingle", "p.offset")
    )
    # Ids and places first, words for what is left. Both sides grow, with the documents or with
    # the benchmark, so none is broadcast.
    placed = (
        at.join(prefix.hint("merge"), "shingle")
        .select("run", "window", "run_words", "size", (F.col("pos") - F.col("offset")).alias("start"))
        .where("start >= 0 and start + size <= run_words")
    )
    held = (
        placed.join(texts.select("window", F.col("words").alias("wanted")).hint("merge"), "window")
        .join(runs.select("run", "words").hint("merge"), "run")
        .where("slice(words, start + 1, size(wanted)) = wanted")
    )
    return (
        held.join(items.hint("merge"), "window")
        .groupBy("run")
        .agg(
            F.collect_set(F.struct("start", F.expr("start + size(wanted) as end"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        )
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of every row (all by default) with n_words, n_hit (words inside an
    occurrence of a window), items (ids found, sorted), spans (start and end words of the
    occurrences) and contaminated.

    Words are runs of ASCII letters and digits, A-Z lower-cased, and all other characters from
    U+0080. Null and empty texts have no words and hit nothing; items without words have no
    window, null item ids are not counted among items; items that share a window are all
    found; repeated rows come back repeated; empty tables are allowed; result columns whose
    name is taken get underscores in front.
    """
    ship(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    names = {n: free_name(kept, n) for n in ("row", "n_words", "runs", "n_hit", "items", "spans", "contaminated")}
    windows = written(windows_of(benchmark, window, item_id, item_text), "benchmark-windows")
    scanned = written(scan(docs, windows, text, keep, names), "benchmark-runs")
    row, runs = F.col(names["row"]), F.col(names["runs"])
    at = scanned.where(F.size(runs) > 0).select(row.alias("row"), F.explode(runs).alias("r"))
    at = at.select("row", "r.start", "r.words", "r.shingles", F.md5(F.concat_ws(" ", "r.words")).alias("run"))
    distinct = written(
        at.groupBy("run").agg(
            F.first("words").alias("words"), F.first("shingles").alias("shingles"), F.count("*").alias("n")
        ),
        "benchmark-distinct",
    )
    found = written(match(distinct, windows), "benchmark-found")
    shifted = F.transform(
        "spans", lambda s: F.struct((s.start + F.col("start")).alias("start"), (s.end + F.col("start")).alias("end"))
    )
    hits = (
        at.select("row", "start", "run")
        .join(found.hint("merge"), "run")
        .select("row", shifted.alias("spans"), "items")
        .groupBy("row")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        .withColumn(
            "n_hit",
            F.expr(
                "aggregate(spans, named_struct('n', 0L, 'end', 0), (a, s) -> named_struct("
                "'n', a.n + greatest(0, s.end - greatest(s.start, a.end)), 'end', greatest(a.end, s.end))).n"
            ),
        )
    )
    plain = [F.col(f"`{c}`") for c in keep]
    kind = benchmark.schema[item_id].dataType.simpleString()
    none = scanned.where(F.size(runs) == 0).select(
        *plain,
        F.col(names["n_words"]),
        F.lit(0).cast("long").alias(names["n_hit"]),
        F.expr(f"cast(array() as array<{kind}>)").alias(names["items"]),
        F.expr("cast(array() as array<struct<start:int,end:int>>)").alias(names["spans"]),
    )
    some = (
        scanned.where(F.size(runs) > 0)
        .withColumnRenamed(names["row"], "quillflow row")
        .join(hits.select(F.col("row").alias("hit row"), F.col("n_hit").alias("hit n"), F.col("items").alias("hit items"), F.col("spans").alias("hit spans")).hint("shuffle_hash"), F.col("quillflow row") == F.col("hit row"), "left")
        .select(
            *plain,
            F.col(names["n_words"]),
            F.coalesce("hit n", F.lit(0)).cast("long").alias(names["n_hit"]),
            F.coalesce("hit items", F.expr(f"cast(array() as array<{kind}>)")).alias(names["items"]),
            F.coalesce("hit spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias(names["spans"]),
        )
    )
    return none.unionByName(some).withColumn(names["contaminated"], F.col(names["n_hit"]) > 0)
