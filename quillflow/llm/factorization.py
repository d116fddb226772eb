"""Quality classifier: a factorisation machine on hashed words and structure.

Features of a text are its words hashed to ``BUCKETS`` (weights 1 + log count, scaled to unit
length) and one-hot bins of structure statistics and of the metadata column with the text's
length. The machine adds to a linear score all pairwise interactions through vectors of ``k``
numbers per feature, computed in linear time as half of (square of sums - sum of squares).

It is fitted on at most ``max_rows`` labelled rows (those with the smallest hashes of their
ids, outside the held-out fifth); their features, a few KB each, are the only thing that
reaches the driver. Scoring sends every task the model, whose size is fixed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_name, mapped, ship

BUCKETS = 1 << 14
BINS = 16
MAX_ROWS = 6000
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOL, _POINT = b"#*$%&|<>{}[]\\^~_=+@", b".,;:!?"
STATISTICS = 16


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for null ids."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def statistics(data: bytes, words: list[bytes], counts: Counter, n_chars: int | None) -> list[float]:
    """Structure of a text: sizes, shares of kinds of characters, repetition; metadata last."""
    n, size = max(1, len(words)), max(1, len(data))
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / size
    return [
        math.log1p(len(words)),
        len(data) / n,
        share(_UPPER),
        share(_DIGIT),
        share(_SYMBOL),
        share(_POINT),
        data.count(b"!") / n,
        data.count(b"|") / n,
        data.count(b"http") / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        max(map(len, lines), default=0) / size,
        max(map(len, counts), default=0),
        math.log1p(n_chars or 0) - math.log1p(len(data.decode("utf-8", "replace"))),
    ]


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Buckets, their weights (unit length) and statistics of a text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    counts = Counter(words)
    stats = statistics(data, words, counts, n_chars)
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), stats
    buckets = np.fromiter(map(crc32, counts), np.int64, len(counts)) % BUCKETS
    weights = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    weights /= np.sqrt((weights**2).sum())
    return buckets.astype(np.int32), weights.astype(np.float32), stats


class Machine:
    """Weights of the factorisation machine and the edges of the statistics' bins."""

    def __init__(self, edges: np.ndarray, k: int = 8, seed: int = 7):
        self.edges = edges
        size = BUCKETS + STATISTICS * (BINS + 1)
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.linear = np.zeros(size, np.float32)
        self.vectors = rng.normal(0, 0.05, (size, k)).astype(np.float32)

    def rows(self, found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices, values and row starts of several texts' features."""
        index, value, starts = [], [], [0]
        base = BUCKETS + np.arange(STATISTICS) * (BINS + 1)
        each = np.full(STATISTICS, STATISTICS**-0.5, np.float32)
        for buckets, weights, stats in found:
            bins = np.array([np.searchsorted(e, s, side="right") for e, s in zip(self.edges, stats)])
            index += [buckets, (base + bins).astype(np.int32)]
            value += [weights, each]
            starts.append(starts[-1] + len(buckets) + STATISTICS)
        return np.concatenate(index), np.concatenate(value), np.array(starts)

    def _sums(self, index, value, starts):
        at = starts[:-1]
        linear = np.add.reduceat(self.linear[index] * value, at)
        scaled = self.vectors[index] * value[:, None]
        total = np.add.reduceat(scaled, at, axis=0)
        squares = np.add.reduceat((scaled**2).sum(1), at)
        return self.bias + linear + ((total**2).sum(1) - squares) / 2, total, scaled

    def scores(self, found: list[tuple]) -> np.ndarray:
        z = self._sums(*self.rows(found))[0]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))

    def fit(self, found: list[tuple], labels: np.ndarray, epochs: int = 12, rate: float = 0.03, decay: float = 1e-5, batch: int = 64) -> None:
        """Logistic loss by Adagrad in small batches; the same rows give the same model."""
        order = np.random.default_rng(11)
        index, value, starts = self.rows(found)
        past_l = np.full(self.linear.shape, 1e-2, np.float32)
        past_v = np.full(self.vectors.shape, 1e-2, np.float32)
        past_b = 1e-2
        for _ in range(epochs):
            for lo in range(0, len(labels), batch):
                if lo == 0:
                    turn = order.permutation(len(labels))
                rows = turn[lo : lo + batch]
                spans = [np.arange(starts[r], starts[r + 1]) for r in rows]
                at = np.concatenate(spans)
                sizes = np.array([len(s) for s in spans])
                i, x = index[at], value[at]
                z, total, scaled = self._sums(i, x, np.concatenate([[0], np.cumsum(sizes)]))
                error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[rows]).astype(np.float32)
                e = np.repeat(error, sizes) * x
                slope = (np.repeat(total, sizes, axis=0) - scaled) * e[:, None]
                seen, place = np.unique(i, return_inverse=True)
                g = np.bincount(place, e, len(seen)).astype(np.float32) + decay * self.linear[seen]
                past_l[seen] += g * g
                self.linear[seen] -= rate * g / np.sqrt(past_l[seen])
                gv = np.stack([np.bincount(place, slope[:, f], len(seen)) for f in range(slope.shape[1])], 1).astype(np.float32)
                gv += decay * self.vectors[seen]
                past_v[seen] += gv * gv
                self.vectors[seen] -= rate * gv / np.sqrt(past_v[seen])
                gb = float(error.sum())
                past_b += gb * gb
                self.bias -= rate * gb / math.sqrt(past_b)


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = MAX_ROWS,
    text: str = "text",
    doc_id: str = "doc_id",
    n_chars: str | None = "n_chars",
    label: str = "quality",
) -> Machine:
    """Fits a machine on at most ``max_rows`` labelled rows outside the held-out fifth.

    Rows without an id, text or a label 0 or 1 are not used; repeated labels count once. With
    no usable row the machine scores every text alike.
    """
    ship(docs.sparkSession)
    key = F.col(f"`{doc_id}`")
    chosen = (
        labels.where(F.col(f"`{label}`").isin(0, 1) & key.isNotNull() & ~held_out(key))
        .select(key.alias("labelled"), F.col(f"`{label}`").cast("int").alias("quality_label"))
        .groupBy("labelled")
        .agg(F.max("quality_label").alias("quality_label"))
        .orderBy(F.xxhash64("labelled"), "labelled")
        .limit(max_rows)
    )
    meta = F.col(f"`{n_chars}`").cast("long") if n_chars else F.lit(None).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t, n) for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([r[0].tobytes() for r in rows], pa.binary()),
                    pa.array([r[1].tobytes() for r in rows], pa.binary()),
                    pa.array([r[2] for r in rows], pa.list_(pa.float64())),
                ],
                ["id", "label", "buckets", "weights", "stats"],
            )

    texts = docs.select(key.alias("id"), F.col(f"`{text}`").alias("text"), meta.alias("meta")).where("text is not null")
    rows = (
        texts.join(F.broadcast(chosen), F.col("id") == F.col("labelled"))  # max_rows rows of 12 bytes
        .select(F.col("id").cast("string").alias("id"), "quality_label", "text", "meta")
        .mapInArrow(run, "id string, label int, buckets binary, weights binary, stats array<double>")
        .groupBy("id")  # of rows that share an id, the one with the least hash
        .agg(F.min_by(F.struct("label", "buckets", "weights", "stats"), F.xxhash64("buckets", "weights")).alias("r"))
        .select("id", "r.*")
        .collect()
    )
    rows.sort(key=lambda r: r["id"])
    found = [(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["weights"], np.float32), r["stats"]) for r in rows]
    if not found:
        return Machine(np.zeros((STATISTICS, BINS)))
    stats = np.array([f[2] for f in found])
    machine = Machine(np.quantile(stats, np.arange(1, BINS + 1) / (BINS + 1), axis=0).T.copy())
    machine.fit(found, np.array([r["label"] for r in rows], np.float32))
    return machine


def score(
    docs: DataFrame,
    machine: Machine,
    text: str = "text",
    n_chars: str | None = "n_chars",
    keep: list[str] | None = None,
    name: str = "score",
) -> DataFrame:
    """The columns ``keep`` (all by default) of every row and its score from 0 to 1.

    Null and empty texts are scored as texts without words; a null length counts as 0;
    repeated rows come back repeated; an empty table gives no rows.
    """
    keep = docs.columns if keep is None else keep
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    name = free_name(kept, name)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts, sizes = batch.column(at).to_pylist(), batch.column(at + 1).to_pylist()
            scores = [
                model.scores([features(t, n) for t, n in zip(texts[lo : lo + 200], sizes[lo : lo + 200])])
                for lo in range(0, len(texts), 200)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                [*batch.schema.names[:at], name],
            )

    meta = F.col(f"`{n_chars}`").cast("long") if n_chars else F.lit(None).cast("long")
    return mapped(docs, keep, [F.col(f"`{text}`"), meta], run, StructType().add(name, "double"))
