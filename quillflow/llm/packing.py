"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each task cuts its own documents: pieces of ``capacity`` tokens become windows of their own,
what remains of a document is cut into pieces of at most ``piece`` tokens and collected.
When the collected tokens come close to ``windows`` full windows, multiway differencing
deals the pieces to that many windows: the two partial partitions with the largest spreads
are merged, fullest slot with emptiest slot, until one partition is left. Its windows are
nearly equal; while one exceeds the capacity, the window count rises by one and the pieces
are dealt again. A task holds one such batch, there is no shuffle, and no key can be hot.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import ship

SCHEMA = (
    "doc_id {id}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
)


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Deals sizes to ``k`` slots by multiway differencing; the indices in each slot."""
    n = len(sizes)
    follow = np.full(n, -1)  # the next piece in the same slot
    empty = np.full(k, -1)
    heap = []
    for i, size in enumerate(sizes):
        sums, head = np.zeros(k, np.int64), empty.copy()
        sums[0], head[0] = size, i
        heap.append((-size, i, sums, head, head.copy()))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, sums, head, tail = heapq.heappop(heap)
        _, _, sums2, head2, tail2 = heapq.heappop(heap)
        sums = sums + sums2[::-1]
        head2, tail2 = head2[::-1], tail2[::-1]
        both = (head >= 0) & (head2 >= 0)
        follow[tail[both]] = head2[both]
        head = np.where(head >= 0, head, head2)
        tail = np.where(tail2 >= 0, tail2, tail)
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), i, sums, head[order], tail[order]))
    slots = []
    for first in heap[0][3].tolist() if heap else []:
        slot = []
        while first >= 0:
            slot.append(first)
            first = int(follow[first])
        slots.append(slot)
    return [s for s in slots if s]


def deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Nearly equal windows of at most ``capacity``; each size is at most that."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        slots = difference(sizes, k)
        if all(sum(sizes[i] for i in s) <= capacity for s in slots):
            return slots
        k += 1


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = 1024,
    end_id: int = 0,
    piece: int = 256,
    windows: int = 128,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents with their window: the pieces' token ids and places.

    One row for each piece: doc_id, start (ids of its document before it), length,
    doc_tokens (with the closing ``end_id``), ids (little-endian unsigned 32-bit),
    sequence_id and offset there. Offsets in a sequence are gapless from 0.

    Null and empty texts are the single id ``end_id``; null ids stay null; repeated rows are
    packed once each; other columns are ignored; an empty table gives no rows. The result
    depends on how the input is partitioned, not on the order in which tasks run. Each task
    leaves at most about one window of padding beside the ``piece``-sized rest.
    """
    ship(docs.sparkSession)
    path = tokenizer or bpe.default_path()
    slack = windows * 2  # tokens; room for the last differences

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 32
        rows: list[tuple] = []
        held: list[tuple] = []
        tokens, waiting = 0, 0
        id_type = None

        def flush():
            nonlocal sequence, held, tokens, waiting
            for slot in deal([h[2] for h in held], capacity):
                at = 0
                for i in slot:
                    rows.append((*held[i], sequence, at))
                    at += held[i][2]
                    waiting += 1
                sequence += 1
            held, tokens = [], 0

        def out() -> pa.RecordBatch:
            nonlocal rows, waiting
            cols = list(zip(*rows)) if rows else [[]] * 7
            made = [
                pa.array(c, t)
                for c, t in zip(cols, [id_type, *[pa.int64()] * 3, pa.binary(), *[pa.int64()] * 2])
            ]
            rows, waiting = [], 0
            return pa.RecordBatch.from_arrays(
                made, ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for key, ids in zip(keys, enc.encode(texts)):
                    ids = np.append(ids.astype("<u4"), np.uint32(end_id))
                    n = len(ids)
                    full = n - n % capacity
                    for s in range(0, full, capacity):
                        rows.append(
                            (key, s, capacity, n, ids[s : s + capacity].tobytes(), sequence, 0)
                        )
                        sequence += 1
                        waiting += 1
                    s = full
                    while s < n:
                        size = min(piece, n - s, windows * capacity - slack - tokens)
                        held.append((key, s, size, n, ids[s : s + size].tobytes()))
                        s += size
                        tokens += size
                        if tokens >= windows * capacity - slack:
                            flush()
                    if waiting > 8000:
                        yield out()
        if held:
            flush()
        if rows:
            yield out()

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        run, SCHEMA.format(id=kind)
    )


def ids_crc32(ids: Column) -> Column:
    """Unsigned CRC-32 of a binary column."""
    return F.crc32(ids)
