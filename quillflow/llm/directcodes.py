"""Token ids in files of directly addressable codes.

A file holds the ids of a run of documents. Every id is split into chunks of eight bits; the
lowest chunks of all ids are level 0, the next chunks of those ids that need one are level 1,
and so on. A continuation bitmap for each level says which entries go on, and a rank directory
(the ones before each 512th bit) tells where. Token i is read as one byte for each level and
one bitmap block: nothing else is decoded.

Layout, all little-endian: ``QDAC0001``, the header's length (8 bytes), the header as JSON
(counts, how many of the first documents have no id, section offsets), doc ids and their first tokens (int64), and for each level
chunks, bitmap and rank directory (int64).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, files
from .common import ship

MAGIC = b"QDAC0001"
BLOCK = 512  # bits between two entries of a rank directory


def levels_of(ids: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Chunks, continuation bitmap and rank directory of each level."""
    out, rest = [], np.asarray(ids, np.uint32)
    while True:
        goes_on = rest > 255
        padded = np.zeros(-(-max(1, len(rest)) // BLOCK) * BLOCK, bool)
        padded[: len(rest)] = goes_on
        ones = padded.reshape(-1, BLOCK).sum(1, dtype=np.int64)
        out.append(
            {
                "chunks": (rest & 255).astype(np.uint8),
                "bitmap": np.packbits(padded, bitorder="little"),
                "ranks": np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<i8"),
            }
        )
        rest = rest[goes_on] >> np.uint32(8)
        if not len(rest):
            return out


def to_bytes(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, nulls: int = 0) -> bytes:
    """A whole file; ``starts`` has one entry more than there are documents, of which the first
    ``nulls`` have no id (0 stands for it)."""
    parts, sections, at = [], {}, 0

    def add(name: str, array: np.ndarray) -> None:
        nonlocal at
        raw = array.tobytes()
        sections[name] = [at, len(raw)]
        parts.append(raw)
        at += len(raw)

    add("docs", np.asarray(doc_ids, "<i8"))
    add("starts", np.asarray(starts, "<i8"))
    levels = levels_of(ids)
    for k, level in enumerate(levels):
        for name, array in level.items():
            add(f"{name}{k}", array)
    header = json.dumps(
        {"docs": len(doc_ids), "nulls": nulls, "tokens": len(ids), "levels": len(levels), "sections": sections}
    ).encode()
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, *parts])


class Reader:
    """Random access to one file through an object with ``read_at(size, offset)``."""

    def __init__(self, source):
        self.source = source
        head = bytes(source.read_at(16, 0))
        if head[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        size = int.from_bytes(head[8:], "little")
        self.header = json.loads(bytes(source.read_at(size, 16)))
        self.base = 16 + size
        self.sections = self.header["sections"]

    def _at(self, name: str, offset: int, size: int) -> bytes:
        start, length = self.sections[name]
        return bytes(self.source.read_at(min(size, length - offset), self.base + start + offset))

    def _all(self, name: str, dtype: str) -> np.ndarray:
        return np.frombuffer(self._at(name, 0, self.sections[name][1]), dtype)

    def token(self, i: int) -> int:
        """The id of token ``i`` of the file."""
        if not 0 <= i < self.header["tokens"]:
            raise IndexError(i)
        value = 0
        for k in range(self.header["levels"]):
            value |= self._at(f"chunks{k}", i, 1)[0] << (8 * k)
            block, bit = divmod(i, BLOCK)
            bits = np.unpackbits(
                np.frombuffer(self._at(f"bitmap{k}", block * BLOCK // 8, BLOCK // 8), np.uint8),
                bitorder="little",
            )
            if not bits[bit]:
                return value
            rank = int.from_bytes(self._at(f"ranks{k}", block * 8, 8), "little")
            i = rank + int(bits[:bit].sum())
        return value

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        return self._all("docs", "<i8"), self._all("starts", "<i8")

    def tokens(self) -> np.ndarray:
        """All ids, level by level from the last."""
        value = np.zeros(0, np.uint32)
        for k in reversed(range(self.header["levels"])):
            chunks = self._all(f"chunks{k}", "u1").astype(np.uint32)
            bits = np.unpackbits(self._all(f"bitmap{k}", "u1"), bitorder="little")[: len(chunks)]
            chunks[bits.astype(bool)] |= value << np.uint32(8)
            value = chunks
        return value


def write_files(
    docs: DataFrame,
    directory: str,
    tokenizer: str | None = None,
    end_id: int = 2,
    file_tokens: int = 8_000_000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> list[dict]:
    """Writes all documents in ascending ``doc_id`` order; the committed manifest.

    Rows are range-partitioned and sorted by ``doc_id`` (equal ids, and rows without one, by
    text, and split over tasks by it), encoded with ``end_id`` closing each document and written
    in files of about ``file_tokens`` tokens, the most a task holds. Where a file ends follows
    Spark's ranges; ids and their order don't. Null and empty texts are the closing id alone;
    null ids come first; ids that are no integers raise TypeError; an empty table gives an
    empty manifest; other columns are ignored. ``base`` in the manifest counts the tokens of
    all files before.
    """
    files.integer_ids(docs, doc_id)
    ship(docs.sparkSession)
    path = tokenizer or bpe.default_path()
    files.prepare(directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path)
        part = TaskContext.get().partitionId()
        fs = files.open_fs(directory)[0]
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        tokens, rolled = 0, 0

        def roll() -> pa.RecordBatch:
            nonlocal keys, held, tokens, rolled
            starts = np.concatenate([[0], np.cumsum([len(h) for h in held])])
            temp = files.temporary(directory)
            with fs.open_output_stream(files.open_fs(temp)[1]) as out:
                nulls = sum(k is None for k in keys)
                out.write(to_bytes(np.array([k or 0 for k in keys]), starts, np.concatenate(held), nulls))
            row = {
                "temp": [temp],
                "part": [part],
                "number": [rolled],
                "docs": [len(keys)],
                "tokens": [tokens],
            }
            keys, held, tokens = [], [], 0
            rolled += 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                for key, ids in zip(
                    piece.column(0).to_pylist(), enc.encode(piece.column(1).to_pylist())
                ):
                    keys.append(key)
                    held.append(np.append(ids, np.array(end_id, ids.dtype)))
                    tokens += len(held[-1])
                    if tokens >= file_tokens:
                        yield roll()
        if keys:
            yield roll()

    found = (
        docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
        .repartitionByRange("doc_id", F.substring("text", 1, 64))
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, "temp string, part long, number long, docs long, tokens long")
        .collect()
    )
    listed, base = [], 0
    for i, r in enumerate(sorted(found, key=lambda r: (r["part"], r["number"]))):
        listed.append(
            {
                "temp": r["temp"],
                "name": f"ids-{i:06d}.qdac",
                "docs": r["docs"],
                "tokens": r["tokens"],
                "base": base,
            }
        )
        base += r["tokens"]
    return files.commit(directory, listed)


def read_files(spark, directory: str) -> DataFrame:
    """One row for each stored document: doc_id, start (over all files), n_tokens, ids
    (little-endian unsigned 32-bit). A task reads one file at a time."""
    ship(spark)
    listed = files.manifest(directory)
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not listed:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = files.open_fs(files.join(directory, name))
                with fs.open_input_file(path) as source:
                    reader = Reader(source)
                    keys, starts = reader.documents()
                    nulls = reader.header["nulls"]
                    ids = reader.tokens().astype("<u4")
                for lo in range(0, len(keys), 2000):
                    hi = min(lo + 2000, len(keys))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[lo:hi], mask=np.arange(lo, hi) < nulls),
                            pa.array(starts[lo:hi] + base, pa.int64()),
                            pa.array(np.diff(starts[lo : hi + 1]), pa.int64()),
                            pa.array([ids[starts[i] : starts[i + 1]].tobytes() for i in range(lo, hi)], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    rows = [(f["name"], f["base"]) for f in listed]
    return files.listed(spark, rows, "name string, base long").mapInArrow(run, schema)


def token_at(spark, directory: str, i: int) -> int:
    """The ``i``-th token of all files: one lookup in the manifest, a few bytes of one file."""
    for f in files.manifest(directory):
        if f["base"] <= i < f["base"] + f["tokens"]:
            fs, path = files.open_fs(files.join(directory, f["name"]))
            with fs.open_input_file(path) as source:
                return Reader(source).token(i - f["base"])
    raise IndexError(i)
