"""Deterministic sharded WARC archives.

Pages are range-partitioned and sorted by page id; each task writes gzip records one after
another and starts a new file when the compressed size passes a limit. Record ids, dates,
HTTP and WARC headers and digests are made anew from the row, so the same table in the same
ranges gives the same bytes (records and their order follow from the table alone, where a file
ends follows Spark's ranges). Files get temporary names and are committed by a manifest.

Pages whose payload equals that of a page with a smaller id become revisit records. Only
(page id, digest) pairs meet for that; the html itself is shuffled once, for the ranges.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import ship, written

# Names that the WARC 1.1 format prescribes.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, n: int, spread: int = 0) -> str:
    """The id of the n-th record of a page, or of those without a page id and one ``spread``."""
    name = f"none:{spread}:{n}" if page_id is None else f"page:{page_id}:{n}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(page_id, url, payload: bytes, refers_to, n: int, date: str, spread: int = 0) -> bytes:
    """One record, not yet compressed; a revisit if ``refers_to`` is not None."""
    revisit = refers_to is not None
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, n, spread)),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if url is not None:
        clean = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
        head.append(("WARC-Target-URI", clean))
    if revisit:
        head += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to, 0)),
            ("X-Refers-To-Page-Id", str(refers_to)),
        ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def revisits_of(pages: DataFrame, min_bytes: int, page_id: str, html: str) -> DataFrame:
    """(page_id, sha1, refers_to) of every page that repeats the payload of a smaller id."""
    payload = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    pairs = pages.select(
        F.col(f"`{page_id}`").alias("page_id"), F.sha1(payload).alias("sha1"), F.length(payload).alias("n")
    ).where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull())
    first = (
        pairs.groupBy("sha1")
        .agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
        .where("refers_to < last")
        .drop("last")
    )
    return (
        pairs.join(first, "sha1")
        .where("page_id > refers_to")
        .select("page_id", "sha1", "refers_to")
        .distinct()
    )


def write_archives(
    pages: DataFrame,
    directory: str,
    min_bytes: int = 0,
    roll_bytes: int = 64 << 20,
    date: str = "2024-01-01T00:00:00Z",
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> list[dict]:
    """Writes one record for each row; the committed manifest.

    Null html is an empty payload, null urls get no target, rows without a page id are
    responses that nothing refers to, spread over tasks by their hash. Of rows that share id
    and payload the first is the response (or a revisit of the smaller id), the others revisit
    it. Page ids that are no integers raise TypeError. An empty table gives an empty manifest;
    other columns are ignored. A task holds one record.
    """
    files.integer_ids(pages, page_id)
    ship(pages.sparkSession)
    files.prepare(directory)
    revisits = written(revisits_of(pages, min_bytes, page_id, html), "warc-revisits")
    kind = pages.schema[page_id].dataType
    rows = pages.select(
        F.col(f"`{page_id}`").alias("page_id"),
        F.when(F.col(f"`{page_id}`").isNull(), F.xxhash64(F.col(f"`{url}`"), F.col(f"`{html}`"))).otherwise(0).alias("spread"),
        F.lit(1).alias("step"),
        F.col(f"`{url}`").alias("url"),
        F.col(f"`{html}`").alias("html"),
        F.lit(None).cast("string").alias("sha1"),
        F.lit(None).cast(kind).alias("refers_to"),
    ).unionByName(
        revisits.select(
            "page_id",
            F.lit(0).cast("long").alias("spread"),
            F.lit(0).alias("step"),
            F.lit(None).cast("string").alias("url"),
            F.lit(None).cast("string").alias("html"),
            "sha1",
            "refers_to",
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs = files.open_fs(directory)[0]
        out, temp, size, records, rolled = None, "", 0, 0, 0
        current, spread, known, n = object(), 0, {}, 0

        def close() -> pa.RecordBatch:
            nonlocal out, size, records, rolled
            out.close()
            out = None
            row = {"temp": [temp], "part": [part], "number": [rolled], "records": [records], "bytes": [size]}
            size, records = 0, 0
            rolled += 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["page_id"], row["spread"]) != (current, spread):
                    current, spread, known, n = row["page_id"], row["spread"], {}, 0
                if row["step"] == 0:
                    known[row["sha1"]] = row["refers_to"]
                    continue
                payload = (row["html"] or "").encode()
                refers_to = None
                if current is not None and len(payload) >= min_bytes:
                    sha1 = hashlib.sha1(payload).hexdigest()
                    refers_to = known.get(sha1)
                    known.setdefault(sha1, current)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = packer.compress(record(current, row["url"], payload, refers_to, n, date, spread)) + packer.flush()
                n += 1
                if out is None:
                    temp = files.temporary(directory)
                    out = fs.open_output_stream(files.open_fs(temp)[1], compression=None)
                out.write(raw)
                size += len(raw)
                records += 1
                if size >= roll_bytes:
                    yield close()
        if out is not None:
            yield close()

    found = (
        rows.repartitionByRange("page_id", "spread")
        .sortWithinPartitions("page_id", "spread", "step", "url", "html")
        .mapInArrow(run, "temp string, part long, number long, records long, bytes long")
        .collect()
    )
    listed = [
        {"temp": r["temp"], "name": f"pages-{i:06d}.warc.gz", "records": r["records"], "bytes": r["bytes"]}
        for i, r in enumerate(sorted(found, key=lambda r: (r["part"], r["number"])))
    ]
    return files.commit(directory, listed)


def parse(source) -> Iterator[dict]:
    """Records of an open archive: headers by lower-case name, and the block."""
    data = b""
    while True:
        if not data:
            data = source.read(CHUNK)
            if not data:
                return
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if not data and not (data := source.read(CHUNK)):
                raise ValueError("an archive ends within a record")
            parts.append(member.decompress(data))
            data = member.unused_data
        raw = b"".join(parts)
        head, _, block = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        found = dict(x.split(": ", 1) for x in lines[1:])
        found = {k.lower(): v for k, v in found.items()}
        yield {"headers": found, "block": block[: int(found["content-length"])]}


def read_archives(spark, directory: str) -> DataFrame:
    """One row for each record of all archives: page_id, url, record_type, payload_bytes,
    payload_digest (for responses made from the payload read), refers_to, payload (null for
    revisits). A task reads one file, record by record; a wrong digest raises an error."""
    ship(spark)
    listed = files.manifest(directory)
    schema = (
        "page_id long, url string, record_type string, payload_bytes long,"
        " payload_digest string, refers_to long, payload binary"
    )
    if not listed:
        return spark.createDataFrame([], schema)
    names = [x.split()[0] for x in schema.split(",")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def out():
            nonlocal rows, held
            made = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            rows, held = [], 0
            return pa.RecordBatch.from_arrays(made, names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = files.open_fs(files.join(directory, name))
                with fs.open_input_stream(path, compression=None) as source:
                    for r in parse(source):
                        h = r["headers"]
                        payload = r["block"].partition(b"\r\n\r\n")[2]
                        stated = h["warc-payload-digest"].removeprefix("sha1:")
                        size = int(h["x-payload-length"])
                        if h["warc-type"] == "revisit":
                            payload = None
                        elif digest(payload) != stated or len(payload) != size:
                            raise ValueError(f"{name}: a payload differs from its digest")
                        if digest(r["block"]) != h["warc-block-digest"].removeprefix("sha1:"):
                            raise ValueError(f"{name}: a block differs from its digest")
                        page, other = h.get("x-page-id"), h.get("x-refers-to-page-id")
                        rows.append(
                            (
                                None if page is None else int(page),
                                h.get("warc-target-uri"),
                                h["warc-type"],
                                size,
                                stated,
                                None if other is None else int(other),
                                payload,
                            )
                        )
                        held += len(payload or b"")
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield out()
        if rows:
            yield out()

    rows = [(f["name"],) for f in listed]
    return files.listed(spark, rows, "name string").mapInArrow(run, schema)
