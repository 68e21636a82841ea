"""Operator 10: WARC archives, written in tasks and read back sequentially.

Writing: each record is one gzip member (version line, named fields, block). Of records with equal payloads of at
least `dedup_from` bytes the one with the largest id is a response, the others are revisits without a block that name it.
Reading: a sequential reader inflates member after member with an incremental zlib object, frames the block by its
Content-Length and compares the payload with its digest; it holds one record, never an archive.

Scale: digests are made in the scan; winners are one aggregated row for each digest (partial sums first, so a digest of
a third of all rows is no hot task), and the join that brings them back is one that Spark may split where it is skewed.
Archives are rolled at `roll_bytes` in the shared folder through the file system that its path names; a path without a
scheme is in the cluster's default file system, as Spark's own tables are. A task's files have
names of its attempt, and only the manifest of finished tasks is read: a lost executor leaves files that nobody reads.

Defined cases: null html is an empty payload; null url an empty target; rows that repeat an id each have a record, and
those of the largest id are all responses; an empty table gives an empty archive list; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, qualified, table

ROLL_BYTES = 32 << 20
CHUNK = 1 << 16


def file_system(path: str):
    """The file system of a qualified path (see store.qualified), and the path inside it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if ":" not in path.split("/", 1)[0]:
        raise ValueError(f"a path without a file system: {path}")
    return fs.FileSystem.from_uri(path)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(c for c in url if c >= " ")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Payload-Length", str(len(payload)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(head.encode() + block + b"\r\n\r\n") + made.flush()


def members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time."""
    inflate, out, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(CHUNK)
        if not data:
            if out:
                raise ValueError("the archive ends inside a record")
            return
        out.append(inflate.decompress(data))
        rest = b""
        if inflate.eof:
            rest = inflate.unused_data
            yield b"".join(out)
            inflate, out = zlib.decompressobj(31), []


def parse(raw: bytes) -> dict:
    """Fields and block of a record; its framing and digest are verified."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is not its Content-Length")
    if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Payload-Digest"][5:]:
        raise ValueError("a record's payload does not have its digest")
    return fields | {"block": block}


def write_warc(pages: DataFrame, folder: str, dedup_from: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes archives of pages (page_id, url, html) below `folder`; the manifest (path, n_records, n_bytes), still lazy."""
    folder = qualified(pages.sparkSession, folder)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
    winners = pages.where(F.length("payload") >= dedup_from).groupBy("digest").agg(F.max("page_id").alias("first_id"))
    rows = pages.join(winners, "digest", "left").select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.col("first_id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        context = TaskContext.get()
        done, out, n, size, name = [], None, 0, 0, ""
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for page_id, url, body, digest, refers_to in zip(*[c.to_pylist() for c in batch.slice(k, 64).columns], strict=True):
                    if out is None:
                        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):04d}-{uuid.uuid4().hex[:8]}.warc.gz"
                        out, n, size = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                    raw = record(page_id, url, body, base64.b32encode(digest).decode(), refers_to)
                    out.write(raw)
                    n, size = n + 1, size + len(raw)
                    if size >= roll_bytes:
                        out.close()
                        done.append((f"{folder}/{name}", n, size))
                        out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "n_records", "n_bytes"])

    return rows.mapInArrow(run, "path string, n_records long, n_bytes long")


def read_warc(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the manifest's archives: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", *(["payload"] if with_payload else [])]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *([pa.binary()] if with_payload else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda s: int(s[10:-1]) if len(s) > 11 else None
        rows: list[tuple] = []
        size = 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inside = file_system(path)
                with system.open_input_stream(inside, compression=None) as stream:
                    for raw in members(stream):
                        x = parse(raw)
                        revisit = x["WARC-Type"] == "revisit"
                        n = int(x["WARC-Refers-To-Payload-Length"]) if revisit else len(x["block"])
                        rows.append((number(x["WARC-Record-ID"]), x["WARC-Target-URI"], x["WARC-Type"], number(x["WARC-Refers-To"]) if revisit else None, x["WARC-Payload-Digest"][5:], n, x["block"])[: len(names)])
                        size += len(x["block"]) * with_payload + 200
                        if size > 8 << 20:
                            yield flush()
                            rows, size = [], 0
        yield flush()

    paths = manifest.select("path")
    n = manifest.sparkSession.sparkContext.defaultParallelism * 2
    return paths.repartition(n).mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * with_payload)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    manifest = scratch.table(write_warc(table(spark, sf_dir, "pages"), scratch.path("archive")), "manifest")
    return read_warc(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
