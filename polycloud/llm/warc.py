"""WARC archives by way of a chunked record table.

A payload travels as rows (record, chunk number, chunk, digest so far), so no step after the page's own row holds a whole
record: the writer streams sorted chunk rows into gzip members and holds its own running digest against each row's, the
reader streams members back into chunk rows and holds the digest of what it read against the record's.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, shared_path, table, text_bytes

CHUNK = 64 << 10
#: Chunk rows per Arrow batch that the writer emits, so that a batch stays within a few MB.
BATCH_BYTES = 4 << 20


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def digests(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """page_id, digest, bytes per page; the digest is carried from chunk to chunk. A null html is an empty payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            view, out = memoryview(data), []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                sha = hashlib.sha1()
                for p in range(a, b, chunk):
                    sha.update(view[p : min(b, p + chunk)])
                out.append(_b32(sha.digest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(offsets[1:] - offsets[:-1])], names=["page_id", "digest", "bytes"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string")).mapInArrow(run, "page_id long, digest string, bytes long")


def record_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, digest, shared (one page answers for the payload), response (that page), one row per (page_id, digest).

    Of equal payloads of at least ``least`` bytes the largest page_id answers, smaller ones answer themselves.
    """
    marks = table(digests(pages), "digests")
    per = marks.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("copies"), F.max("bytes").alias("size"))
    per = per.withColumn("shared", F.col("size") >= least).drop("size")
    ids = marks.select("page_id", "digest").distinct()
    return join_hot(ids, per, "digest", "copies", marks.count(), F.xxhash64("page_id"))


def chunk_table(pages: DataFrame, chunk: int = CHUNK, least: int = 0) -> DataFrame:
    """page_id, url, digest (of the whole payload), bytes, chunk_no, last, copy, data, so_far (digest of the chunks up to this one).

    A row that repeats page_id and payload of an earlier row of its partition is a ``copy``: one row without data, as
    long as the payload has ``least`` bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "digest", "bytes", "chunk_no", "last", "copy", "data", "so_far"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.string()]
        rows: list[tuple] = []
        seen: set[tuple] = set()
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            view = memoryview(data)
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                sha, so_far = hashlib.sha1(), []
                for p in range(a, max(b, a + 1), chunk):
                    sha.update(view[p : min(b, p + chunk)])
                    so_far.append(_b32(sha.digest()))
                digest = so_far[-1]
                if b - a >= least:
                    if (ids[i], digest) in seen:
                        rows.append((ids[i], urls[i], digest, b - a, 0, b - a <= chunk, True, None, None))
                        continue
                    seen.add((ids[i], digest))
                for n, p in enumerate(range(a, max(b, a + 1), chunk)):
                    piece = view[p : min(b, p + chunk)]
                    rows.append((ids[i], urls[i], digest, b - a, n, p + chunk >= b, False, bytes(piece), so_far[n]))
                    held += len(piece) + 100
                    if held >= BATCH_BYTES:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    schema = "page_id long, url string, digest string, bytes long, chunk_no long, last boolean, copy boolean, data binary, so_far string"
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, schema)


class _Member:
    """One gzip member written piece by piece."""

    def __init__(self, out: io.RawIOBase):
        self.out, self.z = out, zlib.compressobj(1, zlib.DEFLATED, 31)

    def write(self, data: bytes) -> None:
        if piece := self.z.compress(data):
            self.out.write(piece)

    def close(self) -> None:
        self.out.write(self.z.flush())


def _head(page_id: int | None, url: str | None, digest: str, size: int, kind: str, refers: int | None) -> tuple[bytes, bytes]:
    """Record header and HTTP header. A revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "")
    name = "null" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {clean}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'null' if refers is None else refers}>"]
    length = len(http) + (size if kind == "response" else 0)
    return ("\r\n".join(lines) + f"\r\nContent-Length: {length}\r\n\r\n").encode(), http


def write_archives(pages: DataFrame, folder: str, least: int = 0, chunk: int = CHUNK) -> list[str]:
    """Writes every page as a record of gzip-per-record WARC files under ``folder``; returns the files.

    A file is written under a name of its own attempt and only the returned ones count, so retried tasks do no harm.
    """
    if least > chunk:
        raise ValueError("payloads below the revisit limit must fit in one chunk")
    # One shuffle of the payloads: a page's decision travels as a row ahead of its chunks.
    decided = record_types(pages, least).select("page_id", "digest", F.lit(-1).cast("long").alias("chunk_no"), "shared", "response")
    rows = chunk_table(pages, chunk, least).unionByName(decided, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        path = out = member = None
        shared = answers = opened = False
        response, written, extra, sha = None, -1, 0, hashlib.sha1()
        for batch in batches:
            for page_id, url, digest, total, n, last, data, so_far, is_shared, said in zip(*[col.to_pylist() for col in batch.columns]):
                if n < 0:
                    shared, response, opened = is_shared, said, False
                    answers = not shared or page_id == response
                    continue
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(path, compression=None)
                if not answers or (n == 0 and shared and opened and member is None):
                    if n == 0:
                        _whole(out, page_id, url, digest, total, response)
                    continue
                if n == 0 and shared and opened:
                    extra += 1  # another copy of the row whose payload is being written
                elif n == 0:
                    opened, written, extra, member, sha = True, -1, 0, _Member(out), hashlib.sha1()
                    for part in _head(page_id, url, digest, total, "response", None):
                        member.write(part)
                if member is not None and n == written + 1:  # copies bring each chunk again
                    member.write(data or b"")
                    sha.update(data or b"")
                    if _b32(sha.digest()) != so_far or (last and so_far != digest):
                        raise ValueError(f"chunk {n} of page {page_id} does not continue the digest before it")
                    written = n
                    if last:
                        member.write(b"\r\n\r\n")
                        member.close()
                        member = None
                        for _ in range(extra):
                            _whole(out, page_id, url, digest, total, response)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    ordered = rows.repartition("page_id", "digest").sortWithinPartitions("page_id", "digest", "chunk_no", "copy")
    files = ordered.select("page_id", "url", "digest", "bytes", "chunk_no", "last", "data", "so_far", "shared", "response").mapInArrow(run, "path string")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    return sorted(r.path for r in files.collect())


def _whole(out: io.RawIOBase, page_id, url, digest, size, refers) -> None:
    """A revisit record."""
    member = _Member(out)
    for part in _head(page_id, url, digest, size, "revisit", refers):
        member.write(part)
    member.write(b"\r\n\r\n")
    member.close()


def _pieces(stream) -> Iterator[tuple[bool, bytes]]:
    """(a member begins, decompressed piece) of a multi-member gzip stream, a bounded piece at a time."""
    z, begins, rest = zlib.decompressobj(31), True, b""
    while True:
        rest = rest or stream.read(CHUNK)
        if not rest:
            if not begins and (tail := z.flush()):
                yield False, tail
            return
        piece = z.decompress(rest, CHUNK)
        rest = z.unconsumed_tail
        if piece:
            yield begins, piece
            begins = False
        if z.eof:
            rest, z, begins = z.unused_data, zlib.decompressobj(31), True


def read_chunks(stream) -> Iterator[tuple[dict, int, bytes, str | None, bool]]:
    """(headers, chunk number, payload piece, digest so far, last) of every record; no record is held whole."""
    head: dict | None = None
    buffer, left, n, sha = b"", 0, 0, hashlib.sha1()
    for begins, piece in _pieces(stream):
        if begins:
            head, buffer, n, sha = None, b"", 0, hashlib.sha1()
        if head is None:
            buffer += piece
            end = buffer.find(b"\r\n\r\n")
            mid = buffer.find(b"\r\n\r\n", end + 4) if end >= 0 else -1
            if mid < 0:
                continue
            head = dict(x.split(": ", 1) for x in buffer[:end].decode().split("\r\n")[1:])
            http = dict(x.split(": ", 1) for x in buffer[end + 4 : mid].decode().split("\r\n")[1:])
            head["size"] = int(http["Content-Length"])
            left = int(head["Content-Length"]) - (mid + 4 - end - 4)
            piece = buffer[mid + 4 :]
            if left == 0:
                yield head, 0, b"", _b32(sha.digest()), True
                left = -1
        if left > 0 and piece:
            data = piece[:left]
            left -= len(data)
            sha.update(data)
            yield head, n, data, _b32(sha.digest()) if left == 0 else None, left == 0
            n += 1
            left = left or -1


def read_archives(spark: SparkSession, files: list[str], folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; each response's digest is checked against its payload."""
    number = lambda s: None if "null" in s else int(s[len("<urn:page:") : -1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    got = 0
                    for head, n, data, digest, last in read_chunks(stream):
                        got = len(data) + (got if n else 0)
                        if not last:
                            continue
                        said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = head["WARC-Type"]
                        if kind == "response" and (digest != said or got != head["size"]):
                            raise ValueError(f"{path}: {head['WARC-Record-ID']} does not match its digest")
                        rows.append((number(head["WARC-Record-ID"]), head["size"], said, kind, number(head["WARC-Refers-To"]) if kind == "revisit" else None))
                        if len(rows) >= 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    paths = spark.createDataFrame([(p,) for p in files], "path string").repartition(max(1, len(files)))
    return paths.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes all ``pages`` to archives in the shared folder and returns what reading them back gives. Only page_id, url and html are read.

    A null html is an empty payload; rows that repeat both page_id and payload give one response and revisits of it; a
    null page_id is the smallest; an empty table gives no archive and no row.
    """
    spark = pages.sparkSession
    folder = shared_path(spark, "archives")
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    return read_archives(spark, write_archives(pages, folder, least), folder)
