"""WARC archives written and read by executors, payloads as a chunked record table.

Writing: one record per row, one gzip member per record, payload fed to the compressor in slices.
Files carry names of their own, and the written list of segments (file, first and last byte) is the
commit: what a lost task left behind is in no list. Reading: each segment is inflated piece by piece
and becomes rows (record, chunk number, chunk, bytes so far, digest so far, last); the digest is
carried from chunk to chunk, so no record is ever held whole, whatever its size.

Of payloads that agree in digest and have ``min_bytes`` or more, the one with the smallest id is
a response; others are revisits that refer to it and carry its HTTP header and digest alone.

Defined results: a null payload is empty; payloads below ``min_bytes`` are all responses. Rows without
id are revisits of an equal payload that has one, else responses. Rows that repeat id
and payload give a record each, all of the same type. An empty table gives an empty list of segments and
no records. A null address becomes that of the record id. Extra columns take no part.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from handful.llm.common import as_batch, byte_values, opened
from handful.session import cut_lineage, shared_path

GZIP = 31
SLICE = 1 << 18
END = b"\r\n\r\n"
SEGMENTS = "path string, start bigint, stop bigint"
RECORDS = (
    "id bigint, record_type string, refers_to bigint, url string, chunk_no int, chunk binary, "
    "so_far bigint, digest string, last boolean"
)
RECORD_SCHEMA = pa.schema(
    [
        ("id", pa.int64()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
        ("chunk_no", pa.int32()),
        ("chunk", pa.binary()),
        ("so_far", pa.int64()),
        ("digest", pa.string()),
        ("last", pa.bool_()),
    ]
)


def record_name(number) -> str:
    return f"<urn:page:{'none' if number is None else number}>"


def name_number(name: str):
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name)
    return int(found[1]) if found else None


def http_header(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + END


def record_header(number, url, size: int, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """Header block of a WARC record and of its HTTP message."""
    block = http_header(size)
    address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else record_name(number)[1:-1]
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_name(number)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {address}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block) + (0 if revisit else size)}",
    ]
    if revisit:
        fields.insert(5, f"WARC-Refers-To: {record_name(refers_to)}")
        fields.insert(5, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(fields).encode() + END + block


def plan_records(pages: DataFrame, key: str, payload: str, url: str, min_bytes: int) -> DataFrame:
    """(id, payload, url, digest, refers_to): refers_to set on revisits."""
    rows = pages.select(
        F.col(key).cast("bigint").alias("id"),
        F.coalesce(F.col(payload), F.lit("")).alias("payload"),
        F.col(url).cast("string").alias("url"),
    ).withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= min_bytes).select("id", "digest")
    first = large.groupBy("digest").agg(F.min("id").alias("refers_to"))
    # Narrow rows meet their digest first, so that a large group of copies moves no payload to one task.
    revisits = (
        large.distinct()
        .join(first, "digest")
        .where(~F.col("id").eqNullSafe(F.col("refers_to")))
        .select(F.col("id").alias("of"), F.col("digest").alias("of_digest"), "refers_to")
    )
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest"))
    return rows.join(revisits, same, "left").select("id", "payload", "url", "digest", "refers_to")


def write_archives(
    pages: DataFrame,
    key: str = "page_id",
    payload: str = "html",
    url: str = "url",
    min_bytes: int = 100,
    date: str = "1970-01-01T00:00:00Z",
    segment_bytes: int = 32 << 20,
    archive_bytes: int = 1 << 30,
) -> DataFrame:
    """The committed list of segments of the archives that hold a record per row of ``pages``."""
    folder = shared_path(pages.sparkSession, "warc")
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])

    def write(batches):
        files, base = opened(folder)
        files.create_dir(base, recursive=True)
        out = path = None
        start = at = 0
        for batch in batches:
            found = []
            numbers, urls, digests, refers = (batch.column(n).to_pylist() for n in ("id", "url", "digest", "refers_to"))
            bodies = batch.column("payload")
            for k, number in enumerate(numbers):
                if out is None:
                    path, start, at = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{base}/{path}", compression=None)
                body = memoryview(bodies[k].as_buffer() or b"")
                revisit = refers[k] is not None
                pack = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                parts = [
                    pack.compress(record_header(number, urls[k], len(body), digests[k], refers[k], revisit, date))
                ]
                for s in range(0, 0 if revisit else len(body), SLICE):
                    parts.append(pack.compress(body[s : s + SLICE]))
                    if sum(map(len, parts)) >= SLICE:
                        at += out.write(b"".join(parts))
                        parts = []
                at += out.write(b"".join([*parts, pack.compress(END), pack.flush()]))
                if at - start >= segment_bytes:
                    found.append((path, start, at))
                    start = at
                    if at >= archive_bytes:
                        out.close()
                        out = None
            if found:
                yield as_batch(schema, **dict(zip(("path", "start", "stop"), zip(*found))))
        if out is not None:
            out.close()
            if at > start:
                yield as_batch(schema, path=[path], start=[start], stop=[at])

    rows = plan_records(pages, key, payload, url, min_bytes)
    segments = cut_lineage(rows.mapInArrow(write, SEGMENTS), "warc-segments")
    return segments.withColumn("path", F.concat(F.lit(folder + "/"), "path"))


def inflate(file, start: int, stop: int):
    """Pieces of the gzip members between two bytes of a file; None after each member."""
    file.seek(start)
    left, pack, rest = stop - start, zlib.decompressobj(GZIP), b""
    while left or rest:
        if not rest:
            rest = file.read(min(SLICE, left))
            left -= len(rest)
            if not rest:
                raise EOFError("archive ends inside a segment")
        piece = pack.decompress(rest, SLICE)
        rest = pack.unused_data if pack.eof else pack.unconsumed_tail
        if piece:
            yield piece
        if pack.eof:
            yield None
            pack = zlib.decompressobj(GZIP)


def header_end(buffer: bytes, at: int = 0) -> int:
    found = buffer.find(END, at)
    return -1 if found < 0 else found + len(END)


def fields_of(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def record_chunks(file, start: int, stop: int, chunk_bytes: int):
    """Rows of RECORD_SCHEMA for the response and revisit records of a segment."""
    buffer, fields, row = b"", None, None
    for piece in inflate(file, start, stop):
        if piece is not None:
            buffer += piece
            if row is None:
                body = header_end(buffer)
                payload = header_end(buffer, body) if body > 0 else -1
                if payload < 0:
                    continue
                fields, http = fields_of(buffer[:body]), fields_of(buffer[body:payload])
                left = int(fields["content-length"]) - (payload - body)
                row = {
                    "id": name_number(fields["warc-record-id"]),
                    "record_type": fields["warc-type"],
                    "refers_to": name_number(fields.get("warc-refers-to", "")),
                    "url": fields.get("warc-target-uri"),
                }
                buffer, number, done, digest = buffer[payload:], 0, 0, hashlib.sha256()
            while left > chunk_bytes and len(buffer) >= chunk_bytes:
                chunk, buffer = buffer[:chunk_bytes], buffer[chunk_bytes:]
                left, done = left - chunk_bytes, done + chunk_bytes
                digest.update(chunk)
                told = {"chunk_no": number, "chunk": chunk, "so_far": done, "digest": digest.hexdigest()}
                yield row | told | {"last": False}
                number += 1
        elif row is not None:
            chunk = buffer[:left]
            if len(chunk) != left or buffer[left:] != END:
                raise ValueError(f"record {row['id']} is cut short")
            digest.update(chunk)
            stated = fields.get("warc-payload-digest", "").removeprefix("sha256:")
            if row["record_type"] == "revisit":
                told = {"so_far": int(http["content-length"]), "digest": stated}
            else:
                told = {"so_far": done + left, "digest": digest.hexdigest()}
                if stated and stated != told["digest"]:
                    raise ValueError(f"payload of record {row['id']} does not have its digest")
            yield row | told | {"chunk_no": number, "chunk": chunk, "last": True}
            buffer, row = b"", None


def read_records(segments: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """The chunked record table of the segments' records.

    ``so_far`` and ``digest`` cover the payload up to and with the chunk; the last chunk of a record
    has those of the whole payload (for a revisit: of the payload it refers to).
    """

    def read(batches):
        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                files, name = opened(path)
                rows, held = [], 0
                with files.open_input_file(name) as file:
                    for row in record_chunks(file, start, stop, chunk_bytes):
                        rows.append(row)
                        held += len(row["chunk"]) + 200
                        if held >= 4 * SLICE:
                            yield pa.RecordBatch.from_pylist(rows, RECORD_SCHEMA)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORD_SCHEMA)

    return segments.select("path", "start", "stop").repartition(
        max(1, segments.sparkSession.sparkContext.defaultParallelism * 2)
    ).mapInArrow(read, RECORDS)
