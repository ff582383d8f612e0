"""Lines that many documents share, found by two Bloom filters and confirmed exactly.

Every line's key is hashed. One filter notes hashes seen, the other those seen in a second document;
tasks write the bit positions they set, which are merged by slice of the filter (first within
salts, so that no task holds more than a few slices of bits). Only keys
that the second filter knows are shuffled, counted per document and confirmed on the key itself. The
filter's size follows the number of lines up to ``max_bits``; past that more keys are
suspected, and none is lost.

Defined results: a null or empty text is one empty line. A document is a row; rows that repeat an id
count on their own. A key below ``min_chars`` code points is never dropped. When several documents
share the key, choose what stays: nothing (``keep="none"``), or its first line in the document with
the smallest id (``keep="first"``; ties of repeated ids keep the line in each). An empty table
gives no rows. Columns other than id and text take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from handful.llm.common import LOWER, SPACE, as_batch, byte_values, rows_of
from handful.session import cut_lineage

SLICE_BITS = 20
PROBES = 4


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(SPACE) for line in text.translate(LOWER).split(b"\n")]


def wanted(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars) and bool(key)


def positions(hashes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """Bit positions of each hash, one row per probe."""
    step = (hashes >> np.uint64(17)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) % np.uint64(1 << bits) for i in range(probes)])


def filter_size(lines: int, max_bits: int) -> tuple[int, int]:
    """log2 of the bits, and probes per hash."""
    bits = min(max(int(np.ceil(np.log2(16 * max(lines, 1)))), SLICE_BITS), max_bits)
    return bits, int(np.clip(round(0.69 * (1 << bits) / max(lines, 1)), 1, PROBES))


def repeated_filter(docs: DataFrame, bits: int, probes: int, min_chars: int, salts: int) -> bytes:
    """The bits of hashes seen in two documents or more; 2^bits bits, a size the caller bounds."""
    schema = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def by_slice(found: np.ndarray) -> dict[int, bytes]:
        found = np.unique(positions(found, bits, probes))
        cuts = np.flatnonzero(np.diff(found >> np.uint64(SLICE_BITS))) + 1
        within = (found & np.uint64((1 << SLICE_BITS) - 1)).astype("<u4")
        heads = found[np.r_[0, cuts]] >> np.uint64(SLICE_BITS) if len(found) else []
        return {int(h): part.tobytes() for h, part in zip(heads, np.split(within, cuts))}

    def note(batches):
        for batch in batches:
            seen = []
            for _, text in rows_of(batch):
                keys = {k for k in line_keys(text) if wanted(k, min_chars)}
                seen += map(xxhash.xxh64_intdigest, keys)
            if not seen:
                continue
            found, times = np.unique(np.array(seen, np.uint64), return_counts=True)
            once, twice = by_slice(found), by_slice(found[times > 1])
            yield as_batch(
                schema, slice=list(once), once=list(once.values()), twice=[twice.get(s, b"") for s in once]
            )

    def merge(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again = np.zeros(1 << SLICE_BITS, bool), np.zeros(1 << SLICE_BITS, bool)
        for part in parts:
            for once, twice in zip(byte_values(part.column("once")), byte_values(part.column("twice"))):
                at = np.frombuffer(once, "<u4")
                again[at[seen[at]]] = True
                seen[at] = True
                again[np.frombuffer(twice, "<u4")] = True
        packed = [np.packbits(seen).tobytes()], [np.packbits(again).tobytes()]
        yield as_batch(schema, slice=[key[0].as_py()], once=packed[0], twice=packed[1])

    def unite(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again = np.zeros(1 << SLICE_BITS - 3, np.uint8), np.zeros(1 << SLICE_BITS - 3, np.uint8)
        for part in parts:
            for once, twice in zip(byte_values(part.column("once")), byte_values(part.column("twice"))):
                once = np.frombuffer(once, np.uint8)
                again |= np.frombuffer(twice, np.uint8) | (seen & once)
                seen |= once
        yield as_batch(out, slice=[key[0].as_py()], bits=[again.tobytes()])

    shape, out = "slice int, once binary, twice binary", pa.schema([("slice", pa.int32()), ("bits", pa.binary())])
    merged = (
        docs.mapInArrow(note, shape)
        .withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("slice", "salt")
        .applyInArrow(merge, shape)
        .groupBy("slice")
        .applyInArrow(unite, "slice int, bits binary")
    )
    whole = bytearray((1 << bits) // 8)
    for row in merged.toLocalIterator():
        at = row["slice"] << (SLICE_BITS - 3)
        whole[at : at + len(row["bits"])] = row["bits"]
    return bytes(whole)


def shared_keys(docs: DataFrame, min_docs: int, min_chars: int, max_bits: int) -> DataFrame:
    """(id, line_key, first): every document's keys that at least ``min_docs`` documents have."""
    spark = docs.sparkSession
    lines = docs.agg(F.sum(F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")))).first()[0] or 0
    bits, probes = filter_size(lines, max_bits)
    known = spark.sparkContext.broadcast(repeated_filter(docs, bits, probes, min_chars, 1 + (lines >> 24)))

    def suspects(batches):
        twice = np.frombuffer(known.value, np.uint8)
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in rows_of(batch):
                own = {k for k in line_keys(text) if wanted(k, min_chars)}
                keys += own
                ids += [doc_id] * len(own)
            if not keys:
                continue
            at = positions(np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64), bits, probes)
            hit = (twice[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).all(0)
            yield as_batch(
                schema, id=[i for i, h in zip(ids, hit) if h], line_key=[k for k, h in zip(keys, hit) if h]
            )

    schema = pa.schema([("id", pa.int64()), ("line_key", pa.binary())])
    # Both sides of the join are plain tables, so that a line of many documents can be split over tasks.
    suspected = cut_lineage(docs.mapInArrow(suspects, "id bigint, line_key binary"), "suspected-lines")
    common = cut_lineage(
        suspected.groupBy("line_key")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("id").alias("first"))
        .where(F.col("n_docs") >= min_docs)
        .select("line_key", "first"),
        "common-lines",
    )
    return suspected.join(common, "line_key")


def drop_shared_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep: str = "none",
    max_bits: int = 28,
) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, kept_text, kept_sha256."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep is 'none' or 'first', not {keep!r}")
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    found = shared_keys(rows, min_docs, min_chars, max_bits)
    drops = found.groupBy("id").agg(
        F.collect_set("line_key").alias("keys"),
        F.collect_set(F.when(F.col("id") == F.col("first"), F.col("line_key"))).alias("owned"),
    )
    told = rows.join(drops.withColumnRenamed("id", "of"), F.col("id").eqNullSafe(F.col("of")), "left").select(
        "id", "text", "keys", "owned"
    )
    first = keep == "first"
    schema = pa.schema(
        [
            ("id", pa.int64()),
            ("n_lines", pa.int64()),
            ("n_dropped", pa.int64()),
            ("kept_text", pa.string()),
            ("kept_sha256", pa.string()),
        ]
    )

    def rewrite(batches):
        for batch in batches:
            rows = []
            for (doc_id, body), keys, owned in zip(
                rows_of(batch), batch.column("keys").to_pylist(), batch.column("owned").to_pylist()
            ):
                gone, mine = set(keys or ()), set(owned or ()) if first else set()
                lines, left = body.split(b"\n"), []
                for line, k in zip(lines, line_keys(body)):
                    if k not in gone or k in mine:
                        left.append(line)
                        mine.discard(k)
                kept = b"\n".join(left)
                rows.append((doc_id, len(lines), len(lines) - len(left), kept, hashlib.sha256(kept).hexdigest()))
            ids, n, dropped, kept, digests = zip(*rows) if rows else ((),) * 5
            yield as_batch(
                schema,
                id=ids,
                n_lines=n,
                n_dropped=dropped,
                kept_text=pa.array(kept, pa.binary()).cast(pa.string()),
                kept_sha256=digests,
            )

    return told.mapInArrow(
        rewrite, "id bigint, n_lines bigint, n_dropped bigint, kept_text string, kept_sha256 string"
    )
