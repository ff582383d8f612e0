"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import string

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from handful.session import cut_lineage

# White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = b" \t\n\x0b\x0c\r"
# Bits of a bitmap of wanted values that tasks hold at most.
MOST_BITS = 1 << 28
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else untouched; ASCII texts take the fast built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def byte_values(column: pa.Array) -> list[bytes]:
    """The values of a string or binary column as bytes, null as empty."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return [v or b"" for v in column.cast(pa.large_binary() if large else pa.binary()).to_pylist()]


def rows_of(batch: pa.RecordBatch):
    """(id, text bytes) of a batch whose first two columns are an id and a text."""
    return zip(batch.column(0).to_pylist(), byte_values(batch.column(1)))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder's name, as Spark writes it.

    Names without a scheme and ``file:`` names are local to all machines' shared mount; every other name needs
    a scheme that the file library knows, else an error tells so, since a guess would write to a machine's own disk.
    """
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    scheme = found[1].lower() if found else ""
    if scheme in ("", "file"):
        if not scheme and not path.startswith("/"):
            raise ValueError(f"the shared folder needs an absolute name: {path}")
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:/*", "", path, flags=re.I).lstrip("/")
    if "://" not in path:
        raise ValueError(f"no file system is known for {path}")
    # Spark's name of the object store's client.
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path, flags=re.I))


def as_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def keep_rows(docs: DataFrame, key: str, mark: Column, stay: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``stay`` names by id and mark of the text, one of each, with all columns.

    ``stay`` has (id, mark, n): n rows of ``docs`` agree in id and mark.
    """
    stay = cut_lineage(stay.select(*(F.col(c).alias(f"_stay_{c}") for c in ("id", "mark", "n"))), "stay")
    marked = docs.withColumn("_mark", mark)
    found = marked.join(stay, F.col(key).eqNullSafe(F.col("_stay_id")) & (F.col("_mark") == F.col("_stay_mark")))
    single = found.where("_stay_n = 1")
    if not stay.where("_stay_n > 1").isEmpty():
        single = single.unionByName(found.where("_stay_n > 1").dropDuplicates(["_stay_id", "_stay_mark"]))
    return single.select(*docs.columns)


def among(rows: DataFrame, wanted: DataFrame, column: str, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows whose value in ``column`` may be one of ``wanted``, found where they are read: all of them, and few others.

    A bitmap of hashes has some 64 bits a value, up to ``most_bits`` (32 MB), in pieces of 4 KB; beyond, more
    other rows pass. Values in ``wanted`` are distinct.
    """
    bits = 1 << min(most_bits.bit_length() - 1, max(16, (wanted.count() * 64).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    pieces = wanted.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_piece"))
    bitmap = pieces.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bitmap"))
    placed = rows.withColumn("_place", place).withColumn("_piece", F.bitmap_bucket_number("_place"))
    byte = F.expr("cast(conv(hex(substring(_bitmap, cast(bitmap_bit_position(_place) div 8 as int) + 1, 1)), 16, 10) as bigint)")
    # At most most_bits / 8 bytes are broadcast.
    met = placed.join(F.broadcast(bitmap), "_piece").where(F.getbit(byte, F.bitmap_bit_position("_place") % 8) == 1)
    return met.select(*rows.columns)
