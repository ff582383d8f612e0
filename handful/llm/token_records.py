"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

Rows are dealt by ranges of the id, sorted, encoded and written by executors: a shard file of records and beside it
an index file. A record is framed as

    length of the body, unsigned 64 bits | masked CRC-32C of these 8 bytes | body | masked CRC-32C of the body

(all little-endian; the mask turns the checksum by 15 bits and adds a constant, so that a checksum stored in
data does not look like one). The body is the id (signed 64 bits), a flag (1: the row has no id), the bytes of
a token id (2 or 4), two zero bytes, then the token ids. An index entry is three unsigned 64-bit numbers: where the
record starts, its body's length, and the token ids before it in the shard. Shards carry names of their own; the
returned list of shards is the commit, so what a lost task left behind is in no list.

``read_records`` reads shards piece by piece in order; ``shuffled`` reads single records by their index entries in a
seeded order. Both check both checksums of every record.

The tokenizer is a public one, read on the driver from a path and sent to the executors (some megabytes). Where
its rules show that white space only separates words, the library encodes every distinct word once and the
ids of words are kept in a cache of bounded size; else it encodes whole texts.

Defined results: a null text is empty and has the end id alone; rows without id come last; rows that share an id follow
each other by a hash of the text. An empty table gives no shards and no rows. Extra columns take no part.
Very long texts are encoded in slices cut at white space, where the rules allow it.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from handful.llm.common import SPACE, as_batch, byte_values, opened
from handful.session import cut_lineage, shared_path

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
# Words a worker keeps in each of two generations, some 90 MB each; longer words are not kept.
CACHED, KEPT_BYTES = 450_000, 128
# A control character that stands between words.
BETWEEN = "\x01"
# Sentence marks that often end a word.
MARKS = [b".", b",", b";", b":", b"!", b"?"]
SLICE = 1 << 20
READ = 4 << 20
SHARDS = "part int, number int, path string, records bigint, ids bigint, bytes bigint"

# Fixed values of the format: the reflected Castagnoli polynomial and the constant of the mask.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
BLOCK = 64
HEAD = np.dtype([("id", "<i8"), ("none", "u1"), ("width", "u1"), ("zero", "<u2")])
ENTRY = np.dtype([("offset", "<u8"), ("length", "<u8"), ("before", "<u8")])


def advanced(register: np.ndarray) -> np.ndarray:
    """Registers after one zero bit."""
    return np.where(register & 1, (register >> 1) ^ np.uint32(POLYNOMIAL), register >> 1)


@cache
def word_steps() -> np.ndarray:
    """What the checksum register becomes after two bytes, for all values of its low 16 bits."""
    table = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        table = advanced(table)
    return table


@cache
def zero_steps(power: int) -> np.ndarray:
    """Four tables of 256 that pass a register over 2^power zero bytes."""
    if power == 0:
        columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(8):
            columns = advanced(columns)
    else:
        half = zero_steps(power - 1)
        columns = passed(passed(np.uint32(1) << np.arange(32, dtype=np.uint32), half), half)
    tables = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        hit = (np.arange(256) >> (bit % 8)) & 1 == 1
        tables[bit // 8, hit] ^= columns[bit]
    return tables


def passed(register: np.ndarray, tables: np.ndarray) -> np.ndarray:
    out = tables[0][register & 0xFF]
    for k in (1, 2, 3):
        out = out ^ tables[k][(register >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return out


def over_zeros(register: np.ndarray, count: np.ndarray, unit: int) -> np.ndarray:
    """Registers passed over ``count`` times 2^unit zero bytes each."""
    out, power = register.copy(), 0
    while (count >> power).any():
        hit = (count >> power) & 1 == 1
        out[hit] = passed(out[hit], zero_steps(unit + power))
        power += 1
    return out


def masked_crcs(pieces: list) -> np.ndarray:
    """Masked CRC-32C of each piece of bytes, all at once.

    The register starts from zero over pieces filled up in front to whole blocks (leading zeros change nothing), all
    blocks advance together two bytes a step, blocks are joined by passing them over the zeros behind
    them, and the usual start and end values are added by the same rule.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    if not len(sizes):
        return np.zeros(0, np.uint32)
    blocks = np.maximum(-(-sizes // BLOCK), 1)
    ends = np.cumsum(blocks)
    data = np.zeros(int(ends[-1]) * BLOCK, np.uint8)
    for piece, size, end in zip(pieces, sizes.tolist(), (ends * BLOCK).tolist()):
        data[end - size : end] = np.frombuffer(piece, np.uint8)
    steps = np.ascontiguousarray(data.view("<u2").reshape(-1, BLOCK // 2).T)
    table, register = word_steps(), np.zeros(len(data) // BLOCK, np.uint32)
    for step in steps:
        register = (register >> np.uint32(16)) ^ table[(register ^ step) & 0xFFFF]
    behind = np.repeat(ends, blocks) - 1 - np.arange(len(register))
    whole = np.bitwise_xor.reduceat(over_zeros(register, behind, BLOCK.bit_length() - 1), ends - blocks)
    start = over_zeros(np.full(len(sizes), 0xFFFFFFFF, np.uint32), sizes, 0)
    crc = (whole ^ start ^ np.uint32(0xFFFFFFFF)).astype(np.uint64)
    turned = ((crc >> np.uint64(15)) | (crc << np.uint64(17))) & np.uint64(0xFFFFFFFF)
    return ((turned + np.uint64(MASK_DELTA)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def framed(bodies: list[bytes]) -> list[bytes]:
    """The records of some bodies."""
    lengths = [len(b).to_bytes(8, "little") for b in bodies]
    heads, tails = (masked_crcs(x).astype("<u4") for x in (lengths, bodies))
    return [a + h.tobytes() + b + t.tobytes() for a, h, b, t in zip(lengths, heads, bodies, tails)]


def unframed(records: list[memoryview], where: str) -> list[memoryview]:
    """The bodies of whole records; an error where a length or a checksum does not fit."""
    lengths = [r[:8] for r in records]
    bodies = [r[12:-4] for r in records]
    fits = [int.from_bytes(n, "little") == len(b) for n, b in zip(lengths, bodies)]
    for parts, stated in ((lengths, [r[8:12] for r in records]), (bodies, [r[-4:] for r in records])):
        fits &= masked_crcs(parts) == np.frombuffer(b"".join(stated), "<u4")
    if not np.all(fits):
        raise ValueError(f"record {int(np.argmin(fits))} of a piece of {where} does not have its checksum")
    return bodies


def words_apart(rules: dict) -> bool:
    """Whether the rules of a tokenizer file encode each word between ASCII white space by itself."""
    kinds = lambda part: part.get("normalizers") or part.get("pretokenizers") or [part] if part else []
    plain = all(
        n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ")
        for n in kinds(rules.get("normalizer"))
    )
    cuts = kinds(rules.get("pre_tokenizer"))
    split = cuts[0] if cuts else {}
    # Matches are kept and the rest is dropped; no part of the pattern may take in white space.
    only = split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed"
    pattern = split.get("pattern", {}).get("Regex", " ")
    no_space = only and all("." not in p and " " not in p and (r"[^" not in p or r"[^\s" in p) for p in pattern.split("|"))
    bytewise = all(c["type"] == "ByteLevel" and not c["add_prefix_space"] and not c.get("use_regex", True) for c in cuts[1:])
    tokens = all(
        not t["lstrip"] and not t["rstrip"] and not any(c.isspace() for c in t["content"]) for t in rules.get("added_tokens", [])
    )
    whole = not rules.get("truncation") and not rules.get("padding")
    return bool(plain and no_space and bytewise and tokens and whole and rules["model"]["type"] == "BPE")


def letters_are_one(rules: dict) -> bool:
    """Whether a word of A-Z and a-z alone, maybe with one sentence mark behind it, is small letters to the model."""
    kinds = [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])]
    cuts = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    parts = cuts[0].get("pattern", {}).get("Regex", "").split("|") if cuts else []
    runs = [r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"]
    others = [p for p in parts if p not in runs]
    return "Lowercase" in kinds and all(r in parts for r in runs) and all(p[0] == "'" or p == r"[\p{N}]" for p in others)


class Encoder:
    """Token ids of texts as little-endian bytes; one per worker and tokenizer."""

    def __init__(self, rules: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_buffer(rules)
        self.width = 2 if self.own.get_vocab_size() <= 1 << 16 else 4
        self.apart = words_apart(json.loads(rules))
        # Words of this generation, and of the one before: a word that is used again moves on, others go.
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        between = self.own.encode(BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if self.apart and len(between) == 1 else None
        self.letters = self.apart and letters_are_one(json.loads(rules))
        self.marks = dict(zip(MARKS, self.plain(MARKS))) if self.letters else {}

    def plain(self, texts: list[bytes]) -> list[bytes]:
        found = self.own.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(f.ids, f"<u{self.width}").tobytes() for f in found]

    def ids_of_words(self, words: list[bytes]) -> list[bytes]:
        """Many words as few texts, with a character between them whose id no word without it has."""
        mark = BETWEEN.encode()
        if self.between is None or any(mark in w for w in words):
            return self.plain(words)
        out = []
        lines = [(b" " + mark + b" ").join(words[at : at + 256]) for at in range(0, len(words), 256)]
        for found in self.own.encode_batch_fast([x.decode() for x in lines], add_special_tokens=False):
            ids = np.array(found.ids, f"<u{self.width}")
            cuts = np.flatnonzero(ids == self.between)
            starts, stops = np.append(0, cuts + 1), np.append(cuts, len(ids))
            data, size = ids.tobytes(), self.width
            out += [data[a:b] for a, b in zip((starts * size).tolist(), (stops * size).tolist())]
        return out

    def new_ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of words not met before; plain letters need no rule of the tokenizer but its pairs of pieces."""
        if not self.letters:
            return self.ids_of_words(words)
        out: list[bytes | None] = [None] * len(words)
        rest = []
        for k, word in enumerate(words):
            if word.isalpha():
                out[k] = self.letter_ids(word)
            elif word[-1:] in MARKS and word[:-1].isalpha():
                core = word[:-1]
                ids = self.known.get(core) or self.before.get(core)
                if ids is None:
                    ids = self.known[core] = self.letter_ids(core)
                out[k] = ids + self.marks[word[-1:]]
            else:
                rest.append(k)
        for k, ids in zip(rest, self.ids_of_words([words[k] for k in rest])):
            out[k] = ids
        return out

    def letter_ids(self, word: bytes) -> bytes:
        ids = [t.id for t in self.own.model.tokenize(word.lower().decode())]
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def word_ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts by their words, each distinct word looked up once."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) + len(new) > CACHED:
                self.before, self.known, new = self.known, {}, words
            old = [w for w in new if w in self.before]
            self.known.update(zip(old, map(self.before.__getitem__, old)))
            new = [w for w in new if w not in self.before]
            self.known.update(zip(new, self.new_ids(new)))
        found = pa.array(list(map(self.known.__getitem__, words)), pa.binary()).take(coded.indices)
        for word in new:
            if len(word) > KEPT_BYTES:
                del self.known[word]
                self.known.pop(word[:-1], None)
        ends = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1) if len(found) else np.zeros(1, np.int32)
        data = found.buffers()[2].to_pybytes() if len(found) and found.buffers()[2] else b""
        cuts = ends[lists.offsets.to_numpy()].tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def long_text(self, text: bytes) -> bytes:
        out, at = [], 0
        while at < len(text):
            end = min(at + SLICE, len(text))
            while end < len(text) and text[end] not in SPACE:
                end += 1
            out += self.word_ids([text[at:end]])
            at = end
        return b"".join(out)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts of about a slice together, or of single long ones."""
        if not self.apart:
            return self.plain(texts)
        if sum(map(len, texts)) > 2 * SLICE:
            return [self.long_text(t) for t in texts]
        return self.word_ids(texts)


@cache
def worker_encoder(rules: bytes) -> Encoder:
    return Encoder(rules)


class Shard:
    """A shard file and its index while they are written."""

    def __init__(self, folder: str):
        self.files, base = opened(folder)
        self.files.create_dir(base, recursive=True)
        self.name = uuid.uuid4().hex
        self.out = self.files.open_output_stream(f"{base}/{self.name}.records", compression=None)
        self.index = self.files.open_output_stream(f"{base}/{self.name}.index", compression=None)
        self.bytes = self.records = self.ids = 0

    def add(self, bodies: list[bytes], counts: list[int]) -> None:
        records = framed(bodies)
        sizes = np.array([len(r) for r in records], np.int64)
        entries = np.zeros(len(records), ENTRY)
        entries["offset"] = self.bytes + np.cumsum(sizes) - sizes
        entries["length"] = sizes - 16
        entries["before"] = self.ids + np.cumsum(counts) - counts
        self.out.write(b"".join(records))
        self.index.write(entries.tobytes())
        self.bytes, self.records, self.ids = self.bytes + int(sizes.sum()), self.records + len(records), self.ids + sum(counts)

    def close(self) -> None:
        self.out.close()
        self.index.close()


def write_records(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    end_id: int = 1,
    shard_bytes: int = 256 << 20,
) -> DataFrame:
    """The committed list of shards, in order: path, records, ids, bytes, and ``first``, the ids before the shard."""
    spark = docs.sparkSession
    folder = shared_path(spark, "token-records")
    with open(tokenizer, "rb") as file:
        rules = spark.sparkContext.broadcast(file.read())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema(
        [
            ("part", pa.int32()),
            ("number", pa.int32()),
            ("path", pa.string()),
            ("records", pa.int64()),
            ("ids", pa.int64()),
            ("bytes", pa.int64()),
        ]
    )

    def write(batches):
        encoder = worker_encoder(rules.value)
        part, shards = TaskContext.get().partitionId(), []
        end = end_id.to_bytes(encoder.width, "little")

        def put(bodies, counts):
            if not shards or shards[-1].bytes >= shard_bytes:
                if shards:
                    shards[-1].close()
                shards.append(Shard(folder))
            shards[-1].add(bodies, counts)

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for some in groups_by_size(sizes, SLICE):
                own = batch.slice(some.start, some.stop - some.start)
                bodies, counts = [], []
                for number, ids in zip(own.column(0).to_pylist(), encoder.encode(byte_values(own.column(1)))):
                    head = np.array((number or 0, number is None, encoder.width, 0), HEAD)
                    bodies.append(head.tobytes() + ids + end)
                    counts.append(len(ids) // encoder.width + 1)
                put(bodies, counts)
        if shards:
            shards[-1].close()
            yield as_batch(
                schema,
                part=[part] * len(shards),
                number=list(range(len(shards))),
                path=[s.name for s in shards],
                records=[s.records for s in shards],
                ids=[s.ids for s in shards],
                bytes=[s.bytes for s in shards],
            )

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    # Equal rows have a number of their own, so that a large group of them is dealt over many ranges.
    rows = rows.select("id", "text", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_last(), F.col("mark"), F.col("row")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")
    shards = cut_lineage(dealt.mapInArrow(write, SHARDS), "shards")
    before = W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1)
    return shards.select(
        F.concat(F.lit(folder + "/"), "path").alias("path"),
        "records",
        "ids",
        "bytes",
        F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"),
    )


def read_index(path: str, first: int = 0, count: int | None = None) -> np.ndarray:
    """Entries of a shard's index."""
    files, name = opened(path)
    with files.open_input_file(f"{name}.index") as file:
        file.seek(first * ENTRY.itemsize)
        return np.frombuffer(file.read(None if count is None else count * ENTRY.itemsize), ENTRY)


RECORD = "id bigint, start bigint, n_tokens bigint, ids binary"
RECORD_SCHEMA = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def rows_of_bodies(bodies: list[memoryview], starts: list[int]) -> pa.RecordBatch:
    numbers, ids = [], []
    for body in bodies:
        head = np.frombuffer(body[: HEAD.itemsize], HEAD)[0]
        numbers.append(None if head["none"] else int(head["id"]))
        ids.append(np.frombuffer(body[HEAD.itemsize :], f"<u{head['width']}").astype("<u4").tobytes())
    return as_batch(RECORD_SCHEMA, id=numbers, start=starts, n_tokens=[len(i) // 4 for i in ids], ids=ids)


def groups_by_size(sizes: np.ndarray, limit: int):
    """Slices of consecutive items of about ``limit`` bytes together."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield slice(at, stop)
        at = stop


def read_records(shards: DataFrame, piece_bytes: int = 32 << 20) -> DataFrame:
    """(id, start, n_tokens, ids) of every record, ``ids`` as little-endian unsigned 32-bit numbers."""

    def read(batches):
        for batch in batches:
            for path, first, count, base in zip(*(c.to_pylist() for c in batch.columns)):
                entries = read_index(path, first, count)
                files, name = opened(path)
                sizes = entries["length"].astype(np.int64) + 16
                with files.open_input_file(f"{name}.records") as file:
                    for some in groups_by_size(sizes, READ):
                        own = entries[some]
                        file.seek(int(own["offset"][0]))
                        data = memoryview(file.read(int(sizes[some].sum())))
                        cuts = (own["offset"] - own["offset"][0]).astype(np.int64).tolist()
                        bodies = unframed([data[c : c + s] for c, s in zip(cuts, sizes[some].tolist())], path)
                        yield rows_of_bodies(bodies, (own["before"].astype(np.int64) + base).tolist())

    step = F.greatest(F.lit(1), F.floor(F.col("records") * F.lit(piece_bytes) / F.col("bytes"))).cast("bigint")
    pieces = shards.withColumn("step", step).select(
        "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("records") - 1, F.col("step"))).alias("from"), "step", "first"
    )
    tasks = max(1, shards.sparkSession.sparkContext.defaultParallelism * 2)
    return pieces.repartition(tasks).mapInArrow(read, RECORD)


def shuffled(shards: DataFrame, seed: int, batch_bytes: int = 32 << 20) -> DataFrame:
    """The records in a seeded random order over all shards, read one by one through the index.

    Partitions follow each other in that order, as do the rows inside them. Reruns over the same shards agree.
    """
    index_schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("start", pa.int64())])

    def entries_of(batches):
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                own = read_index(path)
                for some in range(0, len(own), 100_000):
                    e = own[some : some + 100_000]
                    yield as_batch(
                        index_schema,
                        path=[path] * len(e),
                        offset=e["offset"].astype(np.int64),
                        length=e["length"].astype(np.int64),
                        start=e["before"].astype(np.int64) + base,
                    )

    def read(batches):
        for batch in batches:
            paths, offsets, lengths, starts = (c.to_pylist() for c in batch.columns)
            for some in groups_by_size(np.array(lengths, np.int64) + 16, batch_bytes):
                wanted = range(len(lengths))[some]
                found: dict[int, memoryview] = {}
                # Inside a batch the disk is read in file order; the rows leave in the drawn order.
                for path in sorted({paths[k] for k in wanted}):
                    files, name = opened(path)
                    with files.open_input_file(f"{name}.records") as file:
                        for k in sorted((k for k in wanted if paths[k] == path), key=offsets.__getitem__):
                            file.seek(offsets[k])
                            found[k] = memoryview(file.read(lengths[k] + 16))
                bodies = unframed([found[k] for k in wanted], "a shuffled read")
                yield rows_of_bodies(bodies, [starts[k] for k in wanted])

    spark = shards.sparkSession
    tasks = max(1, spark.sparkContext.defaultParallelism * 2)
    index = shards.select("path", "first").repartition(tasks).mapInArrow(
        entries_of, "path string, offset bigint, length bigint, start bigint"
    )
    # A record's place among all ids names it, whatever the shards are called.
    drawn = index.withColumn("draw", F.xxhash64("start", F.lit(seed)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = drawn.repartitionByRange(parts, "draw", "start").sortWithinPartitions("draw", "start")
    return ordered.select("path", "offset", "length", "start").mapInArrow(read, RECORD)
