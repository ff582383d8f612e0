"""Phrase collocations: n-grams whose words occur together far more often than apart.

Texts are lower-cased (A-Z), cut into pieces at sentence marks and line ends, and packed by language into chunks of
about a megabyte, which are written once; a piece beyond that is cut between words, with the next three words repeated
as lookahead so that every n-gram is counted where it starts.

First pass: each chunk counts its distinct n-grams of one to four words (``Grams``; words are numbered exactly inside the
chunk) and sends the counts, named by short hashes, to hash partitions, packed by sorted differences. A partition
merges them into a Misra-Gries summary whose capacity exceeds its mass divided by the wanted frequency; what was
subtracted is then below that frequency, so no frequent n-gram is lost, whatever the order or the skew. The answer to each
chunk is one bit for each of its hashes. Second pass: each chunk names its surviving n-grams in full and Spark sums
exact counts by the phrase itself, so a hash shared by two n-grams costs time and changes nothing.

Partitions grow in number with the words of the corpus, so that each holds about ``PART_MASS`` occurrences; a frequent
n-gram is one number of each chunk's list, so none makes a partition large. Nothing is broadcast or collected.

Defined results: a null text is empty, a null language is ``und``. Fewer candidates than ``top`` are all returned; an empty
table gives no rows. Repeated rows count as often as they occur; ids and extra columns take no part. Words of any
length are whole words.
"""

from __future__ import annotations

import re
import string
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from handful.llm.common import as_batch, byte_values
from handful.session import cut_lineage

# Sentence marks and line ends become line feeds, A-Z small letters.
PLAIN = bytes.maketrans(
    string.ascii_uppercase.encode() + b".,;:!?\x0b\x0c\r", string.ascii_lowercase.encode() + b"\n" * 9
)
TOKEN = re.compile(rb"[^ \t\n]+|\n")
GAP = re.compile(rb"[ \t\n]")
LONGEST = 4
LOOKAHEAD = re.compile(rb"(?:[ \t]+[^ \t\n]+){0,%d}" % (LONGEST - 1))
CHUNK_BYTES = 1 << 20
HELD_BYTES = 32 << 20
PART_MASS = 1 << 24
SLICES = 32


def cut_body(body: bytes, limit: int):
    """(part, lookahead words at its end) of a text in plain form, parts of about ``limit`` bytes."""
    at = 0
    while len(body) - at > limit:
        end = body.rfind(b"\n", at, at + limit)
        if end < 0:
            gap = GAP.search(body, at + limit)
            if not gap:
                break
            end = gap.start()
            if body[end] != 10:
                more = LOOKAHEAD.match(body, end)
                yield body[at : more.end()], len(more.group().split())
                at = end
                continue
        yield body[at : end + 1], 0
        at = end + 1
    yield body[at:], 0


# Bodies are written and shuffled compressed; ``size`` is that of the plain body.
CODEC = "zstd"
CHUNKS = "chunk bigint, lang string, words bigint, ahead int, size bigint, body binary"
CHUNK_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("lang", pa.string()), ("words", pa.int64()), ("ahead", pa.int32()), ("size", pa.int64()), ("body", pa.binary())]
)


def write_chunks(docs: DataFrame, text: str, lang: str, chunk_bytes: int) -> DataFrame:
    def pack(batches):
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def chunk(name, body, ahead=0):
            words = len(body.split()) - ahead
            number = uuid.uuid4().int >> 65
            small = pa.compress(body, codec=CODEC, asbytes=True)
            return as_batch(CHUNK_SCHEMA, chunk=[number], lang=[name], words=[words], ahead=[ahead], size=[len(body)], body=[small])

        def emptied(names):
            for name in names:
                del sizes[name]
                body = b"\n".join(held.pop(name))
                if body.strip():
                    yield chunk(name, body)

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), byte_values(batch.column(1))):
                *parts, (body, _) = cut_body(body.translate(PLAIN), chunk_bytes)
                for part, ahead in parts:
                    yield chunk(name, part, ahead)
                held.setdefault(name, []).append(body)
                sizes[name] = sizes.get(name, 0) + len(body) + 1
                if sizes[name] >= chunk_bytes:
                    yield from emptied([name])
                elif len(sizes) > 1 and sum(sizes.values()) > HELD_BYTES:
                    yield from emptied(list(sizes))
        yield from emptied(list(sizes))

    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")
    )
    return cut_lineage(rows.mapInArrow(pack, CHUNKS), "chunks")


def mixed(numbers: np.ndarray) -> np.ndarray:
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        numbers = (numbers ^ (numbers >> np.uint64(by))) * np.uint64(times)
    return numbers ^ (numbers >> np.uint64(31))


class Grams:
    """The distinct n-grams of a chunk, by length: counts, hashes, and the words they consist of."""

    def __init__(self, lang: str, body: bytes, ahead: int, bits: int):
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        numbers[b"\n"]
        word = np.array(list(map(numbers.__getitem__, TOKEN.findall(body))), np.int64)
        names = list(numbers)
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        single = np.array([xxhash.xxh3_64_intdigest(n, seed) for n in names], np.uint64)
        places = np.flatnonzero(word)
        places = places[: len(places) - ahead]
        self.words = pa.array(names, pa.binary())
        self.counts, self.hashes, self.spelled = [], [], []
        inverse, hashes, spelled = word[places], single, np.arange(len(names))[:, None]
        for n in range(1, LONGEST + 1):
            if n > 1:
                inside = places + n - 1 < len(word)
                last = word[np.minimum(places + n - 1, max(len(word) - 1, 0))]
                inside &= last > 0
                places, inverse, last = places[inside], inverse[inside], last[inside]
                # The n-gram before its last word is known by number, so this pair is exact.
                pairs, inverse = np.unique(inverse * len(names) + last, return_inverse=True)
                front, back = np.divmod(pairs, len(names))
                hashes = mixed(hashes[front] * np.uint64(0x9E3779B97F4A7C15) + single[back] + np.uint64(n))
                spelled = np.column_stack([spelled[front], back])
            times = np.bincount(inverse, minlength=len(spelled))
            some = np.flatnonzero(times) if n == 1 else slice(None)
            self.counts.append(times[some])
            self.hashes.append(hashes[some] >> np.uint64(64 - bits))
            self.spelled.append(spelled[some])

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes, ascending, and the occurrences of each."""
        found, back = np.unique(np.concatenate(self.hashes), return_inverse=True)
        return found, np.bincount(back, np.concatenate(self.counts), len(found)).astype(np.int64)

    def named(self, keep: np.ndarray):
        """(words of a phrase, phrases, counts) of the n-grams whose hash is among the ascending ``keep``."""
        for n, (counts, hashes, spelled) in enumerate(zip(self.counts, self.hashes, self.spelled), 1):
            own = np.flatnonzero(among(hashes, keep))
            if len(own):
                columns = [self.words.take(pa.array(spelled[own, k])).cast(pa.string()) for k in range(n)]
                phrases = columns[0] if n == 1 else pc.binary_join_element_wise(*columns, " ")
                yield n, phrases, counts[own]


def among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def part_bounds(parts: int, bits: int) -> np.ndarray:
    """The smallest hash of each partition."""
    return np.array([-(-(p << bits) // parts) for p in range(parts)], np.uint64)


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of each number, one behind the other."""
    raw = np.ascontiguousarray(values.astype(">u8")).view(np.uint8).reshape(-1, 8)
    size = -(-width // 8)
    return np.packbits(np.unpackbits(raw[:, 8 - size :], axis=1)[:, 8 * size - width :]).tobytes()


def unpack_bits(blob: np.ndarray, n: int, width: int) -> np.ndarray:
    size = -(-width // 8)
    bits = np.zeros((n, 8 * size), np.uint8)
    bits[:, 8 * size - width :] = np.unpackbits(blob, count=n * width).reshape(n, width)
    raw = np.zeros((n, 8), np.uint8)
    raw[:, 8 - size :] = np.packbits(bits).reshape(n, size)
    return raw.view(">u8").ravel().astype(np.uint64)


def pack_counts(keys: np.ndarray, counts: np.ndarray, low: int) -> bytes:
    """Ascending hashes and their counts: number, mass, low bits, bytes of either part; then the hashes, and the counts by two rules.

    Of a hash beyond ``low`` the low bits are stored as they are and the rest as a run of zeros up to a one, so that it takes
    about two bits more than the logarithm of the mean difference.
    """
    keys = keys - np.uint64(low)
    span = int(keys[-1]) + 1 if len(keys) else 1
    width = max(0, (span // max(1, len(keys))).bit_length() - 1)
    high = (keys >> np.uint64(width)).astype(np.int64)
    marks = np.zeros(int(high[-1]) + len(keys) if len(keys) else 0, np.uint8)
    marks[high + np.arange(len(keys))] = 1
    parts = [pack_bits(keys, width) if width else b"", np.packbits(marks).tobytes()]
    large = counts[counts >= 255]
    head = np.array([len(keys), counts.sum(), width, len(parts[0]), len(parts[1])], "<u8").tobytes()
    return b"".join([head, *parts, np.minimum(counts, 255).astype(np.uint8).tobytes(), large.astype("<u8").tobytes()])


HEAD = 40


def mass_of(blob: bytes) -> int:
    return int.from_bytes(blob[8:16], "little")


def unpack_keys(blob: bytes, low: int) -> np.ndarray:
    size, _, width, own, more = np.frombuffer(blob, "<u8", 5).tolist()
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, more, HEAD + own))
    high = (np.flatnonzero(bits) - np.arange(size)).astype(np.uint64)
    keys = high << np.uint64(width)
    if width:
        keys |= unpack_bits(np.frombuffer(blob, np.uint8, own, HEAD), size, width)
    return keys + np.uint64(low)


def unpack_counts(blob: bytes) -> np.ndarray:
    size, _, _, own, more = np.frombuffer(blob, "<u8", 5).tolist()
    at = HEAD + own + more
    counts = np.frombuffer(blob, np.uint8, size, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob, "<u8", -1, at + size).astype(np.int64)
    return counts


class Summary:
    """A Misra-Gries summary of counted keys: at most ``capacity`` counters, and what was subtracted from each at most."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held >= max(self.capacity, 1 << 16):
            self.settle()

    def settle(self) -> None:
        """Add up what waits; beyond the capacity, all counters lose as much as the first one too many has."""
        if not self.waiting:
            return
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.held = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(self.keys) > self.capacity:
            less = int(np.partition(self.counts, len(self.keys) - self.capacity - 1)[len(self.keys) - self.capacity - 1])
            left = self.counts > less
            self.keys, self.counts = self.keys[left], self.counts[left] - less
            self.taken += less

    def merge(self, other: Summary) -> None:
        other.settle()
        self.add(other.keys, other.counts)
        self.taken += other.taken

    def frequent(self, threshold: int) -> np.ndarray:
        """All keys that may occur ``threshold`` times; none that does is missing while less was taken than that."""
        self.settle()
        if self.taken >= threshold:
            raise ValueError("the summary is too small for this threshold")
        return self.keys[self.counts + self.taken >= threshold]


def frequent_ngrams(chunks: DataFrame, threshold: int, part_mass: int = PART_MASS) -> DataFrame:
    """(lang, k, phrase, f): every n-gram of one to four words that occurs at least ``threshold`` times in its language."""
    spark = chunks.sparkSession
    mass = LONGEST * (chunks.agg(F.sum("words")).first()[0] or 0)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(2 * tasks, -(-mass // part_mass))
    # At most one hash in 60 is shared by a rare n-gram and a frequent one; it costs time alone.
    bits = min(64, max(20, mass.bit_length() + 1))
    bounds = part_bounds(parts, bits)
    sent = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])
    told = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("bits", pa.binary())])
    named = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])

    def chunks_of(batches):
        for batch in batches:
            own = [batch.column(n).to_pylist() for n in ("chunk", "lang", "ahead", "size")]
            for k, (chunk, lang, ahead, size) in enumerate(zip(*own)):
                small = byte_values(batch.column("body").slice(k, 1))[0]
                body = pa.decompress(small, decompressed_size=size, codec=CODEC, asbytes=True)
                yield k, batch, chunk, lang, Grams(lang, body, ahead, bits)

    def count(batches):
        for _, _, chunk, _, grams in chunks_of(batches):
            keys, counts = grams.keys()
            cuts = np.append(np.searchsorted(keys, bounds), len(keys))
            full = np.flatnonzero(np.diff(cuts))
            blobs = [pack_counts(keys[a:b], counts[a:b], bounds[p]) for p, a, b in zip(full, cuts[full], cuts[full + 1])]
            yield as_batch(sent, part=full, chunk=np.full(len(full), chunk), blob=blobs)

    def summarise(batches):
        part, own = None, []

        def answers():
            low, blobs = int(bounds[part]), [blob for _, blob in own]
            summary = Summary(sum(map(mass_of, blobs)) // threshold + 1)
            for blob in blobs:
                summary.add(unpack_keys(blob, low), unpack_counts(blob))
            keep = summary.frequent(threshold)
            found = [(chunk, among(unpack_keys(blob, low), keep)) for chunk, blob in own]
            found = [(chunk, np.packbits(hit).tobytes()) for chunk, hit in found if hit.any()]
            yield as_batch(told, chunk=[c for c, _ in found], part=[part] * len(found), bits=[b for _, b in found])

        for batch in batches:
            for k, (number, chunk) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if number != part:
                    if own:
                        yield from answers()
                    part, own = number, []
                own.append((chunk, batch.column(2)[k].as_py()))
        if own:
            yield from answers()

    def name(batches):
        for k, batch, _, lang, grams in chunks_of(batches):
            keys, _ = grams.keys()
            cuts, keep = np.append(np.searchsorted(keys, bounds), len(keys)), []
            for answer in batch.column("answers")[k].as_py():
                a, b = cuts[answer["part"]], cuts[answer["part"] + 1]
                keep.append(keys[a:b][np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=b - a).astype(bool)])
            for n, phrases, counts in grams.named(np.concatenate(keep)):
                yield as_batch(named, lang=[lang] * len(counts), k=np.full(len(counts), n), phrase=phrases, f=counts)

    rows = chunks.select("chunk", "lang", "ahead", "size", "body")
    dealt = rows.mapInArrow(count, "part int, chunk bigint, blob binary").repartition(tasks, "part").sortWithinPartitions("part")
    bits_of = dealt.mapInArrow(summarise, "chunk bigint, part int, bits binary")
    answers = bits_of.groupBy(F.col("chunk").alias("of")).agg(F.array_sort(F.collect_list(F.struct("part", "bits"))).alias("answers"))
    second = rows.join(answers, F.col("chunk") == F.col("of")).drop("of")
    counted = second.mapInArrow(name, "lang string, k int, phrase string, f bigint")
    return counted.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= threshold)


def joined(words, first: int, size) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = 30,
    share: int = 80,
    top: int = 2000,
    chunk_bytes: int = CHUNK_BYTES,
    part_mass: int = PART_MASS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to four words of each language.

    A phrase is left out if a longer one holds it in at least ``share`` percent of its occurrences; the score is that
    of its weakest cut in two, in millionths: twice the phrase's count over the sum of the parts' counts.
    """
    chunks = write_chunks(docs, text, lang, chunk_bytes)
    frequent = cut_lineage(frequent_ngrams(chunks, min_count, part_mass), "frequent-ngrams")
    words = F.split("phrase", " ")
    own = frequent.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), F.lit(None).cast("bigint").alias("longer"))
    inner = [
        frequent.where(F.col("k") == k).select(
            "lang",
            F.explode(F.array(*(joined(words, at, size) for size in range(2, k) for at in range(1, k - size + 2)))).alias("phrase"),
            F.lit(None).cast("bigint").alias("a"),
            F.col("f").alias("longer"),
        )
        for k in range(3, LONGEST + 1)
    ]
    for more in inner:
        own = own.unionByName(more)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = (
        own.groupBy("lang", "phrase")
        .agg(F.max("a").alias("a"), F.max("longer").alias("longer"))
        .where(F.col("a").isNotNull() & (F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * share)))
    )
    # Each cut asks for the counts of its two parts; a part that many phrases begin or end with is asked in salts.
    salts = 8
    cuts = kept.select("lang", "phrase", "a", words.alias("words"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("cut"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("part")),
        F.struct(F.lit(1).alias("side"), F.array_join(F.slice("words", F.col("cut") + 1, F.size("words")), " ").alias("part")),
    )
    asked = cuts.select("lang", "phrase", "a", "cut", F.explode(sides).alias("one")).select(
        "lang", "phrase", "a", "cut", "one.side", "one.part", F.pmod(F.xxhash64("phrase"), F.lit(salts)).cast("int").alias("salt")
    )
    known = frequent.where(F.col("k") < LONGEST).select(
        "lang", F.col("phrase").alias("part"), "f", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    )
    both = asked.join(known, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "cut")
    parts = both.agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr("cast((2000000 * cast(a AS decimal(20,0))) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0))) AS bigint)")
    weakest = parts.withColumn("score", score).groupBy("lang", "phrase", "a")
    scored = weakest.agg(F.min(F.struct("score", "cut", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # The first of each slice of a language, then the first of all slices, so that no language is sorted in one task.
    sliced = scored.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    first = sliced.withColumn("rank", F.row_number().over(W.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    totals = chunks.groupBy("lang").agg(F.sum("words").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
