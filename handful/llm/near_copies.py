"""Near copies by word shingles: SimHash of five-word shingles, candidates by bands, links by exact Jaccard similarity.

The groups are those of all pairs. Most links are found cheaply first. At a Jaccard similarity of 0.8 two SimHashes of 64 bits
differ in about ten bits, and a pigeonhole search that wide has to compare large shares of the table. So first candidates come from
two sources. The generalised pigeonhole search links SimHashes at ``NEAR`` or fewer differing bits, and the texts of one component of
these links are candidates. Those further apart come from bands of minima: each text's shingle hashes are taken to their
minimum under ``BANDS * ROWS`` mappings, and texts that agree in all minima of a band are candidates, unless their SimHashes are
more than ``FAR`` bits apart. Candidates are compared by the whole sets of shingles; those at ``similarity`` or more are linked.

In a band's bucket the first text is compared with all others. While some are linked to no first one yet, the first ones of
these are compared with all in the next round. A small bucket has several first ones in a round, up to ``SLOTS``; how many
comparisons a bucket may take for that grows while a round makes fewer than the first one did, so rounds stay linear in the
input. After ``PLAIN_ROUNDS`` buckets that are left are split by a further minimum. A text that very many others meet is
compared in slices.

After ``MOST_ROUNDS`` the groups found so far are completed (``set_pairs.py``): of any two texts in different groups that may be
similar, by prefixes of their shingle sets, sizes and counted classes, none is left out, and all of them are compared in full.

Defined results: a null text is empty; texts without a word are copies of each other, and texts of fewer words than a
shingle are one shingle. Rows are told apart by their place, so ids may repeat or be null; of each group the row with the
smallest id stays (rows without one last, ties by the text), with all columns. An empty table stays empty.
"""

from __future__ import annotations

from collections import defaultdict
from contextlib import contextmanager
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from handful.llm import set_pairs
from handful.llm.common import LOWER, among, as_batch, byte_values
from handful.llm.simhash import BITS, components, links, mark_of
from handful.session import cut_lineage

BANDS, ROWS, FURTHER = 10, 5, 8
PLAIN_ROUNDS = 3
NEAR, FAR = 4, 24
SLICE_ROWS = 256
# First ones of a bucket in a round; comparisons that a bucket may take for more than one, at first; their growth in a round.
SLOTS, ROOM, GROWTH = 16, 128, 8
# Rounds before all that is left is compared through prefixes.
MOST_ROUNDS = 4
NODE = "near_copies_node"
# Texts go to Python in small batches, so that long ones take little memory beside the executor's own.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def shingles(text: bytes, words: int) -> np.ndarray:
    """Hashes of all shingles of a text, repeats included; a short text is one shingle, one without words has none."""
    own = text.translate(LOWER).split()
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    places = np.array(list(map(numbers.__getitem__, own)), np.int64)
    single = np.array([xxhash.xxh3_64_intdigest(w) for w in numbers], np.uint64)[places]
    size = min(words, len(own))
    out = np.zeros(len(own) - size + 1 if size else 0, np.uint64)
    for k in range(size):
        out = (out ^ single[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


@cache
def mappings() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    n = BANDS * ROWS + FURTHER
    return rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n).astype(np.uint64)


def signature(found: np.ndarray) -> tuple[int, list[int], list[int]]:
    """(SimHash, key of each band, further minima) of shingle hashes."""
    if not len(found):
        return 0, [0] * BANDS, [0] * FURTHER
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(found), 65536):
        bits = np.unpackbits(found[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int64)
    simhash = int.from_bytes(np.packbits(counts * 2 > len(found)).tobytes(), "big")
    times, plus = mappings()
    least = np.full(len(times), np.iinfo(np.uint64).max)
    for at in range(0, len(found), 512):
        mapped = times[:, None] * found[at : at + 512] + plus[:, None]
        np.minimum(least, mapped.min(1), out=least)
    keys = [xxhash.xxh3_64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes()) for b in range(BANDS)]
    return simhash, keys, least[BANDS * ROWS :].tolist()


def signed(numbers) -> np.ndarray:
    return np.array(numbers, np.uint64).view(np.int64)


def signatures(rows: DataFrame, text: str, words: int) -> DataFrame:
    """(node, print, keys, further) of every row."""
    lists = pa.list_(pa.int64())
    schema = pa.schema([("node", pa.int64()), ("print", pa.int64()), ("keys", lists), ("further", lists)])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                found = [signature(shingles(body, words)) for body in byte_values(some.column(1))]
                yield as_batch(
                    schema,
                    node=some.column(0),
                    print=signed([f[0] for f in found]),
                    keys=list(signed([f[1] for f in found])),
                    further=list(signed([f[2] for f in found])),
                )

    ddl = "node bigint, print bigint, keys array<bigint>, further array<bigint>"
    return rows.select(F.col(NODE).alias("node"), F.col(text).alias("text")).mapInArrow(run, ddl)


def compared(pairs: DataFrame, rows: DataFrame, text: str, words: int, similarity: float) -> DataFrame:
    """(a, b, linked): whether the shingle sets of the two rows agree; a row ``a`` of many pairs is met in slices."""
    slices = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("slices"))
    members = pairs.join(slices, "a").withColumn("slice", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int"))
    firsts = slices.select("a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("bigint").alias("b"))
    asked = firsts.unionByName(members.select("a", "slice", "b")).withColumn("node", F.coalesce("b", "a"))
    # Texts of rows without a candidate are not shuffled.
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    texts = among(rows.select(F.col(NODE).alias("node"), F.col(text).alias("text")), wanted, "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def run(batches):
        first = own = None
        for batch in batches:
            names, members = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for k, (a, b) in enumerate(zip(names, members)):
                found = np.unique(shingles(byte_values(batch.column(2).slice(k, 1))[0], words))
                if b is None:
                    first, own = a, found
                    continue
                both = len(np.intersect1d(own, found, assume_unique=True))
                either = len(own) + len(found) - both
                out.append((a, b, either == 0 or both >= similarity * either))
                assert a == first
            if out:
                yield as_batch(schema, **dict(zip(("a", "b", "linked"), zip(*out))))

    order = [F.col("a"), F.col("slice"), F.col("b").asc_nulls_first()]
    met = asked.join(texts, "node").repartition("a", "slice").sortWithinPartitions(*order)
    return met.select("a", "b", "text").mapInArrow(run, "a bigint, b bigint, linked boolean")


@contextmanager
def small_batches(spark: SparkSession):
    """The batch sizes hold for what is run inside; the session's own come back."""
    before = {name: spark.conf.get(name, None) for name in BATCHES}
    for name, value in BATCHES.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def with_simhash_key(marks: DataFrame) -> DataFrame:
    """One key more for every row: the component of its SimHash under links of at most ``NEAR`` bits."""
    prints = cut_lineage(marks.select("print").distinct(), "distinct-prints")
    rooted = components(links(prints, NEAR)).select(F.col("node").alias("print"), "root")
    own = F.concat("keys", F.array(F.coalesce("root", "print")))
    return marks.join(rooted, "print", "left").select("node", "print", own.alias("keys"), "further")


def buckets_of(members: DataFrame, slots: int, room: int) -> DataFrame:
    """(band, key, firsts): the texts that a bucket of several is compared with; it has one of each slot at most."""
    open_one = ~F.col("settled")
    if slots > 1:
        slot = F.pmod(F.xxhash64("node"), F.lit(slots))
        least = [F.min(F.when(open_one & (slot == s), F.struct("node", "print"))) for s in range(slots)]
    else:
        least = [F.min(F.when(open_one, F.struct("node", "print")))]
    names = [f"least{s}" for s in range(slots)]
    found = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), *(x.alias(name) for x, name in zip(least, names)))
    firsts = F.sort_array(F.array_compact(F.array(*names)))
    # A bucket has ``slots`` first ones at most, so more room than that for all its rows is never used.
    many = F.least(F.lit(slots), F.greatest(F.lit(1), F.floor(F.lit(float(room)) / F.col("n")))).cast("int")
    return found.where("n > 1").select("band", "key", F.slice(firsts, 1, many).alias("firsts")).where("size(firsts) > 0")


def near_links(rows: DataFrame, text: str, words: int, similarity: float) -> DataFrame:
    """(a, b) of linked rows by their numbers, a < b."""
    marks = cut_lineage(signatures(rows, text, words), "signatures")
    keyed = with_simhash_key(marks)
    members = keyed.select("node", "print", F.lit(False).alias("settled"), F.posexplode("keys").alias("band", "key"))
    judged, done, slots, room, at_first = None, 0, 1, ROOM, 0
    while True:
        met = members.join(buckets_of(members, slots, room), ["band", "key"])
        # Two first ones of a bucket meet once, and neither is compared further.
        own = F.exists("firsts", lambda first: first["node"] == F.col("node"))
        met = met.withColumn("done", own).withColumn("first", F.explode("firsts"))
        left = met.where(F.when(F.col("done"), F.col("node") > F.col("first.node")).otherwise(True)).select(
            *members.columns,
            "done",
            F.col("first.node").alias("pivot"),
            (F.bit_count(F.col("print").bitwiseXOR(F.col("first.print"))) <= FAR).alias("near"),
        )
        left = left.withColumn("a", F.least("pivot", "node")).withColumn("b", F.greatest("pivot", "node"))
        left = cut_lineage(left, "candidates")
        made = left.count()
        if not made:
            break
        pairs = left.where("near").groupBy("a", "b").agg(F.min("pivot").alias("pivot"))
        if judged is not None:
            pairs = pairs.join(judged, ["a", "b"], "left_anti")
        # The first text of a bucket is met by many others and stands in front, as it is the one sent in slices.
        other = F.when(F.col("pivot") == F.col("a"), F.col("b")).otherwise(F.col("a"))
        pairs = cut_lineage(pairs.select(F.col("pivot").alias("a"), other.alias("b")), "pairs")
        found = compared(pairs, rows, text, words, similarity)
        found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "linked")
        judged = cut_lineage(found if judged is None else judged.unionByName(found), "compared")
        done += 1
        if done == MOST_ROUNDS:
            break
        linked = judged.where("linked").select("a", "b", F.lit(True).alias("now"))
        members = left.where("not done").join(linked, ["a", "b"], "left")
        settled = F.max(F.col("settled") | F.coalesce("now", F.lit(False))).alias("settled")
        kept = [F.first(c).alias(c) for c in members.columns if c in ("print", "further")]
        members = members.groupBy("node", "band", "key").agg(settled, *kept)
        if done >= PLAIN_ROUNDS and done - PLAIN_ROUNDS < FURTHER:
            if done == PLAIN_ROUNDS:
                members = members.join(marks.select("node", "further"), "node")
            members = members.withColumn("key", F.xxhash64("key", F.element_at("further", done - PLAIN_ROUNDS + 1)))
        if done > 1:
            room = min(room * max(1, min(GROWTH, at_first // made)), 1 << 60)
        else:
            at_first, slots = made, SLOTS
    if judged is None:
        judged = left.select("a", "b", F.lit(True).alias("linked"))
    met = judged.where("linked").select("a", "b")
    # What the rounds never compared: all pairs of two groups that may be similar.
    wide = partial(shingles, words=words)
    rest = set_pairs.unmet(rows, NODE, text, wide, similarity, components(met)).join(judged, ["a", "b"], "left_anti")
    rest = cut_lineage(rest, "unmet")
    if rest.isEmpty():
        return met
    return met.unionByName(cut_lineage(compared(rest, rows, text, words, similarity), "late").where("linked").select("a", "b"))


def keep_one_near(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8
) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group that with the smallest id, with all columns."""
    rows = cut_lineage(docs.withColumn(NODE, F.monotonically_increasing_id()), "rows")
    # Every step inside is run at once: it is written.
    with small_batches(rows.sparkSession):
        links = near_links(rows, text, words, similarity)
    grouped = components(links)
    every = cut_lineage(grouped.unionByName(grouped.select(F.col("root").alias("node"), "root").distinct()), "groups")
    named = rows.select(
        F.col(NODE).alias("node"), F.struct(F.col(key).isNull(), F.col(key), mark_of(text), F.col(NODE).alias("node")).alias("name")
    )
    # Each task passes on one row of a group, and rows are dropped by their own number: no group meets in one task.
    first = every.join(named, "node").groupBy("root").agg(F.min("name").alias("name")).select("name.node")
    others = every.select("node").join(first, "node", "left_anti")
    return rows.join(others, F.col(NODE) == F.col("node"), "left_anti").select(*docs.columns)
