"""Near duplicates by SimHash under the generalised pigeonhole principle.

Equal fingerprints are one from the start. The 64 bits are split into groups of bits that vary
together. Two fingerprints within distance d differ by at most t_i bits in at least one group i
if the thresholds add up to d - groups + 1; a threshold of -1 leaves a group out. The number of
candidates each group would give at each threshold is estimated from a sample of fingerprints, and
dynamic programming picks the thresholds. Every fingerprint is probed under all keys within t_i of
its own in group i, verified on the whole 64 bits, and linked.

Defined results: a null text is the empty text; texts without a word have fingerprint 0 and are
linked like any other. Rows without id take part and get the smallest id of their component (null if
it has none). Rows that repeat an id stay rows. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from handful.llm.common import LOWER, as_batch, keep_rows, rows_of
from handful.session import cut_lineage

BITS = 64
SAMPLE = 2048
# A candidate is verified where it is found; a probe is a row to shuffle.
CANDIDATE_COST = 0.2


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all shingles."""
    own = text.translate(LOWER).split()
    if not own:
        return 0
    joined = b" ".join(own)
    n = len(own) - words + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    starts = np.r_[0, ends[: n - 1]].tolist()
    hash_of = xxhash.xxh64_intdigest
    hashes = [hash_of(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        part = np.array(hashes[at : at + 65536], ">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def mark_of(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42):
    """(id, mark, print): a hash of the text, and the fingerprint as a signed 64-bit number."""
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("print", pa.int64())])

    def run(batches):
        for batch in batches:
            ids, prints = [], []
            for doc_id, body in rows_of(batch):
                ids.append(doc_id)
                prints.append(fingerprint(body, words, seed))
            yield as_batch(schema, id=ids, mark=batch.column(2), print=np.array(prints, np.uint64).view(np.int64))

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), mark_of(text).alias("mark"))
    return rows.mapInArrow(run, "id bigint, mark bigint, print bigint")


def bit_groups(sample: np.ndarray, groups: int) -> list[list[int]]:
    """Bits split into equal groups, correlated bits together: each group grows by the bit closest to it."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(float)
    spread = bits - bits.mean(0) if len(bits) else np.zeros((1, BITS))
    norm = np.sqrt((spread**2).sum(0)) + 1e-9
    alike = np.abs(spread.T @ spread) / np.outer(norm, norm)
    left, out = list(range(BITS)), []
    for k in range(groups):
        size = BITS * (k + 1) // groups - BITS * k // groups
        group = [left.pop(0)]
        while len(group) < size:
            group.append(left.pop(int(np.argmax(alike[np.ix_(left, group)].sum(1)))))
        out.append(sorted(group))
    return out


def key_of(prints: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a group as a number; bit 0 is the highest of the 64."""
    out = np.zeros(len(prints), np.uint64)
    for k, bit in enumerate(group):
        out |= ((prints >> np.uint64(BITS - 1 - bit)) & np.uint64(1)) << np.uint64(k)
    return out


def masks(width: int, threshold: int) -> list[int]:
    return [sum(1 << b for b in c) for t in range(threshold + 1) for c in combinations(range(width), t)]


def allocate(sample: np.ndarray, groups: list[list[int]], distance: int, total: int) -> tuple[float, list[int]]:
    """(estimated cost, thresholds) for fingerprints like the sample, ``total`` of them."""
    options = range(-1, distance + 1)
    cost = {}
    for g, group in enumerate(groups):
        keys = key_of(sample, group)
        apart = np.bitwise_count(keys[:, None] ^ keys[None, :])
        np.fill_diagonal(apart, 255)
        for t in options:
            probes = len(masks(len(group), t)) if t >= 0 else 0
            near = (apart <= t).sum() / max(1, len(sample)) ** 2 if t >= 0 else 0.0
            # What no sampled pair shows is taken as even over the keys.
            near = max(near, probes / 2.0 ** len(group))
            cost[g, t] = total * probes + CANDIDATE_COST * near * total * total / 2
    best = {0: (0.0, [])}
    for g in range(len(groups)):
        step = {}
        for used, (spent, chosen) in best.items():
            for t in options:
                now = (spent + cost[g, t], chosen + [t])
                if used + t + 1 not in step or now < step[used + t + 1]:
                    step[used + t + 1] = now
        best = step
    return best[distance + 1]


def plan(sample: np.ndarray, distance: int, total: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group that is probed, at the number of groups that costs least."""
    choices = []
    for n in range(2, distance + 2):
        groups = bit_groups(sample, n)
        choices.append((*allocate(sample, groups, distance, total), groups))
    _, thresholds, groups = min(choices, key=lambda c: c[0])
    return [(g, t) for g, t in zip(groups, thresholds) if t >= 0]


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b) of distinct fingerprints at most ``distance`` bits apart, a < b; every pair once or more."""
    total = prints.count()
    drawn = prints.orderBy(F.xxhash64("print")).limit(SAMPLE).collect()
    parts = plan(np.array([r["print"] for r in drawn], np.int64).view(np.uint64), distance, total)
    schema = pa.schema([("part", pa.int32()), ("part_key", pa.int64()), ("print", pa.int64())])

    def probe(widen: bool):
        def run(batches):
            for batch in batches:
                own = batch.column(0).to_numpy(zero_copy_only=False)
                for p, (group, threshold) in enumerate(parts):
                    keys = key_of(own.view(np.uint64), group)
                    near = np.array(masks(len(group), threshold if widen else 0), np.uint64)
                    for at in range(0, len(own), 4096):
                        wide = (keys[at : at + 4096, None] ^ near[None, :]).ravel().view(np.int64)
                        same = np.repeat(own[at : at + 4096], len(near))
                        yield as_batch(schema, part=np.full(len(same), p, np.int32), part_key=wide, print=same)

        return run

    shape = "part int, part_key bigint, print bigint"
    index = prints.mapInArrow(probe(False), shape).withColumnRenamed("print", "b")
    probes = prints.mapInArrow(probe(True), shape).withColumnRenamed("print", "a")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    found = probes.join(index, ["part", "part_key"]).where((F.col("a") < F.col("b")) & near)
    return found.select("a", "b")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node each node of an edge can reach, by large and small stars.

    Each round is written to the shared folder; rounds double the reach of a node.
    """
    pairs = cut_lineage(edges.select("a", "b").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        )
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), "low").where("a <> low")
        pairs = cut_lineage(small.select("a", F.col("low").alias("b")).distinct(), "links")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42, distance: int = 4
) -> DataFrame:
    """One row per document: id, mark, fingerprint (hex), component_id."""
    prints = cut_lineage(fingerprints(docs, key, text, words, seed), "prints")
    distinct = cut_lineage(prints.groupBy("print").agg(F.min("id").alias("first")), "distinct-prints")
    rooted = components(links(distinct.select("print"), distance))
    member = distinct.join(rooted, distinct["print"] == rooted["node"], "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")
    )
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = member.join(smallest, "root").select("print", "component_id")
    return prints.join(named, "print").select(
        "id", "mark", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` of each component, that with the smallest id, with all columns.

    A component without ids keeps one row of each text.
    """
    rows = near_duplicates(docs, key, text, **options).groupBy("component_id", "id", "mark").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "mark", "n")).alias("first")
    own = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("mark "), "mark"))
    stay = rows.groupBy(own).agg(first).select("first.id", "first.mark", "first.n")
    return keep_rows(docs, key, mark_of(text), stay)
