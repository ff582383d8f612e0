"""Pairs of shingle sets that may reach a Jaccard similarity: none that does is missing.

Prefix filtering: in any fixed order of all shingles, two sets of similarity ``t`` or more share one of their first
``n - ceil(t n) + 1`` shingles. The order puts shingles last that were frequent in a bounded sample; it decides how many
pairs meet, never which are lost. Keys of the prefixes (48 bits of the hash) are dealt to partitions by ranges, as packed lists.
There the sets that share a key are a run. Of a short run all pairs are named that sizes and places in the prefix allow. A long
run is passed on as members, cut into blocks, and each pair of blocks is a task's own; members of one component need
not meet again, and a pair whose members have one longest run meets in that run alone.

A sketch counts a set's shingles by 256 classes; the sum of the smaller counts bounds what two sets share from above, so
pairs below the similarity are dropped by it and none at it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from handful.llm.common import among, as_batch, byte_values
from handful.session import cut_lineage

CLASSES = 256
KEY_BYTES = 6
SAMPLE_ROWS, LEAST, MOST_FREQUENT = 4096, 3, 1 << 16
PART_POSTINGS = 1 << 19
SHORT_RUN, BLOCK_ROWS = 64, 2048
AT_ONCE = 1 << 20
SLACK = 1e-9

POSTING = (("key", "<u8", KEY_BYTES), ("node", "<i8", 8), ("place", "<i4", 4), ("size", "<i4", 4))


def frequent(rows: DataFrame, node: str, text: str, shingles_of) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) that occur in several of some thousand rows, ascending; they only order the prefixes."""
    total = rows.count()
    some = rows.where(F.pmod(F.xxhash64(node), F.lit(max(1, total))) < SAMPLE_ROWS)
    schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            own = [np.unique(shingles_of(body)) for body in byte_values(batch.column(0))]
            found, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_counts=True)
            yield as_batch(schema, shingle=found.view(np.int64), n=counts)

    counted = some.select(text).mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).collect()
    found = np.array([r["shingle"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r["n"] for r in top], np.int64)[order]


def prefix(own: np.ndarray, known: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of an ascending set without repeats, rare ones in front."""
    most = len(own) - int(np.ceil(similarity * len(own) - SLACK)) + 1 if len(own) else 0
    if not len(known):
        return own[:most]
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    return own[np.lexsort((own, np.where(known[at] == own, counts[at], 0)))[:most]]


def sketches(rows: DataFrame, node: str, text: str, shingles_of, similarity: float) -> DataFrame:
    """(node, size, prefix, sketch) of every row; a sketch whose counts pass a byte is null."""
    known = rows.sparkSession.sparkContext.broadcast(frequent(rows, node, text, shingles_of))
    schema = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("prefix", pa.binary()), ("sketch", pa.binary())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                sizes, prefixes, counted = [], [], []
                for body in byte_values(some.column(1)):
                    own = np.unique(shingles_of(body))
                    keys = prefix(own, *known.value, similarity) >> np.uint64(64 - 8 * KEY_BYTES)
                    counts = np.bincount((own & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
                    sizes.append(len(own))
                    prefixes.append(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes())
                    counted.append(counts.astype(np.uint8).tobytes() if counts.max() < 256 else None)
                yield as_batch(schema, node=some.column(0), size=sizes, prefix=prefixes, sketch=counted)

    texts = rows.select(F.col(node).alias("node"), F.col(text).alias("text"))
    return texts.mapInArrow(run, "node bigint, size int, prefix binary, sketch binary")


def packed(columns: dict[str, np.ndarray]) -> bytes:
    """Postings by byte planes, nodes as differences."""
    parts = []
    for name, kind, width in POSTING:
        own = np.diff(columns[name], prepend=0) if name == "node" else columns[name]
        parts.append(own.astype(kind).view(np.uint8).reshape(-1, int(kind[2]))[:, :width].T.tobytes())
    return b"".join(parts)


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    out, at = {}, 0
    n = len(blob) // sum(width for _, _, width in POSTING)
    for name, kind, width in POSTING:
        own = np.zeros((n, int(kind[2])), np.uint8)
        own[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        out[name] = own.view(kind).ravel()
    out["node"] = np.cumsum(out["node"])
    return out


def runs(known: DataFrame, similarity: float) -> DataFrame:
    """(run, n, a, b): pairs of short runs (run is null), and members ``a`` of long runs of ``n`` (b is null)."""
    spark = known.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = known.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    parts = max(tasks, -(-total // (KEY_BYTES * PART_POSTINGS)))
    width = np.uint64(-(-(1 << (8 * KEY_BYTES)) // parts))
    sent = pa.schema([("part", pa.int32()), ("blob", pa.binary())])
    made = pa.schema([("run", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def deal(batches):
        held: list[dict[str, np.ndarray]] = []

        def emptied():
            every = {name: np.concatenate([h[name] for h in held]) for name, *_ in POSTING}
            part = (every["key"] // width).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                own = order[cuts[p] : cuts[p + 1]]
                yield as_batch(sent, part=[p], blob=[packed({name: values[own] for name, values in every.items()})])

        n = 0
        for batch in batches:
            prefixes = byte_values(batch.column(2))
            sizes = np.array([len(p) // KEY_BYTES for p in prefixes], np.int64)
            raw = np.zeros((sizes.sum(), 8), np.uint8)
            raw[:, :KEY_BYTES] = np.frombuffer(b"".join(prefixes), np.uint8).reshape(-1, KEY_BYTES)
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            held.append({"key": raw.view("<u8").ravel(), "node": np.repeat(columns[0], sizes), "place": place, "size": np.repeat(columns[1], sizes)})
            n += len(raw)
            if n >= PART_POSTINGS:
                yield from emptied()
                held, n = [], 0
        if n:
            yield from emptied()

    def answers(own):
        every = {name: np.concatenate([o[name] for o in own]) for name, *_ in POSTING}
        order = np.argsort(every["key"], kind="stable")
        key, node, place, size = (every[name][order].astype(np.int64) for name, *_ in POSTING)
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        lengths = np.diff(np.r_[begins, len(key)])
        for m in np.unique(lengths[(lengths > 1) & (lengths <= SHORT_RUN)]).tolist():
            i, j = np.triu_indices(m, 1)
            heads, step = begins[lengths == m], max(1, AT_ONCE // len(i))
            for at in range(0, len(heads), step):
                x, y = (heads[at : at + step, None] + i).ravel(), (heads[at : at + step, None] + j).ravel()
                less, more = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
                before = np.minimum(place[x], place[y])
                after = np.minimum(size[x] - place[x], size[y] - place[y])
                ok = (less >= similarity * more - SLACK) & (before + after >= needed(less, more, similarity)) & (node[x] != node[y])
                pair = np.unique(np.column_stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])])[ok], axis=0)
                none = pa.nulls(len(pair), pa.int64())
                yield as_batch(made, run=none, n=none, a=pair[:, 0], b=pair[:, 1])
        for begin, m in zip(begins[lengths > SHORT_RUN].tolist(), lengths[lengths > SHORT_RUN].tolist()):
            for at in range(begin, begin + m, 1 << 16):
                some = node[at : min(at + (1 << 16), begin + m)]
                yield as_batch(made, run=np.full(len(some), key[begin]), n=np.full(len(some), m), a=some, b=pa.nulls(len(some), pa.int64()))

    def meet(batches):
        part, own = None, []
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if p != part:
                    if own:
                        yield from answers(own)
                    part, own = p, []
                own.append(unpacked(blob.as_py()))
        if own:
            yield from answers(own)

    dealt = known.select("node", "size", "prefix").mapInArrow(deal, "part int, blob binary")
    dealt = dealt.repartition(tasks, "part").sortWithinPartitions("part")
    return cut_lineage(dealt.mapInArrow(meet, "run bigint, n bigint, a bigint, b bigint"), "prefix-runs")


def needed(a, b, similarity: float):
    """How much two sets of these sizes share at the similarity."""
    return np.ceil(similarity / (1 + similarity) * (a + b) - SLACK)


def counts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(counts by class, rows without a sketch)."""
    blobs = column.to_pylist()
    gone = np.array([b is None for b in blobs], bool)
    rows = b"".join(b if b is not None else bytes(CLASSES) for b in blobs)
    return np.frombuffer(rows, np.uint8).reshape(-1, CLASSES), gone


def bounded(x, y, similarity: float) -> np.ndarray:
    """Whether two sets, each (sizes, counts, gone), may reach the similarity by sizes and sketches."""
    shared = np.minimum(x[1], y[1]).sum(1, dtype=np.int64)
    near = np.minimum(x[0], y[0]) >= similarity * np.maximum(x[0], y[0]) - SLACK
    return near & ((shared >= needed(x[0], y[0], similarity)) | x[2] | y[2])


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def of_short_runs(pairs: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """The pairs of two components that the sketches allow."""

    def run(batches):
        for batch in batches:
            sets = []
            for k in (2, 4):
                sets.append((batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64), *counts_of(batch.column(k + 1))))
            ok = np.flatnonzero(bounded(*sets, similarity))
            yield as_batch(PAIR, a=batch.column(0).take(pa.array(ok)), b=batch.column(1).take(pa.array(ok)))

    a = own.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a"), F.col("root").alias("root_a"))
    b = own.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b"), F.col("root").alias("root_b"))
    met = pairs.distinct().join(a, "a").join(b, "b").where("root_a <> root_b")
    return met.select("a", "b", "size_a", "sketch_a", "size_b", "sketch_b").mapInArrow(run, "a bigint, b bigint")


def of_long_runs(members: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """The same for (run, n, node) of long runs, block by block."""
    named = members.join(own, "node")
    several = named.groupBy("run").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("run")
    named = cut_lineage(named.join(several, "run", "left_semi"), "long-runs")
    homes = named.groupBy("node").agg(F.max(F.struct("n", "run"))["run"].alias("home"))
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    placed = named.join(homes, "node").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cell = ["run", "low", "high"]
    placed = placed.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    placed = placed.repartition(*cell).sortWithinPartitions(*cell)

    def pairs_of(cell, parts):
        node, root, size, home, block = (np.concatenate([p[k] for p in parts]) for k in range(5))
        counts, gone = np.concatenate([p[5] for p in parts]), np.concatenate([p[6] for p in parts])
        run, low, high = cell
        left = np.flatnonzero(block == low)
        right = np.flatnonzero(block == high)
        step = max(1, (AT_ONCE >> 4) // max(1, len(right)))
        for at in range(0, len(left), step):
            i, j = (v.ravel() for v in np.meshgrid(left[at : at + step], right, indexing="ij"))
            fit = (root[i] != root[j]) & ((home[i] != home[j]) | (home[i] == run))
            fit &= node[i] < node[j] if low == high else True
            i, j = i[fit], j[fit]
            ok = bounded((size[i], counts[i], gone[i]), (size[j], counts[j], gone[j]), similarity)
            i, j = node[i[ok]], node[j[ok]]
            yield as_batch(PAIR, a=np.minimum(i, j), b=np.maximum(i, j))

    def meet(batches):
        cell, parts = None, []
        for batch in batches:
            keys = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            columns = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3, 8)]
            columns += counts_of(batch.column(8))
            begins = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
            for x, y in zip(begins, [*begins[1:], len(keys)]):
                now = tuple(keys[x].tolist())
                if now != cell:
                    if parts:
                        yield from pairs_of(cell, parts)
                    cell, parts = now, []
                parts.append([c[x:y] for c in columns])
        if parts:
            yield from pairs_of(cell, parts)

    return placed.select(*cell, "node", "root", "size", "home", "block", "sketch").mapInArrow(meet, "a bigint, b bigint")


def unmet(rows: DataFrame, node: str, text: str, shingles_of, similarity: float, groups: DataFrame) -> DataFrame:
    """(a, b), a < b, of every two rows in different groups that may reach the similarity; ``groups`` has (node, root)."""
    known = cut_lineage(sketches(rows, node, text, shingles_of, similarity), "sketches")
    found = runs(known, similarity)
    wanted = found.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    own = among(known.select("node", "size", "sketch"), cut_lineage(wanted, "met-nodes"), "node")
    own = cut_lineage(own.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")), "met-sketches")
    short = of_short_runs(found.where("b is not null").select("a", "b"), own, similarity)
    members = found.where("b is null").select("run", "n", F.col("a").alias("node"))
    return short.unionByName(of_long_runs(members, own, similarity)).distinct()
