"""Approximate nearest neighbours on shifted Hilbert curves.

Vectors are rotated at random and projected to a few dimensions per curve; each curve shifts its
grid by an own vector and orders all rows by the Hilbert number of their cell. A curve's order is cut into
blocks of about equal size at bounds taken from a bounded sample (ties of a number are cut by a hash of
the vector, another one on every curve). Equal vectors are indexed and asked once, with the k + 1 smallest of their
ids: no other of them can be among the nearest. Every distinct vector goes to one block per curve. A query
goes to its own block and to neighbouring ones that together hold ``window`` of all vectors;
each block returns the query's nearest by exact distance on the original vectors, and the results of
all blocks and curves are merged. Every vector is indexed; bounds steer only the cutting.

Defined results: vectors that are null, of another length than most, zero, or with null or non-finite
components take no part, nor do rows without id. A row never answers a query of its own id; rows that repeat an
id count once, with their nearest copy, and queries that repeat an id are asked once. Ties go to the
smaller id. Fewer than ``k`` rows are all returned. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from handful.llm.common import as_batch
from handful.session import cut_lineage

SAMPLE = 20_000
ANSWERS = "group bigint, vec_id bigint, score double"


def mixed(numbers: np.ndarray, curve: int) -> np.ndarray:
    """A hash of 64-bit numbers, unrelated from curve to curve."""
    x = numbers.astype(np.uint64) ^ (np.uint64(curve + 1) * np.uint64(0xD1B54A32D192ED03 >> 8))
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(by))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert numbers of grid cells (rows of ``dims`` integers below 2^bits), by Gray-code transposition."""
    x = [column.astype(np.uint64) for column in cells.T]
    for b in range(bits - 1, 0, -1):
        here, below = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(len(x)):
            turn = (x[i] & here) != 0
            swap = np.where(turn, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(turn, below, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    carry = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, 0, -1):
        carry ^= np.where((x[-1] >> np.uint64(b)) & np.uint64(1) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    number = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for column in x:
            number = (number << np.uint64(1)) | (((column ^ carry) >> np.uint64(b)) & np.uint64(1))
    return number


class Curves:
    """Projections, grids and block bounds of all curves."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, curves: int, dims: int, blocks: int, seed: int):
        rng = np.random.default_rng(seed)
        wide = sample.shape[1]
        self.dims, self.bits, self.blocks = min(dims, wide), 56 // min(dims, wide), blocks
        self.bits = min(self.bits, 16)
        columns: list[np.ndarray] = []
        while sum(c.shape[1] for c in columns) < curves * self.dims:
            columns.append(np.linalg.qr(rng.normal(size=(wide, wide)))[0])
        turned = np.concatenate(columns, 1)
        self.turns = [turned[:, c * self.dims : (c + 1) * self.dims] for c in range(curves)]
        low, high = zip(*((p.min(0), p.max(0)) for p in (sample @ t for t in self.turns)))
        self.low, self.span = np.array(low), np.maximum(np.array(high) - np.array(low), 1e-12)
        self.shift = rng.uniform(0, 0.5, (curves, self.dims))
        self.bounds = []
        for c in range(curves):
            place = self.place(c, sample, ids)
            place = place[np.lexsort((place[:, 1], place[:, 0]))]
            cuts = np.arange(1, blocks) * len(place) // blocks
            self.bounds.append(place[cuts])

    def place(self, curve: int, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """(Hilbert number, hash of the id) of each vector on a curve; the id of a vector is a hash of it."""
        unit = (vectors @ self.turns[curve] - self.low[curve]) / self.span[curve]
        cells = (np.clip(unit, 0, 1) * 0.5 + self.shift[curve]) * ((1 << self.bits) - 1)
        return np.stack([hilbert(cells.astype(np.int64), self.bits), mixed(ids, curve)], 1)

    def block(self, curve: int, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        place, bounds = self.place(curve, vectors, ids), self.bounds[curve]
        first = np.searchsorted(bounds[:, 0], place[:, 0], "left")
        last = np.searchsorted(bounds[:, 0], place[:, 0], "right")
        out = first.copy()
        # Among bounds with the same number the hash decides.
        for i in np.flatnonzero(last > first):
            out[i] = first[i] + np.searchsorted(bounds[first[i] : last[i], 1], place[i, 1], "right")
        return out


def clean(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    v = F.col("vector")
    usable = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull()
        & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    lengths = usable.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    # Adding 0 turns -0.0 into 0.0, so equal vectors have equal hashes.
    plain = F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector")
    return usable.where(F.size("vector") == (lengths["size"] if lengths else 0)).select("id", plain)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distinct_vectors(usable: DataFrame, keep: int) -> DataFrame:
    """(group, ids, vector): the distinct vectors of (id, vector, group), each with its ``keep`` smallest ids, ascending."""
    # The limit on the rank is applied before the shuffle as well, so a large group is no large task.
    first = F.row_number().over(W.partitionBy("group", "vector").orderBy("id"))
    ranked = usable.dropDuplicates(["id", "group", "vector"]).withColumn("_first", first).where(F.col("_first") <= keep)
    return ranked.groupBy("group", "vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def nearest(queries: np.ndarray, query_ids, rows: np.ndarray, ids: list[np.ndarray], k: int):
    """(query id, row id, distance) of each query's k nearest ids, exact, ties to smaller ids; a vector has many ids."""
    squares = (rows**2).sum(1)
    sizes = np.array([len(own) for own in ids])
    for at in range(0, len(queries), 256):
        part = queries[at : at + 256]
        near = (part**2).sum(1)[:, None] + squares[None] - 2 * part @ rows.T
        slack = 1e-9 * (1 + squares.max(initial=0) + (part**2).sum(1))
        for i in range(len(part)):
            wanted = k
            while True:
                wanted = min(wanted, len(rows))
                found = np.flatnonzero(near[i] <= np.partition(near[i], wanted - 1)[wanted - 1] + slack[i])
                exact = np.repeat(np.sqrt(((rows[found] - part[i]) ** 2).sum(1)), sizes[found])
                own = np.concatenate([ids[f] for f in found])
                order = np.lexsort((own, exact))
                _, once = np.unique(own[order], return_index=True)
                # Ids that repeat can leave fewer than k.
                if len(once) >= k or wanted == len(rows):
                    break
                wanted *= 2
            order = order[np.sort(once)][:k]
            yield query_ids[at + i], own[order], exact[order]


def search(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    curves: int = 8,
    dims: int = 8,
    window: float = 0.2,
    block_rows: int = 1024,
    seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows by Euclidean distance."""
    spark = rows.sparkSession
    usable = cut_lineage(clean(rows, key, vector).withColumn("group", F.xxhash64("vector")), "vectors")
    # A query's own id is taken out at the end, hence one more.
    index = cut_lineage(distinct_vectors(usable, k + 1), "distinct-vectors")
    total = index.count()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = index.select("group", "vector").orderBy(F.xxhash64("group", F.lit(seed))).limit(SAMPLE).toArrow()
    blocks = -(-total // block_rows)
    reach = int(np.ceil(window * blocks / 2))
    plan = spark.sparkContext.broadcast(
        Curves(matrix(sample["vector"].combine_chunks()), sample["group"].to_numpy(), curves, dims, blocks, seed)
    )
    shape = pa.schema(
        [
            ("curve", pa.int32()),
            ("block", pa.int32()),
            ("asks", pa.bool_()),
            ("group", pa.int64()),
            ("ids", pa.list_(pa.int64())),
            ("vector", pa.list_(pa.float64())),
        ]
    )
    ddl = "curve int, block int, asks boolean, group bigint, ids array<bigint>, vector array<double>"

    def deal(asks: bool):
        def run(batches):
            own = plan.value
            for batch in batches:
                vectors, groups = matrix(batch.column(2)), batch.column(0).to_numpy(zero_copy_only=False)
                for curve in range(curves if len(groups) else 0):
                    home = own.block(curve, vectors, groups)
                    for step in range(-reach, reach + 1) if asks else (0,):
                        # A window that would leave the curve is moved back onto it.
                        block = np.clip(home, reach, max(reach, blocks - 1 - reach)) + step if asks else home
                        inside = np.flatnonzero((block >= 0) & (block < blocks))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(inside), curve, np.int32)),
                                pa.array(block[inside].astype(np.int32)),
                                pa.array(np.full(len(inside), asks)),
                                pa.array(groups[inside]),
                                batch.column(1).take(pa.array(inside)),
                                batch.column(2).take(pa.array(inside)),
                            ],
                            schema=shape,
                        )

        return run

    answers = pa.schema([("group", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def answer(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(parts))
        asks = group["asks"].to_numpy()
        vectors, groups = matrix(group["vector"].combine_chunks()), group["group"].to_numpy()
        if asks.all() or not asks.any():
            return
        ids = [np.array(own, np.int64) for own in group["ids"].filter(pa.array(~asks)).to_pylist()]
        for query, found, exact in nearest(vectors[asks], groups[asks].tolist(), vectors[~asks], ids, k + 1):
            yield as_batch(answers, group=np.full(len(found), query), vec_id=found, score=exact)

    asked = usable.join(queries.select(F.col(key).cast("bigint").alias("id")).distinct(), "id", "left_semi")
    asked = cut_lineage(asked.dropDuplicates(["id"]).select("id", "group"), "asked")
    asking = index.join(asked.select("group").distinct(), "group", "left_semi")
    form = ("group", "ids", "vector")
    dealt = index.select(*form).mapInArrow(deal(False), ddl).unionByName(asking.select(*form).mapInArrow(deal(True), ddl))
    found = dealt.groupBy("curve", "block").applyInArrow(answer, ANSWERS)
    merged = found.groupBy("group", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("group").orderBy("score", "vec_id"))
    best = merged.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("group")
    lists = cut_lineage(best.agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found")), "found")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("id")), 1, k)
    each = asked.join(lists, "group").select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "one"))
    return each.select("query_id", (F.col("at") + 1).alias("rank"), "one.vec_id", "one.score")
