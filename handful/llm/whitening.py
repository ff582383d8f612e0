"""Whitening of embeddings by incremental eigendecomposition.

Every entry c becomes the whole number floor(scale * c) + offset. The fit list is each distinct vector of such
numbers once. Each partition of it keeps a count, a mean and the eigenpairs of its scatter matrix, and takes
in one row after the other: a centred rank-one change, whose new eigenvalues are the roots of the secular
equation. Equal eigenvalues are first reflected onto one direction, and directions that the change does not touch are
left out (deflation). The spectra of two partitions are joined by as many rank-one changes: one for each eigenpair
of the second and one for the distance of the means; a tree of joins leaves one spectrum. A last pass over the
fit list makes it exact (Rayleigh-Ritz): the covariance in the found basis, summed over exactly centred rows, is
diagonalised and turns the basis. A further pass measures the covariance of the whitened fit list.

A spectrum has dims^2 numbers, whatever the size of the table; nothing else reaches the driver or is sent to the tasks.

Defined results: rows whose vector is null, empty, of another length than most (ties: the longer), or holds null or non-finite
entries or entries of 2^50 and more take no part. Rows without id stay, and rows that repeat an id stay rows.
Components whose variance is zero up to rounding are left out, so a table of equal vectors gives no rows, as does an
empty one; fewer dimensions than wanted components give as many as there are. Equal eigenvalues have any orthonormal
basis. ``deviation`` is null where it passes 64 bits. Extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from handful.llm.common import as_batch
from handful.session import cut_lineage

EPS = np.finfo(float).eps
FAN = 8
LARGE = float(2**50)


def secular_roots(poles: np.ndarray, z: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + weight * sum z^2 / (pole - root) = 0, one above each of the ascending poles.

    A root is given as the pole nearest to it and the distance from that pole, so that distances keep all their digits.
    """
    m, squares = len(poles), z**2
    ends = np.append(poles[1:], poles[-1] + weight * squares.sum())
    half = (ends - poles) / 2
    middle = 1 / weight + (squares[:, None] / (poles[:, None] - (poles + half))).sum(0)
    right = (middle < 0) & (np.arange(m) < m - 1)
    origin = np.arange(m) + right
    side = np.where(right, -1.0, 1.0)
    away = poles[:, None] - poles[origin]
    high = np.where(np.arange(m) < m - 1, half, 2 * half)
    low = high * 2.0**-70
    step = np.sqrt(low * high)
    for turn in range(32):
        gap = away - side * step
        part = squares[:, None] / gap
        value = side * (1 / weight + part.sum(0))
        above = value > 0
        high, low = np.where(above, step, high), np.where(above, low, step)
        if turn < 22:
            step = np.sqrt(low * high)
            continue
        # One pole at the origin and a constant, with the value and the slope found here.
        slope = (part / gap).sum(0)
        pole = slope * step**2
        with np.errstate(divide="ignore", invalid="ignore"):
            guess = pole / (value + pole / step)
        step = np.where((guess > low) & (guess < high), guess, np.sqrt(low * high))
    return origin, side * step


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs, values ascending, of basis diag(values) basis^T + weight vector vector^T."""
    z = vector @ basis
    size = float(z @ z)
    if not size or not weight > 0:
        return values, basis
    tiny = 8 * EPS * max(float(np.abs(values).max()), weight * size)
    values, basis = values.copy(), basis.copy()
    # Runs of equal values: a reflection leaves the change one of their directions.
    breaks = np.flatnonzero(np.diff(values) > tiny) + 1
    starts, stops = np.append(0, breaks), np.append(breaks, len(values))
    for a, b in zip(starts[stops - starts > 1].tolist(), stops[stops - starts > 1].tolist()):
        part = z[a:b]
        length = np.sqrt(part @ part)
        if length:
            mirror = part.copy()
            mirror[-1] += np.copysign(length, part[-1])
            basis[:, a:b] -= np.outer(basis[:, a:b] @ mirror, mirror * (2 / (mirror @ mirror)))
            last = -np.copysign(length, part[-1])
            z[a:b] = 0
            z[b - 1] = last
    live = np.flatnonzero(weight * np.abs(z) * np.sqrt(size) > tiny)
    if len(live):
        poles, own = values[live], z[live]
        origin, step = secular_roots(poles, own, weight)
        # Distances root - pole; from them the change whose exact roots these are, so that its vectors are orthogonal.
        gap = (poles[origin] - poles[:, None]) + step
        m = len(live)
        under = np.ones((m, m))
        before = np.arange(m)[:, None] > np.arange(m)
        under[:, :-1] = np.where(before[:, :-1], poles[None, :-1] - poles[:, None], poles[None, 1:] - poles[:, None])
        near = np.sqrt(np.abs(np.prod(gap / under, 1))) * np.sign(own)
        turn = near[:, None] / gap
        turn /= np.sqrt((turn**2).sum(0))
        basis[:, live] = basis[:, live] @ turn
        values[live] = poles[origin] + step
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


@dataclass
class Spectrum:
    """Count, exact sums, mean and eigenpairs of the scatter matrix of some rows."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, [0] * dims, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def add(self, row: np.ndarray) -> None:
        off = row - self.mean
        self.values, self.basis = rank_one(self.values, self.basis, off, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + off / self.n

    def join(self, other: Spectrum) -> Spectrum:
        if not self.n or not other.n:
            return other if not self.n else self
        n, off = self.n + other.n, other.mean - self.mean
        values, basis = rank_one(self.values, self.basis, off, self.n * other.n / n)
        for value, direction in zip(other.values.tolist(), other.basis.T):
            values, basis = rank_one(values, basis, direction, value)
        sums = [a + b for a, b in zip(self.sums, other.sums)]
        return Spectrum(n, sums, self.mean + off * (other.n / n), values, basis)


@dataclass
class Whitening:
    """The fitted transformation: ``basis`` has components as columns, by falling variance ``values``."""

    n: int
    sums: list[int]
    values: np.ndarray
    basis: np.ndarray
    trace: float
    scale: int
    offset: int

    def centre(self) -> tuple[np.ndarray, list[int]]:
        """Whole parts and remainders of the mean: sums = n * whole + rest."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums))
        return np.array(whole, np.int64), list(rest)

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.centre()
        return (x - whole) - np.array([r / self.n for r in rest])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (n * x - sums)^2 of each row."""
        whole, rest = self.centre()
        off = x - whole
        largest, dims = int(np.abs(off).max(initial=0)), len(rest)
        rests = np.array(rest, object if self.n * max(largest, 1) * dims >= 2**63 else np.int64)
        first = (off if largest**2 * dims < 2**63 else off.astype(object)) ** 2
        second = off * rests
        last, n = sum(r * r for r in rest), self.n
        found = (n * n * int(a) - 2 * n * int(b) + last for a, b in zip(first.sum(1), second.sum(1)))
        return [d if d < 2**63 else None for d in found]


def numbers(rows: DataFrame, key: str, vector: str, scale: int, offset: int) -> DataFrame:
    """(id, x) of the rows that take part."""
    v = F.col("v")
    usable = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGE))
    )
    common = usable.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    usable = usable.where(F.size(v) == (common["size"] if common else 0))
    return usable.select("id", F.transform(v, lambda c: F.floor(c * F.lit(float(scale))) + F.lit(offset).cast("bigint")).alias("x"))


def whole_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def folded(parts: DataFrame, ddl: str, merge: Callable[[pa.Table], pa.RecordBatch]) -> pa.Table:
    """One row from (node, ...) rows: groups of ``FAN`` neighbouring nodes are merged until one is left."""
    parts = cut_lineage(parts, "partial")
    last = parts.agg(F.max("node")).first()[0]

    def step(table: pa.Table) -> pa.Table:
        out = merge(table.sort_by("node"))
        node = pa.array([table["node"][0].as_py() // FAN], pa.int64())
        return pa.Table.from_arrays([node, *out.columns], names=["node", *out.schema.names])

    while last:
        parts = parts.groupBy(F.floor(F.col("node") / FAN)).applyInArrow(step, ddl)
        last //= FAN
    return parts.toArrow()


SPECTRUM = "node bigint, n bigint, sums array<decimal(38,0)>, mean array<double>, values array<double>, basis array<double>"
SUMS = "node bigint, sums array<double>"
DIGITS = pa.decimal128(38, 0)


def spectrum_batch(found: Spectrum) -> pa.RecordBatch:
    from decimal import Decimal

    return pa.RecordBatch.from_arrays(
        [
            pa.array([found.n], pa.int64()),
            pa.array([[Decimal(s) for s in found.sums]], pa.list_(DIGITS)),
            *(pa.array([a.ravel()], pa.list_(pa.float64())) for a in (found.mean, found.values, found.basis)),
        ],
        names=["n", "sums", "mean", "values", "basis"],
    )


def spectra_of(table: pa.Table) -> list[Spectrum]:
    out = []
    for row in table.to_pylist():
        d = len(row["mean"])
        arrays = (np.array(row[c]) for c in ("mean", "values"))
        out.append(Spectrum(row["n"], [int(s) for s in row["sums"]], *arrays, np.array(row["basis"]).reshape(d, d)))
    return out


def own_node() -> pa.Array:
    return pa.array([TaskContext.get().partitionId()], pa.int64())


def find_spectrum(fit: DataFrame, offset: int) -> Spectrum | None:
    """The spectrum of the fit list, by rank-one changes in each partition and a tree of joins."""

    def run(batches):
        found = None
        for batch in batches:
            if batch.num_rows:
                x = whole_matrix(batch.column(0))
                found = found or Spectrum.empty(x.shape[1])
                found.sums = [a + int(b) for a, b in zip(found.sums, x.astype(object).sum(0))]
                for row in (x - offset).astype(float):
                    found.add(row)
        if found:
            out = spectrum_batch(found)
            yield pa.RecordBatch.from_arrays([own_node(), *out.columns], names=["node", *out.schema.names])

    def merge(table: pa.Table) -> pa.RecordBatch:
        first, *others = spectra_of(table)
        for other in others:
            first = first.join(other)
        return spectrum_batch(first)

    one = spectra_of(folded(fit.select("x").mapInArrow(run, SPECTRUM), SPECTRUM, merge))
    return one[0] if one else None


def gram(fit: DataFrame, project: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of the outer products of projected rows."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                y = project(whole_matrix(batch.column(0)))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([own_node(), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["node", "sums"])

    def merge(table: pa.Table) -> pa.RecordBatch:
        total = sum(np.array(row) for row in table["sums"].to_pylist())
        return pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    total = np.array(folded(fit.select("x").mapInArrow(run, SUMS), SUMS, merge)["sums"][0].as_py())
    return total.reshape(int(len(total) ** 0.5), -1)


def fit_whitening(fit: DataFrame, scale: int, offset: int) -> Whitening | None:
    """The whitening of a written fit list (x); None for an empty one."""
    rough = find_spectrum(fit, offset)
    if rough is None:
        return None
    basis = np.linalg.qr(rough.basis)[0]
    model = Whitening(rough.n, rough.sums, rough.values, basis, 0.0, scale, offset)
    shared = fit.sparkSession.sparkContext.broadcast(model)
    covariance = gram(fit, lambda x: shared.value.centred(x) @ shared.value.basis) / rough.n
    values, turn = np.linalg.eigh(covariance)
    shared.destroy()
    return Whitening(rough.n, rough.sums, values[::-1], (basis @ turn)[:, ::-1], float(np.trace(covariance)), scale, offset)


def whiten(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    components: int = 16,
    scale: int = 64,
    offset: int = 1_000_000,
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row and leading component."""
    spark = rows.sparkSession
    usable = numbers(rows, key, vector, scale, offset)
    fit = cut_lineage(usable.select("x").distinct(), "fit-list")
    model = fit_whitening(fit, scale, offset)
    kind = usable.schema["id"].dataType.simpleString()
    ddl = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    kept = int((model.values[:components] > len(model.values) * 16 * EPS * model.trace).sum()) if model else 0
    if not kept:
        return spark.createDataFrame([], ddl)
    values, directions = model.values[:kept].copy(), model.basis[:, :kept] / np.sqrt(model.values[:kept])
    shared = spark.sparkContext.broadcast((model, directions))
    white = gram(fit, lambda x: shared.value[0].centred(x) @ shared.value[1]) / model.n
    error = float(np.abs(white - np.eye(kept)).max())

    def run(batches):
        own, turned = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                x = whole_matrix(some.column(1))
                rows_in = len(x)
                names = some.column(0).take(pa.array(np.repeat(np.arange(rows_in), kept)))
                columns = {
                    "component": np.tile(np.arange(1, kept + 1, dtype=np.int32), rows_in),
                    "n": np.full(rows_in * kept, own.n),
                    "whitened": (own.centred(x) @ turned).ravel(),
                    "explained": np.tile(values / own.trace, rows_in),
                    "identity_error": np.full(rows_in * kept, error),
                }
                deviations = pa.array(own.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows_in), kept)))
                schema = pa.schema(
                    [
                        ("id", names.type),
                        ("component", pa.int32()),
                        ("n", pa.int64()),
                        ("deviation", pa.int64()),
                        ("whitened", pa.float64()),
                        ("explained", pa.float64()),
                        ("identity_error", pa.float64()),
                    ]
                )
                yield as_batch(schema, id=names, deviation=deviations, **columns)

    return usable.mapInArrow(run, ddl)
