"""Adapter training in mini-batches: seeded batches, losses mined anew at every update, one small total per update.

Rows (or pairs) are dealt to batches by seeded ranks, another order every epoch, and written once an epoch, by
update. An update reads its share alone: tasks take blocks of whole batches, add up their gradients, and partial
sums are merged in two levels, so only dims x dims numbers reach the driver, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from handful.functions.order import draw_key, exact_rank
from handful.operators.gradients import BATCH_LOSSES, PAIR_LOSSES, step_share
from handful.session import join_checked, shared_path

BLOCK = 64
PARTIAL = "part int, sums array<double>"


def label_batches(df: DataFrame, size: int, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """(row_id, label, batch_id): batches of ``size`` rows in which every row has another one of its label.

    Rows of a label are paired in the seeded order and the pairs are shuffled; a label's odd row, and rows without a
    label, sit this order out.
    """
    if size < 2 or size % 2:
        raise ValueError("a batch has an even number of rows")
    rows = df.select(row_id, "label").filter(F.col("label").isNotNull())
    placed = exact_rank(rows, draw_key(seed, row_id), [row_id], by=["label"], name="_place")
    sizes = placed.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    paired = join_checked(placed, sizes, "label").filter(F.col("_place") < F.col("_n") - F.col("_n") % 2)
    paired = paired.withColumn("_pair", F.floor(F.col("_place") / 2))
    ranked = exact_rank(paired, draw_key(seed, "label", "_pair"), ["label", "_pair", "_place"], name="_rank")
    return ranked.select(row_id, "label", F.floor(F.col("_rank") / size).alias("batch_id"))


def pair_batches(pairs: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """(id_1, id_2, label, batch_id): labelled pairs in batches of ``size``, in the seeded order."""
    rows = pairs.select("id_1", "id_2", F.col("label").cast("double").alias("label"))
    ranked = exact_rank(rows, draw_key(seed, "id_1", "id_2"), ["id_1", "id_2", "label"], name="_rank")
    return ranked.select("id_1", "id_2", "label", F.floor(F.col("_rank") / size).alias("batch_id"))


def _written(batches: DataFrame, updates: int) -> tuple[DataFrame, str]:
    """The batches, written by update and by blocks of whole batches."""
    path = shared_path(batches.sparkSession, "batches")
    step = (F.col("batch_id") % updates).cast("int")
    block = F.floor(F.col("batch_id") / (updates * BLOCK))
    dealt = batches.withColumn("_step", step).withColumn("_block", block).repartition("_step", "_block")
    dealt.write.partitionBy("_step").parquet(path)
    return batches.sparkSession.read.schema(dealt.schema).parquet(path), path


def _total(rows: DataFrame, work: Callable[[pd.DataFrame], Sequence[np.ndarray]]) -> np.ndarray:
    """Sum of (loss, batches, gradient...) over the blocks of one update."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        found = [sums for _, batch in block.groupby("batch_id", sort=True) for sums in work(batch)]
        part = int(block["_block"].iloc[0] % 32)
        sums = [np.sum(found, axis=0)] if found else []
        return pd.DataFrame({"part": pd.Series([part] * len(sums), dtype="int32"), "sums": pd.Series(sums, dtype=object)})

    partial = rows.groupBy("_block").applyInPandas(run, PARTIAL).withColumn("_v", array_to_vector("sums"))
    merged = partial.groupBy("part").agg(Summarizer.sum(F.col("_v")).alias("_v"))
    # At most 32 rows; without any block to learn from there is none.
    sums = [r["s"] for r in merged.select(vector_to_array("_v").alias("s")).collect()]
    return np.sum(sums, axis=0) if sums else np.array([])


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64)


def _batch_work(loss: str, weights: np.ndarray, options: dict):
    def work(batch: pd.DataFrame):
        batch = batch.sort_values("_order", kind="stable")
        x = _matrix(batch["embedding"])
        found = BATCH_LOSSES[loss](x @ weights.T, batch["label"].to_numpy(), **options)
        if found:
            yield np.concatenate([[found[0], 1.0], (found[1].T @ x).ravel()])

    return work


def _pair_work(loss: str, weights: np.ndarray, options: dict):
    def work(batch: pd.DataFrame):
        a, b = _matrix(batch["a"]), _matrix(batch["b"])
        value, by_u, by_v = PAIR_LOSSES[loss](a @ weights.T, b @ weights.T, batch["label"].to_numpy(), **options)
        yield np.concatenate([[value, 1.0], (by_u.T @ a + by_v.T @ b).ravel()])

    return work


def fit_in_batches(
    loss: str,
    vectors: DataFrame,
    pairs: DataFrame | None = None,
    epochs: int = 1,
    lr: float = 0.5,
    batch_size: int = 16,
    updates: int = 1,
    warmup: float = 0.0,
    decay: bool = False,
    seed: int = 42,
    vector: str = "embedding",
    row_id: str = "row_id",
    **options,
) -> tuple[np.ndarray, list[float]]:
    """Learn a square linear map of fixed embeddings; returns it and the mean batch loss before each update.

    Batch losses need (row_id, label, vector) rows, pair losses also (id_1, id_2, label). An epoch makes
    ``updates`` updates, each with the mean gradient of its batches (a batch belongs to update
    batch_id % updates); one batch an update is the sequential descent. With ``warmup`` (a share of all
    updates) or ``decay`` the rate rises evenly from 0, and then falls evenly to 0.
    """
    if loss not in BATCH_LOSSES and loss not in PAIR_LOSSES:
        raise ValueError(f"loss is one of {sorted([*BATCH_LOSSES, *PAIR_LOSSES])}, not {loss!r}")
    by_pairs = loss in PAIR_LOSSES
    if by_pairs and pairs is None:
        raise ValueError(f"the loss {loss!r} needs pairs")
    known = vectors.select(row_id, F.col(vector).cast("array<double>").alias("embedding"))
    first = known.filter(F.col("embedding").isNotNull()).select(F.size("embedding").alias("d")).first()
    if first is None:
        raise ValueError("There are no vectors to learn from.")
    weights, losses = np.eye(first["d"]), []
    for epoch in range(epochs):
        if by_pairs:
            one, two = (known.select(F.col(row_id).alias(f"id_{k}"), F.col("embedding").alias(c)) for k, c in ((1, "a"), (2, "b")))
            rows = pair_batches(pairs, batch_size, seed + epoch).join(one, "id_1").join(two, "id_2")
            rows = rows.select("batch_id", "label", "a", "b")
        else:
            rows = label_batches(vectors, batch_size, seed + epoch, row_id).join(known, row_id)
            rows = rows.select("batch_id", "label", "embedding", F.col(row_id).alias("_order"))
        table, _ = _written(rows, updates)
        for step in range(updates):
            work = (_pair_work if by_pairs else _batch_work)(loss, weights, options)
            sums = _total(table.filter(F.col("_step") == step), work)
            if not len(sums):
                continue
            done = epoch * updates + step
            share = step_share(done, epochs * updates, warmup) if warmup or decay else 1.0
            losses.append(float(sums[0] / sums[1]))
            weights = weights - lr * share * sums[2:].reshape(weights.shape) / sums[1]
    if not losses:
        raise ValueError("No batch has anything to learn from.")
    return weights, losses
