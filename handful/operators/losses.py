"""Batch losses: supervised contrastive loss and triplet mining.

A batch is a few rows, and its pairs are only needed inside it.  Many whole batches are
gathered per task as one block and worked off as stacked matrices, so no pair table exists.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from handful.functions.order import draw_key, exact_rank

# Temperature of the contrastive loss and margin of the triplet losses.
TEMPERATURE = 0.07
MARGIN = 0.25


def make_batches(df: DataFrame, size: int, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Add ``batch_id``: batches of ``size`` rows in the seeded order."""
    ranked = exact_rank(df, draw_key(seed, row_id), [row_id], name="_rank")
    return ranked.withColumn("batch_id", F.floor(F.col("_rank") / size)).drop("_rank")


def _per_batch(
    df: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], fields: Sequence[T.StructField], row_id: str
) -> DataFrame:
    """Run ``work(ids, labels, vectors)`` on every batch; 64 batches go through Python together."""
    schema = T.StructType([T.StructField("batch_id", T.LongType()), *fields])

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for batch, group in rows.groupby("batch_id", sort=False):
            x = np.stack(group["embedding"].to_numpy()).astype(np.float64)
            part = work(group[row_id].to_numpy(), group["label"].to_numpy(), x)
            part.insert(0, "batch_id", batch)
            parts.append(part)
        return pd.concat(parts) if parts else pd.DataFrame(columns=schema.names)

    narrow = df.select("batch_id", row_id, "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return narrow.groupBy(F.floor(F.col("batch_id") / 64)).applyInPandas(block, schema)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def supcon_anchor_losses(df: DataFrame, temperature: float = TEMPERATURE, row_id: str = "row_id") -> DataFrame:
    """(batch_id, row_id, loss) of every anchor: mean log-softmax over the other rows of its label.

    Vectors are made unit length, the anchor itself is left out, and an anchor without
    another row of its label has a NULL loss.
    """

    def work(ids, labels, x):
        unit = _unit(x)
        scores = unit @ unit.T / temperature
        np.fill_diagonal(scores, -np.inf)
        top = scores.max(axis=1, keepdims=True) if len(ids) > 1 else np.zeros((len(ids), 1))
        log_sum = np.log(np.exp(scores - top).sum(axis=1, keepdims=True)) + top if len(ids) > 1 else top
        same = labels[:, None] == labels[None, :]
        np.fill_diagonal(same, False)
        logs = np.where(same, scores - log_sum, 0.0).sum(axis=1)
        n = same.sum(axis=1)
        loss = [-a / b if b else None for a, b in zip(logs, n)]
        return pd.DataFrame({row_id: ids, "loss": pd.Series(loss, dtype="float64")})

    return _per_batch(df, work, [df.schema[row_id], T.StructField("loss", T.DoubleType())], row_id)


def supcon_loss(df: DataFrame, temperature: float = TEMPERATURE, row_id: str = "row_id") -> DataFrame:
    """Per batch: mean loss (NULL if some anchor has none) and how many anchors lack a positive."""
    anchors = supcon_anchor_losses(df, temperature, row_id)
    alone = F.count(F.when(F.col("loss").isNull() | F.isnan("loss"), 1))
    return anchors.groupBy("batch_id").agg(
        F.when(alone == 0, F.avg("loss")).alias("loss"), alone.alias("n_without_positive")
    )


def _distances(x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        unit = _unit(x)
        return 1.0 - unit @ unit.T
    square = (x * x).sum(axis=1)
    return np.sqrt(np.maximum(square[:, None] - 2.0 * (x @ x.T) + square[None, :], 0.0))


def mine_triplets(
    df: DataFrame, mode: str = "hard", metric: str = "cosine", margin: float = MARGIN, row_id: str = "row_id"
) -> DataFrame:
    """Triplet losses per anchor of each batch: (batch_id, row_id, positive, negative, loss, n_triplets).

    'hard' takes the farthest positive and nearest negative; 'hard_soft_margin' the same with
    log(1 + exp(.)); 'semi_hard' takes for every positive the nearest negative beyond it (else
    the farthest negative); 'all' uses every valid triplet.  The last two give the summed loss and
    the number of triplets (with 'all': of those with a loss).  Anchors without a positive or
    a negative get none.
    """
    if mode not in ("hard", "hard_soft_margin", "semi_hard", "all"):
        raise ValueError("mode is 'hard', 'hard_soft_margin', 'semi_hard' or 'all'")
    id_type = df.schema[row_id].dataType

    def work(ids, labels, x):
        d = _distances(x, metric)
        other = labels[:, None] != labels[None, :]
        positive = ~other & ~np.eye(len(ids), dtype=bool)
        valid = positive.any(axis=1) & other.any(axis=1)
        anchors = np.flatnonzero(valid)
        none = np.full(len(anchors), None, dtype=object)
        out = {row_id: ids[anchors], "positive": none, "negative": none}
        if mode in ("hard", "hard_soft_margin"):
            p = np.where(positive, d, -np.inf)[anchors].argmax(axis=1)
            n = np.where(other, d, np.inf)[anchors].argmin(axis=1)
            gap = d[anchors, p] - d[anchors, n]
            loss = np.log1p(np.exp(gap)) if mode == "hard_soft_margin" else np.maximum(gap + margin, 0.0)
            out |= {"positive": ids[p], "negative": ids[n], "loss": loss, "n_triplets": np.ones(len(anchors), np.int64)}
        elif mode == "semi_hard":
            a, p = np.nonzero(positive & valid[:, None])
            beyond = np.where(other[a] & (d[a] > d[a, p][:, None]), d[a], np.inf).min(axis=1, initial=np.inf)
            far = np.where(other[a], d[a], -np.inf).max(axis=1, initial=-np.inf)
            loss = np.maximum(d[a, p] - np.where(np.isinf(beyond), far, beyond) + margin, 0.0)
            sums, times = (np.bincount(a, w, minlength=len(ids))[anchors] for w in (loss, None))
            out |= {"loss": sums, "n_triplets": times}
        else:
            gaps = np.maximum(d[anchors, :, None] - d[anchors, None, :] + margin, 0.0)
            gaps = np.where(positive[anchors, :, None] & other[anchors, None, :], gaps, 0.0)
            out |= {"loss": gaps.sum(axis=(1, 2)), "n_triplets": (gaps > 1e-16).sum(axis=(1, 2))}
        return pd.DataFrame(out).astype({"positive": "object", "negative": "object"})

    fields = [
        df.schema[row_id],
        T.StructField("positive", id_type),
        T.StructField("negative", id_type),
        T.StructField("loss", T.DoubleType()),
        T.StructField("n_triplets", T.LongType()),
    ]
    return _per_batch(df, work, fields, row_id)


def triplet_loss(mined: DataFrame) -> DataFrame:
    """Mean loss over the mined triplets of each batch, 0 where there are none."""
    return mined.groupBy("batch_id").agg(
        F.coalesce(F.try_divide(F.sum("loss"), F.sum("n_triplets")), F.lit(0.0)).alias("loss"),
        F.sum("n_triplets").alias("n_triplets"),
    )
