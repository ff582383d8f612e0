"""Training, evaluation, distillation and parameter search, composed from the operators.

Only weights and class tables reach the driver: rows, pairs and predictions stay in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from handful.functions.order import draw_key, draw_number, take_first
from handful.operators import metrics as E
from handful.operators.augment import pseudo_label
from handful.operators.columns import validate_columns
from handful.operators.heads import FittedHead, MeansHead, MultiHead, fit_head, fit_means, fit_multi_head
from handful.operators.pairs import (
    balance_pairs,
    capped_pairs,
    contrastive_pairs,
    drawn_pairs,
    drawn_pairs_multilabel,
    drawn_teacher_pairs,
    teacher_pairs,
)
from handful.operators.gradients import BATCH_LOSSES
from handful.operators.scoring import embed
from handful.plans.batches import fit_in_batches

Metric = Callable[[DataFrame], DataFrame]


def adapt(df: DataFrame, weights: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Replace vectors by their image under a linear map."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(x: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(x.to_numpy()).astype(np.float64) @ weights.T))

    return df.withColumn(vector, project(F.col(vector)))


def _pair_gradient(weights: np.ndarray, a: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient and sum of (cos(Wa, Wb) - y)^2 over a batch of pairs."""
    u, v = a @ weights.T, b @ weights.T
    nu = np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    nv = np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    cos = (u * v).sum(axis=1, keepdims=True) / (nu * nv)
    pull = 2.0 * (cos - y[:, None])
    du = pull * (v / (nu * nv) - cos * u / (nu * nu))
    dv = pull * (u / (nu * nv) - cos * v / (nv * nv))
    return du.T @ a + dv.T @ b, float(((cos[:, 0] - y) ** 2).sum())


def fit_adapter(
    pairs: DataFrame | None,
    vectors: DataFrame,
    epochs: int = 5,
    lr: float = 0.5,
    vector: str = "embedding",
    row_id: str = "row_id",
    loss: str = "cosine",
    **batches,
) -> tuple[np.ndarray, list[float]]:
    """Learn a square linear map of fixed embeddings on a loss of pairs, or of batches of labelled rows.

    The squared cosine loss of all pairs together is the default: every epoch each partition adds up its own
    gradient; partial sums are merged in two levels, and only the dim x dim total comes to the
    driver. The other losses of ``gradients``, and any settings of ``fit_in_batches``, go by mini-batches; losses of labelled
    rows take them from ``vectors``, and ``pairs`` may be None. Returns the map and the mean loss before each step.
    """
    if loss != "cosine" or batches:
        return fit_in_batches(loss, vectors, pairs, epochs, lr, vector=vector, row_id=row_id, **batches)
    one = vectors.select(F.col(row_id).alias("id_1"), F.col(vector).cast("array<double>").alias("a"))
    two = vectors.select(F.col(row_id).alias("id_2"), F.col(vector).cast("array<double>").alias("b"))
    joined = pairs.select("id_1", "id_2", F.col("label").cast("double").alias("y"))
    rows = joined.join(one, "id_1").join(two, "id_2").select("a", "b", "y").persist(StorageLevel.MEMORY_AND_DISK)
    first = rows.select(F.size("a").alias("d")).first()
    if first is None:
        raise ValueError("There are no pairs to learn from.")
    weights, losses = np.eye(first["d"]), []
    schema = "part int, sums array<double>"

    def step(current: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, loss, n = np.zeros_like(current), 0.0, 0
            for batch in batches:
                if len(batch):
                    a, b = np.stack(batch["a"].to_numpy()), np.stack(batch["b"].to_numpy())
                    grad, part = _pair_gradient(current, a, b, batch["y"].to_numpy())
                    total, loss, n = total + grad, loss + part, n + len(batch)
            if n:
                here = TaskContext.get().partitionId() % 32
                yield pd.DataFrame({"part": [here], "sums": [np.concatenate([[loss, n], total.ravel()])]})

        return run

    try:
        for _ in range(epochs):
            partial = rows.mapInPandas(step(weights), schema).withColumn("_v", array_to_vector("sums"))
            merged = partial.groupBy("part").agg(Summarizer.sum(F.col("_v")).alias("_v"))
            sums = np.array(merged.agg(vector_to_array(Summarizer.sum(F.col("_v"))).alias("s")).first()["s"])
            losses.append(float(sums[0] / sums[1]))
            weights = weights - lr * sums[2:].reshape(weights.shape) / sums[1]
    finally:
        rows.unpersist()
    return weights, losses


@dataclass
class Model:
    """Encoder, adapter and head of a trained classifier."""

    encoder: Callable | None
    dim: int
    adapter: np.ndarray | None
    head: FittedHead | MeansHead | MultiHead
    losses: list[float] = field(default_factory=list)

    def vectors(self, df: DataFrame, text: str = "text") -> DataFrame:
        out = df if "embedding" in df.columns else embed(df, self.encoder, text, dim=self.dim)
        return out if self.adapter is None else adapt(out, self.adapter)

    def predict(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add ``pred_label`` and ``probs``; ready embeddings are used where the frame has them."""
        return self.head.predict(self.vectors(df, text)).drop("embedding")


def train(
    df: DataFrame,
    encoder: Callable | None = None,
    dim: int = 256,
    strategy: str = "oversampling",
    num_iterations: int | None = None,
    max_pairs: int = -1,
    epochs: int = 3,
    lr: float = 0.5,
    multi_target: str | None = None,
    estimator=None,
    seed: int = 42,
    pairs: str = "exact",
    mapping: Mapping[str, str] | None = None,
    row_id: str = "row_id",
    loss: str = "cosine",
    batches: Mapping | None = None,
    head: str = "logistic",
) -> Model:
    """Pair phase, then head phase, on a training table (row_id, text or embedding, label).

    ``loss`` is any loss of ``fit_adapter`` and ``batches`` its settings; losses of batches of labelled rows need no
    pairs, and class labels rather than label sets. ``head`` is 'logistic' (or what ``estimator`` fits) or 'means', the
    class means.

    ``pairs='exact'`` lists all pairs of a few-shot sample; 'drawn' gives every row
    ``num_iterations`` partners of each kind and suits any size.  With ``max_pairs`` a budget of distinct
    pairs is drawn (for label sets: one partner of each kind a row, up to the budget), also from tables of any size.
    """
    needed = ("label",) if "embedding" in df.columns else ("text", "label")
    validate_columns(df, mapping, needed)
    if mapping:
        df = df.withColumnsRenamed(dict(mapping))
    vectors = df if "embedding" in df.columns else embed(df, encoder, dim=dim)
    vectors = vectors.select(row_id, "label", "embedding").persist(StorageLevel.MEMORY_AND_DISK)
    weights, losses = None, []
    try:
        if epochs:
            labels = vectors.select(row_id, "label")
            if loss in BATCH_LOSSES and multi_target is not None:
                raise ValueError(f"the loss {loss!r} needs one label a row")
            draw = drawn_pairs if multi_target is None else drawn_pairs_multilabel
            if loss in BATCH_LOSSES:
                chosen = None
            elif pairs == "drawn":
                chosen = draw(labels, num_iterations or 1, seed, row_id=row_id)
            elif max_pairs != -1 and multi_target is None:
                chosen = balance_pairs(capped_pairs(labels, max_pairs, seed, row_id=row_id), strategy, None, seed)
            elif max_pairs != -1:
                rounds = -(-max_pairs // max(2 * labels.count(), 1))
                chosen = take_first(draw(labels, rounds, seed, row_id=row_id), draw_key(seed, "id_1", "id_2", "draw"), ["id_1", "id_2", "draw", "label"], max_pairs)
            else:
                every = contrastive_pairs(labels, multilabel=multi_target is not None, row_id=row_id)
                per_side = num_iterations * labels.count() if num_iterations else None
                chosen = balance_pairs(every, strategy, per_side, seed)
            weights, losses = fit_adapter(chosen, vectors, epochs, lr, row_id=row_id, loss=loss, **(batches or {}))
        ready = vectors if weights is None else adapt(vectors, weights)
        if multi_target is not None:
            fitted = fit_multi_head(ready, len(vectors.first()["label"]), multi_target)
        else:
            fitted = _fit(ready, head, estimator)
    finally:
        vectors.unpersist()
    return Model(encoder, dim, weights, fitted, losses)


def _fit(rows: DataFrame, head: str, estimator=None) -> FittedHead | MeansHead:
    if head not in ("logistic", "means"):
        raise ValueError(f"head is 'logistic' or 'means', not {head!r}")
    return fit_means(rows) if head == "means" else fit_head(rows, estimator=estimator)


def metric_rows(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., metric, value) from one column per metric."""
    names = [c for c in scores.columns if c not in by]
    return scores.select(*by, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(list(by), names, "metric", "value")


def evaluate(model: Model, df: DataFrame, metric: str | Metric = "accuracy", label: str = "label") -> DataFrame:
    """(metric, value) of a model on labelled rows.

    ``metric`` is a name from ``scores`` (or 'mae'), or a function from predictions
    (true_label, pred_label) to a table with one column per metric or (metric, value) rows.
    """
    preds = model.predict(df.withColumnRenamed(label, "true_label"))
    if callable(metric):
        out = metric(preds)
        return out if out.columns == ["metric", "value"] else metric_rows(out)
    if metric == "mae":
        return metric_rows(E.mae(preds))
    multi = isinstance(model.head, MultiHead)
    scored = E.multilabel_scores(preds).withColumn("accuracy", F.col("subset_accuracy")) if multi else E.scores(preds)
    if metric not in scored.columns:
        raise ValueError(f"metric is a function or one of {sorted(scored.columns)}, not {metric!r}")
    return metric_rows(scored.select(metric))


def distill(
    unlabelled: DataFrame,
    teacher: Model,
    labelled: DataFrame | None = None,
    encoder: Callable | None = None,
    dim: int = 256,
    max_pairs: int = -1,
    num_iterations: int | None = None,
    epochs: int = 3,
    lr: float = 0.5,
    seed: int = 42,
    row_id: str = "row_id",
    head: str = "logistic",
) -> Model:
    """Student whose pairs carry the teacher's cosines and whose head learns the teacher's labels.

    ``num_iterations`` pairs a row, or ``max_pairs // 2`` in all, are drawn from tables of any size; with neither, all
    pairs of a few-shot sample are listed. Without ``epochs`` there is no pair phase.
    """
    judged = teacher.predict(unlabelled).select(row_id, "text", F.col("pred_label"))
    if labelled is not None:
        rows = pseudo_label(labelled.select(row_id, "text", "label"), judged).drop("pseudo")
    else:
        rows = judged.withColumnRenamed("pred_label", "label")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        student = embed(rows, encoder, dim=dim)
        weights, losses = None, []
        if epochs:
            judged_vectors = teacher.vectors(rows).select(row_id, "embedding")
            if num_iterations:
                pairs = drawn_teacher_pairs(judged_vectors, num_iterations, seed, row_id=row_id)
            elif max_pairs != -1:
                pairs = drawn_teacher_pairs(judged_vectors, 0, seed, row_id=row_id, max_pairs=max_pairs // 2)
            else:
                pairs = teacher_pairs(judged_vectors, row_id=row_id)
            weights, losses = fit_adapter(pairs, student, epochs, lr, row_id=row_id)
        fitted = _fit(student if weights is None else adapt(student, weights), head)
    finally:
        rows.unpersist()
    return Model(encoder, dim, weights, fitted, losses)


# The default search space: bounds of the learning rate (on a log scale), epochs and seed, and choices.
DEFAULT_SPACE = {
    "learning_rate": ("log", 1e-6, 1e-4),
    "num_epochs": ("int", 1, 5),
    "num_iterations": ("choice", [5, 10, 20]),
    "seed": ("int", 1, 40),
    "batch_size": ("choice", [4, 8, 16, 32, 64]),
}


def draw_trials(spark, n: int, space: Mapping[str, tuple] | None = None, seed: int = 42) -> DataFrame:
    """Table of n parameter settings (trial, name...) drawn from a space."""
    out = spark.range(n).withColumnRenamed("id", "trial")
    for name, (kind, *bounds) in (space or DEFAULT_SPACE).items():
        number = draw_number(draw_key(seed, F.lit(name), F.col("trial")))
        share = number / F.lit(float(2**32))
        if kind == "log":
            low, high = np.log(bounds[0]), np.log(bounds[1])
            value = F.exp(F.lit(low) + share * F.lit(high - low))
        elif kind == "int":
            value = (F.lit(bounds[0]) + number % (bounds[1] - bounds[0] + 1)).cast("int")
        elif kind == "choice":
            options = F.array(*[F.lit(v) for v in bounds[0]])
            value = F.element_at(options, (number % len(bounds[0]) + 1).cast("int"))
        else:
            raise ValueError(f"unknown kind {kind!r} of parameter {name!r}")
        out = out.withColumn(name, value)
    return out


def sum_of_metrics(metrics: DataFrame) -> float:
    return float(metrics.agg(F.sum("value")).first()[0])


@dataclass
class Search:
    """All trials with their objective, and the best of them."""

    trials: DataFrame
    best: dict
    objective: float


def grid_search(
    spark,
    run: Callable[[dict], DataFrame],
    n_trials: int = 10,
    space: Mapping[str, tuple] | None = None,
    objective: Callable[[DataFrame], float] = sum_of_metrics,
    direction: str = "maximize",
    seed: int = 42,
    parallel: int = 2,
) -> Search:
    """Draw settings, score each with ``run`` (settings -> metric rows), keep the best.

    Trials are a handful of Spark jobs; a few run side by side.
    """
    if direction not in ("maximize", "minimize"):
        raise ValueError("direction is 'maximize' or 'minimize'")
    table = draw_trials(spark, n_trials, space, seed)
    settings = [row.asDict() for row in table.orderBy("trial").collect()]

    def score(setting: dict) -> float:
        return objective(run({k: v for k, v in setting.items() if k != "trial"}))

    with ThreadPoolExecutor(parallel) as pool:
        values = list(pool.map(score, settings))
    scored = spark.createDataFrame([(s["trial"], v) for s, v in zip(settings, values)], "trial long, objective double")
    sign = 1 if direction == "maximize" else -1
    place = max(range(len(values)), key=lambda i: (sign * values[i], -i))
    return Search(table.join(scored, "trial"), settings[place], values[place])
