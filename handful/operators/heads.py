"""Fitting classifier heads: Spark ML for one training set, one task per cell for whole grids."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from handful.operators.scoring import Head, class_means, load_head, predict

STRATEGIES = ("one-vs-rest", "multi-output", "classifier-chain")


def _features(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def _classes(df: DataFrame, label: str) -> list:
    """Distinct labels in text order: the class table, which a head holds anyway."""
    return sorted((r[0] for r in df.select(label).distinct().collect() if r[0] is not None), key=str)


def _place(label: str, classes: Sequence):
    known = F.array(*[F.lit(v) for v in classes])
    return (F.array_position(known, F.col(label)) - 1).cast("double")


def default_estimator(n: int) -> LogisticRegression:
    """Logistic regression with an L2 penalty of one half per training row and no scaling."""
    return LogisticRegression(
        featuresCol="features", labelCol="_y", regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=100
    )


@dataclass
class FittedHead:
    """A Spark ML model with the labels its predictions stand for."""

    model: object
    classes: list

    def predict(self, df: DataFrame, vector: str = "embedding") -> DataFrame:
        """Add ``pred_label`` and, where the model gives them, ``probs``."""
        out = self.model.transform(_features(df, vector))
        columns = list(df.columns)
        labels = F.array(*[F.lit(v) for v in self.classes])
        wanted = [F.element_at(labels, (F.col("prediction") + 1).cast("int")).alias("pred_label")]
        if "probability" in out.columns:
            wanted.append(vector_to_array("probability").alias("probs"))
        return out.select(*columns, *wanted)

    def as_head(self) -> Head:
        """Weights of a logistic regression for ``linear_score`` (with eps=0)."""
        weights = self.model.coefficientMatrix.toArray()
        bias = self.model.interceptVector.toArray()
        if len(self.classes) == 2 and len(bias) == 1:
            weights, bias = np.vstack([np.zeros_like(weights), weights]), np.array([0.0, bias[0]])
        return Head([], [()], [list(self.classes)], [weights], [bias])


@dataclass
class MeansHead:
    """The class means as a head: the nearest mean wins."""

    head: Head

    @property
    def classes(self) -> list:
        return self.head.labels[0]

    def predict(self, df: DataFrame, vector: str = "embedding") -> DataFrame:
        """Add ``pred_label`` and ``probs``."""
        return predict(df, self.head, vector).drop("score")

    def as_head(self) -> Head:
        return self.head


def fit_means(df: DataFrame, label: str = "label", vector: str = "embedding") -> MeansHead:
    """One aggregation over the rows that have a label."""
    return MeansHead(load_head(class_means(df.filter(F.col(label).isNotNull()), label=label, vector=vector)))


def fit_head(df: DataFrame, vector: str = "embedding", label: str = "label", estimator: Estimator | None = None) -> FittedHead:
    """Fit one head on embeddings; any Spark ML classifier with columns (features, _y) may replace the default."""
    classes = _classes(df, label)
    rows = _features(df, vector).withColumn("_y", _place(label, classes)).select("features", "_y").persist()
    try:
        return FittedHead((estimator or default_estimator(rows.count())).fit(rows), classes)
    finally:
        rows.unpersist()


@dataclass
class MultiHead:
    """One binary head per label of a 0/1 vector; in a chain each also reads the earlier labels."""

    strategy: str
    models: list = field(default_factory=list)

    def predict(self, df: DataFrame, vector: str = "embedding") -> DataFrame:
        """Add ``probs`` and ``pred_label``, both one entry per label."""
        out = df.withColumn("_x", F.col(vector).cast("array<double>"))
        probs, marks = [], []
        for i, model in enumerate(self.models):
            source = out.withColumn("features", array_to_vector("_x"))
            scored = model.transform(source)
            mark = F.col("prediction").cast("int")
            out = scored.withColumn(f"_p{i}", vector_to_array("probability")[1]).withColumn(f"_m{i}", mark)
            if self.strategy == "classifier-chain":
                out = out.withColumn("_x", F.concat("_x", F.array(F.col(f"_m{i}").cast("double"))))
            out = out.drop("features", "rawPrediction", "probability", "prediction")
            probs.append(F.col(f"_p{i}"))
            marks.append(F.col(f"_m{i}"))
        return out.select(*df.columns, F.array(*probs).alias("probs"), F.array(*marks).alias("pred_label"))


def fit_multi_head(
    df: DataFrame, n_labels: int, strategy: str = "one-vs-rest", vector: str = "embedding", label: str = "label", parallel: int = 4
) -> MultiHead:
    """Heads for 0/1 vector labels.

    Independent labels are fitted side by side over one cached frame; a chain is fitted in
    label order, each head seeing the true earlier labels.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
    rows = df.select(F.col(vector).cast("array<double>").alias("_x"), F.col(label).alias("_l")).persist()
    n = rows.count()

    def fit(i: int):
        x = F.col("_x")
        if strategy == "classifier-chain" and i:
            x = F.concat(x, F.transform(F.slice("_l", 1, i), lambda v: v.cast("double")))
        one = rows.select(array_to_vector(x).alias("features"), F.get("_l", F.lit(i)).cast("double").alias("_y"))
        return default_estimator(n).fit(one)

    try:
        with ThreadPoolExecutor(parallel) as pool:
            return MultiHead(strategy, list(pool.map(fit, range(n_labels))))
    finally:
        rows.unpersist()


def logistic_weights(x: np.ndarray, y: np.ndarray, k: int, steps: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression with penalty |W|^2 / 2 beside the summed loss, by accelerated gradient steps.

    A small helper for few-shot cells: x is [n, d] with n a handful of rows per class.
    """
    n = len(x)
    target = np.eye(k)[y]
    # the optimum lies in the span of the rows, so n coefficients per class replace d weights
    gram = x @ x.T
    alpha, bias = np.zeros((n, k)), np.zeros(k)
    step = 1.0 / (0.5 * (np.linalg.norm(gram, 2) + n) + 1.0)
    za, zb, t = alpha.copy(), bias.copy(), 1.0
    for _ in range(steps):
        scores = gram @ za + zb
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gap = p - target
        new_alpha, new_bias = za - step * (gap + za), zb - step * gap.sum(axis=0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        za = new_alpha + (t - 1) / t_next * (new_alpha - alpha)
        zb = new_bias + (t - 1) / t_next * (new_bias - bias)
        done = max(np.abs(new_alpha - alpha).max(), np.abs(new_bias - bias).max()) < 1e-10
        alpha, bias, t = new_alpha, new_bias, t_next
        if done:
            break
    return alpha.T @ x, bias


def fit_cells(df: DataFrame, by: Sequence[str], vector: str = "embedding", label: str = "label") -> DataFrame:
    """Logistic heads of every few-shot cell at once, as a head table (by..., label, weights, bias).

    Each cell is one group; a cell holds ``sample_size`` rows per class (at most twice that
    with synthetic rows), so groups stay small however large the source table is.
    """
    by = list(by)
    fields = [df.schema[c] for c in by] + [T.StructField("label", df.schema[label].dataType)]
    schema = T.StructType(
        [*fields, T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("bias", T.DoubleType())]
    )

    def fit(cell: pd.DataFrame) -> pd.DataFrame:
        classes = sorted(cell[label].unique(), key=str)
        places = {v: i for i, v in enumerate(classes)}
        x = np.stack(cell[vector].to_numpy()).astype(np.float64)
        weights, bias = logistic_weights(x, cell[label].map(places).to_numpy(), len(classes))
        out = pd.DataFrame({"label": classes, "weights": list(weights), "bias": bias})
        for c in by:
            out[c] = cell[c].iloc[0]
        return out[[*by, "label", "weights", "bias"]]

    return df.select(*by, label, F.col(vector).cast("array<double>").alias(vector)).groupBy(*by).applyInPandas(fit, schema)
