"""Embedding texts, linear heads and batch prediction.

A head is a small table (by..., label, weights, bias).  It is brought to the
driver under a size check and sent to the tasks once; the scored table only
passes through Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from handful.functions.order import draw_key, exact_rank
from handful.functions.vectors import argmax, cosine, l2_normalize, softmax
from handful.operators.columns import label_name
from handful.session import cut_lineage

# A head may hold this many numbers (256 MB of doubles); more is refused, not cut.
MAX_HEAD_NUMBERS = 32_000_000
# The head's default temperature and the epsilon added to it.
TEMPERATURE, EPSILON = 1.0, 1e-5


def embed(
    df: DataFrame,
    encoder: Callable[[], Callable[[Sequence[str]], np.ndarray]] | None = None,
    text: str = "text",
    out: str = "embedding",
    dim: int = 256,
    idf: bool = False,
    normalize: bool = False,
    batch_size: int = 32,
) -> DataFrame:
    """Add a vector per text.

    ``encoder`` is a factory: it is called once per worker and returns a function
    from a list of texts to an [n, dim] array.  Without one, hashed word counts
    are built inside the JVM (optionally IDF-weighted).
    """
    if encoder is None:
        words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+", toLowercase=True).transform(
            df.withColumn(text, F.coalesce(text, F.lit("")))
        )
        made = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(words)
        column = "_tf"
        if idf:
            made = IDF(inputCol="_tf", outputCol="_idf").fit(made).transform(made)
            column = "_idf"
        if normalize:
            made = Normalizer(inputCol=column, outputCol="_unit").transform(made)
            column = "_unit"
        return made.select(*df.columns, vector_to_array(column).alias(out))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = encoder()
        for texts in batches:
            # Only the texts of one call are strings of Python; the others stay in the Arrow batch.
            parts = [
                np.asarray(run([t or "" for t in texts.slice(i, batch_size).to_pylist()]), dtype=np.float64)
                for i in range(0, len(texts), batch_size)
            ]
            matrix = np.concatenate(parts) if parts else np.zeros((0, 0))
            if normalize:
                size = np.linalg.norm(matrix, axis=1, keepdims=True)
                matrix = np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)
            edges = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
            yield pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(matrix.ravel(), pa.float64(), from_pandas=True))

    # marked so that the planner keeps one call per row instead of copying it into filters
    return df.withColumn(out, encode.asNondeterministic()(F.col(text)))


def pool_tokens(
    tokens: DataFrame, row_id: str = "row_id", vector: str = "vector", mask: str = "mask", out: str = "embedding"
) -> DataFrame:
    """Mean of a row's unmasked token vectors from a long token table, summed map-side."""
    mean = tokens.filter(F.col(mask) > 0).groupBy(row_id).agg(
        Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("_v")
    )
    return mean.select(row_id, vector_to_array("_v").alias(out))


def pair_similarity(pairs: DataFrame, vectors: DataFrame, vector: str = "embedding", row_id: str = "row_id") -> DataFrame:
    """Cosine of the two rows of each pair (id_1, id_2)."""
    one = vectors.select(F.col(row_id).alias("id_1"), F.col(vector).alias("_v1"))
    two = vectors.select(F.col(row_id).alias("id_2"), F.col(vector).alias("_v2"))
    joined = pairs.join(one, "id_1").join(two, "id_2")
    return joined.withColumn("similarity", cosine("_v1", "_v2")).drop("_v1", "_v2")


def class_means(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", vector: str = "embedding", normalize: bool = False
) -> DataFrame:
    """Head whose weights are the class mean vectors, with bias -|mean|^2 / 2 (nearest mean wins)."""
    by = list(by)
    mean = df.groupBy(*by, label).agg(
        Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("_m")
    )
    weights = vector_to_array("_m")
    out = mean.select(*by, F.col(label).alias("label"), (l2_normalize(weights) if normalize else weights).alias("weights"))
    square = F.aggregate("weights", F.lit(0.0), lambda acc, x: acc + x * x)
    return out.withColumn("bias", -square / 2)


@dataclass
class Head:
    """Weights on the driver; ``cells`` are the values of ``by`` and each has its own label list."""

    by: list[str]
    cells: list[tuple]
    labels: list[list]
    weights: list[np.ndarray]
    bias: list[np.ndarray]


def load_head(heads: DataFrame, by: Sequence[str] = (), limit: int = MAX_HEAD_NUMBERS) -> Head:
    """Collect a head table; one that holds more than ``limit`` numbers is refused (``predict_top`` takes any size).

    Labels are kept in text order.  The stored table must have (by..., label, weights, bias).
    """
    by = list(by)
    narrow = heads.select(*by, "label", F.col("weights").cast("array<double>").alias("weights"), "bias").persist()
    size = narrow.agg(F.sum(F.size("weights")).alias("s")).first()["s"] or 0
    if size > limit:
        raise ValueError(f"The head holds {size} numbers; at most {limit} are sent to the tasks.")
    grouped: dict[tuple, list] = {}
    for row in narrow.collect():
        grouped.setdefault(tuple(row[c] for c in by), []).append((row["label"], row["weights"], row["bias"]))
    narrow.unpersist()
    head = Head(by, [], [], [], [])
    for cell in sorted(grouped, key=lambda c: tuple(str(v) for v in c)):
        rows = sorted(grouped[cell], key=lambda r: str(r[0]))
        head.cells.append(cell)
        head.labels.append([r[0] for r in rows])
        head.weights.append(np.array([r[1] for r in rows], dtype=np.float64))
        head.bias.append(np.array([r[2] for r in rows], dtype=np.float64))
    return head


def _probabilities(logits: np.ndarray, multi_target: bool) -> np.ndarray:
    if multi_target:
        return 1.0 / (1.0 + np.exp(-logits))
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def linear_score(
    df: DataFrame,
    head: Head,
    vector: str = "embedding",
    temperature: float = TEMPERATURE,
    eps: float = EPSILON,
    multi_target: bool = False,
) -> DataFrame:
    """Add ``logits`` and ``probs`` of one head, in its label order: (Wx + b) / (T + eps), softmax or sigmoid."""
    weights, bias = head.weights[0], head.bias[0]
    schema = T.StructType(
        [T.StructField("logits", T.ArrayType(T.DoubleType())), T.StructField("probs", T.ArrayType(T.DoubleType()))]
    )

    @F.pandas_udf(schema)
    def score(x: pd.Series) -> pd.DataFrame:
        if len(x) == 0:
            return pd.DataFrame({"logits": [], "probs": []})
        logits = (np.stack(x.to_numpy()).astype(np.float64) @ weights.T + bias) / (temperature + eps)
        return pd.DataFrame({"logits": list(logits), "probs": list(_probabilities(logits, multi_target))})

    return df.withColumn("_s", score(F.col(vector))).select(
        *df.columns, F.col("_s.logits").alias("logits"), F.col("_s.probs").alias("probs")
    )


def predict(
    df: DataFrame, head: Head, vector: str = "embedding", names: Sequence[str] | None = None, multi_target: bool = False
) -> DataFrame:
    """Add ``probs`` and ``pred_label`` (and ``pred_name`` with ``names``).

    One target: the label of the largest probability.  Several targets: a 0/1 vector at threshold 0.5.
    """
    scored = linear_score(df, head, vector, multi_target=multi_target).drop("logits")
    if multi_target:
        return scored.withColumn("pred_label", F.transform("probs", lambda p: (p >= 0.5).cast("int")))
    labels = F.array(*[F.lit(v) for v in head.labels[0]])
    place = F.array_position("probs", F.array_max("probs")).cast("int")
    scored = scored.withColumn("pred_label", F.element_at(labels, place)).withColumn("score", F.array_max("probs"))
    if names is not None:
        scored = scored.withColumn("pred_name", label_name("pred_label", names))
    return scored


def predict_grid(df: DataFrame, head: Head, keep: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Predictions of every cell's head for every row: (keep..., by..., pred_label).

    Each Arrow batch is multiplied with all heads at once; no join with the grid is made.
    """
    sample = next(v for labels in head.labels for v in labels)
    kind = T.StringType() if isinstance(sample, str) else T.LongType()
    joined = np.concatenate(head.weights)
    bias = np.concatenate(head.bias)
    edges = np.cumsum([0] + [len(v) for v in head.labels])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def winners(x: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=object)
        logits = np.stack(x.to_numpy()).astype(np.float64) @ joined.T + bias
        best = np.stack([logits[:, a:b].argmax(axis=1) for a, b in zip(edges, edges[1:])], axis=1)
        return pd.Series(list(best.astype(np.int32)))

    spark = df.sparkSession
    rows = [
        (i, j, *cell, label if kind == T.StringType() else int(label))
        for i, cell in enumerate(head.cells)
        for j, label in enumerate(head.labels[i])
    ]
    by_types = [T.StructField(c, _spark_type(v)) for c, v in zip(head.by, head.cells[0])]
    names = spark.createDataFrame(
        rows,
        T.StructType(
            [T.StructField("_cell", T.IntegerType()), T.StructField("_place", T.IntegerType()), *by_types]
            + [T.StructField("pred_label", kind)]
        ),
    )
    placed = df.select(*keep, F.posexplode(winners(F.col(vector))).alias("_cell", "_place"))
    # names has one row per cell and class: its size is the head's, checked in load_head
    return placed.join(F.broadcast(names), ["_cell", "_place"]).drop("_cell", "_place")


def grid_confusion(df: DataFrame, head: Head, true: str = "true_label", vector: str = "embedding") -> DataFrame:
    """Confusion counts of every cell's head over all rows: (by..., true_label, pred_label, n).

    Each task multiplies its batches with all heads, counts (cell, true, predicted) itself and passes on these counts
    alone, so at most cells x classes^2 rows leave a task however many rows it scores. Rows without a true
    label are left out; a row without a vector is an error with a NULL prediction.
    """
    sample = next(v for labels in head.labels for v in labels)
    kind = T.StringType() if isinstance(sample, str) else T.LongType()
    schema = T.StructType(
        [T.StructField(c, _spark_type(v)) for c, v in zip(head.by, head.cells[0])]
        + [T.StructField("true_label", df.schema[true].dataType), T.StructField("pred_label", kind), T.StructField("n", T.LongType())]
    )
    arrow = to_arrow_schema(schema)
    joined, bias = np.concatenate(head.weights), np.concatenate(head.bias)
    edges = np.cumsum([0] + [len(v) for v in head.labels])
    shared = df.sparkSession.sparkContext.broadcast((joined, bias))
    cell_of = np.repeat(np.arange(len(head.cells)), np.diff(edges))
    label_of = [label for labels in head.labels for label in labels]

    def run(batches):
        weights, plus = shared.value
        codes, counts = {}, Counter()
        for batch in batches:
            trues = [codes.setdefault(v, len(codes)) for v in batch.column(0).to_pylist()]
            known = np.asarray(batch.column(1).is_valid())
            x = batch.column(1).drop_null()
            code, none = np.array(trues, np.int64)[known], np.array(trues, np.int64)[~known]
            counts.update((t, -1) for t in none.tolist())
            if not len(x):
                continue
            logits = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) @ weights.T + plus
            flat = [code * len(weights) + a + logits[:, a:b].argmax(axis=1) for a, b in zip(edges, edges[1:])]
            found, times = np.unique(np.concatenate(flat), return_counts=True)
            for f, n in zip(found.tolist(), times.tolist()):
                counts[divmod(f, len(weights))] += n
        names = list(codes)
        rows = []
        for (t, place), n in counts.items():
            if place < 0:
                rows += [(*cell, names[t], None, n) for cell in head.cells]
            else:
                rows.append((*head.cells[cell_of[place]], names[t], label_of[place], n))
        for at in range(0, len(rows), 10_000):
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 10_000]), arrow)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    narrow = df.filter(F.col(true).isNotNull()).select(true, F.col(vector).cast("array<double>").alias("vector"))
    counted = narrow.mapInArrow(run, schema)
    return counted.groupBy(*head.by, "true_label", "pred_label").agg(F.sum("n").alias("n"))


def predict_top(
    df: DataFrame,
    heads: DataFrame,
    keep: Sequence[str],
    k: int = 1,
    vector: str = "embedding",
    limit: int = MAX_HEAD_NUMBERS,
) -> DataFrame:
    """The ``k`` best labels of a head of any size: (keep..., top), ``top`` an array of (label, score), best first.

    The head table (label, weights, bias) is cut into blocks of at most ``limit`` numbers. Block by block goes to the tasks,
    which keep each row's best labels so far and the sum of all powers, so scores are those of the softmax over
    all labels. Rows never move. Ties go to the label first in text order; a row without a vector has a NULL ``top``.
    """
    sample = heads.select(F.size("weights").alias("d")).first()
    if sample is None:
        raise ValueError("The head has no labels.")
    block = max(1, limit // (sample["d"] + 1))
    kind = heads.schema["label"].dataType
    placed = exact_rank(heads.select("label"), draw_key(0, "label"), ["label"], name="_place")
    placed = placed.select("label", F.floor(F.col("_place") / block).alias("_block"))
    table = cut_lineage(heads.select("label", F.col("weights").cast("array<double>").alias("weights"), "bias").join(placed, "label"), "head-blocks")
    blocks = -(-table.count() // block)
    state = T.StructType(
        [T.StructField("labels", T.ArrayType(kind)), T.StructField("logits", T.ArrayType(T.DoubleType())), T.StructField("total", T.DoubleType())]
    )
    empty = F.struct(F.array().cast(T.ArrayType(kind)).alias("labels"), F.array().cast("array<double>").alias("logits"), F.lit(0.0).alias("total"))
    rows = df.select(*keep, F.col(vector).cast("array<double>").alias("_x"), empty.alias("_s"))
    for number in range(blocks):
        own = sorted(table.filter(F.col("_block") == number).collect(), key=lambda r: str(r["label"]))
        shared = df.sparkSession.sparkContext.broadcast(
            ([r["label"] for r in own], np.array([r["weights"] for r in own], np.float64), np.array([r["bias"] for r in own], np.float64))
        )
        merged = _merge_block(shared, k, state)
        rows = rows.select(*keep, "_x", merged(F.col("_x"), F.col("_s")).alias("_s"))
        # The block has been used when the next one comes, so tasks hold one at a time.
        if number + 1 < blocks:
            rows = cut_lineage(rows, "top-labels")
            shared.destroy()
    scores = F.transform(
        F.arrays_zip(F.col("_s.labels").alias("label"), F.col("_s.logits").alias("logit")),
        lambda e: F.struct(e["label"].alias("label"), (F.exp(e["logit"] - F.col("_s.logits")[0]) / F.col("_s.total")).alias("score")),
    )
    return rows.select(*keep, F.when(F.col("_x").isNotNull(), scores).alias("top"))


def _merge_block(shared, k: int, state: T.StructType):
    """Rows' best labels and sum of powers (relative to the best logit) after one more block of labels."""

    @F.pandas_udf(state)
    def merge(x: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        labels, weights, bias = shared.value
        out = []
        for at in range(0, len(x), 256):
            part = x.iloc[at : at + 256]
            known = part.notna().to_numpy()
            logits = np.full((len(part), len(labels)), -np.inf)
            if known.any():
                logits[known] = (np.stack(part[known].to_numpy()) @ weights.T + bias) / (TEMPERATURE + EPSILON)
            some = min(k, len(labels))
            edge = np.partition(logits, len(labels) - some, axis=1)[:, len(labels) - some]
            for i, row in enumerate(logits):
                if not known[i]:
                    out.append((None, None, None))
                    continue
                old = before.iloc[at + i]
                pairs = list(zip(old["logits"], old["labels"])) + [(row[j], labels[j]) for j in np.flatnonzero(row >= edge[i])]
                best = sorted(pairs, key=lambda p: (-p[0], str(p[1])))[:k]
                top = best[0][0]
                had = old["total"] * np.exp(old["logits"][0] - top) if len(old["logits"]) else 0.0
                out.append(([p[1] for p in best], [float(p[0]) for p in best], float(had + np.exp(row - top).sum())))
        return pd.DataFrame(out, columns=["labels", "logits", "total"])

    return merge


def _spark_type(value) -> T.DataType:
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, float):
        return T.DoubleType()
    return T.LongType()


def rank_labels(df: DataFrame, head: Head, row_id: str = "row_id") -> DataFrame:
    """All labels of a scored row by falling probability: (row_id, place, label, score), the winner at place 1."""
    labels = F.array(*[F.lit(v) for v in head.labels[0]])
    pairs = F.transform(
        F.arrays_zip(F.col("probs").alias("p"), labels.alias("l")),
        lambda e, i: F.struct((-e["p"]).alias("n"), i.alias("i"), e["l"].alias("label"), e["p"].alias("score")),
    )
    return df.select(row_id, F.posexplode(F.array_sort(pairs)).alias("place", "e")).select(
        row_id, (F.col("place") + 1).alias("place"), "e.label", "e.score"
    )


def ensemble(preds: DataFrame, row_id: str = "row_id", logits: str = "logits") -> DataFrame:
    """Mean over patterns of each row's softmaxed scores, then the best class: (row_id, probs, pred_pos)."""
    mean = preds.groupBy(row_id).agg(Summarizer.mean(array_to_vector(softmax(logits))).alias("_m"))
    out = mean.select(row_id, vector_to_array("_m").alias("probs"))
    return out.withColumn("pred_pos", argmax("probs"))


def head_loss(preds: DataFrame, true_pos: str = "true_pos", probs: str = "probs") -> DataFrame:
    """Mean cross-entropy; ``true_pos`` is the 0-based place of the true class."""
    p = F.element_at(F.col(probs), (F.col(true_pos) + 1).cast("int"))
    return preds.agg(F.avg(-F.log(p)).alias("loss"))


def head_loss_multi(preds: DataFrame, true: str = "true_label", probs: str = "probs") -> DataFrame:
    """Mean binary cross-entropy over all (row, label) cells."""
    cell = F.zip_with(
        true, probs, lambda t, p: -(t * F.log(p) + (F.lit(1) - t) * F.log(F.lit(1.0) - p))
    )
    return preds.select(F.explode(cell).alias("c")).agg(F.avg("c").alias("loss"))
