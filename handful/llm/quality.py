"""Quality of whole texts by a small convolutional network over bytes, in numpy.

Every byte has a learned embedding. Learned filters of 8 bytes slide over the text in steps of 4;
their rectified outputs are averaged inside chunks of 256 bytes that overlap by half and cover the
whole text. A second layer turns each chunk into features, each feature is max-pooled
over all chunks, and a logistic unit combines the maxima into one probability. One more filter bank is fixed: for
every lag, the share of a chunk's bytes that equal the byte that many places before; the second layer
sees the largest of these shares.

The network is fitted by Adam on a bounded sample: at most ``per_class`` labelled rows of each class,
of each at most ``max_chunks`` chunks spread evenly over the text. Scoring reads every byte, long texts
in pieces.

Defined results: a null text is the empty text; a text without chunks has the score of empty features.
Bytes past the end count as 0 and their windows are masked. If a class has no labelled rows all scores are the
smoothed share of class 1. An empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from handful.llm.common import as_batch, byte_values, rows_of
from handful.llm.labelled import held_out, sample_ids

WIDTH, STRIDE, CHUNK, HOP = 8, 4, 256, 128
SPAN = CHUNK + WIDTH - STRIDE
WINDOWS = CHUNK // STRIDE
EMBED, FILTERS, FEATURES = 8, 16, 12
LAGS = range(2, 33)
# Brings the share of repeated bytes to the range of the other inputs of the second layer.
REPEAT_SCALE = 4.0
PIECE = 1 << 16


def chunk_starts(size: int) -> np.ndarray:
    """Starts of the chunks that cover ``size`` bytes."""
    return np.arange(0, max(size - HOP, 1), HOP) if size else np.arange(0)


def sampled_chunks(text: bytes, max_chunks: int) -> tuple[bytes, list[int]]:
    """(chunk bytes of SPAN each, valid windows of each), evenly spread over the text."""
    starts = chunk_starts(len(text))
    if len(starts) > max_chunks:
        starts = starts[np.linspace(0, len(starts) - 1, max_chunks).astype(int)]
    parts = [text[s : s + SPAN].ljust(SPAN, b"\0") for s in starts.tolist()]
    return b"".join(parts), [min(WINDOWS, -(-(len(text) - s) // STRIDE)) for s in starts.tolist()]


def pieces(text: bytes):
    """(piece, chunks): the text, or where it is long, pieces that together have its chunks.

    Lags do not reach from a piece into the one before.
    """
    starts = len(chunk_starts(len(text)))
    step = PIECE // HOP
    for first in range(0, starts, step):
        n = min(step, starts - first)
        yield text[first * HOP : (first + n + 1) * HOP + WIDTH - STRIDE], n


def repeats(data: np.ndarray) -> np.ndarray:
    """For every stretch of HOP bytes and every lag: bytes that equal the byte a lag before, 0 never."""
    there = data != 0
    out = np.empty((len(data) // HOP, len(LAGS)), np.float32)
    for k, lag in enumerate(LAGS):
        same = np.zeros(len(data), bool)
        np.equal(data[lag:], data[:-lag], out=same[lag:])
        same &= there
        out[:, k] = np.bitwise_count(np.packbits(same).view(np.uint64)).reshape(-1, HOP // 64).sum(1)
    return out


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        wide = WIDTH * EMBED
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)),
            "filters": rng.normal(0, wide**-0.5, (wide, FILTERS)),
            "filter_bias": np.zeros(FILTERS),
            "mix": rng.normal(0, 2 * FILTERS**-0.5, (FILTERS + 1, FEATURES)),
            "mix_bias": np.zeros(FEATURES),
            "out": rng.normal(0, FEATURES**-0.5, FEATURES),
            "out_bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Rectified filter outputs at every step of a run of bytes; the last step has none."""
        cut = STRIDE * EMBED
        halves = self.p["embed"][data].reshape(-1, cut)
        pre = halves @ self.p["filters"][:cut]
        pre[:-1] += halves[1:] @ self.p["filters"][cut:]
        pre += self.p["filter_bias"]
        return np.maximum(pre, 0, out=pre)

    def features(self, averages: np.ndarray) -> np.ndarray:
        return np.maximum(averages @ self.p["mix"] + self.p["mix_bias"], 0)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled @ self.p["out"] + self.p["out_bias"][0], -60, 60)))

    def score_all(self, texts: list[bytes]) -> list[float]:
        """Probability of class 1 of each text, from all its chunks."""
        pooled = np.zeros((len(texts), FEATURES), np.float32)
        parts: list[tuple[int, bytes, int]] = []
        held = 0
        for owner, text in enumerate(texts):
            for part, n in pieces(text):
                parts.append((owner, part, n))
                held += len(part)
                if held >= PIECE:
                    self.pool(parts, pooled)
                    parts, held = [], 0
        if parts:
            self.pool(parts, pooled)
        return self.probability(pooled).astype(float).tolist()

    def pool(self, parts: list[tuple[int, bytes, int]], pooled: np.ndarray) -> None:
        """Raise the maxima of the owners of some pieces, laid out in one run with zeros between them."""
        chunks = np.array([n for _, _, n in parts])
        slots = chunks + 2
        row = np.frombuffer(b"".join(part.ljust((n + 2) * HOP, b"\0") for _, part, n in parts), np.uint8)
        sizes = np.array([len(part) for _, part, _ in parts])
        begins = np.r_[0, np.cumsum(slots)[:-1]]
        steps = HOP // STRIDE
        seen = self.windows(row)
        inside = np.arange(len(seen)) - np.repeat(begins * steps, slots * steps)
        seen[inside >= np.repeat(-(-sizes // STRIDE), slots * steps)] = 0
        stretch = np.concatenate([seen.reshape(-1, steps, FILTERS).sum(1), repeats(row)], 1)
        # Chunk k of a piece is its stretches k and k + 1.
        number = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        at = np.repeat(begins, chunks) + number
        both = stretch[at] + stretch[at + 1]
        left = np.repeat(sizes, chunks) - number * HOP
        averages = both[:, :FILTERS] / np.clip(-(-left // STRIDE), 1, WINDOWS)[:, None]
        again = REPEAT_SCALE * both[:, FILTERS:].max(1) / np.clip(left, 1, CHUNK)
        made = self.features(np.concatenate([averages, again[:, None]], 1, dtype=np.float32))
        np.maximum.at(pooled, np.repeat([owner for owner, _, _ in parts], chunks), made)

    def gradients(self, data, valid, owner, docs: int, labels, weights) -> dict[str, np.ndarray]:
        """Of the weighted log loss of ``docs`` texts; chunk k belongs to text ``owner[k]`` (ascending)."""
        p = self.p
        flat_windows = self.windows(data.reshape(-1)).reshape(len(data), -1, FILTERS)
        seen = flat_windows[:, :WINDOWS] * (np.arange(WINDOWS)[None] < valid[:, None])[:, :, None]
        sizes = np.maximum((data[:, :CHUNK] != 0).sum(1), 1)
        # Lags reach back into the chunk alone: chunks are laid out with zeros between them.
        apart = np.zeros((len(data), CHUNK + HOP), np.uint8)
        apart[:, :CHUNK] = data[:, :CHUNK]
        again = repeats(apart.reshape(-1)).reshape(len(data), -1, len(LAGS)).sum(1).max(1)
        again *= REPEAT_SCALE / sizes
        averages = np.concatenate([seen.sum(1) / valid[:, None], again[:, None]], 1, dtype=np.float32)
        made = self.features(averages)
        pooled = np.zeros((docs, FEATURES), made.dtype)
        np.maximum.at(pooled, owner, made)
        wrong = (self.probability(pooled) - labels) * weights
        d_pooled = wrong[:, None] * p["out"][None]
        # The maximum passes its gradient to the first chunk that attains it.
        top = (made == pooled[owner]) & (made > 0)
        order = np.arange(len(owner))[:, None]
        first = np.full((docs, FEATURES), len(owner))
        np.minimum.at(first, owner, np.where(top, order, len(owner)))
        d_made = np.where(first[owner] == order, d_pooled[owner], 0).astype(np.float32)
        d_averages = (d_made @ p["mix"].T)[:, :FILTERS]
        d_seen = np.where(seen > 0, (d_averages / valid[:, None])[:, None, :], 0).astype(np.float32)
        halves = p["embed"][data].reshape(len(data), -1, STRIDE * EMBED)
        cut = STRIDE * EMBED
        flat = d_seen.reshape(-1, FILTERS)
        d_filters = np.concatenate(
            [halves[:, :-1].reshape(-1, cut).T @ flat, halves[:, 1:].reshape(-1, cut).T @ flat]
        )
        d_halves = np.zeros_like(halves)
        d_halves[:, :-1] = d_seen @ p["filters"][:cut].T
        d_halves[:, 1:] += d_seen @ p["filters"][cut:].T
        d_bytes = d_halves.reshape(-1, EMBED)
        codes = data.reshape(-1)
        d_embed = np.stack([np.bincount(codes, d_bytes[:, k], 256) for k in range(EMBED)], 1)
        return {
            "embed": d_embed,
            "filters": d_filters,
            "filter_bias": flat.sum(0),
            "mix": averages.T @ d_made,
            "mix_bias": d_made.sum(0),
            "out": pooled.T @ wrong,
            "out_bias": np.array([wrong.sum()]),
        }

    def fit(self, texts: list[tuple[bytes, list[int]]], labels: np.ndarray, epochs: int, seed: int = 0) -> Network:
        """Adam over small batches of texts given as sampled chunks."""
        rng = np.random.default_rng(seed)
        share = labels.mean()
        weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, batch = 0, 32
        epochs = max(epochs, min(60, 400 * batch // len(texts)))
        total = epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(texts), batch):
                chosen = order[at : at + batch]
                data = np.frombuffer(b"".join(texts[i][0] for i in chosen), np.uint8).reshape(-1, SPAN)
                valid = np.array([v for i in chosen for v in texts[i][1]], np.float32)
                owner = np.repeat(np.arange(len(chosen)), [len(texts[i][1]) for i in chosen])
                if not len(data):
                    continue
                slope = self.gradients(data, valid, owner, len(chosen), labels[chosen], weights[chosen])
                step += 1
                rate = 0.01 * (1 - 0.9 * step / total)
                for k, g in slope.items():
                    g = (g / len(chosen)).astype(np.float32)
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    hat = square[k] / (1 - 0.999**step)
                    self.p[k] -= (rate * mean[k] / (1 - 0.9**step) / (np.sqrt(hat) + 1e-8)).astype(np.float32)
        return self


class Constant:
    """The model where one class has no examples."""

    def __init__(self, share: float):
        self.share = share

    def score_all(self, texts: list[bytes]) -> list[float]:
        return [self.share] * len(texts)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    key: str = "doc_id",
    text: str = "text",
    per_class: int = 1500,
    max_chunks: int = 24,
    epochs: int = 10,
):
    """A fitted model from a bounded sample of labelled rows of the learning folds."""
    picked = sample_ids(labels, label, per_class)
    schema = pa.schema(
        [("id", pa.int64()), ("label", pa.int32()), ("chunks", pa.binary()), ("valid", pa.list_(pa.int32()))]
    )

    def cut(batches):
        for batch in batches:
            ids, targets = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            parts = [sampled_chunks(body, max_chunks) for _, body in rows_of(batch)]
            yield as_batch(schema, id=ids, label=targets, chunks=[p[0] for p in parts], valid=[p[1] for p in parts])

    # At most 2 * per_class ids, so the broadcast has a bound.
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    sample = (
        rows.join(F.broadcast(picked), "id")
        .select("id", "text", "label")
        .mapInArrow(cut, "id bigint, label int, chunks binary, valid array<int>")
        .collect()
    )
    sample.sort(key=lambda r: (r["id"], r["chunks"]))
    targets = np.array([r["label"] for r in sample], np.float32)
    if not len(targets) or targets.min() == targets.max():
        return Constant((float(targets.sum()) + 1) / (len(targets) + 2))
    return Network().fit([(bytes(r["chunks"]), r["valid"]) for r in sample], targets, epochs)


def score_quality(docs: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net = known.value
        for batch in batches:
            yield as_batch(schema, id=batch.column(0), score=net.score_all(byte_values(batch.column(1))))

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id bigint, score double")


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted."""
    scored = score_quality(docs, fit_quality(docs, labels, key=key, text=text, **options), key, text)
    return scored.select(
        "id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    key: str = "doc_id",
    text: str = "text",
    learn_from: DataFrame | None = None,
    **options,
) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; scored where they lie.

    The labels are those of ``learn_from``, by default of ``docs``.
    """
    own = docs if learn_from is None else learn_from
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(own, labels, key=key, text=text, **options))
    at = docs.columns.index(text)

    def run(batches):
        net = model.value
        for batch in batches:
            scores = np.array(net.score_all(byte_values(batch.column(at))))
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
