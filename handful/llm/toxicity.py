"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, with evidence.

Terms are words and word beginnings. From a bounded sample of labelled rows, the terms whose presence
depends on the label form the vocabulary, chosen by distributed counts; document frequencies are counted over all documents. The examples'
TF-IDF vectors over the vocabulary form an inverted index: postings by term, cut into blocks of
examples, with the largest weight of each term in each block. A text's terms give an upper bound
for every block; blocks are scored in falling order of their bounds until none can beat the k-th
neighbour found, so the neighbours are exact. Votes weigh by nearness and by what a
sampled example stands for among all labelled rows; the smoothed share of class 1 is the score.

Defined results: a null text is the empty text. A text without a vocabulary term has no neighbours, and its score
is the smoothed share of class 1 among examples without one. Equal cosines prefer the smaller example
id. Without examples of both classes all scores are the smoothed share of class 1. An empty table gives no rows;
extra columns take no part.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from handful.llm.common import as_batch, rows_of
from handful.llm.labelled import class_counts, held_out, sample_ids
from handful.session import cut_lineage

WORD = re.compile(r"[^\W\d_]+")
BEGINS = (4, 5, 6, 7, 8)
BLOCK = 64
# Blocks scored at a time.
STEP = 4


def words_of(text: bytes) -> list[str]:
    return WORD.findall(text.decode("utf-8", "replace").lower())


def begins_of(words: set[str], sizes: tuple[int, ...] = BEGINS) -> dict[str, list[str]]:
    """Words by their beginnings; a bar keeps a beginning apart from the whole word."""
    out: dict[str, list[str]] = {}
    for size in sizes:
        for word in words:
            if len(word) > size:
                out.setdefault(word[:size] + "|", []).append(word)
    return out


def terms_of(text: bytes) -> set[str]:
    words = set(words_of(text))
    return words | begins_of(words).keys()


class Vocabulary:
    """Numbered terms, and the occurrences of each in a text."""

    def __init__(self, terms: list[str]):
        self.words = {t: i for i, t in enumerate(terms) if not t.endswith("|")}
        begins = [(t[:-1], i) for i, t in enumerate(terms) if t.endswith("|")]
        self.begins = [
            (size, {t: i for t, i in begins if len(t) == size}) for size in sorted({len(t) for t, _ in begins})
        ]

    def present(self, text: bytes) -> set[int]:
        """The terms that occur in a text."""
        words = set(words_of(text))
        found = {self.words[w] for w in words & self.words.keys()}
        for size, begins in self.begins:
            found |= {begins[w[:size]] for w in words if w[:size] in begins and len(w) > size}
        return found

    def counts(self, text: bytes) -> dict[int, int]:
        words = words_of(text)
        distinct = set(words)
        found = [(w, self.words[w]) for w in distinct & self.words.keys()]
        for size, begins in self.begins:
            found += [(w, begins[w[:size]]) for w in distinct if w[:size] in begins and len(w) > size]
        if not found:
            return {}
        wanted = {w for w, _ in found}
        times = Counter(w for w in words if w in wanted)
        out: dict[int, int] = {}
        for word, term in found:
            out[term] = out.get(term, 0) + times[word]
        return out


class Index:
    """Inverted index of the examples: strips of weights by term and block, and their maxima.

    Examples are ordered by their heaviest term, so that a block's maxima stand for similar examples. ``frequency``
    holds the number of documents and that of each term; without it, the examples are counted.
    """

    def __init__(self, terms, counts, ids, labels, stands, k: int, smoothing: float, frequency=None):
        self.vocabulary = Vocabulary(terms)
        self.k, self.smoothing = k, smoothing
        n = len(ids)
        total, seen = frequency or (n, np.zeros(len(terms)))
        if not frequency:
            for c in counts:
                seen[list(c)] += 1
        self.idf = np.log((1 + total) / (1 + seen)) + 1
        vectors = [self.vector(c) for c in counts]
        heaviest = [int(numbers[np.argmax(w)]) if len(numbers) else -1 for numbers, w in vectors]
        order = np.lexsort((ids, labels, heaviest))
        self.ids, self.labels, self.stands = ids[order], labels[order], stands[order]
        self.blocks = max(1, -(-n // BLOCK))
        # Strip 0 is that of a term a block does not have.
        self.strip_of = np.zeros((len(terms), self.blocks), np.int32)
        strips = [np.zeros(BLOCK)]
        for row, k_th in enumerate(order.tolist()):
            for t, w in zip(*(x.tolist() for x in vectors[k_th])):
                if not self.strip_of[t, row // BLOCK]:
                    self.strip_of[t, row // BLOCK] = len(strips)
                    strips.append(np.zeros(BLOCK))
                strips[self.strip_of[t, row // BLOCK]][row % BLOCK] = w
        self.strips = np.array(strips)
        self.most = self.strips.max(1)[self.strip_of]
        bare = np.array([not counts[i] for i in order.tolist()], bool)
        self.prior = float((self.stands * self.labels).sum() / self.stands.sum())
        self.bare = self.share(self.stands[bare], self.labels[bare])

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit-length TF-IDF weights."""
        numbers = np.array(sorted(counts), np.int64)
        weights = (1 + np.log([counts[t] for t in numbers.tolist()])) * self.idf[numbers] if len(numbers) else np.zeros(0)
        return numbers, weights / (np.sqrt((weights**2).sum()) or 1.0)

    def share(self, votes: np.ndarray, labels: np.ndarray) -> float:
        smooth = self.smoothing * (self.stands.mean() if len(self.stands) else 1.0)
        return float(((votes * labels).sum() + smooth * self.prior) / (votes.sum() + smooth))

    def nearest(self, counts: dict[int, int]) -> list[tuple[float, int]]:
        """The k (cosine, row) with the largest cosines over 0, ties to smaller ids."""
        numbers, weights = self.vector(counts)
        if not len(numbers):
            return []
        bounds = weights @ self.most[numbers]
        order = np.argsort(-bounds, kind="stable")
        # Bounds and cosines are summed in different orders, hence the margin.
        order = order[bounds[order] > 1e-9]
        best, rows = np.zeros(0), np.zeros(0, np.int64)
        for at in range(0, len(order), STEP):
            blocks = order[at : at + STEP]
            if len(best) == self.k and bounds[blocks[0]] < best[-1] - 1e-9:
                break
            strips = self.strips[self.strip_of[numbers[:, None], blocks[None]]]
            scores = np.round(np.einsum("t,tbj->bj", weights, strips), 12).reshape(-1)
            where = (blocks[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
            found = np.flatnonzero(scores > (best[-1] - 1e-12 if len(best) == self.k else 0))
            best, rows = np.r_[best, scores[found]], np.r_[rows, where[found]]
            first = np.lexsort((self.ids[rows], -best))[: self.k]
            best, rows = best[first], rows[first]
        return list(zip(best.tolist(), rows.tolist()))

    def score(self, counts: dict[int, int]) -> tuple[float, list[int], list[float]]:
        """(score, ids of the neighbours, their cosines)."""
        found = self.nearest(counts)
        if not found:
            return self.bare, [], []
        near = np.array([s for s, _ in found])
        rows = np.array([r for _, r in found])
        votes = self.stands[rows] / (1.01 - np.minimum(near, 1.0))
        return self.share(votes, self.labels[rows]), self.ids[rows].tolist(), near.tolist()


def document_frequencies(rows: DataFrame, vocabulary: Vocabulary, terms: int) -> tuple[int, np.ndarray]:
    """(number of documents, documents with each term) of all rows (id, text)."""
    shape = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def run(batches):
        # The last place counts documents.
        seen = np.zeros(terms + 1, np.int64)
        for batch in batches:
            for _, body in rows_of(batch):
                seen[list(vocabulary.present(body))] += 1
            seen[terms] += batch.num_rows
        found = np.flatnonzero(seen)
        yield as_batch(shape, term=found, n=seen[found])

    seen = np.zeros(terms + 1)
    for term, n in rows.mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n")).collect():
        seen[term] = n
    return int(seen[terms]), seen[:terms]


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    key: str = "doc_id",
    text: str = "text",
    per_class: int = 2000,
    max_terms: int = 2000,
    least_association: float = 30.0,
    least_log_odds: float = 1.5,
    k: int = 15,
    smoothing: float = 1.0,
) -> Index | float:
    """The index of a bounded sample (``per_class`` rows of each class, ``max_terms`` terms), or a constant score."""
    picked = sample_ids(labels, label, per_class)
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    sample = cut_lineage(rows.join(F.broadcast(picked), "id").select("id", "text", "label"), "toxic-sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    all0, all1 = class_counts(labels, label, key)
    if not n0 or not n1:
        return (all1 + smoothing) / (all0 + all1 + 2 * smoothing)
    shape = pa.schema([("label", pa.int32()), ("term", pa.string())])

    def spread(batches):
        for batch in batches:
            targets = batch.column(2).to_pylist()
            found = [(y, t) for (_, body), y in zip(rows_of(batch), targets) for t in terms_of(body)]
            yield as_batch(shape, label=[y for y, _ in found], term=[t for _, t in found])

    # Copies of a text are one witness.
    counted = sample.dropDuplicates(["text"]).mapInArrow(spread, "label int, term string").groupBy("term").agg(
        F.sum(1 - F.col("label")).alias("a0"), F.sum("label").alias("a1")
    )
    a0, a1 = F.col("a0"), F.col("a1")
    odds = F.log((a1 + 0.5) * (n0 - a0 + 0.5) / ((a0 + 0.5) * (n1 - a1 + 0.5)))
    chi = (n0 + n1) * F.pow(a1 * (n0 - a0) - a0 * (n1 - a1), 2) / ((a0 + a1) * (n0 + n1 - a0 - a1 + 1e-9) * n0 * n1)
    chosen = (
        counted.withColumn("chi", chi)
        .where((F.col("chi") >= least_association) & (F.abs(odds) >= least_log_odds))
        .orderBy(F.desc("chi"), "term")
        .limit(max_terms)
        .select("term")
        .collect()
    )
    terms = sorted(r["term"] for r in chosen)
    vocabulary = Vocabulary(terms)
    kept = pa.schema(
        [("id", pa.int64()), ("label", pa.int32()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
    )

    def count(batches):
        for batch in batches:
            found = [vocabulary.counts(body) for _, body in rows_of(batch)]
            yield as_batch(
                kept,
                id=batch.column(0),
                label=batch.column(2),
                terms=[list(c) for c in found],
                counts=[list(c.values()) for c in found],
            )

    frequency = document_frequencies(rows, vocabulary, len(terms))
    rows = sample.mapInArrow(count, "id bigint, label int, terms array<int>, counts array<int>").collect()
    rows.sort()
    targets = np.array([r["label"] for r in rows], float)
    stands = np.where(targets == 1, all1 / n1, all0 / n0)
    return Index(
        terms,
        [dict(zip(r["terms"], r["counts"])) for r in rows],
        np.array([r["id"] for r in rows]),
        targets,
        stands,
        k,
        smoothing,
        frequency,
    )


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted, neighbours, cosines (the evidence)."""
    index = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, key=key, text=text, **options))
    schema = pa.schema(
        [
            ("id", pa.int64()),
            ("score", pa.float64()),
            ("neighbours", pa.list_(pa.int64())),
            ("cosines", pa.list_(pa.float64())),
        ]
    )

    def run(batches):
        own = index.value
        for batch in batches:
            ids, found = [], []
            for doc_id, body in rows_of(batch):
                ids.append(doc_id)
                fixed = isinstance(own, float)
                found.append((own, [], []) if fixed else own.score(own.vocabulary.counts(body)))
            yield as_batch(
                schema, id=ids, score=[f[0] for f in found], neighbours=[f[1] for f in found], cosines=[f[2] for f in found]
            )

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    scored = rows.mapInArrow(run, "id bigint, score double, neighbours array<bigint>, cosines array<double>")
    return scored.select(
        "id",
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "neighbours",
        "cosines",
    )
