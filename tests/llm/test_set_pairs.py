"""Pairs by prefixes against all pairs, and the near-copy stage where its rounds find nothing."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from handful.llm import near_copies as N, set_pairs as S
from tests.llm import cases
from tests.llm.test_near_copies import altered, brute_groups, brute_shingles, similar


def corpus(rng):
    """Groups at the edge of the similarity, a passage that many texts share, short texts and copies."""
    passage = cases.prose(rng, 30)
    base = [cases.prose(rng, n) for n in (20, 40, 60, 150, 300)]
    texts = [altered(rng, b, rng.randrange(0, 1 + len(b.split()) // 35)) for b in base for _ in range(30)]
    texts += [passage + " " + cases.prose(rng, rng.randrange(1, 12)) for _ in range(60)]
    texts += [cases.prose(rng, n) for n in range(7)] + ["", None, "a b c d e", "a b c d e f", "A b c d e f g"] + texts[:3]
    return texts


@pytest.mark.parametrize("short,block,part", [(64, 2048, 1 << 19), (3, 16, 256)])
def test_no_similar_pair_is_missing(spark, monkeypatch, short, block, part):
    for name, value in (("SHORT_RUN", short), ("BLOCK_ROWS", block), ("PART_POSTINGS", part)):
        monkeypatch.setattr(S, name, value)
    texts = corpus(random.Random(3))
    rows = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string").repartition(4)
    none = spark.createDataFrame([], "node bigint, root bigint")
    found = S.unmet(rows, "node", "text", lambda b: N.shingles(b, 5), 0.8, none).collect()
    got = {(r["a"], r["b"]) for r in found}
    sets = [brute_shingles(t) for t in texts]
    alike = {(i, j) for j in range(len(texts)) for i in range(j) if sets[i] and similar(sets[i], sets[j]) >= 0.8}
    assert len(got) == len(found) and alike <= got and len(alike) > 1000
    assert len(got) < len(texts) * (len(texts) - 1) / 4


def test_pairs_of_one_group_are_not_named_again(spark):
    texts = corpus(random.Random(3))
    rows = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    group = brute_groups(texts)
    groups = spark.createDataFrame([(i, g) for i, g in enumerate(group)], "node bigint, root bigint")
    found = S.unmet(rows, "node", "text", lambda b: N.shingles(b, 5), 0.8, groups).collect()
    assert all(group[r["a"]] != group[r["b"]] for r in found)


def test_groups_are_whole_without_a_common_band(spark, monkeypatch):
    """No two texts share a band or a close SimHash; every group is found all the same."""
    texts = corpus(random.Random(5))

    def apart(rows, text, words):
        marks = rows.select(F.col(N.NODE).alias("node")).collect()
        rng = random.Random(1)
        table = [(r["node"], rng.getrandbits(62), [r["node"] * N.BANDS + b for b in range(N.BANDS)], [k] * N.FURTHER) for k, r in enumerate(marks)]
        return rows.sparkSession.createDataFrame(table, "node bigint, print bigint, keys array<bigint>, further array<bigint>")

    monkeypatch.setattr(N, "signatures", apart)
    texts = [t for t in texts if brute_shingles(t)]
    docs = cases.table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    kept = sorted(r["doc_id"] for r in N.keep_one_near(docs).select("doc_id").collect())
    group = brute_groups(texts)
    assert kept == sorted({group.index(g) for g in group}) and len(kept) < len(texts) / 2


def test_postings_come_back():
    rng = np.random.default_rng(2)
    n = 1000
    own = {"key": rng.integers(0, 1 << 48, n).astype(np.uint64), "node": np.sort(rng.integers(0, 1 << 60, n)), "place": np.arange(n), "size": rng.integers(1, 1 << 30, n)}
    back = S.unpacked(S.packed(own))
    assert all((back[name].astype(np.int64) == own[name].astype(np.int64)).all() for name in own)


def test_sketches_that_pass_a_byte_bound_nothing(spark):
    """A text with more shingles in a class than a byte counts is not dropped by its sketch."""
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10**9)}" for _ in range(90_000))
    rows = spark.createDataFrame([(0, long), (1, long + " end")], "node bigint, text string")
    none = spark.createDataFrame([], "node bigint, root bigint")
    found = S.unmet(rows, "node", "text", lambda b: N.shingles(b, 5), 0.8, none).collect()
    assert [(r["a"], r["b"]) for r in found] == [(0, 1)]


def test_empty_tables(spark):
    rows, none = spark.createDataFrame([], "node bigint, text string"), spark.createDataFrame([], "node bigint, root bigint")
    assert S.unmet(rows, "node", "text", lambda b: N.shingles(b, 5), 0.8, none).collect() == []
