"""Collocations against brute force, and the summaries' guarantee."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from handful.llm import collocations as C
from tests.llm import cases


def brute(rows, min_count, share, top):
    counts: dict = {}
    totals: Counter = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            own = counts.setdefault(lang, Counter())
            own.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        scored = []
        for phrase, a in own.items():
            if len(phrase) < 2 or a < min_count:
                continue
            if any(
                100 * f >= share * a and f >= min_count
                for longer, f in own.items()
                if len(longer) > len(phrase)
                and any(longer[i : i + len(phrase)] == phrase for i in range(len(longer) - len(phrase) + 1))
            ):
                continue
            score, cut = min((2000000 * a // (own[phrase[:k]] + own[phrase[k:]]), k) for k in range(1, len(phrase)))
            scored.append((-score, -a, " ".join(phrase).encode(), own[phrase[:cut]], own[phrase[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def prose():
    rng = random.Random(9)
    words = "New York of the a city big apple pie York's É-x ß in".split()
    texts = []
    for i in range(120):
        out = []
        for _ in range(rng.randrange(0, 90)):
            out.append(rng.choice(words) if rng.random() < 0.6 else rng.choice(["new york city", "apple pie in the", "big\tapple"]))
            out.append(rng.choice([" ", "  ", "\t", " ", ". ", "\n", "!?", ";\r\x0b"]))
        texts.append(("".join(out), rng.choice(["en", "en", "fr", None, ""])))
    return texts + [("the city " * 300, "en"), (None, "de"), ("", None), (" \t\n.", "en"), ("x" * 5000, "fr")] + texts[:5] * 3


def frame(spark, texts):
    return cases.table(spark, [(i, t, lang, "s", 1) for i, (t, lang) in enumerate(texts)], extra=True)


@pytest.mark.parametrize(("chunk", "mass"), [(1 << 20, 1 << 24), (300, 2000)])
def test_rows_equal_brute_force(spark, chunk, mass):
    texts = prose()
    got = C.collocations(frame(spark, texts), min_count=12, share=80, top=40, chunk_bytes=chunk, part_mass=mass)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(texts, 12, 80, 40)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len({w[0] for w in want}) == 4 and max(w[1] for w in want) == 40


def test_cases_all_operators_define(spark):
    rows = cases.documents()
    got = C.collocations(cases.table(spark, rows), min_count=2, top=10)
    assert sorted(tuple(r) for r in got.collect()) == brute([(r[1], r[2]) for r in rows], 2, 80, 10)
    assert C.collocations(cases.table(spark, [])).collect() == []


@pytest.mark.parametrize("limit", [1, 7, 30, 200])
def test_cut_texts_keep_every_ngram(limit):
    rng = random.Random(limit)
    for _ in range(60):
        body = bytes(rng.choice(b"ab \t\n") for _ in range(rng.randrange(120)))
        want: Counter = Counter()
        for piece in body.split(b"\n"):
            words = piece.split()
            want.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
        got: Counter = Counter()
        for part, ahead in C.cut_body(body, limit):
            grams = C.Grams("en", part, ahead, 64)
            for _, phrases, counts in grams.named(np.unique(np.concatenate(grams.hashes))):
                for phrase, n in zip(phrases.to_pylist(), counts.tolist()):
                    got[tuple(phrase.encode().split(b" "))] += n
        assert got == want


def test_summaries_lose_no_frequent_key_and_bound_their_error():
    rng = np.random.default_rng(3)
    keys = np.r_[rng.integers(0, 1 << 40, 30_000).astype(np.uint64), np.repeat(rng.integers(0, 1 << 40, 50).astype(np.uint64), 40)]
    rng.shuffle(keys)
    threshold, blocks = 30, np.array_split(keys, 37)
    summary, halves = C.Summary(len(keys) // threshold + 1), [C.Summary(len(keys) // threshold + 1) for _ in range(2)]
    for i, block in enumerate(blocks):
        own, counts = np.unique(block, return_counts=True)
        for one in (summary, halves[i % 2]):
            one.add(own, counts.astype(np.int64))
            one.settle()
    halves[0].merge(halves[1])
    true = dict(zip(*(x.tolist() for x in np.unique(keys, return_counts=True))))
    for one in (summary, halves[0]):
        found = set(one.frequent(threshold).tolist())
        assert {k for k, n in true.items() if n >= threshold} <= found
        assert 0 < one.taken < threshold and len(one.keys) <= one.capacity
        assert all(n <= true[k] <= n + one.taken for k, n in zip(one.keys.tolist(), one.counts.tolist()))
    small = C.Summary(3)
    small.add(np.arange(100, dtype=np.uint64), np.full(100, 40))
    with pytest.raises(ValueError):
        small.frequent(30)


def test_packed_counts_come_back():
    rng = np.random.default_rng(5)
    for high in (1 << 20, 1 << 63):
        keys = np.unique(rng.integers(10, high, 500).astype(np.uint64))
        counts = rng.choice([1, 2, 254, 255, 256, 10**12], len(keys))
        blob = C.pack_counts(keys, counts, 10)
        assert (C.unpack_keys(blob, 10) == keys).all() and (C.unpack_counts(blob) == counts).all()
        assert C.mass_of(blob) == counts.sum()
    empty = C.pack_counts(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0)
    assert len(C.unpack_keys(empty, 0)) == len(C.unpack_counts(empty)) == 0


def test_hashes_that_meet_do_not_mix_counts():
    own = C.Grams("en", b"a b c d e f g h i j k l m n o p q r s t a b", 0, 3)
    keys, counts = own.keys()
    assert len(keys) <= 8 and counts.sum() == 22 + 21 + 20 + 19
    found = {p: n for _, phrases, ns in own.named(keys) for p, n in zip(phrases.to_pylist(), ns.tolist())}
    assert found["a b"] == 2 and found["a b c"] == 1 and len(found) == 20 + 20 + 20 + 19


def test_packed_hashes_take_two_bits_more_than_their_spread():
    """Before, every hash had whole bytes: three where these need 14 bits."""
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(0, 1 << 31, 450_000).astype(np.uint64))
    ones = np.ones(len(keys), np.int64)
    blob = C.pack_counts(keys, ones, 0)
    assert (len(blob) - len(keys)) * 8 / len(keys) < np.log2((1 << 31) / len(keys)) + 2.1
    assert (C.unpack_keys(blob, 0) == keys).all() and (C.unpack_counts(blob) == 1).all()
    for own in ([5], [0, (1 << 63) - 1], list(range(300))):
        back = C.unpack_keys(C.pack_counts(np.array(own, np.uint64), np.ones(len(own), np.int64), 0), 0)
        assert back.tolist() == own
