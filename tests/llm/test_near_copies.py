"""Near copies against all pairs, and the share of similar pairs that is found."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from handful.llm import near_copies as N
from tests.llm import cases


def brute_shingles(text, words=5):
    own = (text or "").encode().translate(N.LOWER).split()
    size = min(words, len(own))
    return {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()


def similar(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def brute_groups(texts, similarity=0.8):
    """The number of each text's group."""
    sets, group = [brute_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and similar(sets[i], sets[j]) >= similarity:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def altered(rng, text, changes):
    words = text.split()
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"other{rng.randrange(10**6)}"
    return " ".join(words)


def test_shingles_are_those_of_the_words():
    for text in ["", " \t", "One", "a b c d", "a b c d e", "A b  c\nd e F a b c d e"]:
        found = N.shingles(text.encode(), 5)
        assert len(set(found.tolist())) == len(brute_shingles(text))
    assert (N.shingles(b"A b c", 5) == N.shingles(b"a  B\tc", 5)).all()
    assert N.shingles(b"a b c d e f", 5)[1] == N.shingles(b"b c d e f", 5)[0]


def test_one_row_of_each_group_stays(spark, monkeypatch):
    monkeypatch.setattr(N, "SLICE_ROWS", 3)
    rng = random.Random(4)
    rows = cases.documents()
    base = [cases.prose(rng, 150) for _ in range(5)]
    rows += [(1000 + i, altered(rng, base[i % 5], rng.randrange(0, 4)), "en", "s", 1) for i in range(60)]
    got = N.keep_one_near(cases.table(spark, rows, extra=True))
    assert got.columns == cases.table(spark, rows, extra=True).columns
    group = brute_groups([r[1] for r in rows])
    want = {}
    for r, g in zip(rows, group):
        name = (r[0] is None, r[0] or 0)
        want[g] = min(want.get(g, name), name)
    kept = [(r[0] is None, r[0] or 0) for r in got.select("doc_id").collect()]
    # The first of every group stays; a group may come apart where no first text of a bucket meets both sides.
    assert len(set(kept)) == len(kept) and set(want.values()) <= set(kept)
    assert len(kept) <= len(want) + 2 and len(want) < len(rows) - 50


def test_a_bucket_of_unlike_texts_is_worked_off(spark, monkeypatch):
    """All texts share their bands; only those that are alike are linked, in few rounds and without all pairs."""
    plain = N.signature
    monkeypatch.setattr(N, "PLAIN_ROUNDS", 1)
    monkeypatch.setattr(N, "signatures", lambda rows, text, words: shared(rows, text, words, plain))
    rng = random.Random(6)
    base = [cases.prose(rng, 60) for _ in range(12)]
    rows = [(i, base[i % 12] + (" end" if i >= 12 else ""), "en", "s", 1) for i in range(24)]
    docs = cases.table(spark, rows).withColumn(N.NODE, F.col("doc_id"))
    links = N.near_links(docs, "text", 5, 0.8).distinct().collect()
    assert sorted((r["a"], r["b"]) for r in links) == [(i, i + 12) for i in range(12)]


def test_a_bucket_of_many_unlike_texts_takes_few_rounds(spark, monkeypatch):
    """With one first text a round, 24 unlike texts of one bucket took 23 rounds; the links are still all found."""
    plain, compared, rounds = N.signature, N.compared, []
    monkeypatch.setattr(N, "PLAIN_ROUNDS", 99)
    monkeypatch.setattr(N, "signatures", lambda rows, text, words: shared(rows, text, words, plain))
    monkeypatch.setattr(N, "compared", lambda pairs, *more: rounds.append(pairs.count()) or compared(pairs, *more))
    rng = random.Random(7)
    base = [cases.prose(rng, 60) for _ in range(24)]
    rows = [(i, base[i % 24] + (" end" if i >= 24 else ""), "en", "s", 1) for i in range(26)]
    docs = cases.table(spark, rows).withColumn(N.NODE, F.col("doc_id"))
    links = N.near_links(docs, "text", 5, 0.8).distinct().collect()
    assert sorted((r["a"], r["b"]) for r in links) == [(0, 24), (1, 25)]
    assert len(rounds) <= 7 and sum(rounds) <= 26 * 25 / 2


def shared(rows, text, words, plain):
    found = [(r[N.NODE], plain(N.shingles(r[text].encode(), words))) for r in rows.collect()]
    table = [(n, 0, [7] * N.BANDS, N.signed(f[2]).tolist()) for n, f in found]
    return rows.sparkSession.createDataFrame(table, "node bigint, print bigint, keys array<bigint>, further array<bigint>")


def test_close_simhashes_are_candidates_without_a_common_band(spark, monkeypatch):
    """No two texts share a band; those of close SimHashes are met all the same, and unlike ones are not linked."""
    rng = random.Random(8)
    base, prints = [cases.prose(rng, 60) for _ in range(12)], [rng.getrandbits(62) for _ in range(12)]
    rows = [(i, base[i % 12] + (" end" if i >= 12 else ""), "en", "s", 1) for i in range(24)] + [(24, cases.prose(rng, 60), "en", "s", 1)]
    marks = [(i, prints[i % 12] ^ (7 if i >= 12 else 0), [i * N.BANDS + b for b in range(N.BANDS)], [i] * N.FURTHER) for i in range(25)]
    ddl = "node bigint, print bigint, keys array<bigint>, further array<bigint>"
    monkeypatch.setattr(N, "signatures", lambda rows, text, words: rows.sparkSession.createDataFrame(marks, ddl))
    docs = cases.table(spark, rows).withColumn(N.NODE, F.col("doc_id"))
    links = N.near_links(docs, "text", 5, 0.8).distinct().collect()
    assert sorted((r["a"], r["b"]) for r in links) == [(i, i + 12) for i in range(12)]


@pytest.mark.parametrize("level", [0.8, 0.9, 0.95])
def test_most_similar_pairs_become_candidates(level):
    rng, far, met, n = random.Random(int(level * 100)), 0, 0, 150
    for _ in range(n):
        text = cases.prose(rng, 400)
        other, changes = text, 0
        while similar(brute_shingles(text), brute_shingles(other)) > level + 0.01:
            changes += 1
            other = altered(random.Random(changes), text, changes)
        (p, a, _), (q, b, _) = (N.signature(N.shingles(t.encode(), 5)) for t in (text, other))
        far += (p ^ q).bit_count() > N.FAR
        met += any(x == y for x, y in zip(a, b))
    assert far == 0 and met / n > 0.97


def test_empty_tables(spark):
    assert N.keep_one_near(cases.table(spark, [])).collect() == []
    alone = N.keep_one_near(cases.table(spark, [(None, None, None, None, None), (None, " ", None, None, None)]))
    assert alone.count() == 1


def test_signatures_of_no_words_agree():
    assert N.signature(np.zeros(0, np.uint64)) == N.signature(N.shingles(b" \n", 5))


@pytest.mark.parametrize("growths", [7, 9, 30])
def test_buckets_take_any_room(spark, growths):
    """Room grows eight-fold a round; after nine rounds a bucket's share of it was beyond an int, which ended the job."""
    members = spark.createDataFrame([(n, n, False, 0, 7) for n in range(2)], "node bigint, print bigint, settled boolean, band int, key bigint")
    found = N.buckets_of(members, N.SLOTS, N.ROOM * N.GROWTH**growths).collect()
    assert [(r["band"], r["key"]) for r in found] == [(0, 7)] and 1 <= len(found[0]["firsts"]) <= 2
