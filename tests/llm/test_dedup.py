"""Exact copies, lines, fingerprints and passages against brute force."""

from __future__ import annotations

import hashlib
import random
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from handful.llm import common, exact_dedup, line_dedup, simhash, suffixes
from tests.llm import cases

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def collected(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


# exact copies


def expected_exact(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[(row[1] or "").translate(LOWER)].append(row[0])
    out, seen = Counter(), set()
    for row in rows:
        body = (row[1] or "").translate(LOWER)
        ids = [i for i in groups[body] if i is not None]
        keep = max(ids) if ids else None
        kept = row[0] == keep and (body, row[0]) not in seen
        seen.add((body, row[0]))
        out[(row[0], keep, len(groups[body]), kept, hashlib.sha256(body.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("extra", [False, True])
def test_exact_groups(spark, extra):
    got = exact_dedup.exact_groups(cases.table(spark, extra=extra), files_per_batch=1)
    assert collected(got, "key", "keep", "n", "kept", "digest") == expected_exact(cases.documents())


def test_exact_state_goes_on_over_batches_and_confs_come_back(spark):
    before = {name: spark.conf.get(name, None) for name in exact_dedup.STATE}
    rows = [(i, "Ab" if i % 2 else f"t{i}", "en", "s", 1) for i in range(40)]
    got = exact_dedup.exact_groups(cases.table(spark, rows).repartition(7), files_per_batch=1)
    assert collected(got, "key", "keep", "n", "kept", "digest") == expected_exact(rows)
    assert {name: spark.conf.get(name, None) for name in exact_dedup.STATE} == before


def test_different_bytes_under_one_digest_are_taken_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(real(c, n), 1, 1))
    rows = [(i, f"text {i % 30}", "en", "s", 1) for i in range(60)]
    got = exact_dedup.exact_groups(cases.table(spark, rows))
    assert collected(got, "key", "keep", "n", "kept") == Counter(
        (i, 30 + i % 30, 2, i >= 30) for i in range(60)
    )


def test_a_second_run_goes_on_from_the_state_of_the_first(spark, tmp_path):
    rows = [(i, "Ab" if i % 2 else f"t{i}", "en", "s", 1) for i in range(40)]
    state = str(tmp_path / "state")
    first = exact_dedup.exact_groups(cases.table(spark, rows[:25]).repartition(3), state=state)
    assert collected(first, "key", "keep", "n", "kept", "digest") == expected_exact(rows[:25])
    second = exact_dedup.exact_groups(cases.table(spark, rows[25:]).repartition(2), state=state)
    assert collected(second, "key", "keep", "n", "kept", "digest") == expected_exact(rows)
    # A third run without new rows reads no arrival again and tells the same.
    third = exact_dedup.exact_groups(cases.table(spark, []), state=state)
    assert collected(third, "key", "keep", "n", "kept", "digest") == expected_exact(rows)


def test_locators_lead_to_the_kept_content(spark, tmp_path):
    from pyspark.sql import functions as F

    state = str(tmp_path / "state")
    found = exact_dedup.exact_groups(cases.table(spark), state=state).where("kept").select("digest", "locator.*")
    stored = spark.read.parquet(f"{state}/arrivals").select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), F.sha2("content", 256).alias("have")
    )
    assert found.join(stored, ["file", "row"]).where("digest = have").count() == found.count() > 10


@pytest.mark.parametrize("bits", [1 << 16, 1 << 28])
def test_texts_without_a_copy_do_not_pass_the_bitmap(spark, bits):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")
    hits = rows.where("id % 50 = 0").select("digest")
    met = {r["id"] for r in common.among(rows, hits, "digest", bits).collect()}
    assert set(range(0, 5000, 50)) <= met and len(met) < 160
    assert common.among(rows, hits.limit(0), "digest", bits).count() == 0


def test_drop_exact_copies_keeps_columns_and_one_row_each(spark):
    rows = cases.documents()
    docs = cases.table(spark, extra=True)
    got = exact_dedup.drop_exact_copies(docs)
    assert got.columns == docs.columns
    stay = Counter((i, d) for (i, _, _, kept, d), n in expected_exact(rows).items() if kept)
    have = Counter((r[0], hashlib.sha256((r[1] or "").translate(LOWER).encode()).hexdigest()) for r in got.collect())
    assert have == stay


# lines


def expected_lines(rows, least=10):
    strip = " \t\n\x0b\x0c\r"
    docs = [(r[0], [(x, x.strip(strip).translate(LOWER)) for x in (r[1] or "").split("\n")]) for r in rows]
    found = Counter(k for _, lines in docs for k in {k for _, k in lines if k})
    out = Counter()
    for i, lines in docs:
        left = [x for x, k in lines if not k or found[k] < least]
        out[(i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("max_bits", [28, line_dedup.SLICE_BITS])
def test_lines_in_ten_documents_go(spark, max_bits):
    got = line_dedup.drop_shared_lines(cases.table(spark, extra=True), max_bits=max_bits)
    want = expected_lines(cases.documents())
    assert collected(got, "id", "n_lines", "n_dropped", "kept_sha256") == want
    assert sum(k[2] * n for k, n in want.items()) == 11


def test_first_occurrence_can_stay(spark):
    rows = [(i, "Shared\nown " + str(i) + "\nshared ", "en", "s", 1) for i in range(12)]
    got = {r["id"]: r["kept_text"] for r in line_dedup.drop_shared_lines(cases.table(spark, rows), keep="first").collect()}
    assert got[0] == "Shared\nown 0" and got[5] == "own 5"
    with pytest.raises(ValueError):
        line_dedup.drop_shared_lines(cases.table(spark, rows), keep="last")


def test_a_full_filter_loses_no_line():
    bits, probes = line_dedup.filter_size(10**12, 28)
    assert (bits, probes) == (28, 1)
    assert line_dedup.filter_size(0, 28)[0] == line_dedup.SLICE_BITS


# fingerprints


def brute_fingerprint(text, words=4, seed=42):
    own = (text or "").translate(LOWER).encode().split()
    if not own:
        return 0
    shingles = [b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    own = sorted(set(prints))
    root = {p: p for p in own}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[find(b)] = find(a)
    return {p: find(p) for p in own}


def test_fingerprints_and_components(spark):
    rows = cases.documents()
    got = simhash.near_duplicates(cases.table(spark, extra=True))
    prints = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(prints, 4)
    smallest = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            smallest[roots[p]] = min(r[0], smallest.get(roots[p], r[0]))
    want = Counter((r[0], f"{p:016x}", smallest.get(roots[p])) for r, p in zip(rows, prints))
    assert collected(got, "id", "fingerprint", "component_id") == want


def test_links_of_close_fingerprints(spark):
    rng = random.Random(3)
    own = [rng.getrandbits(64) for _ in range(60)]
    for p in own[:30]:
        for k in (1, 3, 4, 5, 6):
            q = p
            for b in rng.sample(range(64), k):
                q ^= 1 << b
            own.append(q)
    signed = [(int(np.array([p], np.uint64).view(np.int64)[0]),) for p in sorted(set(own))]
    for distance in (1, 4, 6):
        got = simhash.links(spark.createDataFrame(signed, "print bigint"), distance)
        want = {
            (a[0], b[0]) for a in signed for b in signed if a[0] < b[0] and ((a[0] ^ b[0]) % 2**64).bit_count() <= distance
        }
        assert {tuple(r) for r in got.collect()} == want


def test_thresholds_add_up():
    sample = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    for total in (10, 10_000, 10**8):
        groups = simhash.plan(sample, 4, total)
        bits = [b for g, _ in groups for b in g]
        assert len(bits) == len(set(bits)) and all(t >= 0 for _, t in groups)
        assert sum(t + 1 for _, t in groups) == 5


def test_a_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    assert {r["node"]: r["root"] for r in simhash.components(edges).collect()} == {
        **{i: 0 for i in range(1, 41)},
        101: 100,
    }


def test_one_row_of_each_component_stays(spark):
    rows = cases.documents()
    docs = cases.table(spark, extra=True)
    got = simhash.keep_one_each(docs)
    assert got.columns == docs.columns
    prints = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(prints, 4)
    have = Counter(roots[brute_fingerprint(r["text"])] for r in got.collect())
    assert have == Counter(set(roots.values()))


# passages


def brute_passages(rows, length=100):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for r in order:
        body = (r[1] or "").encode()
        for i in range(len(body) - length + 1):
            place = (r[0] is None, r[0] or 0, i)
            w = body[i : i + length]
            first[w] = min(first.get(w, place), place)
    out = Counter()
    for r in rows:
        body = (r[1] or "").encode()
        gone = np.zeros(len(body), bool)
        for i in range(len(body) - length + 1):
            if first[body[i : i + length]] < (r[0] is None, r[0] or 0, i):
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(body, np.uint8)[~gone])
        pieces = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[(r[0], len(body), int(gone.sum()), pieces, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("run_bytes, hot", [(4 << 20, 4096), (3000, 4096), (3000, 1), (3000, 3)])
def test_passages(spark, monkeypatch, run_bytes, hot):
    monkeypatch.setattr(suffixes, "RUN_BYTES", run_bytes)
    rng = random.Random(5)
    rows = cases.documents()
    passage = cases.prose(rng, 60)
    rows += [(300 + i, cases.prose(rng, 5) + passage[i * 3 : 200 + i * 7] + cases.prose(rng, 9), "en", "s", 1) for i in range(12)]
    rows += [(400, "\0" * 300 + "a" * 250 + "\0" * 150, "en", "s", 1), (7, "a" * 130 + passage, "en", "s", 1)]
    got = suffixes.remove_repeats(cases.table(spark, rows, extra=True), hot=hot)
    assert collected(got, "id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_passages(rows)


def test_merge_of_front_coded_runs():
    rng = random.Random(2)
    width = 12
    runs = []
    for _ in range(5):
        rows = sorted(bytes(rng.choice(b"ab") for _ in range(width)) for _ in range(rng.randrange(0, 40)))
        data = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, width)
        zero = np.zeros(len(rows), np.int64)
        sizes, *_, back = suffixes.unpack(suffixes.pack(data, zero, zero, zero), width)
        assert back == rows
        runs.append((sizes, back))
    out = [(runs[r][1][k], shared) for r, k, shared in suffixes.merge(runs)]
    assert [row for row, _ in out] == sorted(row for _, own in runs for row in own)
    for (a, _), (b, shared) in zip(out, out[1:]):
        assert shared == next((i for i in range(width) if a[i] != b[i]), width)


def test_windows_are_compared_where_hashes_agree(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[2000:2400] = data[300:700]
    run = suffixes.Run([data[:2000].tobytes(), data[2000:].tobytes()], [1, 2], 100)
    chosen = np.arange(len(run.place))
    rows = run.suffixes(chosen)
    starts = run.place - run.begins[run.owner]
    group = np.unique(rows[:, :32], axis=0, return_inverse=True)[1].reshape(-1)
    args = (rows, group, run.ids[run.owner], starts, 100)
    want = set(zip(*(x.tolist() for x in suffixes.repeated_windows(*args))))
    assert len(want) == 301
    monkeypatch.setattr(suffixes, "BYTE_HASH", np.zeros(256, np.uint64))
    assert set(zip(*(x.tolist() for x in suffixes.repeated_windows(*args)))) == want


# empty tables


@pytest.mark.parametrize(
    "run",
    [
        exact_dedup.exact_groups,
        exact_dedup.drop_exact_copies,
        line_dedup.drop_shared_lines,
        simhash.near_duplicates,
        simhash.keep_one_each,
        suffixes.remove_repeats,
    ],
)
def test_empty_table(spark, run):
    assert run(cases.table(spark, [])).collect() == []
