"""Classifiers, search, mixing, archives and pieces against brute force."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from handful.llm import labelled, mixing, neighbours, pieces, quality, toxicity, warc
from tests.llm import cases

LANGUAGE = "the of and stone river cloud market paper window garden music night over under".split()


def collected(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


def crc_fold(i):
    return zlib.crc32(str(i).encode()) % 5


def labelled_corpus(seed=4, n=300):
    """Texts whose labels follow from rude words (toxic) and from shouting or repetition (quality)."""
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        words = [rng.choice(LANGUAGE) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(30, 200))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "grumpen" + rng.choice("abcd")]))
        body = " ".join(words)
        if not good:
            body = body.upper().replace(" ", "!! ") if i % 2 else body[:40] + " " + "Blah " * 80
        rows.append((1000 + i, body, "en", "s", len(body)))
        marks.append((1000 + i, good, toxic))
    return rows, marks


# samples of labels


def test_sample_leaves_out_held_out_and_doubtful_rows(spark):
    got = {r["id"]: r["label"] for r in labelled.sample_ids(cases.labels(spark), "toxic", 1000).collect()}
    want = {i: int(i % 4 == 0) for i in range(30) if crc_fold(i)} | ({5000: 0} if crc_fold(5000) else {})
    assert got == want
    assert labelled.sample_ids(cases.labels(spark), "toxic", 3).count() == 6
    folds = spark.range(50).select("id", labelled.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (crc_fold(r["id"]) == 0) for r in folds)


# quality


def test_quality_learns_and_ignores_other_columns(spark):
    rows, marks = labelled_corpus()
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    docs = cases.table(spark, rows + cases.documents()[30:40], extra=True)
    got = quality.classify(docs, labels, threshold=0.5).collect()
    truth = {i: q for i, q, _ in marks}
    held = [r for r in got if r["held_out"] and r["id"] in truth]
    assert np.mean([r["predicted"] == truth[r["id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    empty = {r["score"] for r in got if r["id"] in (100, 101)}
    assert len(empty) == 1
    kept = quality.keep_good(docs, labels, threshold=0.5)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["id"] for r in got if r["predicted"])


def direct_score(net, text):
    """The network's formula on one text, chunk by chunk."""
    starts = quality.chunk_starts(len(text))
    pooled = np.zeros(quality.FEATURES)
    for s in starts.tolist():
        total, n = np.zeros(quality.FILTERS), 0
        for w in range(s, min(s + quality.CHUNK, len(text)), quality.STRIDE):
            part = np.frombuffer(text[w : w + quality.WIDTH].ljust(quality.WIDTH, b"\0"), np.uint8)
            out = net.p["embed"][part].reshape(-1) @ net.p["filters"] + net.p["filter_bias"]
            total += np.maximum(out, 0)
            n += 1
        own = text[s : s + quality.CHUNK]
        again = max(
            sum(text[t] == text[t - lag] for t in range(max(s, lag), s + len(own))) for lag in quality.LAGS
        )
        inputs = np.r_[total / n, quality.REPEAT_SCALE * again / len(own)]
        pooled = np.maximum(pooled, inputs @ net.p["mix"] + net.p["mix_bias"])
    return 1 / (1 + math.exp(-(pooled @ net.p["out"] + net.p["out_bias"][0])))


def test_scores_cover_the_whole_text_in_pieces(monkeypatch):
    net = quality.Network(3)
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abc DEF!") for _ in range(n)) for n in (0, 1, 7, 127, 128, 129, 256, 300, 1024, 2000)]
    want = [direct_score(net, t) for t in texts]
    assert np.allclose(net.score_all(texts), want, atol=1e-4)
    monkeypatch.setattr(quality, "PIECE", 512)
    monkeypatch.setattr(quality, "REPEAT_SCALE", 0.0)  # lags start anew in a piece
    assert np.allclose(net.score_all(texts), [direct_score(net, t) for t in texts], atol=1e-4)


def test_gradients_are_those_of_the_loss():
    net = quality.Network(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    data = rng.integers(60, 90, (5, quality.SPAN)).astype(np.uint8)
    valid = np.array([64, 64, 10, 64, 33], float)
    owner, labels, weights = np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        seen = net.windows(data.reshape(-1)).reshape(5, -1, quality.FILTERS)[:, : quality.WINDOWS]
        seen = seen * (np.arange(quality.WINDOWS)[None] < valid[:, None])[:, :, None]
        apart = np.zeros((5, quality.CHUNK + quality.HOP), np.uint8)
        apart[:, : quality.CHUNK] = data[:, : quality.CHUNK]
        again = quality.repeats(apart.reshape(-1)).reshape(5, -1, len(quality.LAGS)).sum(1).max(1) / quality.CHUNK
        made = net.features(np.c_[seen.sum(1) / valid[:, None], quality.REPEAT_SCALE * again])
        pooled = np.zeros((3, quality.FEATURES))
        np.maximum.at(pooled, owner, made)
        p = net.probability(pooled)
        return -(weights * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum()

    slope = net.gradients(data, valid, owner, 3, labels, weights)
    for name, at in (("out", 2), ("mix_bias", 1), ("mix", (3, 4)), ("filters", (9, 5)), ("filter_bias", 6), ("embed", (70, 3))):
        step = 1e-5
        net.p[name][at] += step
        up = loss()
        net.p[name][at] -= 2 * step
        down = loss()
        net.p[name][at] += step
        assert slope[name][at] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=1e-5)


def test_one_class_gives_a_constant(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id bigint, quality int, toxic int")
    docs = cases.table(spark)
    n = sum(1 for i in range(10) if crc_fold(i)) + (1 if crc_fold(7) else 0)
    assert {r["score"] for r in quality.classify(docs, labels).collect()} == {(n + 1) / (n + 2)}
    m = sum(1 for i in range(10) if crc_fold(i))
    assert {round(r["score"], 12) for r in toxicity.classify(docs, labels).collect()} == {round(1 / (m + 2), 12)}


# toxicity


def test_toxicity_learns_and_gives_evidence(spark):
    rows, marks = labelled_corpus()
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    docs = cases.table(spark, rows + cases.documents()[30:40], extra=True)
    got = toxicity.classify(docs, labels).collect()
    truth = {i: t for i, _, t in marks}
    held = [r for r in got if r["held_out"] and r["id"] in truth]
    # Repetition cuts the rude words off some texts; shouting keeps them.
    seen = [r for r in held if truth[r["id"]] == 0 or any(w in rows[r["id"] - 1000][1].lower() for w in ("idiot", "moron", "grumpen"))]
    assert np.mean([r["predicted"] == truth[r["id"]] for r in seen]) > 0.95
    for r in got:
        assert 0 <= r["score"] <= 1 and len(r["neighbours"]) == len(r["cosines"]) <= 15
        assert r["cosines"] == sorted(r["cosines"], reverse=True)
        assert all(crc_fold(i) for i in r["neighbours"])


def test_neighbours_are_exact_whatever_the_blocks(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    rng = random.Random(6)
    terms = [f"t{i}" for i in range(20)]
    counts = [{t: rng.randrange(1, 4) for t in rng.sample(range(20), rng.randrange(0, 5))} for _ in range(60)]
    ids = np.array(rng.sample(range(1000), 60))
    index = toxicity.Index(terms, counts, ids, np.zeros(60), np.ones(60), 7, 1.0)

    def unit(c):
        v = np.zeros(20)
        for t, n in c.items():
            v[t] = (1 + math.log(n)) * index.idf[t]
        return v / (np.linalg.norm(v) or 1)

    for query in counts[:25] + [{}, {0: 9}]:
        cosines = [(-round(float(unit(query) @ unit(c)), 12), int(i)) for c, i in zip(counts, ids)]
        want = sorted(c for c in cosines if c[0] < 0)[:7]
        got = [(-s, int(index.ids[row])) for s, row in index.nearest(query)]
        assert [i for _, i in got] == [i for _, i in want]
        assert np.allclose([s for s, _ in got], [s for s, _ in want])


def test_document_frequencies_are_those_of_all_documents(spark):
    rows, marks = labelled_corpus()
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    more = cases.documents() + [(5000 + i, "Idiot river idiots", "en", "s", 1) for i in range(9)]
    index = toxicity.fit_toxicity(cases.table(spark, rows + more), labels)
    texts = [toxicity.terms_of((r[1] or "").encode()) for r in rows + more]
    known = index.vocabulary.words | {t + "|": i for _, begins in index.vocabulary.begins for t, i in begins.items()}
    assert "idiot" in known
    for term, i in known.items():
        seen = sum(term in own for own in texts)
        assert index.idf[i] == pytest.approx(math.log((1 + len(texts)) / (1 + seen)) + 1)


# mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("extra", [False, True])
def test_mixture_meets_targets(spark, extra):
    rows = cases.documents(n=200)
    got = mixing.mixture(cases.table(spark, rows, extra=extra)).collect()
    size = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    assert Counter((r["id"], r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    targets = brute_targets(sizes)
    source = {(r[0], size(r[1])): r[3] for r in rows}
    taken = defaultdict(int)
    for r in got:
        own = source[(r["id"], r["size"])]
        assert r["source_size"] == sizes[own] and r["target"] == pytest.approx(targets[own])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[own] += r["taken"]
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 0.01 * target + 5
    again = mixing.mixture(cases.table(spark, rows).repartition(5)).collect()
    assert Counter((r["id"], r["taken"]) for r in again) == Counter((r["id"], r["taken"]) for r in got)


def test_capped_and_empty_sources(spark):
    rows = [(1, "a b c", "en", "a", 1), (2, "x " * 300, "en", "b", 1), (3, "", "en", "c", 1), (4, None, "en", None, 1)]
    got = {r["id"]: (r["target"], r["taken"]) for r in mixing.mixture(cases.table(spark, rows)).collect()}
    assert got[1] == (9.0, 9) and got[3] == (0.0, 0) and got[4] == (0.0, 0)
    assert got[2][0] == pytest.approx(294.0)


def test_rates_are_exponentially_tilted(spark):
    rows = [(i, "w " * (1 + i % 50), "en", f"s{i % 3}", 1) for i in range(600)]
    rows += [(600 + i, "w w", "en", f"s{i}", 1) for i in (0, 1, 1)]
    got = [r for r in mixing.mixture(cases.table(spark, rows)).collect() if r["target"] < r["source_size"]]
    by = defaultdict(set)
    for r in got:
        by[r["source_size"]].add(round(math.log(r["rate"]) / r["size"], 9))
    assert by and all(len(slopes) == 1 for slopes in by.values())
    for words in by:
        total = sum(r["rate"] * r["size"] for r in got if r["source_size"] == words)
        target = next(r["target"] for r in got if r["source_size"] == words)
        assert total == pytest.approx(target, rel=1e-7)


def test_take_mixture_repeats_rows(spark):
    rows = [r for r in cases.documents() if r[0] != 7]
    docs = cases.table(spark, rows, extra=True)
    got = mixing.take_mixture(docs)
    assert got.columns == docs.columns
    want = {r["id"]: r["copies"] for r in mixing.mixture(docs).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(want)


# archives

PAGES = "page_id bigint, url string, html string"


def pages(spark):
    big = "".join(random.Random(1).choice("abc\r\n ") for _ in range(5000))
    rows = [(i, f"http://x/{i}", f"<p>{i % 4}</p>" + "body " * (30 if i % 2 else 1)) for i in range(20)]
    rows += [(50, "http://x/ y\r\nz", big), (49, "u", big), (51, "u", None), (52, None, ""), (53, "u", "\r\n\r\n" * 60)]
    rows += [(None, "u", big), (60, "u", "é" * 99), (60, "u", "é" * 99), (61, "u", "é" * 99)]
    return rows, spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("own")).repartition(3)


@pytest.mark.parametrize("segment, chunk", [(32 << 20, 1 << 20), (200, 64)])
def test_records_come_back(spark, segment, chunk):
    rows, frame = pages(spark)
    segments = warc.write_archives(frame, segment_bytes=segment, archive_bytes=4 * segment)
    table = warc.read_records(segments, chunk_bytes=chunk).collect()
    first = {}
    for i, _, body in rows:
        b = (body or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    want = Counter()
    for i, _, body in rows:
        b = (body or "").encode()
        revisit = b in first and first[b] != i
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None)] += 1
    last = [r for r in table if r["last"]]
    assert Counter((r["id"], r["so_far"], r["digest"], r["record_type"], r["refers_to"]) for r in last) == want
    parts = defaultdict(list)
    for r in table:
        if r["record_type"] == "response" and r["id"] not in (60,):
            parts[r["id"]].append((r["chunk_no"], bytes(r["chunk"]), r["so_far"], r["digest"], r["last"]))
    bodies = {i: (b or "").encode() for i, _, b in rows}
    for i, chunks in parts.items():
        chunks.sort()
        whole = b""
        for k, (number, part, so_far, digest, is_last) in enumerate(chunks):
            whole += part
            assert number == k and len(part) <= chunk and so_far == len(whole)
            assert digest == hashlib.sha256(whole).hexdigest() and is_last == (k + 1 == len(chunks))
        assert whole == bodies[i]


def test_archives_are_plain_warc_files(spark):
    _, frame = pages(spark)
    paths = {r["path"] for r in warc.write_archives(frame).collect()}
    types = Counter()
    for path in paths:
        data = gzip.open("/" + path.removeprefix("file:").lstrip("/")).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n")
            types[fields["WARC-Type"]] += 1
            size = int(fields["Content-Length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            data = rest[size + 4 :]
    assert sum(types.values()) == frame.count() and types["revisit"] == 11


def test_no_pages(spark):
    segments = warc.write_archives(spark.createDataFrame([], PAGES))
    assert segments.collect() == [] and warc.read_records(segments).collect() == []


# nearest vectors


def vectors(spark, n=3000, seed=2):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, 12)) + 2 * rng.normal(size=(8, 12))[rng.integers(0, 8, n)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    rows += [(5000 + i, rows[7][1]) for i in range(40)] + [(5, rows[9][1])]
    odd = [(9000, None), (9001, [0.0] * 12), (9002, [float("nan")] * 12), (9003, [1.0, None] * 6), (9004, [1.0]), (None, rows[3][1]), (9005, [float("inf")] * 12)]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("own"))
    return rows, frame


def brute_nearest(rows, query, k=10):
    own = np.array(dict(reversed([(i, v) for i, v in rows if i == query]))[query])
    best = {}
    for i, v in rows:
        if i != query:
            d = float(np.sqrt(((np.array(v) - own) ** 2).sum()))
            best[i] = min(d, best.get(i, d))
    return sorted((d, i) for i, d in best.items())[:k]


def test_search_finds_at_least_nine_of_ten(spark):
    rows, frame = vectors(spark)
    got = neighbours.search(frame, frame.where("vec_id % 100 = 0"), block_rows=128).collect()
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    queries = {i for i, _ in rows if i % 100 == 0}
    assert set(by) == queries
    hits = total = 0
    data = dict(rows)
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [f[1:] for f in found] == sorted(f[1:] for f in found)
        for _, score, i in found:
            if i != 5:
                assert score == pytest.approx(float(np.linalg.norm(np.array(data[q]) - np.array(data[i]))), abs=1e-12)
        hits += len({i for _, i in brute_nearest(rows, q)} & {f[2] for f in found})
        total += 10
    assert hits / total >= 0.9


def test_one_block_is_exact_with_ties_and_few_rows(spark):
    rows, frame = vectors(spark, n=200)
    got = neighbours.search(frame, frame.where("vec_id in (7, 100)"))
    for q in (7, 100):
        mine = got.where(F.col("query_id") == q).orderBy("rank").collect()
        want = brute_nearest(rows, q)
        assert [r["vec_id"] for r in mine] == [i for _, i in want]
        assert np.allclose([r["score"] for r in mine], [d for d, _ in want])
    few = frame.where("vec_id < 4")
    assert neighbours.search(few, few).count() == 12
    none = frame.where("vec_id > 9000")
    assert neighbours.search(none, none).collect() == []


def test_a_third_of_equal_rows_keeps_the_smallest_ids(spark):
    rng = np.random.default_rng(6)
    data = rng.normal(size=(6000, 12))
    data[rng.permutation(6000)[:2000]] = data[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = neighbours.search(frame, frame.where("vec_id % 100 = 0"), block_rows=64).collect()
    equal = {i for i, v in rows if v == rows[0][1]}
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r["query_id"]].append((r["score"], r["vec_id"]))
    copies = [q for q in found if q in equal]
    assert len(copies) > 10
    for q in copies:
        assert found[q] == [(0.0, i) for i in sorted(equal - {q})[:10]]
    hits = sum(len({i for _, i in brute_nearest(rows, q)} & {i for _, i in found[q]}) for q in found)
    assert len(found) == 60 and hits / 600 >= 0.9


def test_hilbert_numbers_are_a_curve():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    numbers = neighbours.hilbert(cells, 3)
    assert sorted(numbers.tolist()) == list(range(side**3))
    path = cells[np.argsort(numbers)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# pieces


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_ids_are_those_of_the_library(spark, model):
    rng = random.Random(9)
    alphabet = "abcdeé▁ \n\tñ日😀0123ththeing.,!=-<s>\0"
    rows = cases.documents() + [
        (1000 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60))), "en", "s", 1) for i in range(300)
    ]
    rows += [(2000, " " * 40 + "x" + " " * 17, "en", "s", 1), (2001, "x" * 5000, "en", "s", 1)]
    got = pieces.encode(cases.table(spark, rows, extra=True)).collect()
    want = Counter()
    for i, body, *_ in rows:
        ids = model.encode(body or "")
        back = (body or "").replace("▁", " ")
        want[(i, len(ids), tuple(ids), hashlib.sha256(back.encode()).hexdigest(), "▁" not in (body or ""))] += 1
    assert Counter((r[0], r[1], tuple(r[2]), r[3], r[4]) for r in got) == want


def test_decoding(spark, model):
    texts = ["Hello  world\n é日😀", "", " x"]
    rows = [(i, model.encode(t)) for i, t in enumerate(texts)] + [(9, None)]
    got = {r["id"]: r["text"] for r in pieces.decode(spark.createDataFrame(rows, "id bigint, token_ids array<int>")).collect()}
    assert got == {**dict(enumerate(texts)), 9: ""}


def test_a_small_cache_changes_nothing(monkeypatch, model):
    monkeypatch.setattr(pieces, "CACHED", 3)
    own = pieces.Pieces(model.serialized_model_proto())
    rng = random.Random(1)
    for _ in range(4):
        texts = [cases.prose(rng, 12) for _ in range(3)]
        ids, counts = own.encode([t.encode() for t in texts])
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [model.encode(t) for t in texts]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    data[50:250] = 97
    order = pieces.suffix_array(data, pieces.windows(data))
    whole = data.tobytes() + b"\xff" * 16
    found = [whole[i : i + 16] for i in order.tolist()]
    assert sorted(order.tolist()) == list(range(400)) and found == sorted(found)


@pytest.mark.parametrize(
    "run",
    [
        lambda docs, labels: quality.classify(docs, labels),
        lambda docs, labels: quality.keep_good(docs, labels),
        lambda docs, labels: toxicity.classify(docs, labels),
        lambda docs, labels: mixing.mixture(docs),
        lambda docs, labels: mixing.take_mixture(docs),
        lambda docs, labels: pieces.encode(docs),
    ],
)
def test_empty_table(spark, run):
    assert run(cases.table(spark, []), cases.labels(spark).limit(0)).collect() == []
