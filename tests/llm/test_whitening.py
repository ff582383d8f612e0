"""Whitening against numpy's eigenvectors and exact integers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from handful.llm import whitening as Wh


def same_matrix(values, basis, want):
    assert np.allclose(basis.T @ basis, np.eye(len(values)), atol=1e-11)
    assert np.all(np.diff(values) >= 0)
    assert np.allclose((basis * values) @ basis.T, want, atol=1e-11 * max(1, np.abs(want).max()))


@pytest.mark.parametrize("kind", ["zero", "distinct", "repeated", "close", "one", "wide"])
def test_a_rank_one_change_equals_a_new_decomposition(kind):
    rng = np.random.default_rng(4)
    values = {
        "zero": np.zeros(7),
        "distinct": np.arange(7.0),
        "repeated": np.array([0, 0, 1, 1, 1, 5, 5.0]),
        "close": np.array([1, 1 + 1e-13, 1 + 1e-9, 2, 2 + 1e-15, 3, 3 + 1e-6]),
        "one": np.array([2.0]),
        "wide": np.array([0, 1e-12, 1e-6, 1, 1e3, 1e6, 1e9]),
    }[kind]
    for trial in range(20):
        basis = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
        vector, weight = rng.normal(size=len(values)), float(rng.uniform(0.1, 10))
        if trial % 4 == 1:
            vector = basis[:, trial % len(values)] * 3
        if trial % 4 == 2:
            vector = basis @ np.where(rng.random(len(values)) < 0.5, 0, rng.normal(size=len(values)))
        if trial % 4 == 3:
            vector = vector * 1e-9
        want = (basis * values) @ basis.T + weight * np.outer(vector, vector)
        same_matrix(*Wh.rank_one(values, basis, vector, weight), want)


def test_roots_lie_between_their_poles_and_solve_the_equation():
    poles, z = np.array([0.0, 1, 1.5, 4]), np.array([1e-7, 1, 0.3, 2])
    origin, step = Wh.secular_roots(poles, z, 0.7)
    roots = poles[origin] + step
    assert np.all(roots > poles) and np.all(roots[:-1] < poles[1:])
    for o, s in zip(origin, step):
        terms = z**2 / ((poles - poles[o]) - s)
        assert abs(1 + 0.7 * terms.sum()) < 1e-9 * (1 + 0.7 * np.abs(terms).sum())


def test_spectra_of_two_parts_join_to_that_of_all():
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(90, 9)) * np.arange(1, 10)).round()
    x[40:60] = x[0]
    parts = []
    for own in (x[:35], x[35:36], x[36:]):
        found = Wh.Spectrum.empty(9)
        for row in own:
            found.add(row)
        parts.append(found)
    whole = parts[0].join(parts[1]).join(parts[2])
    off = x - x.mean(0)
    assert whole.n == 90 and np.allclose(whole.mean, x.mean(0))
    same_matrix(whole.values, whole.basis, off.T @ off)
    assert Wh.Spectrum.empty(9).join(parts[0]) is parts[0]


def vectors():
    rng = random.Random(8)
    mix = np.random.default_rng(1).normal(size=(20, 20)) * 0.2
    rows = [(i, [float(v) for v in np.array([rng.gauss(0, 1) for _ in range(20)]) @ mix]) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(150)]
    odd = [None, [], [1.0, 2.0], [math.nan] * 20, [math.inf] + [0.0] * 19, [None] + [0.0] * 19, [2.0**51] * 20]
    rows += [(600 + i, v) for i, v in enumerate(odd)] + [(None, rows[9][1]), (7, rows[7][1]), (700, [0.0] * 20)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)


def brute(rows, k):
    used = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and len(v) == 20
            and all(c is not None and math.isfinite(c) and abs(c) < 2**50 for c in v)]
    fit = sorted({tuple(x) for _, x in used})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    off = (np.array(fit, object) * n - np.array(sums, object)).astype(float) / n
    cov = off.T @ off / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return used, n, sums, values, basis, np.trace(cov)


def test_rows_equal_brute_force(spark):
    rows = vectors()
    data = frame(spark, rows).withColumn("x", F.lit("own")).withColumn("id", F.lit(1)).withColumn("v", F.lit(2))
    got = Wh.whiten(data, components=16).collect()
    used, n, sums, values, basis, trace = brute(rows, 16)
    assert len(got) == 16 * len(used) and {r["n"] for r in got} == {n}
    want: dict = {}
    for i, x in used:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        white = np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ basis / np.sqrt(values)
        want.setdefault(i, []).append((dev, white))
    signs = {}
    for r in got:
        dev, white = want[r["id"]][0]
        k = r["component"] - 1
        assert r["deviation"] == dev
        assert r["explained"] == pytest.approx(values[k] / trace, rel=1e-10)
        assert r["identity_error"] < 1e-10
        assert abs(r["whitened"]) == pytest.approx(abs(white[k]), abs=1e-8)
        if abs(white[k]) > 0.1:
            signs.setdefault(k, set()).add(np.sign(r["whitened"] * white[k]))
    assert all(len(s) == 1 for s in signs.values()) and len(signs) == 16


def test_few_dimensions_flat_tables_and_empty_ones(spark):
    flat = frame(spark, [(i, [1.0, 2.0]) for i in range(9)])
    assert Wh.whiten(flat).collect() == []
    assert Wh.whiten(frame(spark, [])).collect() == []
    line = frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])
    got = Wh.whiten(line).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 9
    assert np.var([r["whitened"] for r in got]) == pytest.approx(1)
    assert got[0]["explained"] == pytest.approx(1)


def test_deviations_beyond_64_bits_are_null_and_large_ones_exact():
    rng = random.Random(2)
    n, dims = 10**9 + 7, 3
    sums = [rng.randrange(10**15) for _ in range(dims)]
    model = Wh.Whitening(n, sums, np.ones(dims), np.eye(dims), 3.0, 64, 0)
    x = np.array([[s // n + rng.randrange(-2, 3) for s in sums] for _ in range(20)] + [[2**40] * dims], np.int64)
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert model.deviations(x) == [w if w < 2**63 else None for w in want]
    assert model.deviations(x)[-1] is None and any(w is not None for w in model.deviations(x))


def test_query_keeps_every_usable_row(spark):
    from handful.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["op13_whitening"](spark, sf)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert got.count() == 16 * rows
    top = got.agg(F.max("identity_error"), F.max("explained"), F.min("component"), F.max("component")).first()
    assert top[0] < 1e-6 and 0 < top[1] < 1 and (top[2], top[3]) == (1, 16)
