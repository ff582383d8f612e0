"""Gradients of the batch and pair losses against numeric ones, and mini-batch training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from handful.operators import gradients as G, losses as L
from handful.plans import batches as B, training as T
from tests.conftest import rows


def numeric(value, x, step=1e-6):
    out = np.zeros_like(x)
    for at in np.ndindex(*x.shape):
        up, down = x.copy(), x.copy()
        up[at] += step
        down[at] -= step
        out[at] = (value(up) - value(down)) / (2 * step)
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("name", G.BATCH_LOSSES)
def test_batch_losses_have_the_gradients_of_their_values(name, metric):
    rng = np.random.default_rng(2)
    for labels in ([0, 0, 1, 1, 2, 2, 0, 1], [0, 0, 0, 1, 1, 3, 1, 4]):
        x, y = rng.normal(size=(8, 4)), np.array(labels)
        run = lambda v: G.BATCH_LOSSES[name](v, y, metric=metric)  # noqa: E731, B023
        loss, grad = run(x)
        assert np.allclose(grad, numeric(lambda v: run(v)[0], x), atol=1e-5)
        assert loss > 0


def test_batches_without_anything_to_learn():
    x = np.eye(3)
    assert all(loss(x, np.array([0, 1, 2])) is None for loss in G.BATCH_LOSSES.values())
    for name in G.BATCH_LOSSES:
        found = G.BATCH_LOSSES[name](np.ones((4, 2)), np.array([0, 0, 1, 1]), metric="euclidean")
        assert np.isfinite(found[0]) and np.isfinite(found[1]).all()
    with pytest.raises(ValueError):
        G.BATCH_LOSSES["batch_hard"](x, np.array([0, 0, 1]), metric="none")


@pytest.mark.parametrize("name", G.PAIR_LOSSES)
def test_pair_losses_have_the_gradients_of_their_values(name):
    rng = np.random.default_rng(3)
    for y in ([1.0, 0, 1, 0, 0, 1], [1.0, 1, 1, 1, 1, 1], [0.0, 0, 0, 0, 0, 1]):
        u, v, y = rng.normal(size=(6, 3)), rng.normal(size=(6, 3)), np.array(y)
        _, by_u, by_v = G.PAIR_LOSSES[name](u, v, y)
        assert np.allclose(by_u, numeric(lambda z: G.PAIR_LOSSES[name](z, v, y)[0], u), atol=1e-5)  # noqa: B023
        assert np.allclose(by_v, numeric(lambda z: G.PAIR_LOSSES[name](u, z, y)[0], v), atol=1e-5)  # noqa: B023


def test_online_pairs_by_hand():
    u = np.array([[1.0, 0]] * 4)
    v = np.array([[0.0, 1], [1, 0], [0.6, 0.8], [0.8, 0.6]])
    # Distances 1, 0 (label 1) and 0.4, 0.2 (label 0): hard are the first, and both others.
    loss, by_u, _ = G.online_contrastive(u, v, np.array([1.0, 1, 0, 0]))
    assert loss == pytest.approx(1 + 0.1**2 + 0.3**2)
    assert np.allclose(by_u[1], 0)


def test_rates_rise_and_fall():
    assert [G.step_share(s, 10, 0.2) for s in (0, 1, 2, 6, 9)] == [0, 0.5, 1, 0.5, 0.125]
    assert G.step_share(0, 4, 0) == 1


def data(spark, n=100, k=3, d=5):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(k, d))
    table = [(i, (centers[i % k] + 0.8 * rng.normal(size=d)).tolist(), None if i == 50 else i % k) for i in range(n)]
    return spark.createDataFrame(table, "row_id long, embedding array<double>, label int")


def test_batches_hold_two_rows_of_every_label(spark):
    df = data(spark)
    first, second = (B.label_batches(df, 8, seed).collect() for seed in (1, 2))
    for found in (first, second):
        assert len({r["row_id"] for r in found}) == len(found) == 98
        for batch in range(12):
            labels = [r["label"] for r in found if r["batch_id"] == batch]
            assert len(labels) == 8 and all(labels.count(x) >= 2 for x in labels)
    assert {tuple(r) for r in first} != {tuple(r) for r in second}
    with pytest.raises(ValueError):
        B.label_batches(df, 7)


@pytest.mark.parametrize("name", ["supcon", "batch_all"])
def test_updates_equal_a_descent_over_the_same_batches(spark, name):
    df = data(spark)
    weights, losses = T.fit_adapter(None, df, epochs=2, lr=0.3, loss=name, batch_size=8, updates=2, warmup=0.5, decay=True)
    x = {r["row_id"]: np.array(r["embedding"]) for r in df.collect()}
    want, told, step = np.eye(5), [], 0
    for epoch in range(2):
        found = sorted((r["batch_id"], r["row_id"], r["label"]) for r in B.label_batches(df, 8, 42 + epoch).collect())
        for update in range(2):
            values, grads = [], []
            for batch in sorted({f[0] for f in found if f[0] % 2 == update}):
                own = [f for f in found if f[0] == batch]
                rows_in = np.stack([x[f[1]] for f in own])
                out = G.BATCH_LOSSES[name](rows_in @ want.T, np.array([f[2] for f in own]))
                if out:
                    values.append(out[0])
                    grads.append(out[1].T @ rows_in)
            told.append(np.mean(values))
            want = want - 0.3 * G.step_share(step, 4, 0.5) * np.mean(grads, axis=0)
            step += 1
    assert losses == pytest.approx(told) and np.allclose(weights, want)


def test_first_losses_are_those_of_the_loss_operators(spark):
    df = data(spark)
    batched = B.label_batches(df, 8, 42).join(df.drop("label"), "row_id")
    mean = lambda frame: frame.agg(F.avg("loss")).first()[0]
    for name, mode in (("batch_semi_hard", "semi_hard"), ("batch_all", "all")):
        _, (loss,) = T.fit_adapter(None, df, epochs=1, loss=name, batch_size=8)
        have = L.triplet_loss(L.mine_triplets(batched, mode))
        assert loss == pytest.approx(mean(have))
    _, (loss,) = T.fit_adapter(None, df, epochs=1, loss="supcon", batch_size=8)
    assert loss == pytest.approx(mean(L.supcon_loss(batched)))


def test_training_with_other_losses(spark):
    df = data(spark).filter("label is not null")
    for name in ("supcon", "online_contrastive"):
        model = T.train(df, loss=name, epochs=1, lr=0.05, pairs="drawn", num_iterations=2, batches={"batch_size": 16})
        assert len(model.losses) == 1 and model.adapter.shape == (5, 5)
        assert rows(T.evaluate(model, df))[0][1] > 0.5
    with pytest.raises(ValueError, match="loss is one of"):
        T.fit_adapter(None, df, loss="none")
    with pytest.raises(ValueError, match="needs pairs"):
        T.fit_adapter(None, df, loss="contrastive")
    with pytest.raises(ValueError, match="one label"):
        T.train(df.withColumn("label", F.array("label")), loss="supcon", multi_target="one-vs-rest")
    with pytest.raises(ValueError, match="anything to learn"):
        T.fit_adapter(None, df.filter("label = 0"), loss="batch_hard", epochs=1)
