import tracemalloc

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from handful.operators import heads as H, losses as L, metrics as E, scoring as M
from handful.plans import benchmark as B, training as T
from tests.conftest import rows


def cloud(spark, n=60, k=3, d=5, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(k, d)) * 2
    data = [(i, (centers[i % k] + rng.normal(size=d)).tolist(), i % k) for i in range(n)]
    return spark.createDataFrame(data, "row_id long, embedding array<double>, label int")


def word_encoder():
    words = ["good", "fine", "bad", "poor"]

    def run(texts):
        return np.array([[float(w in t.split()) for w in words] + [0.1] for t in texts]).reshape(len(texts), 5)

    return run


@pytest.fixture(scope="module")
def reviews(spark):
    data = [(i, ("a good day" if i % 4 else "so fine it is") if i % 2 else ("a bad day" if i % 3 else "poor it is"), "pos" if i % 2 else "neg") for i in range(60)]
    return spark.createDataFrame(data, "row_id long, text string, label string")


def test_hashed_words(spark):
    df = spark.createDataFrame([("Apple pear, apple!",), ("",), (None,)], "text string")
    got = [r["embedding"] for r in M.embed(df, dim=16).collect()]
    tf = HashingTF(numFeatures=16)
    want = np.zeros(16)
    for w in ("apple", "pear", "apple"):
        want[tf.indexOf(w)] += 1
    assert got[0] == want.tolist() and got[1] == [0.0] * 16 == got[2]
    unit = M.embed(df, dim=16, normalize=True).first()["embedding"]
    assert np.linalg.norm(unit) == pytest.approx(1.0)
    assert M.embed(df, dim=16, idf=True).count() == 3


def test_user_encoder_batches_and_normalizes(spark, reviews):
    out = M.embed(reviews, word_encoder, batch_size=7, normalize=True)
    assert all(np.linalg.norm(r["embedding"]) == pytest.approx(1.0) for r in out.collect())


def traced_encoder():
    """The MB that Python holds while texts are encoded."""
    tracemalloc.start()

    def run(texts):
        held = tracemalloc.get_traced_memory()[0] / 1e6
        if len(texts) < 32:
            tracemalloc.stop()
        return np.array([[held, len(t)] for t in texts])

    return run


def test_user_encoder_holds_the_texts_of_one_call(spark):
    df = spark.range(0, 1001, 1, 1).select("id", F.when(F.col("id") % 100 < 99, F.repeat(F.lit("a"), (40_000 + F.col("id")).cast("int"))).alias("text"))
    got = {r["id"]: r["embedding"] for r in M.embed(df, traced_encoder).select("id", "embedding").collect()}
    assert all(got[i][1] == (40_000 + i if i % 100 < 99 else 0) for i in range(1001))
    # The batch of 40 MB itself, but no second copy of it as strings.
    assert max(v[0] for v in got.values()) < 60


def test_head_agrees_with_its_optimum(spark):
    df = cloud(spark)
    fitted = H.fit_head(df)
    data = df.orderBy("row_id").collect()
    x, y = np.array([r["embedding"] for r in data]), np.array([r["label"] for r in data])
    weights, bias = H.logistic_weights(x, y, 3)
    p = np.exp(x @ weights.T + bias)
    p /= p.sum(axis=1, keepdims=True)
    assert np.abs((p - np.eye(3)[y]).T @ x + weights).max() < 1e-5  # zero gradient
    probs = np.array([r["probs"] for r in fitted.predict(df).orderBy("row_id").collect()])
    assert np.abs(probs - p).max() < 1e-2
    by_weights = M.linear_score(df, fitted.as_head(), eps=0.0).orderBy("row_id").collect()
    assert np.abs(np.array([r["probs"] for r in by_weights]) - probs).max() < 1e-9


def test_binary_head_with_text_labels(spark):
    df = cloud(spark, k=2).withColumn("label", F.when(F.col("label") == 1, "yes").otherwise("no"))
    head = H.fit_head(df)
    assert E.accuracy(head.predict(df.withColumnRenamed("label", "true_label"))).first()[0] > 0.9
    assert M.linear_score(df, head.as_head(), eps=0.0).first()["probs"] is not None


@pytest.mark.parametrize("strategy", H.STRATEGIES)
def test_multi_heads(spark, strategy):
    df = cloud(spark).withColumn("label", F.array(*[(F.col("label") == i).cast("int") for i in range(3)]))
    out = H.fit_multi_head(df, 3, strategy).predict(df.withColumnRenamed("label", "true_label"))
    first = out.first()
    assert len(first["probs"]) == len(first["pred_label"]) == 3
    assert E.multilabel_scores(out).first()["micro_f1"] > 0.8
    with pytest.raises(ValueError):
        H.fit_multi_head(df, 3, "none")


def test_cells_are_fitted_one_by_one(spark):
    df = cloud(spark).withColumn("cell", F.explode(F.array(F.lit(1), F.lit(2)))).filter("cell = 1 or row_id < 30")
    heads = M.load_head(H.fit_cells(df, ["cell"]), ["cell"])
    assert heads.cells == [(1,), (2,)] and heads.labels[0] == [0, 1, 2]
    alone = H.fit_cells(df.filter("cell = 2"), ["cell"]).orderBy("label").collect()
    assert np.allclose(heads.weights[1], [r["weights"] for r in alone])
    grid = M.predict_grid(cloud(spark), heads, ["row_id", "label"])
    assert grid.count() == 120
    one = M.predict(cloud(spark), M.load_head(H.fit_cells(df.filter("cell = 2"), ["cell"]).drop("cell")))
    assert rows(grid.filter("cell = 2"), "row_id", "pred_label") == rows(one, "row_id", "pred_label")


def test_large_head_is_refused(spark):
    with pytest.raises(ValueError, match="at most 4"):
        M.load_head(M.class_means(cloud(spark)), limit=4)


def test_adapter_gradient():
    rng = np.random.default_rng(1)
    w, a, b, y = rng.normal(size=(3, 3)), rng.normal(size=(6, 3)), rng.normal(size=(6, 3)), np.array([1.0, 0, 1, 0, 1, 0])
    grad, _ = T._pair_gradient(w, a, b, y)
    for i, j in ((0, 0), (1, 2), (2, 1)):
        step = np.zeros_like(w)
        step[i, j] = 1e-6
        up, down = T._pair_gradient(w + step, a, b, y)[1], T._pair_gradient(w - step, a, b, y)[1]
        assert grad[i, j] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def test_training_and_metrics(reviews):
    model = T.train(reviews, word_encoder, epochs=4, lr=0.5)
    assert model.losses[-1] < model.losses[0]
    assert rows(T.evaluate(model, reviews)) == [("accuracy", 1.0)]
    own = T.evaluate(model, reviews, lambda p: p.agg(F.count("*").alias("n")))
    assert rows(own) == [("n", 60.0)]
    with pytest.raises(ValueError, match="metric is a function"):
        T.evaluate(model, reviews, "unknown")
    mapped = reviews.withColumnsRenamed({"text": "body", "label": "kind"})
    again = T.train(mapped, word_encoder, epochs=0, mapping={"body": "text", "kind": "label"})
    assert again.adapter is None
    with pytest.raises(ValueError):
        T.train(mapped, word_encoder)


def test_multilabel_training(reviews):
    df = reviews.withColumn("label", F.array((F.col("label") == "pos").cast("int"), F.lit(1) - (F.col("label") == "pos").cast("int")))
    model = T.train(df.limit(20), word_encoder, epochs=1, multi_target="one-vs-rest")
    assert rows(T.evaluate(model, df)) == [("accuracy", 1.0)]


def test_distillation(reviews):
    teacher = T.train(reviews, word_encoder, epochs=0)
    student = T.distill(reviews.drop("label").limit(30), teacher, encoder=word_encoder, epochs=1)
    assert rows(T.evaluate(student, reviews)) == [("accuracy", 1.0)]
    both = T.distill(reviews.drop("label").filter("row_id >= 30").limit(10), teacher, reviews.filter("row_id < 10"), word_encoder, max_pairs=60)
    assert len(both.losses) == 3


def test_search(spark):
    trials = T.draw_trials(spark, 50).collect()
    assert all(1e-6 <= r["learning_rate"] <= 1e-4 and 1 <= r["num_epochs"] <= 5 and r["batch_size"] in (4, 8, 16, 32, 64) for r in trials)

    def run(setting):
        return spark.createDataFrame([("m", float(setting["x"]))], "metric string, value double")

    space = {"x": ("int", 1, 1000)}
    up, down = T.grid_search(spark, run, 6, space), T.grid_search(spark, run, 6, space, direction="minimize")
    values = [r["objective"] for r in up.trials.collect()]
    assert up.objective == max(values) == up.best["x"] and down.objective == min(values)


def test_contrastive_loss_by_hand(spark):
    data = [(0, 1, 0, [1.0, 0.0]), (0, 2, 0, [0.6, 0.8]), (0, 3, 1, [0.0, 1.0]), (1, 4, 0, [2.0, 0.0]), (1, 5, 0, [1.0, 1.0])]
    df = spark.createDataFrame(data, "batch_id long, row_id long, label int, embedding array<double>")
    got = dict(rows(L.supcon_anchor_losses(df), "row_id", "loss"))
    t = 0.07
    assert got[1] == pytest.approx(-(0.6 / t - np.log(np.exp(0.6 / t) + np.exp(0.0))))
    assert got[3] is None or np.isnan(got[3])
    by_batch = {r["batch_id"]: r for r in L.supcon_loss(df).collect()}
    assert by_batch[0]["loss"] is None and by_batch[0]["n_without_positive"] == 1
    assert by_batch[1]["loss"] == pytest.approx(0.0)


def test_triplets_by_hand(spark):
    data = [(0, 1, 0, [0.0, 0.0]), (0, 2, 0, [3.0, 0.0]), (0, 3, 1, [1.0, 0.0]), (0, 4, 1, [5.0, 0.0])]
    df = spark.createDataFrame(data, "batch_id long, row_id long, label int, embedding array<double>")
    hard = {r["row_id"]: r for r in L.mine_triplets(df, "hard", "euclidean").collect()}
    assert (hard[1]["positive"], hard[1]["negative"], hard[1]["loss"]) == (2, 3, 3.0 - 1.0 + 0.25)
    semi = {r["row_id"]: r["loss"] for r in L.mine_triplets(df, "semi_hard", "euclidean").collect()}
    assert semi[1] == 0.0 and semi[2] == pytest.approx(3.0 - 2.0 + 0.25)
    everything = L.triplet_loss(L.mine_triplets(df, "all", "euclidean")).first()
    d = lambda a, b: abs(a - b)
    pos = {1: 0.0, 2: 3.0, 3: 1.0, 4: 5.0}
    lab = {1: 0, 2: 0, 3: 1, 4: 1}
    gaps = [
        max(d(pos[a], pos[p]) - d(pos[a], pos[n]) + 0.25, 0)
        for a in pos for p in pos for n in pos if a != p and lab[a] == lab[p] and lab[a] != lab[n]
    ]
    valid = [g for g in gaps if g > 0]
    assert everything["n_triplets"] == len(valid) and everything["loss"] == pytest.approx(sum(valid) / len(valid))
    with pytest.raises(ValueError):
        L.mine_triplets(df, "soft")


def test_benchmark(spark, reviews):
    test = reviews.withColumn("text", F.when(F.col("row_id") % 5 == 0, "it is what it is").otherwise(F.col("text")))
    result = B.fewshot_benchmark(reviews, test, "sst2", word_encoder, sizes=[2, 4], seeds=[0, 1], synthetic_ratio=1.0, head="logistic")
    runs = result["runs"]
    assert runs.count() == 12 and {r[0] for r in runs.select("method").collect()} == {"vanilla", "random_aug", "error_driven"}
    total = result["confusion"].groupBy("sample_size", "seed", "method").agg(F.sum("n")).collect()
    assert all(r[3] == 60 for r in total)
    sizes = result["synthetic"].groupBy("sample_size", "seed", "method").count().collect()
    assert sizes and all(r["count"] <= 2 * r["sample_size"] for r in sizes)
    records = B.run_records(result, "sst2", settings={"loss": "cosine"}).collect()
    assert len(records) == 12
    for r in records:
        gain = r["improvement_delta"]
        if r["method"] == "vanilla":
            assert gain["accuracy_delta"] == 0 and all(v == 0 for v in gain["per_class_accuracy_delta"].values() if v is not None)
            assert r["synthetic_data"]["num_samples"] == 0 and r["synthetic_data"]["strategy"] == "none"
        matrix = np.array(r["confusion_matrix"])
        assert matrix.sum() == 60 and r["accuracy"] == pytest.approx(100 * np.trace(matrix) / 60)
        vanilla = next(v for v in records if (v["shot"], v["seed"], v["method"]) == (r["shot"], r["seed"], "vanilla"))
        errors = np.array(vanilla["confusion_matrix"])
        assert r["error_analysis"]["num_errors"] == errors.sum() - np.trace(errors)
    # finished cells are skipped
    done = runs.filter("sample_size = 2")
    rest = B.fewshot_benchmark(reviews, test, "sst2", word_encoder, sizes=[2, 4], seeds=[0, 1], done=done, head="means")["runs"]
    assert {r[0] for r in rest.select("sample_size").collect()} == {4}


def test_scoring_runs_on_a_stream(spark, tmp_path):
    cloud(spark).write.parquet(str(tmp_path / "in"))
    head = M.load_head(M.class_means(cloud(spark)))
    stream = spark.readStream.schema("row_id long, embedding array<double>, label int").parquet(str(tmp_path / "in"))
    query = M.predict(stream, head).select("row_id", "pred_label").writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows(spark.table("scored")) == rows(M.predict(cloud(spark), head), "row_id", "pred_label")


def test_confusion_of_a_grid_is_that_of_its_predictions(spark):
    df = cloud(spark).withColumn("cell", F.explode(F.array(F.lit(1), F.lit(2)))).filter("cell = 1 or row_id < 30")
    heads = M.load_head(H.fit_cells(df, ["cell"]), ["cell"])
    data = cloud(spark).withColumn("label", F.when(F.col("row_id") != 7, F.col("label")))
    data = data.withColumn("embedding", F.when(F.col("row_id") != 9, F.col("embedding")))
    got = [tuple(r) for r in M.grid_confusion(data, heads, true="label").select("cell", "true_label", "pred_label", "n").collect()]
    preds = M.predict_grid(data.filter("embedding is not null"), heads, ["label"])
    want = rows(E.confusion(preds, ["cell"], true="label"), "cell", "true_label", "pred_label", "n")
    assert sorted(map(str, got)) == sorted(map(str, want + [(1, 0, None, 1), (2, 0, None, 1)]))


def test_heads_of_any_size_go_in_blocks(spark):
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(1000, 6))
    weights[17] = weights[411] = 6 * weights[412]
    weights[412] = weights[17]
    heads = spark.createDataFrame([(f"l{i:03d}", w.tolist(), 0.1) for i, w in enumerate(weights)], "label string, weights array<double>, bias double")
    x = [rng.normal(size=6).tolist() for _ in range(40)] + [None, (weights[17] * 9).tolist()]
    df = spark.createDataFrame(list(enumerate(x)), "row_id long, embedding array<double>")
    blocks, whole = ({r["row_id"]: r["top"] for r in M.predict_top(df, heads, ["row_id"], k=4, limit=n).collect()} for n in (700, 10**6))
    full = {r["row_id"]: r for r in M.predict(df.filter("embedding is not null"), M.load_head(heads)).collect()}
    assert blocks[40] is None and whole[40] is None
    for i, row in full.items():
        assert i == 41 or [t["label"] for t in blocks[i]] == [t["label"] for t in whole[i]]
        assert i == 41 or blocks[i][0]["label"] == row["pred_label"]
        assert blocks[i][0]["score"] == pytest.approx(row["score"])
        assert [t["score"] for t in blocks[i]] == pytest.approx(sorted(row["probs"], reverse=True)[:4])
    assert sorted(t["label"] for t in blocks[41][:3]) == ["l017", "l411", "l412"]
    with pytest.raises(ValueError, match="no labels"):
        M.predict_top(df, heads.limit(0), ["row_id"])
