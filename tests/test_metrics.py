import math
import random

import pytest
from pyspark.sql import functions as F

from handful.operators import metrics as E
from tests.conftest import rows


@pytest.fixture(scope="module")
def preds(spark):
    rng = random.Random(5)
    # 'd' is never predicted, 'x' is never true
    data = [(i, rng.choice("aabcd"), rng.choice("aabcx"), rng.choice([0.1, 0.2, 0.2, 0.5, 0.9])) for i in range(300)]
    return spark.createDataFrame(data, "row_id long, true_label string, pred_label string, score double")


def brute(preds):
    data = [(r["true_label"], r["pred_label"]) for r in preds.collect()]
    labels = sorted({t for t, _ in data} | {p for _, p in data})
    stats = {}
    for c in labels:
        tp = sum(t == p == c for t, p in data)
        fp = sum(p == c != t for t, p in data)
        fn = sum(t == c != p for t, p in data)
        stats[c] = (tp, fp, fn)
    return data, labels, stats


def test_scores(preds):
    data, labels, stats = brute(preds)
    n = len(data)
    f1 = {c: 2 * tp / (2 * tp + fp + fn) for c, (tp, fp, fn) in stats.items()}
    right = sum(t == p for t, p in data)
    s = E.scores(preds, positive="a").first()
    assert s["accuracy"] == pytest.approx(right / n)
    assert s["macro_f1"] == pytest.approx(sum(f1.values()) / len(labels))
    assert s["micro_f1"] == pytest.approx(right / n)
    assert s["weighted_f1"] == pytest.approx(sum(f1[c] * (stats[c][0] + stats[c][2]) for c in labels) / n)
    assert s["binary_f1"] == pytest.approx(f1["a"])
    t = {c: stats[c][0] + stats[c][2] for c in labels}
    p = {c: stats[c][0] + stats[c][1] for c in labels}
    top = right * n - sum(t[c] * p[c] for c in labels)
    bottom = math.sqrt((n * n - sum(v * v for v in p.values())) * (n * n - sum(v * v for v in t.values())))
    assert s["mcc"] == pytest.approx(top / bottom)


def test_confusion_is_complete_and_sorted(preds):
    data, labels, _ = brute(preds)
    m = E.confusion_matrix(E.confusion(preds)).first()
    assert m["labels"] == labels
    assert m["matrix"] == [[sum((t, p) == (a, b) for t, p in data) for b in labels] for a in labels]


def test_text_order_of_numbers(spark):
    df = spark.createDataFrame([(10, 9), (9, 2)], "true_label int, pred_label int")
    assert E.confusion_matrix(E.confusion(df)).first()["labels"] == [10, 2, 9]


def test_per_class_accuracy_is_null_without_rows(preds):
    got = dict(rows(E.per_class_accuracy(preds)))
    assert got["x"] is None and got["d"] == 0.0


def test_one_class_has_no_correlation(spark):
    df = spark.createDataFrame([("a", "a")] * 3, "true_label string, pred_label string")
    assert E.scores(df).first()["mcc"] == 0.0


def test_average_precision_with_ties(spark):
    rng = random.Random(2)
    data = [(rng.choice([0.1, 0.2, 0.3, 0.35, 0.9]), rng.random() < 0.3) for _ in range(200)]
    df = spark.createDataFrame(data, "score double, is_positive boolean")
    total, want, tp, seen = sum(p for _, p in data), 0.0, 0, 0
    for value in sorted({s for s, _ in data}, reverse=True):
        here = [p for s, p in data if s == value]
        tp, seen = tp + sum(here), seen + len(here)
        want += sum(here) / total * tp / seen
    assert E.average_precision(df).first()[0] == pytest.approx(want)


def test_average_precision_without_positives_or_spread(spark):
    df = spark.createDataFrame([(0.5, False), (0.5, False)], "score double, is_positive boolean")
    assert E.average_precision(df).first()[0] == 0.0


def test_multilabel(spark):
    df = spark.createDataFrame([([0, 0],), ([1, 0],), ([0, 1],), ([1, 1],)], "true_label array<int>")
    s = E.multilabel_scores(df.withColumn("pred_label", F.col("true_label"))).first()
    assert (s["subset_accuracy"], s["micro_f1"], s["macro_f1"]) == (1.0, 1.0, 1.0)


def test_example_based_scores_of_empty_sets(spark):
    df = spark.createDataFrame([([], ["a"]), (["a"], []), (["a", "b"], ["a"])], "true_label array<string>, pred_label array<string>")
    s = E.example_based_prf(df).first()
    assert s["precision"] == pytest.approx(1 / 3) and s["recall"] == pytest.approx(0.5 / 3)


def test_merge_labels(spark):
    df = spark.createDataFrame([("d1_0", "a,b", "a"), ("d1_1", None, "c"), ("d2_0", None, None)], "index string, true_label string, pred_label string")
    assert rows(E.merge_labels_by_document(df)) == [("d1", ["a", "b"], ["a", "c"]), ("d2", [], [])]


def test_groups(spark):
    df = spark.createDataFrame([(1, 0, 1, 1), (1, 1, 0, 1), (2, 0, 1, 1), (3, 0, 0, 1)], "g int, seq int, true_label int, pred_label int")
    assert E.group_exact_match(df, "g").first()[0] == 0.333
    assert E.first_prediction_accuracy(df, "g", "seq").first()[0] == 0.667


def test_alignment_stops_on_lonely_keys(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "b")], "k int, true_label string")
    pred = spark.createDataFrame([(1, "a"), (2, "c")], "k int, pred_label string")
    assert E.align_predictions(gold, pred, "k").count() == 2
    with pytest.raises(Exception, match="key on one side only"):
        E.align_predictions(gold, pred.filter("k = 1"), "k").collect()


def test_word_order(spark):
    plain = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, 0)], "row_id int, true_label int, pred_label int")
    mixed = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "row_id int, pred_label int")
    assert E.word_order_sensitivity(plain, mixed, 2).first()[0] == pytest.approx((100 - 50) / 50)


def test_profiles(spark):
    df = spark.createDataFrame([(1, "x", "one two  three"), (2, "x", "one"), (3, "y", "a b")], "row_id int, label string, text string")
    assert tuple(E.text_profile(df).first()) == (1, pytest.approx(7 / 3), 2.0, 4)
    labels = spark.createDataFrame([("x", "X"), ("z", "Z")], "label_id string, label_name string")
    assert rows(E.label_profile(df, labels)) == [("x", "X", 2), ("z", "Z", 0)]
    assert rows(E.label_examples(df, 1)) == [("x", ["one two  three"]), ("y", ["a b"])]
