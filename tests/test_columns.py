import pytest
from pyspark.sql import functions as F

from handful.functions import cells as L, text as X, vectors as V
from handful.operators import augment as A, columns as C, prompts as Q
from tests.conftest import rows


@pytest.fixture(scope="module")
def mapping_frame(spark):
    return spark.createDataFrame([("a", 0, "x"), ("b", 1, "y"), ("c", 2, "z")], "text_new string, label_new int, extra_column string")


def test_mapping(mapping_frame):
    out = C.apply_column_mapping(mapping_frame, {"text_new": "text", "label_new": "label"})
    assert out.columns == ["text", "label", "feat_extra_column"]


def test_mapping_errors(mapping_frame):
    with pytest.raises(ValueError, match="single split"):
        C.validate_columns({"train": mapping_frame})
    with pytest.raises(ValueError, match="Expected the columns"):
        C.validate_columns(mapping_frame)
    with pytest.raises(ValueError, match="no source"):
        C.validate_columns(mapping_frame, {"text_new": "text"})
    with pytest.raises(ValueError, match="names the columns"):
        C.validate_columns(mapping_frame, {"text_new": "text", "label_new": "label", "gone": "more"})


def test_take_range(spark):
    df = spark.range(20).withColumnRenamed("id", "row_id")
    assert rows(C.take_range(df, 5, 8)) == rows(C.take_range(df, 5, 8, dense=True)) == [(5,), (6,), (7,)]


def test_label_names(spark):
    df = spark.createDataFrame([(0,), (1,), (7,)], "label int")
    assert rows(df.select("label", C.label_name("label", ["no", "yes"]))) == [(0, "no"), (1, "yes"), (7, "7")]


def test_similarity_rounds_half_even(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 1.5, 2.5, 4.6)], "label double")
    assert [r["sim_class"] for r in C.bucket_similarity(df).collect()] == [0, 2, 2, 5]


def test_multi_hot_of_missing_list(spark):
    df = spark.createDataFrame([("a,c",), (None,)], "labels string")
    assert [r[0] for r in df.select(C.multi_hot("labels", ["a", "b", "c"])).collect()] == [[1, 0, 1], [0, 0, 0]]


def test_default_ordinal(spark):
    df = spark.createDataFrame([("t", "s")], "text string, span string")
    assert C.with_default_ordinal(df).first()["ordinal"] == 0
    for bad in (df.drop("span"), df.withColumn("pred_polarity", F.lit("x"))):
        with pytest.raises(ValueError):
            C.with_default_ordinal(bad)


def test_templates(spark):
    made = A.templated_dataset(spark, candidate_labels=["label-0", "label-1"], template="this sentence is {}", multi_label=True)
    want = [("this sentence is label-0", [1, 0])] * 2 + [("this sentence is label-1", [0, 1])] * 2
    assert rows(made) == sorted(want)
    given = spark.createDataFrame([("one", [1, 0]), ("two", [0, 1])], "text string, label array<int>")
    both = A.templated_dataset(spark, given, ["label-0", "label-1"], multi_label=True)
    assert both.count() == 6
    with pytest.raises(ValueError):
        A.templated_dataset(spark, given.drop("label"), ["a"])
    with pytest.raises(ValueError):
        A.templated_dataset(spark)


def test_candidate_labels_are_paired_by_id(spark):
    df = spark.createDataFrame([(3, 1, "b"), (1, 1, "first"), (2, 0, "zero")], "row_id int, label int, label_text string")
    assert rows(A.candidate_labels(df)) == [(0, "zero"), (1, "first")]


def test_error_driven(spark):
    errors = spark.createDataFrame([(0, 1)] * 2 + [(0, 2)] + [(1, 0)], "true_label int, pred_label int")
    out = A.error_driven_synthetic(errors, ["sad", "glad", "mad"], per_error=2, cap=4).orderBy("label", "sample_idx").collect()
    assert [r["label"] for r in out] == [0] * 4 + [1] * 2
    assert out[0]["text"] == "Synthetic hard example for class 'sad': the correct label is 'sad', not 'glad, mad'."
    assert out[3]["text"] == out[0]["text"]
    assert A.error_driven_synthetic(errors.limit(0)).count() == 0


def test_random_synthetic_and_budgets(spark):
    out = A.random_synthetic(spark, [1, 0], 7, seed=1, names=["n", "p"])
    assert out.count() == 7 and {r["label"] for r in out.collect()} <= {0, 1}
    assert A.random_synthetic(spark, [0], 0, seed=1).count() == 0
    assert A.synthetic_budget(10, 0.25) == 2 and A.synthetic_budget(10, 3.0) == 10
    assert spark.range(1).select(A.random_budget(F.lit(5), 0.5)).first()[0] == 2
    rows_ = spark.createDataFrame([(i, "t", i % 2) for i in range(10)], "row_id long, text string, label int")
    assert A.cap_synthetic(rows_, 8, 0.0, 1).count() == 0
    assert A.cap_synthetic(rows_, 8, 0.5, 1).count() == 4
    assert A.cap_synthetic(rows_, 80, 1.0, 1, per_class=2).count() == 4
    assert A.augment_train(rows_.limit(3), rows_, 3).count() == 6


def test_shuffle_words_keeps_the_words(spark):
    df = spark.createDataFrame([(1, "a b  c a"), (2, "one")], "row_id long, text string")
    for r in df.withColumn("s", A.shuffle_words("text", 3, "row_id")).collect():
        assert sorted(r["s"].split(" ")) == sorted(r["text"].split(" "))


def test_patterns(spark):
    df = spark.createDataFrame([("x [LBL]", "y", "good", 1)], "TEXT1 string, TEXT2 string, label_text string, label int")
    assert Q.apply_pattern(df.withColumn("TEXT1", F.lit("x")), "[TEXT1] and [TEXT2] are [LBL]").first()["prompt"] == "x and y are good"
    grid = Q.pattern_label_grid(df, "[TEXT1] this is [LBL]", ["bad", "good"])
    assert [r["is_true"] for r in grid.orderBy("lbl").collect()] == [False, True]
    for bad in ("no text [LBL]", "[TEXT1] none", "[TEXT1] [LBL] [LBL]", "[TEXT2] [LBL]"):
        with pytest.raises(ValueError):
            Q.check_pattern(bad)


def test_mirror(spark):
    df = spark.createDataFrame([(1, "a", "b", 0)], "idx int, choice1 string, choice2 string, label int")
    assert rows(Q.mirror_choices(df)) == [(1, "a", "b", 0, False), (1, "b", "a", 1, True)]


def test_cells(spark):
    df = spark.createDataFrame([("4.0",), ("",), (" x ",), (None,), ("007",), ("1e3",)], "c string")
    got = df.select(L.safe_float("c"), L.safe_int("c"), L.clean_scalar("c")).collect()
    assert [tuple(r) for r in got] == [
        (4.0, "4.0", "4"), (None, None, ""), (None, " x ", "x"), (None, None, ""), (7.0, "7", "007"), (1000.0, "1e3", "1e3"),
    ]


def test_names_and_paths(spark):
    df = spark.createDataFrame([("Random Augmentation", "r/ag-news/8-shot/seed_3/augmented.json"), (None, "r/x/augmented.json"), ("?", "a.csv")], "m string, f string")
    assert [r[0] for r in df.select(L.normalize_method("m", "f")).collect()] == ["random_aug", "error_driven", None]
    assert tuple(df.select(L.parse_path("f")).first()[0]) == ("ag_news", "8", "3", "augmented")
    log = spark.createDataFrame([("logs/SST-2_run_shot16_x_seed7.log",), ("other.log",)], "f string")
    assert [tuple(r[0]) for r in log.select(L.parse_log_name("f")).collect()] == [("SST_2", "16", "7"), ("", "", "")]


def test_text_helpers(spark):
    df = spark.createDataFrame([("aaaa", "aa", 0), ("aaaa", "aa", 1), ("aaaa", "aa", 2), ("aaaa", "aa", 3), ("abc", "x", 0)], "t string, n string, k int")
    assert [r[0] for r in df.select(X.nth_occurrence("t", "n", "k", True)).collect()] == [0, 1, 2, None, None]
    assert [r[0] for r in df.select(X.nth_occurrence("t", "n", "k", False)).collect()] == [0, 2, None, None, None]
    answers = spark.createDataFrame([("The cat, the cat!", "a cat sat"), ("dog", "cat"), ("", "")], "p string, g string")
    assert [round(r[0], 6) for r in answers.select(X.token_f1("p", "g")).collect()] == [0.5, 0.0, 0.0]
    assert [r[0] for r in spark.range(1).select(X.format_score(F.lit(1.23456))).collect()] == ["1.235"]
    many = spark.createDataFrame([([str(i) for i in range(32)] + ["", "5"],)], "v array<string>")
    assert many.select(X.unique_join("v", 30)).first()[0].endswith(";...(+2)")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0, 5.0, 5.0])], "a array<double>, z array<double>, s array<double>")
    r = df.select(V.l2_normalize("a"), V.l2_normalize("z"), V.cosine("a", "z"), V.cosine("a", "a"), V.argmax("s"), V.softmax("s")).first()
    assert r[0] == [0.6, 0.8] and r[1] == [0.0, 0.0] and r[2] == 0.0 and r[3] == pytest.approx(1.0) and r[4] == 1
    assert sum(r[5]) == pytest.approx(1.0) and r[5][1] == r[5][2]
    tokens = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1.0, 1.0, 0.0])], "t array<array<double>>, m array<double>")
    assert tokens.select(V.mean_pool("t", "m")).first()[0] == [2.0, 3.0]
