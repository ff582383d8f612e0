from collections import Counter

import pytest
from pyspark.sql import functions as F

from handful.operators import pairs as P
from tests.conftest import rows


@pytest.fixture(scope="module")
def three(spark):
    return spark.createDataFrame([(1, "l1"), (2, "l1"), (3, "l2")], "row_id long, label string")


@pytest.fixture(scope="module")
def four(spark):
    data = [(1, [1, 0, 0, 1]), (2, [0, 1, 1, 0]), (3, [0, 0, 1, 0]), (4, [0, 0, 0, 1])]
    return spark.createDataFrame(data, "row_id long, label array<int>")


def sides(df):
    counts = Counter(r["label"] for r in df.collect())
    return counts[1.0], counts[0.0]


@pytest.mark.parametrize("strategy,expected", [("unique", (4, 2)), ("undersampling", (2, 2)), ("oversampling", (4, 4))])
def test_pair_counts(three, strategy, expected):
    assert sides(P.balance_pairs(P.contrastive_pairs(three), strategy)) == expected


@pytest.mark.parametrize("strategy,expected", [("unique", (6, 4)), ("undersampling", (4, 4)), ("oversampling", (6, 6))])
def test_multilabel_pair_counts(four, strategy, expected):
    assert sides(P.balance_pairs(P.contrastive_pairs(four, multilabel=True), strategy)) == expected


def test_pairs_are_all_unordered_pairs(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(40)], "row_id long, label int")
    got = rows(P.contrastive_pairs(df, tiles=5))
    want = sorted((a, b, 1.0 if a % 3 == b % 3 else 0.0) for a in range(40) for b in range(a, 40))
    assert got == want
    assert rows(P.positive_pairs(df)) == [p for p in want if p[2] == 1.0]


def test_alternation_and_recycling(three):
    out = P.balance_pairs(P.contrastive_pairs(three), "oversampling").orderBy("pair_ix").collect()
    assert [r["pair_ix"] for r in out] == list(range(8))
    assert [r["label"] for r in out] == [1.0, 0.0] * 4
    negatives = [(r["id_1"], r["id_2"]) for r in out if r["label"] == 0.0]
    assert negatives[:2] == negatives[2:]


def test_iterations(three):
    assert sides(P.balance_pairs(P.contrastive_pairs(three), n_per_side=15)) == (15, 15)


def test_empty_side_gives_none(spark):
    one = spark.createDataFrame([(1, "a"), (2, "a")], "row_id long, label string")
    for strategy in ("unique", "oversampling"):
        assert sides(P.balance_pairs(P.contrastive_pairs(one), strategy)) == (3, 0)
    assert sides(P.balance_pairs(P.contrastive_pairs(one), "undersampling")) == (0, 0)


def test_bad_strategy_and_too_many_rows(three):
    with pytest.raises(ValueError):
        P.balance_pairs(P.contrastive_pairs(three), "any")
    with pytest.raises(ValueError):
        P.contrastive_pairs(three, limit=2)


def test_cap(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "row_id long, label int")
    pairs = P.contrastive_pairs(df)
    assert sides(P.cap_pairs(pairs, 30)) == (15, 15)
    assert P.cap_pairs(pairs, -1).count() == pairs.count()


def test_no_cartesian_product(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "row_id long, label int")
    for pairs in (P.positive_pairs(df), P.contrastive_pairs(df), P.drawn_pairs(df, 2)):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_whole_table_counts(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(40)], "row_id long, label int")
    counts = P.pair_counts(df).first()
    assert (counts["n_positive"], counts["n_negative"]) == sides(P.contrastive_pairs(df))


def test_drawn_pairs_with_a_dominant_class(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 20 == 0, "small").otherwise("big").alias("label"))
    drawn = P.drawn_pairs(df, 2).cache()
    assert sides(drawn) == (6000, 6000)
    named = drawn.join(df.toDF("id_1", "l1"), "id_1").join(df.toDF("id_2", "l2"), "id_2")
    assert named.filter("(label = 1.0) <> (l1 = l2)").count() == 0
    # partners spread over the class instead of piling up on a few rows
    most = drawn.filter("label = 1.0").groupBy("id_2").count().agg(F.max("count")).first()[0]
    assert most < 20


def test_drawn_pairs_of_one_class(spark):
    df = spark.createDataFrame([(i, "a") for i in range(10)], "row_id long, label string")
    assert sides(P.drawn_pairs(df, 3)) == (30, 0)


def test_teacher_pairs_carry_their_own_cosine(spark):
    data = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0])]
    df = spark.createDataFrame(data, "row_id long, embedding array<double>")
    got = {(r["id_1"], r["id_2"]): round(r["label"], 6) for r in P.teacher_pairs(df).collect()}
    assert got == {(1, 1): 1.0, (2, 2): 1.0, (3, 3): 1.0, (1, 2): 0.0, (1, 3): 0.707107, (2, 3): 0.707107}


def test_cosine_pair_loss(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.2, 0.0)], "similarity double, label double")
    assert P.cosine_pair_loss(df).first()[0] == pytest.approx((0.25 + 0.04) / 2)
