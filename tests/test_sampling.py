import pytest
from pyspark.sql import functions as F

from handful.functions.order import draw_key, exact_rank, first_per_group, take_first
from handful.operators import sampling as S
from tests.conftest import rows


def labelled(spark, counts):
    data = [(i, label) for i, label in enumerate(x for label, n in counts.items() for x in [label] * n)]
    return spark.createDataFrame(data, "row_id long, label int")


@pytest.mark.parametrize("n", [8, 16, 32])
def test_balanced_counts(spark, n):
    out = S.sample_per_class(labelled(spark, {0: 50, 1: 50}), n=n)
    assert rows(S.class_counts(out)) == [(0, n), (1, n)]


def test_small_and_unbalanced_classes(spark):
    assert S.sample_per_class(labelled(spark, {0: 3, 1: 3}), n=8).count() == 6
    assert rows(S.class_counts(S.sample_per_class(labelled(spark, {0: 1, 1: 51}), n=8))) == [(0, 1), (1, 8)]


def test_string_labels(spark):
    df = spark.createDataFrame([(i, "a b" if i % 2 else "it's") for i in range(20)], "row_id long, label string")
    assert S.sample_per_class(df, n=3).count() == 6


def test_grid(spark):
    grid = S.fewshot_splits(labelled(spark, {0: 50, 1: 50}))
    counts = rows(grid.groupBy("sample_size", "split_idx").agg(F.count_distinct("row_id"), F.count("*")))
    assert len(counts) == 60
    assert all(c[2] == c[3] == min(2 * c[0], 100) for c in counts)
    # a cell is what sampling alone gives for its size and seed
    one = S.sample_per_class(labelled(spark, {0: 50, 1: 50}), n=16, seed=3)
    assert rows(grid.filter("sample_size = 16 and seed = 3"), "row_id", "label") == rows(one, "row_id", "label")


def test_multilabel_grid_without_row_id(spark):
    data = [(f"t{i % 25}", i % 2, (i // 2) % 2, i % 3 == 0) for i in range(50)]
    df = spark.createDataFrame([(t, a, b, int(c)) for t, a, b, c in data], "text string, a int, b int, c int")
    grid = S.fewshot_splits_multilabel(df, ["a", "b", "c"], sizes=[2, 4], row_id=None)
    assert grid.count() == grid.distinct().count()
    per_label = grid.groupBy("sample_size", "seed").agg(*[F.sum(c).alias(c) for c in "abc"]).collect()
    assert len(per_label) == 20 and all(r[c] >= r["sample_size"] for r in per_label for c in "abc")


def test_partitioning_does_not_matter(spark):
    df = labelled(spark, {0: 40, 1: 70, 2: 5})
    one = rows(S.fewshot_splits(df.repartition(1), [4, 8], [1, 2]), "sample_size", "seed", "row_id", "label")
    many = rows(S.fewshot_splits(df.repartition(64), [4, 8], [1, 2]), "sample_size", "seed", "row_id", "label")
    assert one == many


def test_sampling_trims_before_the_shuffle(spark):
    plan = S.sample_per_class(labelled(spark, {0: 50, 1: 50}))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_dominant_class_with_large_n(spark):
    df = spark.range(20000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 20 == 0, 1).otherwise(0).alias("label"))
    salted = S.sample_per_class(df, n=1200, seed=5)
    expected = first_per_group(df.withColumn("k", draw_key(5, "row_id")), ["label"], ["k", "row_id"], 900)
    assert rows(S.class_counts(salted)) == [(0, 1200), (1, 1000)]
    assert set(rows(expected, "row_id")) <= set(rows(salted, "row_id"))


def test_exact_rank_and_take_first(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id")
    ranked = exact_rank(df, draw_key(1, "row_id"), ["row_id"]).collect()
    assert sorted(r["rank"] for r in ranked) == list(range(5000))
    small = rows(take_first(df, draw_key(1, "row_id"), ["row_id"], 700))
    sliced = rows(take_first(df, draw_key(1, "row_id"), ["row_id"], 700, driver_rows=10))
    assert small == sliced and len(small) == 700


@pytest.mark.parametrize("size,expected", [(200, {0: 5, 1: 30, 2: 60}), (30, {0: 5, 1: 13, 2: 12}), (7, {0: 3, 1: 2, 2: 2}), (2, {0: 1, 1: 1})])
def test_balanced_downsample(spark, size, expected):
    out = S.balanced_downsample(labelled(spark, {0: 5, 1: 30, 2: 60}), size, seed=1)
    counts = dict(rows(S.class_counts(out)))
    assert sum(counts.values()) == min(size, 95)
    if size != 30:
        assert counts == expected
    else:  # the five places the small class leaves go to whoever comes first in the seeded order
        assert counts[0] == 5 and counts[1] >= 10 and counts[2] >= 10


def test_downsample_cells_agrees_with_single_cells(spark):
    df = labelled(spark, {0: 5, 1: 30, 2: 60})
    cells = df.withColumn("cell", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("_m", F.when(F.col("cell") == 1, 12).otherwise(50))
    out = S.downsample_cells(cells, F.col("_m"), ["cell"], F.lit("9"))
    for cell, size in ((1, 12), (2, 50)):
        assert rows(out.filter(F.col("cell") == cell), "row_id") == rows(S.balanced_downsample(df, size, seed=9), "row_id")


def test_bounded_and_direct_ranking_agree(spark):
    df = spark.range(60000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, 1).when(F.col("id") < 9, 2).alias("label")
    )
    for n in (1, 8, 300):
        direct = rows(S.sample_per_class(df, n=n, seed=4))
        assert rows(S.sample_per_class(df, n=n, seed=4, direct_rows=0)) == direct
        assert {r[1] for r in direct} == {0, 1, 2}
    direct = rows(S.fewshot_splits(df, [2, 16], [3, 1]))
    assert rows(S.fewshot_splits(df, [2, 16], [3, 1], direct_rows=0)) == direct
    bounded = S.fewshot_splits(df, [2, 16], [3, 1], direct_rows=0)
    assert "Join" not in bounded._jdf.queryExecution().executedPlan().toString().split("InMemory")[0]


def test_too_narrow_bounds_are_noticed(spark, monkeypatch):
    df = spark.range(20000).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("label"))
    direct = rows(S.sample_per_class(df, n=50))
    first = S.train_test_split_exact(df, 5000)
    monkeypatch.setattr(S, "slack", lambda n: -0.5 * n)
    monkeypatch.setattr("handful.functions.order.slack", lambda n: -0.5 * n)
    assert rows(S.sample_per_class(df, n=50, direct_rows=0)) == direct
    assert rows(S.train_test_split_exact(df, 5000)) == rows(first)


def test_large_uniform_sample(spark, monkeypatch):
    df = spark.range(20000).withColumnRenamed("id", "row_id").withColumn("x", F.col("row_id") * 2)
    small = rows(S.sample_uniform(df, 3000, 8))
    monkeypatch.setattr(S, "SMALL_SAMPLE", 10)
    large = S.sample_uniform(df, 3000, 8)
    assert rows(large) == small and "Exchange" not in large._jdf.queryExecution().executedPlan().toString()


def test_train_test_split(spark):
    df = spark.range(10000).withColumnRenamed("id", "row_id")
    share = S.train_test_split(df, 0.2).agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert abs(share - 0.2) < 0.02
    for n in (0, 1234, 10000):
        assert S.train_test_split_exact(df, n).filter("is_test").count() == n


def test_imbalance_flag(spark):
    flag = lambda counts: S.imbalance_report(labelled(spark, counts)).first()["imbalanced"]
    assert flag({0: 10, 1: 16}) and not flag({0: 10, 1: 15})


def test_language_regimes(spark):
    df = spark.createDataFrame(
        [(i, lang, i % 2) for i, lang in enumerate(["en", "de"] * 20)], "row_id long, lang string, label int"
    )
    for kind in ("each", "en", "all"):
        out = S.language_regimes(df, kind, ["de", "en"], [2], [0])
        assert {r[0] for r in out.select("test_lang").collect()} == {"de", "en"}
    each = S.language_regimes(df, "each", ["de", "en"], [2], [0]).join(df.select("row_id", "lang"), "row_id")
    assert each.filter("lang <> test_lang").count() == 0
    with pytest.raises(ValueError):
        S.language_regimes(df, "none", ["de"])
