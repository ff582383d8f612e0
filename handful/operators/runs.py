"""Run analytics: deduplication, summaries, comparisons, audits.

A run row is (dataset, sample_size, seed, iteration, split, method, accuracy,
macro_f1, result_file).  Every operator groups map-side; windows only see the
handful of methods of one run or already grouped rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from handful.functions.cells import METHODS
from handful.functions.order import quantiles, unique_lists

CELL = ["dataset", "sample_size", "split"]
# The columns of the raw run table, in order.
RAW_FIELDS = [
    "dataset", "sample_size", "seed", "iteration", "split", "method", "accuracy", "macro_f1",
    "delta_vs_vanilla", "delta_vs_random_aug", "per_class_accuracy_delta", "result_file",
]
_VERSUS = [("random_aug", "vanilla"), ("error_driven", "vanilla"), ("error_driven", "random_aug")]


def run_id() -> Column:
    """Seed of a run, or its iteration where there is no seed."""
    return F.coalesce(F.col("seed").cast("string"), F.col("iteration").cast("string"))


def sample_std(value) -> Column:
    """Sample deviation; 0 for a single value, NULL for none."""
    return F.when(F.count(value) == 1, F.lit(0.0)).otherwise(F.stddev_samp(value))


def _with_split(runs: DataFrame) -> DataFrame:
    return runs if "split" in runs.columns else runs.withColumn("split", F.lit(""))


def dedupe_runs(runs: DataFrame, order: Sequence[str] = ("result_file", "position")) -> DataFrame:
    """One row per run and method: the first that is not from a CSV file, else the first."""
    csv = F.col("result_file").endswith(".csv").cast("int")
    keyed = runs.withColumn("_run", run_id())
    best = F.min_by(F.struct(*runs.columns), F.struct(csv, *[F.col(c) for c in order]))
    return (
        keyed.groupBy("dataset", "sample_size", "_run", "split", "method").agg(best.alias("_best")).select("_best.*")
    )


def latest_runs(records: DataFrame, order: Sequence[str] = ("source_file", "position"), shot: str = "sample_size") -> DataFrame:
    """One row per (dataset, shot, seed, method): the one of the last file."""
    last = F.max_by(F.struct(*records.columns), F.struct(*[F.col(c) for c in order]))
    return records.groupBy("dataset", shot, "seed", "method").agg(last.alias("_last")).select("_last.*")


def _of(method: str, value: str, window: Window) -> Column:
    return F.max(F.when(F.col("method") == method, F.col(value))).over(window)


def method_deltas(runs: DataFrame) -> DataFrame:
    """Accuracy of each run minus that of the vanilla and of the random-augmented run beside it."""
    beside = Window.partitionBy("dataset", "sample_size", run_id(), "split")
    return runs.withColumn("delta_vs_vanilla", F.col("accuracy") - _of("vanilla", "accuracy", beside)).withColumn(
        "delta_vs_random_aug", F.col("accuracy") - _of("random_aug", "accuracy", beside)
    )


def raw_wide(records: DataFrame) -> DataFrame:
    """Each run with the accuracies of the three methods beside it and its gain over vanilla."""
    beside = Window.partitionBy("dataset", "sample_size", "seed")
    wide = records
    for m in METHODS:
        wide = wide.withColumn(f"{m}_accuracy", _of(m, "accuracy", beside))
    return wide.withColumn("accuracy_delta", F.col("accuracy") - F.col("vanilla_accuracy")).withColumn(
        "macro_f1_delta", F.col("macro_f1") - _of("vanilla", "macro_f1", beside)
    )


def per_class_delta(classes: DataFrame, runs: Sequence[str], baseline: str = "vanilla") -> DataFrame:
    """Accuracy of every class minus the baseline's: (runs..., method, label, delta), NULL if a side lacks it.

    ``classes`` is (runs..., method, label, accuracy).  Classes of both sides are kept.
    """
    runs = list(runs)
    base = classes.filter(F.col("method") == baseline).select(*runs, "label", F.col("accuracy").alias("_base"))
    methods = classes.select(*runs, "method").distinct()
    wanted = methods.join(base.select(*runs, "label"), runs).union(classes.select(*runs, "method", "label")).distinct()
    return (
        wanted.join(classes, [*runs, "method", "label"], "left")
        .join(base, [*runs, "label"], "left")
        .select(*runs, "method", "label", (F.col("accuracy") - F.col("_base")).alias("delta"))
    )


def summarize(runs: DataFrame) -> DataFrame:
    """Run count, mean and sample deviation per (dataset, size, split, method), with the three mean deltas."""
    grouped = (
        _with_split(runs)
        .groupBy(*CELL, "method")
        .agg(
            F.count(F.lit(1)).alias("n_runs"),
            F.avg("accuracy").alias("accuracy_mean"),
            sample_std("accuracy").alias("accuracy_std"),
            F.avg("macro_f1").alias("macro_f1_mean"),
            sample_std("macro_f1").alias("macro_f1_std"),
        )
    )
    cell = Window.partitionBy(*CELL)
    mean = {m: _of(m, "accuracy_mean", cell) for m in METHODS}
    return grouped.select(
        "*",
        (mean["error_driven"] - mean["vanilla"]).alias("delta_error_driven_vs_vanilla"),
        (mean["random_aug"] - mean["vanilla"]).alias("delta_random_aug_vs_vanilla"),
        (mean["error_driven"] - mean["random_aug"]).alias("delta_error_driven_vs_random_aug"),
    )


def compare(runs: DataFrame) -> DataFrame:
    """One row per (dataset, size, split): three methods x mean and deviation x two metrics, and six deltas."""
    wanted = []
    for metric in ("accuracy", "macro_f1"):
        for m in METHODS:
            value = F.when(F.col("method") == m, F.col(metric))
            wanted += [F.avg(value).alias(f"{m}_{metric}_mean"), sample_std(value).alias(f"{m}_{metric}_std")]
    counts = [F.count(F.when(F.col("method") == m, 1)) for m in METHODS]
    grouped = _with_split(runs).groupBy(*CELL).agg(F.greatest(*counts).alias("n_runs"), *wanted)
    deltas = [
        (F.col(f"{a}_{metric}_mean") - F.col(f"{b}_{metric}_mean")).alias(f"{a}_vs_{b}_{metric}_delta")
        for metric in ("accuracy", "macro_f1")
        for a, b in _VERSUS
    ]
    return grouped.select("*", *deltas)


def metrics_long(runs: DataFrame) -> DataFrame:
    """Mean and deviation per (dataset, size, method, metric)."""
    long = runs.select("dataset", "sample_size", "method", "accuracy", "macro_f1").unpivot(
        ["dataset", "sample_size", "method"], ["accuracy", "macro_f1"], "metric", "value"
    )
    return long.groupBy("dataset", "sample_size", "method", "metric").agg(
        F.avg("value").alias("mean"), sample_std("value").alias("std")
    )


def shot_scaling(runs: DataFrame) -> DataFrame:
    """Gain in mean accuracy from each shot to the next."""
    means = runs.groupBy("dataset", "method", "sample_size").agg(F.avg("accuracy").alias("_mean"))
    order = Window.partitionBy("dataset", "method").orderBy("sample_size")
    return (
        means.select(
            "dataset",
            "method",
            F.lag("sample_size").over(order).alias("from_shot"),
            F.col("sample_size").alias("to_shot"),
            (F.col("_mean") - F.lag("_mean").over(order)).alias("mean_accuracy_delta"),
        )
        .filter("from_shot is not null")
    )


def seed_medians(scores: DataFrame, by: Sequence[str] = ("dataset", "sample_size", "split_idx"), score: str = "score") -> DataFrame:
    """Median and interquartile range of score x100 over seeds."""
    value = F.col(score) * 100
    return scores.groupBy(*by).agg(
        F.median(value).alias("score"), (F.percentile(value, 0.75) - F.percentile(value, 0.25)).alias("iqr")
    )


def score_table(scores: DataFrame, sizes: Sequence[int], score: str = "score") -> DataFrame:
    """Per dataset the mean and population deviation of every size; the 'Average' row averages those."""
    cells = scores.groupBy("dataset", "sample_size").agg(
        F.max("measure").alias("measure"), F.avg(score).alias("_avg"), F.stddev_pop(score).alias("_std")
    )

    def spread(frame: DataFrame, key: Column, measure: Column) -> DataFrame:
        columns = []
        for size in sizes:
            here = F.col("sample_size") == size
            columns += [
                F.avg(F.when(here, F.col("_avg"))).alias(f"{size}_avg"),
                F.avg(F.when(here, F.col("_std"))).alias(f"{size}_std"),
            ]
        return frame.groupBy(key.alias("dataset")).agg(measure.alias("measure"), *columns)

    rows = spread(cells, F.col("dataset"), F.max("measure"))
    return rows.unionByName(spread(cells, F.lit("Average"), F.lit("N/A")))


def seed_stats(scores: DataFrame, by: Sequence[str], n_classes: str = "n_classes") -> DataFrame:
    """Mean and population deviation over seeds, to 10 digits; average precision only for two classes."""
    columns = []
    for name in ("acc", "f1_mic", "f1_mac", "avg_pre", "logit_ap"):
        value = F.col(name)
        if name in ("avg_pre", "logit_ap"):
            value = F.when(F.col(n_classes) <= 2, value)
        columns += [F.round(F.avg(value), 10).alias(f"mean_{name}"), F.round(F.stddev_pop(value), 10).alias(f"{name}_std")]
    return scores.groupBy(*by).agg(*columns)


def box_stats(scores: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """Smallest, quartiles and largest."""
    q = F.percentile(score, F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    names = ["low", "q1", "median", "q3", "high"]
    return scores.groupBy(*by).agg(q.alias("_q")).select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def latency_stats(times: DataFrame, seconds: str = "latency_s", by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, 95th percentile and total of a timing table of any length."""
    by = list(by)
    plain = times.groupBy(*by).agg(
        F.avg(seconds).alias("mean_s"), F.stddev_pop(seconds).alias("std_s"), F.sum(seconds).alias("total_s")
    )
    high = quantiles(times, seconds, [0.95], by).withColumnRenamed("q0", "p95_s")
    if not by:
        return plain.withColumn("p95_s", high.scalar()).select("mean_s", "std_s", "p95_s", "total_s")
    return plain.join(high, by).select(*by, "mean_s", "std_s", "p95_s", "total_s")


def seed_coverage(runs: DataFrame, required: Sequence[int]) -> DataFrame:
    """Seeds seen per dataset and shot over all methods, with a flag per required count."""
    seen = runs.filter(F.col("seed").isNotNull()).groupBy("dataset", "sample_size").agg(
        F.count_distinct("seed").alias("seeds")
    )
    return seen.select("*", *[(F.col("seeds") >= n).alias(f"has_{n}") for n in required])


def missing_runs(runs: DataFrame, limit: int = 30) -> DataFrame:
    """Methods with fewer seeds than the best covered method of the same dataset and shot.

    The seeds are listed up to ``limit``, with the number of the others.
    """
    cell = ["dataset", "sample_size", "method"]
    seen = unique_lists(runs.filter(F.col("seed").isNotNull()), cell, ["seed"], limit)
    most = F.max("n_seed").over(Window.partitionBy("dataset", "sample_size"))
    return seen.select(*cell, F.col("n_seed").alias("runs"), most.alias("expected"), F.col("seed").alias("seeds")).filter(
        "runs < expected"
    )


def pending_runs(grid: DataFrame, done: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """Grid cells (dataset, sample_size, seed) in which some method has no result yet."""
    named = F.when(F.col("method") == "augmented", "error_driven").otherwise(F.col("method"))
    full = (
        done.withColumn("_m", named)
        .filter(F.col("_m").isin(*methods))
        .groupBy("dataset", "sample_size", "seed")
        .agg(F.count_distinct("_m").alias("_n"))
        .filter(F.col("_n") == len(methods))
    )
    return grid.join(full, ["dataset", "sample_size", "seed"], "left_anti")


def run_inventory(runs: DataFrame) -> DataFrame:
    """Runs per file, dataset, shot and method, and whether the rows name a seed."""
    return (
        runs.filter("dataset <> '' and sample_size is not null and method <> ''")
        .groupBy("result_file", "dataset", "sample_size", "method")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.bool_or(F.col("seed").isNotNull()).alias("has_seed"))
    )


# An old results folder, temporary folders and the age that makes a file stale.
OLD_FOLDER = "scripts/results/"
STALE_DAYS = 7


def stale_files(files: DataFrame, days: int = STALE_DAYS, path: str = "path", mtime: str = "mtime") -> DataFrame:
    """Files (path, mtime) with the reasons why they look old, '; '-joined and '' if there are none."""
    newest = files.agg(F.max(mtime).alias("m")).scalar()
    late = F.col("_newest").cast("double") - F.col(mtime).cast("double") > days * 86400
    reasons = F.concat_ws(
        "; ",
        F.when(F.col(path).startswith(OLD_FOLDER), "under scripts/results"),
        F.when(F.col(path).contains("/tmp/") | F.col(path).startswith("tmp/"), "temporary path"),
        F.when(late, F.lit(f">{days} days older than newest scanned result")),
    )
    return files.withColumn("_newest", newest).withColumn("old_reason", reasons).drop("_newest")
