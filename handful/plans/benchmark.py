"""The few-shot benchmark: vanilla, random-augmented and error-driven training over a whole grid.

Grid cells (sample size, seed) and methods are columns, so every phase is one job over all
cells.  Errors are taken on the test rows and feed the error-driven training rows; this
leak is part of the method and is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from handful.operators import augment as A, metrics as E
from handful.operators.columns import label_name
from handful.operators.heads import fit_cells
from handful.operators.runs import pending_runs
from handful.operators.sampling import downsample_cells, fewshot_splits
from handful.operators.scoring import class_means, embed, grid_confusion, load_head
from handful.session import cut_lineage, join_checked

CELL = ["sample_size", "seed"]
# Which templates each method trains on.
STRATEGY_NAMES = {"vanilla": "none", "random_aug": "random_label_template", "error_driven": "error_driven_template"}


def _heads(train: DataFrame, by: Sequence[str], head: str) -> DataFrame:
    if head == "logistic":
        return fit_cells(train, by)
    if head == "means":
        return class_means(train, by)
    raise ValueError("head is 'logistic' or 'means'")


def _limit_synthetic(rows: DataFrame, sizes: DataFrame, ratio: float, per_class: int | None) -> DataFrame:
    """Cut synthetic rows of every cell: first to ``per_class`` times its classes, then to its budget."""
    keyed = rows.withColumn("row_id", F.concat(F.lit("s"), F.col("label").cast("string"), F.lit("-"), "sample_idx"))
    if per_class is not None:
        classes = keyed.groupBy(*CELL).agg((F.count_distinct("label") * per_class).cast("int").alias("_cap"))
        keyed = downsample_cells(keyed.join(classes, CELL), F.col("_cap"), CELL, F.col("seed")).drop("_cap")
    budget = F.least("n_train", F.floor(F.col("n_train") * F.lit(float(ratio)))).cast("int")
    limits = sizes.select(*CELL, budget.alias("_budget")).filter("_budget > 0")
    return downsample_cells(keyed.join(limits, CELL), F.col("_budget"), CELL, F.col("seed")).drop("_budget")


def fewshot_benchmark(
    train: DataFrame,
    test: DataFrame,
    dataset: str,
    encoder: Callable | None = None,
    sizes: Sequence[int] = (4, 8, 16),
    seeds: Sequence[int] = tuple(range(10)),
    names: Sequence[str] | dict = (),
    head: str = "logistic",
    per_error: int = 1,
    max_per_class: int = 5,
    synthetic_ratio: float = 0.5,
    random_multiplier: float = 1.0,
    max_train: int | None = None,
    per_class: int | None = None,
    done: DataFrame | None = None,
    dim: int = 256,
) -> dict[str, DataFrame]:
    """Run the benchmark on (row_id, text, label) tables.

    Returns the ``confusion`` counts of all runs by (sample_size, seed, method), the
    ``synthetic`` rows and the ``runs`` table (dataset, sample_size, seed, method, accuracy,
    macro_f1, score).  Cells whose three methods are in ``done`` are left out.
    """
    splits = fewshot_splits(train.select("row_id", "label"), sizes, seeds).select(*CELL, "row_id", "label")
    if done is not None:
        grid = splits.select(F.lit(dataset).alias("dataset"), *CELL).distinct()
        splits = splits.join(pending_runs(grid, done).select(*CELL), CELL, "left_semi")
    splits = cut_lineage(splits)

    # training texts are few: one row per sampled id, however often it is drawn
    texts = join_checked(train.select("row_id", "text"), splits.select("row_id").distinct(), "row_id", "left_semi")
    vectors = cut_lineage(embed(texts, encoder, dim=dim))
    core = splits.join(vectors, "row_id").withColumn("row_id", F.col("row_id").cast("string"))
    core = core.select(*CELL, "row_id", "label", "text", "embedding")

    # the test rows are embedded once and read back for both prediction passes
    scored = cut_lineage(embed(test, encoder, dim=dim).select("row_id", F.col("label").alias("true_label"), "embedding"))

    def confusion_of(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        heads = load_head(_heads(rows, by, head), by)
        return cut_lineage(grid_confusion(scored, heads))

    vanilla = confusion_of(core, CELL)

    wrong = vanilla.filter(F.col(E.TRUE) != F.col(E.PRED)).withColumnRenamed("n", "_times")
    error_rows = _error_synthetic(wrong, names, per_error, max_per_class)
    counts = core.groupBy(*CELL).agg(F.count(F.lit(1)).cast("int").alias("n_train"))
    error_synthetic = _limit_synthetic(error_rows, counts, synthetic_ratio, per_class)

    budget = error_synthetic.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n"))
    labels = [r[0] for r in core.select("label").distinct().collect()]
    random_rows = A.random_synthetic_cells(budget, labels, A.random_budget("_n", random_multiplier), CELL, names)
    random_synthetic = _limit_synthetic(random_rows, counts, synthetic_ratio, per_class)

    columns = [*CELL, "row_id", "label", "text"]
    synthetic = cut_lineage(
        error_synthetic.select(F.lit("error_driven").alias("method"), *columns).unionByName(
            random_synthetic.select(F.lit("random_aug").alias("method"), *columns)
        )
    )
    made = embed(synthetic.withColumn("label", F.col("label").cast(core.schema["label"].dataType)), encoder, dim=dim)
    methods = F.explode(F.array(F.lit("random_aug"), F.lit("error_driven"))).alias("method")
    both = core.select(methods, *core.columns).unionByName(made.select("method", *core.columns))
    by = ["method", *CELL]
    limit = core.groupBy(*CELL).agg((F.lit(2) * F.count(F.lit(1))).cast("int").alias("_max"))
    if max_train is not None:
        limit = limit.withColumn("_max", F.least("_max", F.lit(max_train)))
    grown = downsample_cells(both.join(limit, CELL), F.col("_max"), by, F.col("seed")).drop("_max")
    augmented = confusion_of(grown, by)

    confusion = vanilla.withColumn("method", F.lit("vanilla")).unionByName(augmented)
    runs = E.scores_of(confusion, by).join(E.mae_of(confusion, by), by).select(
        F.lit(dataset).alias("dataset"),
        F.col("sample_size"),
        F.col("seed"),
        F.lit(None).cast("string").alias("iteration"),
        F.lit("").alias("split"),
        "method",
        (F.col("accuracy") * 100).alias("accuracy"),
        (F.col("macro_f1") * 100).alias("macro_f1"),
        E.primary_score(F.lit(E.metric_of(dataset))).alias("score"),
    )
    return {"confusion": confusion, "synthetic": synthetic, "runs": runs}


def _error_synthetic(wrong: DataFrame, names, per_error: int, cap: int) -> DataFrame:
    """Error-driven sentences from confusion counts, each confusion standing for ``_times`` errors."""
    spread = wrong.select(*CELL, E.TRUE, E.PRED, F.explode(F.sequence(F.lit(1), F.least("_times", F.lit(cap)).cast("int"))))
    return A.error_driven_synthetic(spread.drop("col"), names, per_error, cap, by=CELL)


def run_records(
    result: dict[str, DataFrame], dataset: str, names: Sequence[str] | dict = (), settings: dict | None = None
) -> DataFrame:
    """One nested record per run: scores, confusion matrix, per-class accuracy and its gain over vanilla,
    synthetic preview, error analysis of the vanilla run and settings."""
    by = [*CELL, "method"]
    counts = result["confusion"]
    runs = result["runs"].select(*by, "accuracy", "macro_f1", "score")
    matrix = E.confusion_matrix(counts, by).select(
        *by, F.col("labels").alias("confusion_matrix_labels"), F.col("matrix").alias("confusion_matrix")
    )
    support = F.col("tp") + F.col("fn")
    per_class = E.label_totals(counts, by).select(
        *by, F.col("label").cast("string").alias("label"), F.when(support > 0, F.col("tp") / support * 100).alias("a")
    )

    def entries(key: str, value: str):
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v")))))

    accuracy = per_class.groupBy(*by).agg(entries("label", "a").alias("per_class_accuracy"))
    base = accuracy.filter("method = 'vanilla'").select(*CELL, F.col("per_class_accuracy").alias("_base"))
    plain = runs.filter("method = 'vanilla'").select(*CELL, F.col("accuracy").alias("_acc"), F.col("macro_f1").alias("_f1"))
    made = result["synthetic"].groupBy(*by).agg(
        F.count(F.lit(1)).cast("int").alias("num_samples"),
        F.slice(F.array_sort(F.collect_list(F.struct("row_id", "text", "label"))), 1, 5).alias("preview"),
    )
    wrong = counts.filter((F.col(E.TRUE) != F.col(E.PRED)) & (F.col("method") == "vanilla"))
    shown = F.struct(
        F.col(E.TRUE).cast("string").alias("s"), F.col(E.PRED).cast("string").alias("p"), F.col(E.TRUE).alias("true_label"),
        label_name(E.TRUE, names).alias("true_label_name"), F.col(E.PRED).alias("predicted_label"),
        label_name(E.PRED, names).alias("predicted_label_name"), F.col("n").cast("int").alias("count"),
    )
    errors = wrong.groupBy(*CELL).agg(
        F.sum("n").cast("int").alias("num_errors"),
        F.transform(F.array_sort(F.collect_list(shown)), lambda c: c.dropFields("s", "p")).alias("confusions"),
    )
    per_error = wrong.groupBy(*CELL, E.TRUE).agg(F.sum("n").cast("int").alias("_n"))
    named = F.struct(label_name(E.TRUE, names).alias("label_name"), F.col("_n").alias("count"))
    classes = per_error.groupBy(*CELL).agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col(E.TRUE).cast("string").alias("k"), named.alias("v"))))
        ).alias("errored_classes")
    )
    strategy = F.element_at(F.create_map(*[F.lit(x) for kv in STRATEGY_NAMES.items() for x in kv]), F.col("method"))
    both_keys = F.array_sort(F.array_union(F.map_keys("per_class_accuracy"), F.map_keys("_base")))
    gains = F.map_from_entries(
        F.transform(
            both_keys,
            lambda k: F.struct(
                k.alias("k"),
                (F.try_element_at(F.col("per_class_accuracy"), k) - F.try_element_at(F.col("_base"), k)).alias("v"),
            ),
        )
    )
    settings = settings or {}
    rows = runs.join(matrix, by).join(accuracy, by).join(base, CELL).join(plain, CELL).join(made, by, "left")
    rows = rows.join(errors, CELL, "left").join(classes, CELL, "left")
    return rows.select(
        F.lit(dataset).alias("dataset"),
        F.col("sample_size").alias("shot"),
        "seed",
        "method",
        F.lit(E.metric_of(dataset)).alias("measure"),
        "score",
        "accuracy",
        "macro_f1",
        "confusion_matrix",
        "confusion_matrix_labels",
        F.transform("confusion_matrix_labels", lambda v: label_name(v, names)).alias("confusion_matrix_label_names"),
        "per_class_accuracy",
        F.struct(
            (F.col("accuracy") - F.col("_acc")).alias("accuracy_delta"),
            (F.col("macro_f1") - F.col("_f1")).alias("macro_f1_delta"),
            gains.alias("per_class_accuracy_delta"),
        ).alias("improvement_delta"),
        F.struct(
            strategy.alias("strategy"),
            F.coalesce("num_samples", F.lit(0)).alias("num_samples"),
            F.transform("preview", lambda p: F.struct(p["text"].alias("text"), p["label"].alias("label"))).alias("preview"),
        ).alias("synthetic_data"),
        F.struct(F.coalesce("num_errors", F.lit(0)).alias("num_errors"), "errored_classes", "confusions").alias("error_analysis"),
        F.struct(
            F.col("seed").alias("seed"), *[F.lit(v).alias(k) for k, v in settings.items()]
        ).alias("reproducibility"),
    )
