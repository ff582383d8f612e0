"""Templated and error-driven synthetic rows, pseudo-labels and training-set growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from handful.functions.order import draw_key, draw_number
from handful.functions.text import fill
from handful.operators.columns import label_name, one_hot
from handful.operators.sampling import balanced_downsample, downsample_cells, fewshot_splits

# Sentences of the three rotating templates of each kind.
ERROR_TEMPLATES = [
    "Synthetic hard example for class '{name}': the correct label is '{name}', not '{others}'.",
    "Error-driven sample: this input may look similar to '{others}', but it belongs to '{name}'.",
    "Deterministic augmentation for '{name}' with challenging cues from '{others}'.",
]
RANDOM_TEMPLATES = [
    "Random synthetic example for class '{name}'.",
    "Template augmentation sample labeled as '{name}'.",
    "Simple generated text associated with category '{name}'.",
]
DEFAULT_TEMPLATE = "This sentence is {}"


def _put(template: Column, slot: str, value: Column) -> Column:
    return F.replace(template, F.lit(slot), value)


def candidate_labels(df: DataFrame, label: str = "label", name: str = "label_text", row_id: str = "row_id") -> DataFrame:
    """(label_id, label_name): the first-seen name of every label id."""
    return df.groupBy(F.col(label).alias("label_id")).agg(F.min_by(name, row_id).alias("label_name"))


def templated_dataset(
    spark,
    df: DataFrame | None = None,
    candidate_labels: Sequence[str] | None = None,
    reference: DataFrame | None = None,
    template: str = DEFAULT_TEMPLATE,
    sample_size: int = 2,
    text: str = "text",
    label: str = "label",
    multi_label: bool = False,
) -> DataFrame:
    """``sample_size`` filled templates per label, appended to ``df`` if given.

    Labels come from a list of names or from a table (label_id, label_name), exactly one of them.
    """
    if df is not None and df.columns:
        lacking = {text, label} - set(df.columns)
        if lacking:
            raise ValueError(f"The input lacks the columns {sorted(lacking)}.")
    if (candidate_labels is None) == (reference is None):
        raise ValueError("Give exactly one of candidate_labels and reference.")
    if reference is None:
        named = [(i, n) for i, n in enumerate(candidate_labels)]
        source = spark.createDataFrame(named, "label_id int, label_name string")
        size = len(named)
    else:
        source = reference
        size = reference.count() if multi_label else 0
    made = source.select(
        fill(template, "label_name").alias(text),
        (one_hot("label_id", size) if multi_label else F.col("label_id")).alias(label),
        F.explode(F.sequence(F.lit(1), F.lit(sample_size))).alias("copy"),
    ).drop("copy")
    if df is None or not df.columns:
        return made
    return df.unionByName(made.withColumn(label, F.col(label).cast(df.schema[label].dataType)), allowMissingColumns=True)


def fewshot_splits_augmented(
    df: DataFrame,
    labels: DataFrame | None,
    sizes: Sequence[int],
    seeds: Sequence[int],
    template: str = DEFAULT_TEMPLATE,
    text: str = "text",
    label: str = "label",
    row_id: str = "row_id",
) -> DataFrame:
    """Grid of splits where each cell also gets ``sample_size`` filled templates per label.

    Synthetic rows have no row id; ``order_key`` gives the shuffled order inside a cell.
    """
    if labels is None:
        raise ValueError("Augmented splits need a table of label names.")
    real = fewshot_splits(df.select(row_id, label, text), sizes, seeds, label, row_id)
    cells = F.array(
        *[
            F.struct(F.lit(z).alias("sample_size"), F.lit(i).alias("split_idx"), F.lit(s).alias("seed"))
            for z in sizes
            for i, s in enumerate(seeds)
        ]
    )
    made = labels.select("label_id", "label_name", F.inline(cells)).select(
        "sample_size",
        "split_idx",
        "seed",
        F.lit(None).cast(df.schema[row_id].dataType).alias(row_id),
        F.col("label_id").cast(df.schema[label].dataType).alias(label),
        fill(template, "label_name").alias(text),
        F.explode(F.sequence(F.lit(1), F.col("sample_size"))).alias("copy"),
    )
    rows = real.withColumn("copy", F.lit(0)).unionByName(made)
    key = draw_key(F.col("seed"), F.coalesce(F.col(row_id).cast("string"), F.concat(F.lit("t"), F.col("copy"))), label)
    return rows.withColumn("order_key", key).drop("copy")


def error_driven_synthetic(
    errors: DataFrame,
    names=(),
    per_error: int = 1,
    cap: int = 5,
    by: Sequence[str] = (),
    true: str = "true_label",
    pred: str = "pred_label",
) -> DataFrame:
    """Template sentences for every class with errors, naming the classes it was mistaken for.

    A class gets min(errors * per_error, cap) sentences.  Errors are counted map-side
    per (true, pred), so one row per confusion is all that is shuffled.
    """
    by = list(by)
    confusions = errors.groupBy(*by, true, pred).agg(F.count(F.lit(1)).alias("_n"))
    classes = confusions.groupBy(*by, true).agg(
        F.sum("_n").alias("_errors"), F.array_sort(F.collect_set(label_name(pred, names))).alias("_others")
    )
    others = F.array_join("_others", ", ")
    others = F.when(others == "", F.lit("another class")).otherwise(others)
    wording = F.element_at(F.array(*[F.lit(t) for t in ERROR_TEMPLATES]), (F.col("sample_idx") % 3 + 1).cast("int"))
    wanted = F.least(F.col("_errors") * per_error, F.lit(cap)).cast("int")
    return (
        classes.withColumn("_wanted", wanted)
        .filter("_wanted > 0")
        .select(*by, true, others.alias("_text"), F.explode(F.sequence(F.lit(0), F.col("_wanted") - 1)).alias("sample_idx"))
        .select(
            *by,
            F.col(true).alias("label"),
            "sample_idx",
            _put(_put(wording, "{name}", label_name(true, names)), "{others}", F.col("_text")).alias("text"),
        )
    )


def random_label(labels: Sequence, seed, index: Column) -> Column:
    """Evenly drawn member of ``labels`` (in text order) for each index."""
    ordered = sorted(labels, key=str)
    place = draw_number(draw_key(seed, index)) % len(ordered)
    return F.element_at(F.array(*[F.lit(v) for v in ordered]), (place + 1).cast("int"))


def random_synthetic(spark, labels: Sequence, n: int, seed: int, names=()) -> DataFrame:
    """n template sentences with randomly drawn labels."""
    wording = F.element_at(F.array(*[F.lit(t) for t in RANDOM_TEMPLATES]), (F.col("id") % 3 + 1).cast("int"))
    drawn = spark.range(max(n, 0)).withColumn("label", random_label(labels, seed, F.col("id")))
    return drawn.select(
        F.col("id").alias("sample_idx"), "label", _put(wording, "{name}", label_name("label", names)).alias("text")
    )


def random_synthetic_cells(
    cells: DataFrame, labels: Sequence, budget: Column, by: Sequence[str], names=(), seed="seed"
) -> DataFrame:
    """``random_synthetic`` for many cells at once; ``budget`` is the number of sentences of a cell."""
    wording = F.element_at(F.array(*[F.lit(t) for t in RANDOM_TEMPLATES]), (F.col("sample_idx") % 3 + 1).cast("int"))
    return (
        cells.withColumn("_budget", budget.cast("int"))
        .filter("_budget > 0")
        .select(*by, F.explode(F.sequence(F.lit(0), F.col("_budget") - 1)).alias("sample_idx"))
        .withColumn("label", random_label(labels, F.col(seed), F.col("sample_idx")))
        .select(*by, "label", "sample_idx", _put(wording, "{name}", label_name("label", names)).alias("text"))
    )


def synthetic_budget(n_train: int, ratio: float) -> int:
    return min(n_train, int(n_train * ratio))


def random_budget(n_error_synthetic, multiplier: float) -> Column:
    """Half-even rounding of the error-driven count times the multiplier."""
    n = F.col(n_error_synthetic) if isinstance(n_error_synthetic, str) else n_error_synthetic
    return F.bround(n * F.lit(float(multiplier)), 0).cast("int")


def cap_synthetic(
    synthetic: DataFrame,
    n_train: int,
    ratio: float,
    seed: int,
    per_class: int | None = None,
    label: str = "label",
    row_id: str = "row_id",
) -> DataFrame:
    """Cut synthetic rows to the budget of the training size, first to ``per_class`` times the classes."""
    budget = synthetic_budget(n_train, ratio)
    if budget <= 0:
        return synthetic.limit(0)
    if per_class is not None:
        n_classes = synthetic.select(label).distinct().count()
        if n_classes == 0:
            return synthetic
        synthetic = balanced_downsample(synthetic, per_class * n_classes, seed, label, row_id)
    return balanced_downsample(synthetic, budget, seed, label, row_id)


def augment_train(
    train: DataFrame,
    synthetic: DataFrame,
    n_train: int,
    max_examples: int | None = None,
    seed: int = 0,
    label: str = "label",
    text: str = "text",
    row_id: str = "row_id",
) -> DataFrame:
    """Train plus synthetic rows cut to at most twice the training size; real rows may be cut as well.

    Row ids become text, those of synthetic rows with 'syn-' in front so that the two never meet.
    """
    core = train.select(F.col(row_id).cast("string").alias(row_id), text, label)
    cast = synthetic.select(
        F.concat(F.lit("syn-"), F.col(row_id).cast("string")).alias(row_id),
        F.col(text).cast(train.schema[text].dataType).alias(text),
        F.col(label).cast(train.schema[label].dataType).alias(label),
    )
    size = 2 * n_train if max_examples is None else min(2 * n_train, max_examples)
    return balanced_downsample(core.unionByName(cast), size, seed, label, row_id)


def shuffle_words(text, seed, row_id) -> Column:
    """The words of a text in a seeded order."""
    text = F.col(text) if isinstance(text, str) else text
    row = F.col(row_id) if isinstance(row_id, str) else row_id
    keyed = F.transform(
        F.split(text, " "),
        lambda w, i: F.struct(draw_key(seed, row, i).alias("k"), i.alias("i"), w.alias("w")),
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["w"]), " ")


def pseudo_label(labelled: DataFrame, unlabelled: DataFrame, pred: str = "pred_label", label: str = "label") -> DataFrame:
    """Teacher rows plus unlabelled rows that carry the teacher's prediction as their label."""
    return labelled.withColumn("pseudo", F.lit(False)).unionByName(
        unlabelled.withColumn(label, F.col(pred).cast(labelled.schema[label].dataType))
        .select(*labelled.columns)
        .withColumn("pseudo", F.lit(True))
    )
