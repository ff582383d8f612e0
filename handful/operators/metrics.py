"""Quality metrics.

Every label metric starts from the confusion counts, which are summed map-side:
one small row per (true, pred) is shuffled however many rows are scored.  ``by``
scores many runs in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from handful.functions.order import first_per_group, running_totals

TRUE, PRED = "true_label", "pred_label"


def confusion(preds: DataFrame, by: Sequence[str] = (), true: str = TRUE, pred: str = PRED) -> DataFrame:
    """Counts (by, true_label, pred_label, n) of the pairs that occur.

    A row without a prediction is an error of its true label and keeps a NULL ``pred_label``; only rows
    without a true label are left out (``unlabelled`` counts them).
    """
    return (
        preds.filter(F.col(true).isNotNull())
        .groupBy(*by, F.col(true).alias(TRUE), F.col(pred).alias(PRED))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def unlabelled(preds: DataFrame, by: Sequence[str] = (), true: str = TRUE) -> DataFrame:
    """(by, n_unlabelled): rows that no metric can judge."""
    return preds.groupBy(*by).agg(F.count(F.when(F.col(true).isNull(), 1)).alias("n_unlabelled"))


def _text_order(labels: Column) -> Column:
    pairs = F.transform(labels, lambda v: F.struct(v.cast("string").alias("s"), v.alias("v")))
    return F.transform(F.array_sort(F.array_distinct(pairs)), lambda p: p["v"])


def confusion_dense(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts over the union of true and predicted labels, zeros included; NULL is no label.

    A run's class table travels as one array, so no label table is joined.
    """
    run = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct(TRUE, PRED), "n"))).alias("_cells"),
        F.array_union(F.collect_set(TRUE), F.collect_set(PRED)).alias("_labels"),
    )
    run = run.withColumn("_labels", _text_order(F.col("_labels")))
    rows = run.select(*by, "_cells", "_labels", F.posexplode("_labels").alias("true_pos", TRUE))
    cells = rows.select(*by, "_cells", "true_pos", TRUE, F.posexplode("_labels").alias("pred_pos", PRED))
    n = F.try_element_at(F.col("_cells"), F.struct(TRUE, PRED))
    return cells.select(*by, "true_pos", TRUE, "pred_pos", PRED, F.coalesce(n, F.lit(0)).cast("bigint").alias("n"))


def confusion_matrix(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, labels, matrix): rows are true labels, columns predicted ones, both in text order."""
    dense = confusion_dense(counts, by)
    lines = dense.groupBy(*by, "true_pos", TRUE).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pred_pos", "n"))), lambda c: c["n"]).alias("line")
    )
    ordered = F.array_sort(F.collect_list(F.struct("true_pos", F.col(TRUE).alias("label"), "line")))
    return lines.groupBy(*by).agg(ordered.alias("_m")).select(
        *by,
        F.transform("_m", lambda r: r["label"]).alias("labels"),
        F.transform("_m", lambda r: r["line"]).alias("matrix"),
    )


def label_totals(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, label, tp, fp, fn) over the union of true and predicted labels."""
    hit = F.col(TRUE) == F.col(PRED)
    zero = F.lit(0).cast("bigint")
    parts = F.array(
        F.struct(
            F.col(TRUE).alias("label"),
            F.when(hit, F.col("n")).otherwise(zero).alias("tp"),
            zero.alias("fp"),
            F.when(hit, zero).otherwise(F.col("n")).alias("fn"),
        ),
        F.struct(
            F.col(PRED).alias("label"),
            zero.alias("tp"),
            F.when(hit, zero).otherwise(F.col("n")).alias("fp"),
            zero.alias("fn"),
        ),
    )
    return (
        counts.select(*by, F.inline(parts))
        .filter(F.col("label").isNotNull())
        .groupBy(*by, "label")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def classification_report(preds: DataFrame, by: Sequence[str] = (), true: str = TRUE, pred: str = PRED) -> DataFrame:
    """Precision, recall, F1 and support per class; an undefined share is 0."""
    t = label_totals(confusion(preds, by, true, pred), by)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return t.select(
        *by,
        "label",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (tp + fn).alias("support"),
    )


def per_class_accuracy(preds: DataFrame, by: Sequence[str] = (), true: str = TRUE, pred: str = PRED) -> DataFrame:
    """Share of each true label predicted right, x100; NULL for a label that is only predicted."""
    t = label_totals(confusion(preds, by, true, pred), by)
    support = F.col("tp") + F.col("fn")
    return t.select(*by, "label", F.when(support > 0, F.col("tp") / support * 100).alias("accuracy"))


def accuracy(preds: DataFrame, by: Sequence[str] = (), true: str = TRUE, pred: str = PRED) -> DataFrame:
    counts = confusion(preds, by, true, pred)
    right = F.when(F.col(TRUE) == F.col(PRED), F.col("n")).otherwise(0)
    return counts.groupBy(*by).agg((F.sum(right) / F.sum("n")).alias("accuracy"))


def scores(
    preds: DataFrame, by: Sequence[str] = (), true: str = TRUE, pred: str = PRED, positive=None
) -> DataFrame:
    """Accuracy, macro/micro/weighted F1 and Matthews correlation per run; binary F1 when ``positive`` is given."""
    return scores_of(confusion(preds, by, true, pred), by, positive)


def scores_of(counts: DataFrame, by: Sequence[str] = (), positive=None) -> DataFrame:
    """``scores`` from confusion counts."""
    t = label_totals(counts, by)
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    actual, guessed = tp + fn, tp + fp
    right, total = F.sum(tp), F.sum(actual)
    spread = (total * total - F.sum(guessed * guessed)) * (total * total - F.sum(actual * actual))
    mcc = F.when(spread > 0, (right * total - F.sum(guessed * actual)) / F.sqrt(spread)).otherwise(F.lit(0.0))
    wanted = [
        (right / total).alias("accuracy"),
        F.avg(f1).alias("macro_f1"),
        _ratio(2 * right, 2 * right + F.sum(fp) + F.sum(fn)).alias("micro_f1"),
        (F.sum(f1 * actual) / total).alias("weighted_f1"),
        mcc.alias("mcc"),
    ]
    if positive is not None:
        wanted.append(F.coalesce(F.max(F.when(F.col("label") == F.lit(positive), f1)), F.lit(0.0)).alias("binary_f1"))
    return t.groupBy(*by).agg(*wanted)


# The metric each benchmark dataset is judged by; others use accuracy.
DATASET_METRICS = {
    "toxic_conversations": "matthews_correlation",
    "amazon_counterfactual_en": "matthews_correlation",
    "amazon_reviews_multi_en": "mae",
    "amazon_reviews_multi_de": "mae",
    "amazon_reviews_multi_es": "mae",
    "amazon_reviews_multi_fr": "mae",
    "amazon_reviews_multi_ja": "mae",
    "amazon_reviews_multi_zh": "mae",
}


def metric_of(dataset: str) -> str:
    return DATASET_METRICS.get(dataset, "accuracy")


def primary_score(measure) -> Column:
    """Score x100 picked by metric name from a row of ``scores`` (with ``mae`` where that is asked for).

    An unknown name stops the job.
    """
    measure = F.col(measure) if isinstance(measure, str) else measure
    unknown = F.raise_error(F.concat(F.lit("unknown metric: "), F.coalesce(measure, F.lit("NULL")))).cast("double")
    return (
        F.when(measure == "matthews_correlation", F.col("mcc"))
        .when(measure == "macro_f1", F.col("macro_f1"))
        .when(measure == "accuracy", F.col("accuracy"))
        .when(measure == "mae", F.col("mae"))
        .otherwise(unknown)
        * 100
    )


def mae_of(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, mae) from confusion counts; NULL where labels are no numbers or nothing was predicted."""
    gap = F.abs(F.col(TRUE).try_cast("double") - F.col(PRED).try_cast("double"))
    return counts.groupBy(*by).agg((F.sum(gap * F.col("n")) / F.sum(F.when(gap.isNotNull(), F.col("n")))).alias("mae"))


def mae(preds: DataFrame, by: Sequence[str] = (), true: str = TRUE, pred: str = PRED) -> DataFrame:
    return preds.groupBy(*by).agg(F.avg(F.abs(F.col(true) - F.col(pred)).cast("double")).alias("mae"))


def average_precision(
    preds: DataFrame, score: str = "score", positive: str = "is_positive", by: Sequence[str] = ()
) -> DataFrame:
    """Average precision as a step sum over distinct scores, so tied rows form one threshold.

    Counts are taken per score first; running totals over the scores come in slices, so a
    run with many distinct scores is not sorted by one task.  Rows without a score rank last.
    """
    by = list(by)
    steps = preds.groupBy(*by, score).agg(
        F.sum(F.col(positive).cast("int")).alias("pos"), F.count(F.lit(1)).alias("seen")
    )
    ranked = running_totals(steps, by, score, ["pos", "seen"], descending=True)
    gain = F.when(
        F.col("pos_all") > 0, F.col("pos") / F.col("pos_all") * F.col("pos_run") / F.col("seen_run")
    )
    return ranked.groupBy(*by).agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("average_precision"))


def multilabel_scores(preds: DataFrame, by: Sequence[str] = (), true: str = TRUE, pred: str = PRED) -> DataFrame:
    """Subset accuracy and micro/macro F1 over label cells of 0/1 vectors."""
    by = list(by)
    cells = F.transform(
        F.arrays_zip(F.col(true).alias("t"), F.col(pred).alias("p")),
        lambda c: F.struct(
            (c["t"] * c["p"]).cast("bigint").alias("tp"),
            ((1 - c["t"]) * c["p"]).cast("bigint").alias("fp"),
            (c["t"] * (1 - c["p"])).cast("bigint").alias("fn"),
        ),
    )
    whole = F.when(F.col(true) == F.col(pred), 1).otherwise(0).alias("_whole")
    per_label = (
        preds.select(*by, whole, F.posexplode(cells).alias("label", "c"))
        .groupBy(*by, "label")
        .agg(
            F.sum("c.tp").alias("tp"),
            F.sum("c.fp").alias("fp"),
            F.sum("c.fn").alias("fn"),
            F.avg("_whole").alias("subset_accuracy"),
        )
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return per_label.groupBy(*by).agg(
        F.max("subset_accuracy").alias("subset_accuracy"),
        _ratio(2 * F.sum(tp), 2 * F.sum(tp) + F.sum(fp) + F.sum(fn)).alias("micro_f1"),
        F.avg(_ratio(2 * tp, 2 * tp + fp + fn)).alias("macro_f1"),
    )


def example_based_prf(preds: DataFrame, by: Sequence[str] = (), true: str = TRUE, pred: str = PRED) -> DataFrame:
    """Mean per-row precision, recall and Jaccard of label sets, and F1 of the two means; 0 where undefined."""
    shared = F.size(F.array_intersect(true, pred))
    means = preds.groupBy(*by).agg(
        F.avg(_ratio(shared, F.size(pred))).alias("precision"),
        F.avg(_ratio(shared, F.size(true))).alias("recall"),
        F.avg(_ratio(shared, F.size(F.array_union(true, pred)))).alias("jaccard"),
    )
    p, r = F.col("precision"), F.col("recall")
    return means.withColumn("f1", _ratio(2 * p * r, p + r))


def merge_labels_by_document(sentences: DataFrame, index: str = "index", columns: Sequence[str] = (TRUE, PRED)) -> DataFrame:
    """Union the label lists of all sentences of a document; the document is the index before its first '_'.

    Labels are made distinct before they are collected, so a document holds at most the label set.
    """
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("labels")) for c in columns])
    doc = F.substring_index(F.col(index), "_", 1).alias("document")
    long = (
        sentences.select(doc, F.inline(kinds))
        .select("document", "kind", F.explode_outer(F.split("labels", ",")).alias("v"))
        .distinct()
    )
    return long.groupBy("document").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.col("v")))).alias(c) for c in columns]
    )


def group_exact_match(preds: DataFrame, group: str, by: Sequence[str] = (), true: str = TRUE, pred: str = PRED) -> DataFrame:
    """Share of groups whose rows are all right, rounded to 3 digits."""
    whole = preds.groupBy(*by, group).agg(F.bool_and(F.col(true) == F.col(pred)).alias("_ok"))
    return whole.groupBy(*by).agg(F.round(F.avg(F.col("_ok").cast("int")), 3).alias("exact_match"))


def first_prediction_accuracy(
    preds: DataFrame, group: str, order: str, by: Sequence[str] = (), true: str = TRUE, pred: str = PRED
) -> DataFrame:
    """Accuracy of the first row of each group, rounded to 3 digits."""
    first = preds.groupBy(*by, group).agg(F.min_by(F.col(true) == F.col(pred), order).alias("_ok"))
    return first.groupBy(*by).agg(F.round(F.avg(F.col("_ok").cast("int")), 3).alias("accuracy"))


def word_order_sensitivity(
    preds: DataFrame, shuffled: DataFrame, n_labels: int, row_id: str = "row_id", true: str = TRUE, pred: str = PRED
) -> DataFrame:
    """(100 - 100p) / (100 - 100/k), p being the accuracy on shuffled words among rows right in order."""
    right = preds.filter(F.col(true) == F.col(pred)).select(row_id, F.col(true).alias("_t"))
    joined = right.join(shuffled.select(row_id, F.col(pred).alias("_p")), row_id)
    p = F.avg((F.col("_t") == F.col("_p")).cast("int"))
    return joined.agg(((100 - 100 * p) / F.lit(100 - 100 / n_labels)).alias("word_order_sensitivity"))


def error_summary(preds: DataFrame, by: Sequence[str] = (), true: str = TRUE, pred: str = PRED) -> DataFrame:
    """Error counts in total, per true label and per (true, pred); ``level`` is 'all', 'class' or 'pair'."""
    wrong = confusion(preds, by, true, pred).filter(~F.col(TRUE).eqNullSafe(F.col(PRED)))
    keys = [F.col(c) for c in by]
    sets = [[*keys], [*keys, F.col(TRUE)], [*keys, F.col(TRUE), F.col(PRED)]]
    level = F.when(F.grouping(TRUE) == 1, "all").when(F.grouping(PRED) == 1, "class").otherwise("pair")
    return wrong.groupingSets(sets, *keys, F.col(TRUE), F.col(PRED)).agg(
        level.alias("level"), F.coalesce(F.sum("n"), F.lit(0)).alias("count")
    )


def align_predictions(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Join gold and predicted rows; a key on one side only stops the job."""
    g = gold.withColumn("_g", F.lit(True))
    p = pred.withColumn("_p", F.lit(True))
    joined = g.join(p, key, "full")
    message = F.concat(F.lit("key on one side only: "), F.col(key).cast("string"))
    lonely = F.col("_g").isNull() | F.col("_p").isNull()
    checked = F.when(lonely, F.raise_error(message).cast(joined.schema[key].dataType)).otherwise(F.col(key))
    return joined.withColumn(key, checked).drop("_g", "_p")


def text_profile(df: DataFrame, text: str = "text") -> DataFrame:
    """Words per text (split at single blanks): smallest, mean, median, largest."""
    words = F.size(F.split(F.col(text), " "))
    return df.select(words.alias("w")).agg(
        F.min("w").alias("min_words"),
        F.avg("w").alias("mean_words"),
        F.median("w").alias("median_words"),
        F.max("w").alias("max_words"),
    )


def label_profile(df: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label name of a table (label_id, label_name); a label without rows counts 0."""
    counts = df.groupBy(F.col(label).alias("label_id")).agg(F.count(F.lit(1)).alias("n_samples"))
    return labels.join(counts, "label_id", "left").select(
        "label_id", "label_name", F.coalesce("n_samples", F.lit(0)).alias("n_samples")
    )


def label_examples(df: DataFrame, n: int = 3, label: str = "label", text: str = "text", row_id: str = "row_id") -> DataFrame:
    """The first n texts of each label, in row order."""
    first = first_per_group(df.select(row_id, label, text), [label], [row_id], n)
    ordered = F.array_sort(F.collect_list(F.struct("rn", text)))
    return first.groupBy(label).agg(F.transform(ordered, lambda e: e[text]).alias("examples"))
