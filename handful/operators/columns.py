"""Column contracts, renames, label names and label encodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from handful.functions.cells import lookup
from handful.functions.order import draw_key, running_totals
from handful.session import join_checked

TEXT_LABEL = ("text", "label")


def validate_columns(
    df: DataFrame, mapping: Mapping[str, str] | None = None, required: Sequence[str] = TEXT_LABEL
) -> DataFrame:
    """Check that the required columns exist, directly or through ``mapping`` (source -> required)."""
    if not isinstance(df, DataFrame):
        raise ValueError(f"Expected one DataFrame but got {type(df).__name__}; pass a single split.")
    present = set(df.columns)
    if mapping is None:
        if not set(required) <= present:
            raise ValueError(f"Expected the columns {sorted(required)}, but found {sorted(present)}; pass a mapping.")
        return df
    unmet = set(required) - set(mapping.values()) - (present - set(mapping))
    if unmet:
        raise ValueError(f"The mapping gives no source for the columns {sorted(unmet)}.")
    unknown = set(mapping) - present
    if unknown:
        raise ValueError(f"The mapping names the columns {sorted(unknown)}, but only {sorted(present)} exist.")
    return df


def apply_column_mapping(
    df: DataFrame, mapping: Mapping[str, str], required: Sequence[str] = TEXT_LABEL, keep: Sequence[str] = ("row_id",)
) -> DataFrame:
    """Rename by ``mapping``; other columns become ``feat_<name>``, required and ``keep`` columns stay."""
    validate_columns(df, mapping, required)
    fixed = set(required) | set(keep)
    return df.select(
        *[F.col(c).alias(mapping.get(c) or (c if c in fixed else f"feat_{c}")) for c in df.columns]
    )


def take_range(df: DataFrame, start: int, stop: int, order: str = "row_id", dense: bool = False) -> DataFrame:
    """Rows ``start`` to ``stop - 1`` in ``order``; a plain filter when the order column counts 0, 1, 2, ..."""
    if dense:
        return df.filter((F.col(order) >= start) & (F.col(order) < stop))
    ordered = df.orderBy(order)
    return (ordered.offset(start) if start else ordered).limit(stop - start)


def errors_of(preds: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    return preds.filter(~F.col(true).eqNullSafe(F.col(pred)))


def label_name(label, names: Sequence[str] | Mapping) -> Column:
    """Name of a label id from a class list; ids outside it become their text."""
    table = dict(enumerate(names)) if not isinstance(names, Mapping) else dict(names)
    label = F.col(label) if isinstance(label, str) else label
    return F.coalesce(lookup(table, label), label.cast("string")) if table else label.cast("string")


def label_names(df: DataFrame, labels: DataFrame, label: str = "label", name: str = "label_name") -> DataFrame:
    """Join names from a table (label_id, label_name); ids not in it become their text."""
    table = labels.select(F.col("label_id").alias(label), F.col("label_name").alias("_name"))
    return join_checked(df, table, label, "left").withColumn(
        name, F.coalesce("_name", F.col(label).cast("string"))
    ).drop("_name")


# Star names per language, the wording that joins text and label, similarity classes.
STAR_NAMES = {
    "zh": ["1星", "2星", "3星", "4星", "5星"],
    "de": ["1 stern", "2 sterne", "3 sterne", "4 sterne", "5 sterne"],
    "fr": ["1 étoile", "2 étoiles", "3 étoiles", "4 étoiles", "5 étoiles"],
    "ja": ["一つ星", "二つ星", "三つ星", "四つ星", "五つ星"],
    "es": ["1 estrella", "2 estrellas", "3 estrellas", "4 estrellas", "5 estrellas"],
    "en": ["1 star", "2 stars", "3 stars", "4 stars", "5 stars"],
}
SIMILARITY_NAMES = ["very different", "different", "dissimilar", "somewhat similar", "similar", "very similar"]


def relabel(label, names: Mapping) -> Column:
    """Replace labels by the given texts; labels without one give NULL."""
    return lookup(dict(names), label)


def star_names(label, lang) -> Column:
    """Star name of a 0..4 label in the row's language (English where the language is unknown)."""
    flat = {f"{code}:{i}": name for code, names in STAR_NAMES.items() for i, name in enumerate(names)}
    label = F.col(label) if isinstance(label, str) else label
    lang = F.col(lang) if isinstance(lang, str) else lang
    return F.coalesce(
        lookup(flat, F.concat_ws(":", lang, label.cast("string"))),
        lookup(flat, F.concat_ws(":", F.lit("en"), label.cast("string"))),
    )


def spaced(label) -> Column:
    """Label text with blanks for underscores."""
    return F.replace(F.col(label) if isinstance(label, str) else label, F.lit("_"), F.lit(" "))


def bucket_similarity(df: DataFrame, score: str = "label") -> DataFrame:
    """Round a 0..5 score half-even to a class and name it."""
    level = F.bround(F.col(score).cast("double"), 0).cast("int")
    return df.withColumn("sim_class", level).withColumn(
        "sim_name", lookup(dict(enumerate(SIMILARITY_NAMES)), F.col("sim_class"))
    )


def multi_hot(labels, classes: Sequence[str], separator: str = ",") -> Column:
    """0/1 vector over ``classes`` from a separated list; a missing list gives zeros."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    given = F.split(F.coalesce(labels, F.lit("")), separator)
    return F.array(*[F.array_contains(given, c).cast("int") for c in classes])


def one_hot(label, size: int) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return F.array(*[(label == i).cast("int") for i in range(size)])


def wide_to_vector(columns: Sequence[str]) -> Column:
    """0/1 vector from one 0/1 column per label."""
    return F.array(*[F.col(c).cast("int") for c in columns])


def with_default_ordinal(df: DataFrame) -> DataFrame:
    """Span rows with ``ordinal`` (0 if the column is missing)."""
    if not {"text", "span"} <= set(df.columns):
        raise ValueError(f"Expected the columns 'text' and 'span', but found {sorted(df.columns)}.")
    if "pred_polarity" in df.columns:
        raise ValueError("The column 'pred_polarity' is to be added, but it exists already.")
    return df if "ordinal" in df.columns else df.withColumn("ordinal", F.lit(0))


def encode_labels(df: DataFrame, columns: Sequence[str] = ("true_label", "pred_label")) -> DataFrame:
    """Give the text labels of all ``columns`` one shared 0-based code, in text order.

    Only the distinct labels are ranked, by range partitions; codes come back by a join per column.
    """
    seen = df.select(F.explode(F.array_distinct(F.array(*[F.col(c).cast("string") for c in columns]))).alias("_v"))
    domain = seen.filter("_v is not null").distinct().withColumn("_one", F.lit(1))
    ranked = running_totals(domain, [], "_v", ["_one"])
    out = df
    for c in columns:
        codes = ranked.select(F.col("_v").alias(f"_v_{c}"), (F.col("_one_run") - 1).cast("int").alias(f"{c}_code"))
        out = join_checked(out.withColumn(f"_v_{c}", F.col(c).cast("string")), codes, f"_v_{c}", "left").drop(f"_v_{c}")
    return out


def seeded_shuffle(df: DataFrame, seed: int, row_id: str = "row_id") -> DataFrame:
    """All rows in a seeded order (a range-partitioned sort)."""
    return df.orderBy(draw_key(seed, row_id), row_id)


def string_sorted(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows in the text order of the label."""
    return df.orderBy(F.col(label).cast("string"))


def preview(df: DataFrame, n: int = 5, order: str = "row_id", columns: Sequence[str] = TEXT_LABEL) -> DataFrame:
    """One row holding the first n rows as an array of structs."""
    first = df.orderBy(order).limit(n)
    return first.agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("preview"))


def label_domain(df: DataFrame, columns: Sequence[str] = ("true_label", "pred_label")) -> DataFrame:
    """Distinct labels over several columns, in text order."""
    return (
        df.select(F.explode(F.array_distinct(F.array(*columns))).alias("label"))
        .filter("label is not null")
        .distinct()
        .orderBy(F.col("label").cast("string"))
    )
