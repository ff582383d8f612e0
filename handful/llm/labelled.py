"""Bounded samples of labelled rows, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(key: Column, folds: int = 5) -> Column:
    """True on the fold that no label is learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


def sample_ids(labels: DataFrame, label: str, per_class: int, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """(id, label): at most ``per_class`` ids of each class from the learning folds, in hash order.

    Rows without id or with a label other than 0 and 1 are left out; an id with two labels is, too.
    """
    rows = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).cast("bigint").alias("id"))
        .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
        .where("label = other")
        .select("id", "label")
    )
    draw = F.xxhash64("id", F.lit(seed))
    return rows.where("label = 0").orderBy(draw, "id").limit(per_class).unionByName(
        rows.where("label = 1").orderBy(draw, "id").limit(per_class)
    )


def class_counts(labels: DataFrame, label: str, key: str = "doc_id") -> tuple[int, int]:
    """Rows of class 0 and 1 in the learning folds."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    found = rows.agg(*(F.sum((F.col(label) == c).cast("bigint")) for c in (0, 1))).first()
    return found[0] or 0, found[1] or 0
