"""Prompt patterns: filling text and label slots, label grids, mirrored choices."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from handful.functions.order import draw_key, draw_number

# Patterns per task kind.
TASK_PATTERNS = {
    "similarity": "[TEXT1] and [TEXT2] are [LBL]",
    "pair": "[TEXT1] and [TEXT2] imply [LBL]",
    "single": "[TEXT1] this is [LBL]",
}


def check_pattern(pattern: str) -> int:
    """Number of text slots; the pattern needs [TEXT1] and exactly one [LBL]."""
    slots = {int(n) for n in re.findall(r"\[TEXT(\d+)\]", pattern)}
    n_text = next(i for i in range(1, len(slots) + 2) if i not in slots) - 1
    if n_text == 0:
        raise ValueError("The pattern needs at least one text slot.")
    if pattern.count("[LBL]") != 1:
        raise ValueError(f"[LBL] must be in the pattern once, but is there {pattern.count('[LBL]')} times.")
    return n_text


def fill_pattern(pattern: str, label: Column, texts: Sequence[str] | None = None) -> Column:
    """The pattern with its text slots and label slot filled, text slots in order."""
    n_text = check_pattern(pattern)
    texts = texts or [f"TEXT{i}" for i in range(1, n_text + 1)]
    filled = F.lit(pattern)
    for i, column in enumerate(texts[:n_text], start=1):
        filled = F.replace(filled, F.lit(f"[TEXT{i}]"), F.col(column))
    return F.replace(filled, F.lit("[LBL]"), label)


def apply_pattern(df: DataFrame, pattern: str, label: str = "label_text", texts: Sequence[str] | None = None) -> DataFrame:
    return df.withColumn("prompt", fill_pattern(pattern, F.col(label), texts))


def masked_pattern(df: DataFrame, pattern: str, mask: str = "[MASK]", texts: Sequence[str] | None = None) -> DataFrame:
    """Pattern with the model's mask token in the label slot."""
    return df.withColumn("prompt", fill_pattern(pattern, F.lit(mask), texts))


def pattern_label_grid(
    df: DataFrame, pattern: str, verbalizer: Sequence[str], label: str = "label", texts: Sequence[str] | None = None
) -> DataFrame:
    """Every row once per label name, filled in, flagged when the label is the true one."""
    named = F.array(*[F.struct(F.lit(i).alias("lbl"), F.lit(t).alias("lbl_text")) for i, t in enumerate(verbalizer)])
    return (
        df.select(*df.columns, F.inline(named))
        .withColumn("prompt", fill_pattern(pattern, F.col("lbl_text"), texts))
        .withColumn("is_true", F.col("lbl").eqNullSafe(F.col(label)))
    )


def pattern_drawn_label(
    df: DataFrame,
    pattern: str,
    verbalizer: Sequence[str],
    seed: int,
    label: str = "label",
    row_id: str = "row_id",
    texts: Sequence[str] | None = None,
) -> DataFrame:
    """Every row with one drawn label name filled in."""
    lbl = (draw_number(draw_key(seed, row_id)) % len(verbalizer)).cast("int")
    name = F.element_at(F.array(*[F.lit(t) for t in verbalizer]), F.col("lbl") + 1)
    return (
        df.withColumn("lbl", lbl)
        .withColumn("prompt", fill_pattern(pattern, name, texts))
        .withColumn("is_true", F.col("lbl").eqNullSafe(F.col(label)))
    )


def mirror_choices(df: DataFrame, first: str = "choice1", second: str = "choice2", label: str = "label") -> DataFrame:
    """Each two-choice row and its copy with swapped choices and flipped label."""
    swap = {first: F.col(second), second: F.col(first), label: F.when(F.col(label) == 0, 1).otherwise(0)}
    mirrored = df.select(*[swap[c].cast(df.schema[c].dataType).alias(c) if c in swap else F.col(c) for c in df.columns])
    return df.withColumn("mirrored", F.lit(False)).unionByName(mirrored.withColumn("mirrored", F.lit(True)))
