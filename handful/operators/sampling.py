"""Seeded sampling per class, grids of sample sizes and seeds, splits and balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from handful.functions.order import (
    GROUP_LIMIT, KEY_DIGITS, among_first, draw_key, draw_number, exact_rank, first_per_group, key_bound, slack, take_first,
)
from handful.session import cut_lineage, join_checked

# Seeds and sizes of the standard grid.
SEEDS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
SAMPLE_SIZES = [2, 4, 8, 16, 32, 64]
# Tables up to this many rows are ranked directly.
DIRECT_ROWS = 5_000_000
# Uniform samples up to this many rows are taken as a top-k.
SMALL_SAMPLE = 100_000


def _fetch(df: DataFrame, picked: DataFrame, row_id: str, label: str) -> DataFrame:
    """Bring back the other columns of picked rows; ranking itself touches only id and label."""
    if set(df.columns) <= {row_id, label}:
        return picked
    rest = df.drop(label) if label in picked.columns else df
    return join_checked(rest, picked, row_id)


def _first_drawn(
    df: DataFrame, group: Sequence[str], row_id: str, seeds: Sequence[tuple[int, int]], n: int, direct_rows: int
) -> DataFrame:
    """Rows (group..., row_id, split_idx, seed, rn) with rn <= n in the seeded order of each group.

    Rows without a label or set are left out.  Small tables are ranked directly.  For others the
    class sizes tell how far into the even draw keys the n-th row can lie; rows beyond that
    bound are dropped while scanning, so the many seeds are never sorted over the whole
    table.  A count of what is left shows whether the bound was far enough; if not, the
    direct way is taken, so the result is the same.
    """
    group = list(group)
    numbered = F.array(*[F.struct(F.lit(i).alias("split_idx"), F.lit(s).alias("seed")) for i, s in seeds])
    narrow = df.select(*group, row_id).dropna(subset=group)

    def ranked(rows: DataFrame) -> DataFrame:
        by = [*group, "split_idx", "seed"]
        if n <= GROUP_LIMIT:
            return first_per_group(rows, by, ["_key", row_id], n)
        places = exact_rank(rows.withColumn("_k", F.col("_key")), F.col("_k"), [row_id], by, name="rn")
        return places.withColumn("rn", F.col("rn") + 1).filter(F.col("rn") <= n).withColumnRenamed("_k", "_key")

    drawn = narrow.select(*group, row_id, F.inline(numbered)).withColumn("_key", draw_key(F.col("seed"), row_id))
    sizes = cut_lineage(narrow.groupBy(*group).agg(F.count(F.lit(1)).alias("_size")), "class-sizes")
    if (sizes.agg(F.sum("_size")).first()[0] or 0) <= direct_rows:
        return ranked(drawn)
    bounds = sizes.select(*group, "_size", key_bound(F.lit(n + slack(n)) / F.col("_size")).alias("_bound"))
    near = join_checked(narrow, bounds, group).select(*group, row_id, "_size", "_bound", F.inline(numbered))
    near = near.withColumn("_key", draw_key(F.col("seed"), row_id)).filter(
        F.substring("_key", 1, KEY_DIGITS) <= F.col("_bound")
    )
    near = cut_lineage(near.drop("_bound"), "near-keys")
    enough = near.groupBy(*group, "seed", "_size").count().filter(F.col("count") >= F.least(F.lit(n), F.col("_size")))
    if enough.count() == sizes.count() * len({s for _, s in seeds}):
        return ranked(near.drop("_size"))
    return ranked(drawn)


def sample_per_class(
    df: DataFrame,
    label: str = "label",
    n: int = 8,
    seed: int = 42,
    row_id: str = "row_id",
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """At most n seeded rows of each class; smaller classes are taken whole."""
    picked = _first_drawn(df, [label], row_id, [(0, seed)], n, direct_rows).select(row_id, label)
    return _fetch(df, picked, row_id, label).select(*df.columns)


def fewshot_splits(
    df: DataFrame,
    sizes: Sequence[int] = SAMPLE_SIZES,
    seeds: Sequence[int] = SEEDS,
    label: str = "label",
    row_id: str = "row_id",
    within: Sequence[str] = (),
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """All training splits of a size x seed grid as one table.

    Ranks are taken once per (seed, class) at the largest size; every smaller size is a
    prefix of it, so the whole grid costs one shuffle of id and label.  ``within`` names
    columns that hold separate train sets.
    """
    within = list(within)
    ranked = _first_drawn(df, [*within, label], row_id, list(enumerate(seeds)), max(sizes), direct_rows)
    wanted = F.filter(F.array(*[F.lit(s) for s in sorted(set(sizes))]), lambda s: F.col("rn") <= s)
    picked = ranked.select(
        *within, F.explode(wanted).alias("sample_size"), "split_idx", "seed", row_id, label
    )
    if set(df.columns) <= {row_id, label, *within}:
        return picked
    return join_checked(df.drop(label, *within), picked, row_id)


def split_name(size="sample_size", idx="split_idx") -> Column:
    return F.concat(F.lit("train-"), F.col(size).cast("string"), F.lit("-"), F.col(idx).cast("string"))


def fewshot_splits_multilabel(
    df: DataFrame,
    label_columns: Sequence[str],
    sizes: Sequence[int] = SAMPLE_SIZES,
    seeds: Sequence[int] = SEEDS,
    row_id: str | None = "row_id",
) -> DataFrame:
    """Per set label up to n rows for each grid cell, duplicates dropped.

    Without a row id the whole row is its own identity, so equal rows count once.
    """
    keep = list(df.columns)
    if row_id is None:
        row_id = "_row_key"
        df = df.withColumn(row_id, F.md5(F.to_json(F.struct(*keep)))).dropDuplicates([row_id])
    named = F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in label_columns])
    long = df.select(row_id, F.explode(F.filter(named, lambda c: c.isNotNull())).alias("_class"))
    picked = (
        fewshot_splits(long, sizes, seeds, label="_class", row_id=row_id)
        .select("sample_size", "split_idx", "seed", row_id)
        .distinct()
    )
    out = join_checked(df, picked, row_id)
    return out.select("sample_size", "split_idx", "seed", *keep)


def sample_uniform(df: DataFrame, n: int, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """n seeded rows whatever their label: a top-k when few, a filter by the n-th key when many."""
    key = draw_key(seed, row_id)
    if n > SMALL_SAMPLE:
        return df.filter(among_first(df.select(row_id), key, [row_id], n))
    if set(df.columns) == {row_id}:
        return take_first(df, key, [row_id], n)
    picked = take_first(df.select(row_id), key, [row_id], n)
    return join_checked(df, picked, row_id).select(*df.columns)


def shortest_example(sample: DataFrame, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """The shortest text of a sample, the first by id among equals."""
    return sample.orderBy(F.length(text), row_id).limit(1)


def hash_fraction(seed, row_id: str = "row_id") -> Column:
    """Even number in [0, 1) for each row of a seed."""
    return draw_number(draw_key(seed, row_id)) / F.lit(float(2**32))


def train_test_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Add ``is_test``; rows are assigned one by one, so no shuffle is needed and the size is approximate."""
    return df.withColumn("is_test", hash_fraction(seed, row_id) < test_size)


def train_test_split_exact(df: DataFrame, n_test: int, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Add ``is_test`` for exactly ``n_test`` seeded rows; rows stay where they are."""
    chosen = among_first(df.select(row_id), draw_key(seed, row_id), [row_id], n_test)
    return df.withColumn("is_test", chosen)


def class_quotas(df: DataFrame, label: str, max_size, by: Sequence[str] = ()) -> DataFrame:
    """Rows allowed per class when a group is cut to ``max_size``: even shares, the rest to the first classes.

    Returns (by, label, quota, total); ``max_size`` is a number or a column of ``by`` grain.
    """
    by = list(by)
    size = max_size if isinstance(max_size, Column) else F.lit(int(max_size))
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    return (
        counts.groupBy(*by)
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col(label).cast("string").alias("s"), F.col(label).alias("v")))).alias(
                "_classes"
            ),
            F.sum("_n").alias("total"),
        )
        .select(*by, "total", F.size("_classes").alias("_k"), F.posexplode("_classes").alias("_pos", "_class"))
        .select(
            *by,
            F.col("_class.v").alias(label),
            "total",
            (F.floor(size / F.col("_k")) + (F.col("_pos") < size % F.col("_k")).cast("int")).cast("bigint").alias("quota"),
        )
    )


def balanced_downsample(
    df: DataFrame, max_size: int | None, seed: int = 42, label: str = "label", row_id: str = "row_id"
) -> DataFrame:
    """Cut to ``max_size`` rows with even class shares; what small classes leave free goes to the others.

    Ranks inside a class and among the rows left over come from slices of the draw keys, so a class of any
    size is spread over many tasks.  Nothing is ranked when nothing is to be cut.
    """
    if max_size is None:
        return df
    narrow = df.select(row_id, label)
    quotas = cut_lineage(class_quotas(narrow, label, max_size), "quotas")
    counts = narrow.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total, kept = counts.join(quotas, label).agg(F.max("total"), F.sum(F.least("_n", "quota"))).first()
    if (total or 0) <= max_size:
        return df
    ranked = exact_rank(narrow, draw_key(seed, row_id), [row_id], [label], name="_rank")
    ranked = cut_lineage(join_checked(ranked, quotas.select(label, "quota"), label), "class-ranks")
    picked = ranked.filter("_rank < quota").select(row_id)
    if kept < max_size:
        rest = ranked.filter("_rank >= quota").select(row_id)
        picked = picked.unionByName(take_first(rest, draw_key(seed, row_id), [row_id], max_size - kept))
    return join_checked(df, picked, row_id).select(*df.columns)


def downsample_cells(
    df: DataFrame, max_size: Column, by: Sequence[str], seed, label: str = "label", row_id: str = "row_id"
) -> DataFrame:
    """``balanced_downsample`` inside every few-shot cell at once; ``max_size`` is a column constant per cell."""
    by = list(by)
    keyed = df.withColumn("_key", draw_key(seed, row_id)).withColumn("_max", max_size)
    shares = class_quotas(keyed, label, F.col("_max"), [*by, "_max"]).withColumnRenamed("quota", "_quota").drop("total")
    in_class = Window.partitionBy(*by, label).orderBy("_key", row_id)
    in_cell = Window.partitionBy(*by).orderBy((F.col("_rn") > F.col("_quota")).cast("int"), "_key", row_id)
    return (
        keyed.withColumn("_rn", F.row_number().over(in_class))
        .join(shares, [*by, "_max", label])
        .withColumn("_place", F.row_number().over(in_cell))
        .filter(F.col("_place") <= F.col("_max"))
        .select(*df.columns)
    )


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_samples"))


def imbalance_report(df: DataFrame, label: str = "label", ratio: float = 1.5) -> DataFrame:
    """Class counts with a flag when the largest class exceeds ``ratio`` times the smallest."""
    counts = class_counts(df, label)
    flag = counts.agg((F.max("n_samples") > F.min("n_samples") * F.lit(ratio)).alias("f")).scalar()
    return counts.withColumn("imbalanced", flag)


def language_regimes(
    df: DataFrame,
    regime: str,
    languages: Sequence[str],
    sizes: Sequence[int] = SAMPLE_SIZES,
    seeds: Sequence[int] = SEEDS,
    lang: str = "lang",
    label: str = "label",
    row_id: str = "row_id",
    pivot_lang: str = "en",
) -> DataFrame:
    """Training splits per test language: its own ('each'), English only ('en') or all languages ('all')."""
    if regime == "each":
        splits = fewshot_splits(df.select(lang, row_id, label), sizes, seeds, label, row_id, within=[lang])
        return splits.withColumnRenamed(lang, "test_lang")
    if regime == "en":
        source = df.filter(F.col(lang) == pivot_lang)
    elif regime == "all":
        source = df
    else:
        raise ValueError("regime is one of 'each', 'en' and 'all'")
    splits = fewshot_splits(source.select(row_id, label), sizes, seeds, label, row_id)
    targets = F.array(*[F.lit(code) for code in languages])
    return splits.select(F.explode(targets).alias("test_lang"), *splits.columns)
