"""Seeded order: md5 over (seed, row id), so results never depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from handful.session import cut_lineage

# Spark pushes row_number() <= n below the shuffle only up to this limit.
GROUP_LIMIT = 1000


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def draw_key(seed, *ids) -> Column:
    """Hex string that orders rows for one seed; ``seed`` is a value or a column."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", head.cast("string"), *[_col(c).cast("string") for c in ids]))


def draw_number(key: Column, digits: int = 8) -> Column:
    """First hex digits of a draw key as BIGINT in [0, 16**digits), digits up to 15."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("bigint")


def first_per_group(df: DataFrame, by: Sequence, order: Sequence, n: int, rank: str = "rn") -> DataFrame:
    """Keep the first ``n`` rows of each group, adding their rank from 1; n is at most ``GROUP_LIMIT``.

    Spark trims every map partition to n rows per group before the shuffle, so a dominant group never
    reaches one task whole.  Beyond the limit use ``exact_rank``.
    """
    if n > GROUP_LIMIT:
        raise ValueError(f"first_per_group keeps at most {GROUP_LIMIT} rows of a group; exact_rank has no limit")
    window = Window.partitionBy(*[_col(c) for c in by]).orderBy(*[_col(c) for c in order])
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def exact_rank(
    df: DataFrame, key: Column, ties: Sequence[str], by: Sequence[str] = (), name: str = "rank", digits: int = 3
) -> DataFrame:
    """Zero-based position inside ``by`` in the order (key, ties), without one big sort task.

    ``key`` is a draw key.  Its first hex digits cut each group into 16**digits
    even slices; slice counts give each slice its offset and only slices are
    sorted, so a group that holds most rows is still spread over many tasks.
    """
    by = list(by)
    sliced = df.withColumn("_key", key).withColumn("_slice", F.substring("_key", 1, digits))
    counts = sliced.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_slice", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_slice").orderBy("_key", *ties)
    return (
        sliced.join(offsets, [*by, "_slice"])
        .withColumn(name, (F.col("_offset") + F.row_number().over(inside) - 1).cast("bigint"))
        .drop("_key", "_slice", "_offset")
    )


def unique_lists(df: DataFrame, by: Sequence[str], columns: Sequence[str], limit: int = 30) -> DataFrame:
    """(by..., columns...): the first ``limit`` distinct non-blank values of each column in text order, joined by
    ';', with '...(+n)' for n others; '' where there are none. ``n_<column>`` counts the distinct values.

    Values are made distinct first; each task passes on ``limit`` of a group and counts of the rest, so no row
    grows with the values of its group. Groups without any value are left out.
    """
    by = list(by)
    cells = F.array(*[F.struct(F.lit(c).alias("_field"), F.col(c).cast("string").alias("_value")) for c in columns])
    values = cut_lineage(df.select(*by, F.inline(cells)).filter("_value <> ''").distinct(), "distinct-values")
    counts = values.groupBy(*by, "_field").agg(F.count(F.lit(1)).alias("_n"))
    first = first_per_group(values, [*by, "_field"], ["_value"], limit).groupBy(*by, "_field")
    heads = first.agg(F.array_join(F.array_sort(F.collect_list("_value")), ";").alias("_head"))
    empty = F.lit(None)
    both = heads.withColumn("_n", empty.cast("bigint")).unionByName(counts.withColumn("_head", empty.cast("string")))
    own = lambda c, v: F.max(F.when(F.col("_field") == c, F.col(v)))
    out = both.groupBy(*by).agg(
        *[own(c, "_head").alias(f"_head_{c}") for c in columns], *[F.coalesce(own(c, "_n"), F.lit(0)).alias(f"n_{c}") for c in columns]
    )
    told = []
    for c in columns:
        rest = F.col(f"n_{c}") - limit
        more = F.when(rest > 0, F.concat(F.lit(";...(+"), rest.cast("string"), F.lit(")"))).otherwise(F.lit(""))
        told.append(F.coalesce(F.concat(f"_head_{c}", more), F.lit("")).alias(c))
    return out.select(*by, *told, *[f"n_{c}" for c in columns])


def running_totals(
    steps: DataFrame, by: Sequence[str], value: str, sums: Sequence[str], descending: bool = False
) -> DataFrame:
    """Running and whole-group sums in the order of a column that is unique per group; NULL comes last.

    Adds ``<sum>_run`` (this row included) and ``<sum>_all``.  Rows are range-partitioned by
    group and value at sampled quantiles, so neither a large group nor an outlier fills one task;
    partitions are written once, their sums accumulated, and only partitions are sorted.
    """
    by = list(by)
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    ranged = steps.repartitionByRange(*[F.col(c).asc() for c in by], order)
    cut = cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()), "ranged")
    parts = cut.groupBy(*by, "_slice").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    parts = parts.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_slice").alias("_of"),
        *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_before") for c in sums],
        *[F.sum(f"_{c}").over(whole).alias(f"{c}_all") for c in sums],
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_slice") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return cut.join(parts, same).select(
        *steps.columns,
        *[(F.col(f"_{c}_before") + F.sum(c).over(inside)).alias(f"{c}_run") for c in sums],
        *[f"{c}_all" for c in sums],
    )


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation: (by..., q0, q1, ...), groups of any size.

    Equal values are counted first; ranks then come from running totals, so no group is
    held in memory.
    """
    by = list(by)
    steps = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(steps, by, value, ["n"])
    columns = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("n_all") - 1)

        def at(rank):
            here = (F.col("n_run") - F.col("n") <= rank) & (rank < F.col("n_run"))
            return F.max(F.when(here, F.col(value)))

        low, high = at(F.floor(place)), at(F.ceil(place))
        share = F.max(place - F.floor(place))
        columns.append((low + share * (high - low)).alias(f"q{i}"))
    return ranked.groupBy(*by).agg(*columns)


# Hex digits of a draw key that are compared, and numbers of that many digits.
KEY_DIGITS = 15
KEY_SPACE = 16**KEY_DIGITS


def key_bound(share: Column) -> Column:
    """The draw-key prefix below which about ``share`` of all rows lie; above every key for shares from 1."""
    number = (F.least(share, F.lit(1.0)) * F.lit(float(KEY_SPACE))).cast("bigint")
    return F.when(share >= 1, F.lit("g")).otherwise(F.lower(F.lpad(F.hex(number), KEY_DIGITS, "0")))


def slack(n):
    """Rows around n that a uniform draw misses only with negligible probability (and then a check notices)."""
    return 10 * n**0.5 + 20


def among_first(df: DataFrame, key: Column, ties: Sequence[str], n: int) -> Column:
    """Condition that holds for exactly the n first rows in the order (key, ties).

    Draw keys are even, so the n-th key lies in a narrow band around n / rows.  One pass
    counts the rows below the band and inside it, and only the band is ordered: no row is
    shuffled.  If the band misses the n-th row, the exact ranks find it.
    """
    total = df.count()
    if n >= total:
        return F.lit(True)
    if n <= 0:
        return F.lit(False)
    prefix = F.substring(key, 1, KEY_DIGITS)
    low = key_bound(F.lit(max(n - slack(n), 0) / total))
    high = key_bound(F.lit((n + slack(n)) / total))
    below, inside = df.agg(
        F.count(F.when(prefix < low, 1)), F.count(F.when((prefix >= low) & (prefix <= high), 1))
    ).first()
    place = n - below
    named = df.select(*ties, key.alias("_key"))
    if 0 < place <= inside:
        band = named.filter((F.substring("_key", 1, KEY_DIGITS) >= low) & (F.substring("_key", 1, KEY_DIGITS) <= high))
        last = band.orderBy("_key", *ties).offset(place - 1).limit(1).first()
    else:
        ranked = exact_rank(named.withColumn("_k", F.col("_key")), F.col("_k"), ties, name="_rank")
        last = ranked.filter(F.col("_rank") == n - 1).withColumnRenamed("_k", "_key").first()
    edge = F.struct(F.lit(last["_key"]).alias("k"), *[F.lit(last[t]).alias(t) for t in ties])
    return F.struct(key.alias("k"), *[F.col(t).alias(t) for t in ties]) <= edge


def take_first(df: DataFrame, key: Column, ties: Sequence[str], n: int, driver_rows: int = 100_000) -> DataFrame:
    """The n first rows in the order (key, ties): a top-k when small, sliced ranks beyond."""
    if n <= driver_rows:
        return df.orderBy(key, *ties).limit(n)
    return exact_rank(df, key, ties, name="_rank").filter(F.col("_rank") < n).drop("_rank")
