"""Contrastive pairs: exact over few-shot samples, drawn over whole tables.

``contrastive_pairs`` lists every pair of a few-shot sample, as pair training
does; it is quadratic in the sample and refuses more than ``MAX_SAMPLE`` rows.
For a whole table ``drawn_pairs`` gives every row a fixed number of partners by
rank arithmetic and equi-joins, and ``pair_counts`` gives the exact numbers of
pairs without listing any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from handful.functions.order import draw_key, draw_number, exact_rank
from handful.functions.vectors import cosine
from handful.session import cut_lineage, join_checked

MAX_SAMPLE = 20_000


def _guard(df: DataFrame, by: Sequence[str], limit: int) -> None:
    sizes = df.groupBy(*by).count() if by else df.agg(F.count(F.lit(1)).alias("count"))
    largest = sizes.agg(F.max("count")).first()[0] or 0
    if largest > limit:
        raise ValueError(
            f"{largest} rows in one sample: all pairs are listed up to {limit} rows only; use drawn_pairs instead."
        )


def _tiled(df: DataFrame, by: Sequence[str], payload: Sequence[str], row_id: str, tiles: int) -> DataFrame:
    """Every unordered pair (x, x included) of each sample, spread over tiles*(tiles+1)/2 join keys.

    Rows are cut into tiles by id hash.  A pair belongs to the key made of its two
    tiles, so the pairs of one sample are formed in many tasks by an equi-join.
    """
    by = list(by)
    tile = F.pmod(F.xxhash64(row_id), F.lit(tiles)).cast("int")
    base = df.select(*by, row_id, *payload).withColumn("_t", tile)
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    keyed = base.withColumn("_o", other).withColumn("_lo", F.least("_t", "_o")).withColumn("_hi", F.greatest("_t", "_o"))
    left = keyed.select(
        *by, "_lo", "_hi", F.col(row_id).alias("id_1"), F.col("_t").alias("_t1"), *[F.col(c).alias(f"{c}_1") for c in payload]
    )
    right = keyed.select(
        *by, "_lo", "_hi", F.col(row_id).alias("id_2"), F.col("_t").alias("_t2"), *[F.col(c).alias(f"{c}_2") for c in payload]
    )
    home = (F.col("_lo") == F.least("_t1", "_t2")) & (F.col("_hi") == F.greatest("_t1", "_t2"))
    joined = left.join(right, [*by, "_lo", "_hi"])
    return joined.filter(home & (F.col("id_1") <= F.col("id_2"))).drop("_lo", "_hi", "_t1", "_t2")


def contrastive_pairs(
    df: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    row_id: str = "row_id",
    multilabel: bool = False,
    tiles: int = 4,
    limit: int = MAX_SAMPLE,
) -> DataFrame:
    """All unordered pairs of a sample, a row with itself included: (by..., id_1, id_2, label).

    1.0 for equal labels (or, for 0/1 vectors, a label set in both), else 0.0.
    """
    _guard(df, by, limit)
    pairs = _tiled(df, by, [label], row_id, tiles)
    one, two = F.col(f"{label}_1"), F.col(f"{label}_2")
    same = F.exists(F.zip_with(one, two, lambda a, b: (a == 1) & (b == 1)), lambda x: x) if multilabel else one == two
    return pairs.select(*by, "id_1", "id_2", F.when(same, 1.0).otherwise(0.0).alias("label"))


def positive_pairs(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", row_id: str = "row_id", limit: int = MAX_SAMPLE
) -> DataFrame:
    """Only the equal-label pairs of a sample, as an equi-join on the label."""
    _guard(df, by, limit)
    by = list(by)
    left = df.select(*by, label, F.col(row_id).alias("id_1"))
    right = df.select(*by, label, F.col(row_id).alias("id_2"))
    return left.join(right, [*by, label]).filter("id_1 <= id_2").select(*by, "id_1", "id_2", F.lit(1.0).alias("label"))


def teacher_pairs(
    df: DataFrame,
    by: Sequence[str] = (),
    vector: str = "embedding",
    row_id: str = "row_id",
    tiles: int = 4,
    limit: int = MAX_SAMPLE,
) -> DataFrame:
    """All unordered pairs of a sample labelled with the cosine of the teacher's vectors."""
    _guard(df, by, limit)
    pairs = _tiled(df, by, [vector], row_id, tiles)
    return pairs.select(*by, "id_1", "id_2", cosine(f"{vector}_1", f"{vector}_2").alias("label"))


def pair_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Exact numbers of positive and negative pairs of a whole table, and the rows each strategy gives."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("decimal(38,0)")
    pos = F.sum((n * (n + 1) / 2).cast("decimal(38,0)"))
    every = (F.sum(n) * (F.sum(n) + 1) / 2).cast("decimal(38,0)")
    base = counts.agg(pos.cast("bigint").alias("n_positive"), (every - pos).cast("bigint").alias("n_negative"))
    return base.select(
        "*",
        (F.col("n_positive") + F.col("n_negative")).alias("n_unique"),
        (2 * F.least("n_positive", "n_negative")).alias("n_undersampling"),
        (2 * F.greatest("n_positive", "n_negative")).alias("n_oversampling"),
    )


def balance_pairs(
    pairs: DataFrame,
    strategy: str = "oversampling",
    n_per_side: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Order and repeat pairs so that positives and negatives alternate: adds ``pair_ix``.

    'unique' keeps every pair once; 'undersampling' and 'oversampling' bring both
    sides to the smaller or larger count; ``n_per_side`` overrides the strategy.  A
    short side starts over in the same order.  An empty side stays empty.
    """
    if strategy not in ("unique", "undersampling", "oversampling"):
        raise ValueError("strategy is one of 'unique', 'oversampling' and 'undersampling'")
    side = F.when(F.col("label") == 1.0, F.lit(0)).otherwise(F.lit(1))
    ranked = exact_rank(
        pairs.withColumn("_side", side), draw_key(seed, "id_1", "id_2"), ["id_1", "id_2"], ["_side"], name="_rank"
    )
    sizes = pairs.agg(
        F.struct(
            F.count(F.when(side == 0, 1)).alias("pos"), F.count(F.when(side == 1, 1)).alias("neg")
        ).alias("s")
    ).scalar()
    ranked = ranked.withColumn("_s", sizes)
    own = F.when(F.col("_side") == 0, F.col("_s.pos")).otherwise(F.col("_s.neg"))
    if n_per_side is not None:
        target = F.lit(int(n_per_side))
    elif strategy == "unique":
        target = own
    elif strategy == "undersampling":
        target = F.least("_s.pos", "_s.neg")
    else:
        target = F.greatest("_s.pos", "_s.neg")
    copies = F.ceil(target / own).cast("int")
    turn = F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>")))
    spread = ranked.select("*", target.alias("_target"), own.alias("_own"), turn.alias("_turn"))
    place = F.col("_rank") + F.col("_turn") * F.col("_own")
    return (
        spread.withColumn("_place", place)
        .filter(F.col("_place") < F.col("_target"))
        .select(*pairs.columns, (2 * F.col("_place") + F.col("_side")).cast("bigint").alias("pair_ix"))
    )


def cap_pairs(pairs: DataFrame, max_pairs: int, seed: int = 42) -> DataFrame:
    """At most ``max_pairs // 2`` pairs of each kind, the first in the seeded order; -1 keeps all."""
    if max_pairs == -1:
        return pairs
    side = (F.col("label") == 1.0).cast("int")
    ranked = exact_rank(
        pairs.withColumn("_side", side), draw_key(seed, "id_1", "id_2"), ["id_1", "id_2"], ["_side"], name="_rank"
    )
    return ranked.filter(F.col("_rank") < max_pairs // 2).drop("_rank", "_side")


def drawn_pairs(
    df: DataFrame, m: int, seed: int = 42, label: str = "label", row_id: str = "row_id"
) -> DataFrame:
    """m positive and m negative partners for every row of a whole table: (id_1, id_2, label, draw).

    Rows get a rank inside their class and classes get offsets, so a partner is a
    number: a drawn rank of the own class, or a drawn place among all rows outside
    it.  Two equi-joins on unique numbers find the partners; no pair is listed that
    is not kept, and output grows with the rows.  A row may draw itself as positive
    partner, as pairs of a row with itself are allowed; a class without any other
    class gives no negatives.
    """
    narrow = df.select(row_id, label)
    ranked = exact_rank(narrow, draw_key(seed, row_id), [row_id], [label], name="_rank")
    counts = narrow.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(F.col(label).cast("string")).rowsBetween(Window.unboundedPreceding, -1)
    classes = counts.select(
        label, "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(Window.partitionBy()).alias("_all")
    )
    placed = join_checked(ranked, classes, label).withColumn("_place", F.col("_off") + F.col("_rank"))
    draws = placed.select(
        F.col(row_id).alias("id_1"),
        "_n",
        "_off",
        "_all",
        F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("draw"),
    )
    pick_pos = draw_number(draw_key(seed, F.lit("p"), F.col("id_1"), F.col("draw")), 15)
    pick_neg = draw_number(draw_key(seed, F.lit("n"), F.col("id_1"), F.col("draw")), 15)
    outside = F.col("_all") - F.col("_n")
    skip = pick_neg % outside
    choices = F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("_off") + pick_pos % F.col("_n")).alias("_place")),
        F.struct(
            F.lit(0.0).alias("label"),
            F.when(outside > 0, F.when(skip < F.col("_off"), skip).otherwise(skip + F.col("_n"))).alias("_place"),
        ),
    )
    wanted = draws.select("id_1", "draw", F.inline(choices)).filter(F.col("_place").isNotNull())
    partners = placed.select(F.col("_place"), F.col(row_id).alias("id_2"))
    return wanted.join(partners, "_place").select("id_1", "id_2", "label", "draw")


def _placed(df: DataFrame, label: str, row_id: str, seed: int) -> DataFrame:
    """(row_id, label, _rank) in the seeded order of each class."""
    return exact_rank(df.select(row_id, label), draw_key(seed, row_id), [row_id], [label], name="_rank")


def _classes(df: DataFrame, label: str, max_pairs: int) -> DataFrame:
    """Per class: size, first place, rows after it, and how many positive and negative pairs it gives to the budget.

    Both halves of the budget are shared by cumulative rounding in proportion to the pairs a class has,
    so the shares add up exactly and never exceed what there is.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy(F.col(label).cast("string"))
    before, upto, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    rows = counts.select(
        label, "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(whole).alias("_all")
    ).withColumn("_after", F.col("_all") - F.col("_off") - F.col("_n"))
    wide = "decimal(38,0)"
    n = F.col("_n").cast(wide)
    rows = rows.withColumn("_p", (n * (n + 1) / 2).cast(wide)).withColumn("_q", (n * F.col("_after").cast(wide)).cast(wide))
    for side in ("p", "q"):
        total, run = F.sum(f"_{side}").over(whole).cast(wide), F.sum(f"_{side}").over(upto).cast(wide)
        budget = F.least(F.lit(max_pairs // 2).cast(wide), total)
        share = F.floor(run.cast("double") / total.cast("double") * budget.cast("double"))
        mark = F.when(budget == total, run.cast("bigint")).when(run == total, budget.cast("bigint")).otherwise(share)
        rows = rows.withColumn(f"_mark_{side}", mark)
        rows = rows.withColumn(f"_k{side}", F.col(f"_mark_{side}") - F.coalesce(F.lag(f"_mark_{side}").over(order), F.lit(0)))
    return rows.select(label, "_n", "_off", "_after", "_kp", "_kq")


def _turns(budget: str) -> Column:
    """0, 1, ... for every round in which the row of this rank still gets a pair of its class's budget."""
    left = F.col(budget) - F.col("_rank")
    return F.when(left > 0, F.sequence(F.lit(0).cast("bigint"), F.floor((left - 1) / F.col("_n")))).otherwise(
        F.array().cast("array<bigint>")
    )


def capped_pairs(df: DataFrame, max_pairs: int, seed: int = 42, label: str = "label", row_id: str = "row_id") -> DataFrame:
    """``max_pairs // 2`` distinct positive and as many negative pairs of a table of any size: (id_1, id_2, label).

    Rows are ranked in a seeded order inside their class.  In round t a row is paired with the row t
    ranks on in its class, and with a row of a later class: every unordered pair comes up in exactly one round,
    so a budget is a number of rounds, no pair outside it is listed, and the output is the budget.  A side
    with fewer pairs gives all it has.
    """
    placed = join_checked(_placed(df, label, row_id, seed), _classes(df, label, max_pairs), label)
    placed = cut_lineage(placed.withColumn("_place", F.col("_off") + F.col("_rank")), "placed")
    same = placed.select(
        F.col(row_id).alias("id_1"),
        F.lit(1.0).alias("label"),
        F.explode(_turns("_kp")).alias("_turn"),
        "_rank", "_n", "_off",
    ).select("id_1", "label", (F.col("_off") + (F.col("_rank") + F.col("_turn")) % F.col("_n")).alias("_place"))
    # Ranks are spread evenly over all later rows, so that no class is preferred.
    spread = F.floor(F.col("_rank").cast("double") / F.col("_n") * F.col("_after"))
    other = placed.select(
        F.col(row_id).alias("id_1"),
        F.lit(0.0).alias("label"),
        F.explode(_turns("_kq")).alias("_turn"),
        "_rank", "_n", "_off", "_after",
    ).select(
        "id_1", "label", (F.col("_off") + F.col("_n") + (spread + F.col("_turn")) % F.col("_after")).alias("_place")
    )
    partners = placed.select("_place", F.col(row_id).alias("id_2"))
    found = same.unionByName(other).join(partners, "_place")
    one, two = F.least("id_1", "id_2"), F.greatest("id_1", "id_2")
    return found.select(one.alias("id_1"), two.alias("id_2"), "label")


def drawn_teacher_pairs(
    df: DataFrame, m: int, seed: int = 42, vector: str = "embedding", row_id: str = "row_id", max_pairs: int = -1
) -> DataFrame:
    """Pairs of every row with the row itself and the ``m - 1`` next ones in a seeded order, with the teacher's cosine.

    Pairs are distinct as long as ``2 * m`` is at most the number of rows.  ``max_pairs`` instead of ``m`` (then 0) takes as many rounds as
    give that many pairs, but never a pair twice.  Two equi-joins by rank and id move each vector a
    bounded number of times, and no pair outside the draw is listed.
    """
    ranked = cut_lineage(exact_rank(df.select(row_id), draw_key(seed, row_id), [row_id], name="_rank"), "ranked-rows")
    n = ranked.count()
    budget = m * n if m else max_pairs
    budget = min(budget, n * (n + 1) // 2)
    left = F.lit(budget) - F.col("_rank")
    turns = F.when(left > 0, F.sequence(F.lit(0).cast("bigint"), F.floor((left - 1) / F.lit(max(n, 1))))).otherwise(
        F.array().cast("array<bigint>")
    )
    wanted = ranked.select(F.col(row_id).alias("id_1"), "_rank", F.explode(turns).alias("_turn"))
    wanted = wanted.select("id_1", ((F.col("_rank") + F.col("_turn")) % F.lit(max(n, 1))).alias("_place"))
    found = wanted.join(ranked.select(F.col("_rank").alias("_place"), F.col(row_id).alias("id_2")), "_place")
    one = df.select(F.col(row_id).alias("id_1"), F.col(vector).alias("_a"))
    two = df.select(F.col(row_id).alias("id_2"), F.col(vector).alias("_b"))
    joined = found.select(F.least("id_1", "id_2").alias("id_1"), F.greatest("id_1", "id_2").alias("id_2"))
    return joined.join(one, "id_1").join(two, "id_2").select("id_1", "id_2", cosine("_a", "_b").alias("label"))


# Label sets that occur; each row carries the sets it shares a label with.
MAX_SETS = 4096


def drawn_pairs_multilabel(df: DataFrame, m: int, seed: int = 42, label: str = "label", row_id: str = "row_id") -> DataFrame:
    """m positive and m negative partners for every row with a 0/1 label vector: (id_1, id_2, label, draw).

    A partner is positive if it has a label in common.  Rows with the same vector form a set class; a drawn number
    picks a place among the rows of all classes that share a label (or of all that share none).  A row without such
    rows gives no pair of that kind.  The table of set classes is bounded by ``MAX_SETS``.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(MAX_SETS + 1).collect()
    if len(counts) > MAX_SETS:
        raise ValueError(f"more than {MAX_SETS} different label sets")
    sets = sorted(([int(v) for v in r[0]], r["n"]) for r in counts)
    offsets, total = [], 0
    for _, n in sets:
        offsets.append(total)
        total += n
    table = []
    for own, _ in sets:
        sides: tuple[list, list] = ([], [])
        sizes = [0, 0]
        for (other, n), off in zip(sets, offsets):
            side = 0 if any(a and b for a, b in zip(own, other)) else 1
            sides[side].append((sizes[side], n, off))
            sizes[side] += n
        table.append((own, offsets[len(table)], *sides, *sizes))
    part = "array<struct<start: bigint, n: bigint, off: bigint>>"
    spark = df.sparkSession
    kind = df.schema[label].dataType.simpleString()
    classes = spark.createDataFrame(
        table, f"_set array<bigint>, _off bigint, _pos {part}, _neg {part}, _n_pos bigint, _n_neg bigint"
    ).withColumn(label, F.col("_set").cast(kind))
    placed = _placed(df, label, row_id, seed).join(F.broadcast(classes.drop("_set")), label)
    placed = placed.withColumn("_place", F.col("_off") + F.col("_rank"))
    draws = placed.select(
        F.col(row_id).alias("id_1"), "_pos", "_neg", "_n_pos", "_n_neg", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("draw")
    )

    def pick(side: str, letter: str) -> Column:
        size = F.col(f"_n_{side}")
        number = draw_number(draw_key(seed, F.lit(letter), F.col("id_1"), F.col("draw")), 15) % size
        part = F.filter(f"_{side}", lambda c: (c["start"] <= number) & (number < c["start"] + c["n"]))[0]
        return F.when(size > 0, part["off"] + number - part["start"])

    choices = F.array(
        F.struct(F.lit(1.0).alias("label"), pick("pos", "p").alias("_place")),
        F.struct(F.lit(0.0).alias("label"), pick("neg", "n").alias("_place")),
    )
    wanted = draws.select("id_1", "draw", F.inline(choices)).filter(F.col("_place").isNotNull())
    return wanted.join(placed.select("_place", F.col(row_id).alias("id_2")), "_place").select("id_1", "id_2", "label", "draw")


def attach_texts(pairs: DataFrame, texts: DataFrame, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """Add ``sentence_1`` and ``sentence_2``."""
    one = texts.select(F.col(row_id).alias("id_1"), F.col(text).alias("sentence_1"))
    two = texts.select(F.col(row_id).alias("id_2"), F.col(text).alias("sentence_2"))
    return pairs.join(one, "id_1").join(two, "id_2")


def cosine_pair_loss(scored: DataFrame, similarity: str = "similarity", label: str = "label") -> DataFrame:
    """Mean squared difference of cosine and pair label."""
    gap: Column = F.col(similarity) - F.col(label)
    return scored.agg(F.avg(gap * gap).alias("loss"))
