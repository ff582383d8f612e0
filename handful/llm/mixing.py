"""Mixing sources to target weights by entropy balancing.

Every source gets a target in words: its share by weight of all words, at most ``cap`` times its own
size, the excess going to the other sources by weight until none is above its cap. Among all document
rates between 0 and ``cap`` that meet a source's target, those closest in entropy to taking each
document once are ``min(cap, exp(lambda * size / scale))``. The dual variable of each source is found by
Newton steps on the log of the words taken, kept inside a bracket; a step is one aggregation over
the (source, size) counts of all documents. Rates become copies by rounding that carries its error from
larger to smaller sizes, so a source ends within about one small document of its target; documents
of one source and size share their copies by hash of the id.

Defined results: a null text has size 0; size 0 takes 0 words. A null source is a source of its
own, last in order. Rows that repeat an id are documents of their own. A source of size 0 has target 0.
An empty table gives no rows. Columns other than id, text and source take no part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from handful.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
SLOTS = 256


def word_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size, sid, target) from (source, source_size), one row per source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("sid", F.row_number().over(order) - 1).withColumn("weight", weight.cast("bigint"))
    # Sources that reach their cap first come first; the level is what a unit of weight is still due.
    ranked = ranked.withColumn("most", cap * F.col("source_size"))
    by_room = W.orderBy(F.col("most") / F.col("weight"), "sid")
    before, everything = by_room.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    due = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    of = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = ranked.withColumn("due", due).withColumn("of", of)
    ranked = ranked.withColumn("capped", F.col("most") * F.col("of") < F.col("weight") * F.col("due"))
    # All uncapped sources use the level of the first of them.
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("most") / F.col("weight"), F.col("sid"), "due", "of")))
    level = first.over(everything)
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(
        F.col("weight") * level["due"] / level["of"]
    )
    return ranked.select("source", "source_size", "sid", target.alias("target"), "capped")


def balance(counts: DataFrame, sources: DataFrame, cap: int = 3, tolerance: float = 1e-9, max_rounds: int = 60):
    """(sid, lam, scale): the dual variable of every source; ``counts`` has (sid, size, n)."""
    scale = counts.groupBy("sid").agg(
        (F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")) / F.sum(F.col("n") * F.col("size"))).alias(
            "scale"
        )
    )
    ratio = F.col("target") / F.col("source_size")
    state = (
        sources.where("source_size > 0 and not capped")
        .where(F.col("target") < cap * F.col("source_size"))
        .join(scale, "sid")
        .select("sid", "target", "scale", F.log(ratio).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"))
    )
    state = cut_lineage(state.withColumn("error", F.lit(1.0)), "mix-dual")
    for _ in range(max_rounds):
        rate = F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size") / F.col("scale")))
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < cap, words * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = counts.join(state, "sid").groupBy(*state.columns).agg(
            F.sum(words).alias("taken"), F.sum(slope).alias("slope")
        )
        gap = F.log(F.col("taken") / F.col("target"))
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - gap * F.col("taken") / F.col("slope")
        middle = F.when(
            (lo > -1e6) & (hi < 1e6), (lo + hi) / 2
        ).otherwise(F.when(gap < 0, F.col("lam") + 1 + F.abs("lam")).otherwise(F.col("lam") - 1 - F.abs("lam")))
        good = (F.col("slope") > 0) & (F.col("taken") > 0) & (step > lo) & (step < hi)
        done = F.abs(F.col("taken") / F.col("target") - 1) <= tolerance
        state = cut_lineage(
            sums.select(
                "sid",
                "target",
                "scale",
                F.when(done, F.col("lam")).when(good, step).otherwise(middle).alias("lam"),
                lo.alias("lo"),
                hi.alias("hi"),
                F.when(done, 0.0).otherwise(F.abs(F.col("taken") / F.col("target") - 1)).alias("error"),
            ),
            "mix-dual",
        )
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst == 0.0:
            break
    return state.select("sid", "lam", "scale")


def rounding(cap: int):
    """Whole copies of every size of one source, from the largest to the smallest size.

    A size gets the number of copies that brings the words taken so far closest to what the rates
    call for; smaller sizes make up for what larger ones leave. One row per size of a source is held.
    """
    schema = pa.schema(
        [
            ("sid", pa.int32()),
            ("size", pa.int64()),
            ("rate", pa.float64()),
            ("each", pa.int64()),
            ("more", pa.int64()),
        ]
    )

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending")])
        asked, taken, out = 0.0, 0, []
        for size, n, rate in zip(*(rows[name].to_pylist() for name in ("size", "n", "rate"))):
            asked += size * n * rate
            copies = min(max(round((asked - taken) / size), 0), cap * n)
            taken += size * copies
            out.append(divmod(copies, n))
        each, more = zip(*out)
        return pa.Table.from_arrays(
            [rows["sid"], rows["size"], rows["rate"], pa.array(each, pa.int64()), pa.array(more, pa.int64())], schema=schema
        )

    return run


def mixture(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, rate, copies, taken."""
    sized = cut_lineage(
        docs.select(
            F.col(key).alias("id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")
        ),
        "mix-sizes",
    )
    per_size = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = per_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    sources = cut_lineage(source_targets(totals, weights, cap), "mix-sources")
    named = sources.select(F.col("source").alias("of"), "sid", "source_size", "target")
    counts = cut_lineage(
        per_size.join(named, F.col("source").eqNullSafe(F.col("of"))).select("sid", "size", "n").where("size > 0"),
        "mix-counts",
    )
    dual = balance(counts, sources, cap)
    tilt = F.exp(F.col("lam") * F.col("size") / F.col("scale"))
    rated = counts.join(dual, "sid", "left").select(
        "sid", "size", "n", F.least(F.lit(float(cap)), F.coalesce(tilt, F.lit(float(cap)))).alias("rate")
    )
    shared = rated.groupBy("sid").applyInArrow(rounding(cap), "sid int, size bigint, rate double, each bigint, more bigint")
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("of"))).select(
        "id", "size", "sid", "source_size", "target", F.xxhash64("id").alias("draw")
    ).withColumn("slot", F.pmod("draw", F.lit(SLOTS)))
    # Rank inside (source, size) without holding a group in one task: slots, then ranks inside slots.
    slots = rows.groupBy("sid", "size", "slot").agg(F.count(F.lit(1)).alias("n"))
    ahead = W.partitionBy("sid", "size").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    slots = slots.select("sid", "size", "slot", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    plans = slots.join(shared, ["sid", "size"])
    rank = F.row_number().over(W.partitionBy("sid", "size", "slot").orderBy("draw", "id")) - 1
    ranked = rows.withColumn("rank", rank).join(plans, ["sid", "size", "slot"], "left")
    own = F.coalesce(F.col("each") + (F.col("rank") + F.col("ahead") < F.col("more")).cast("bigint"), F.lit(0))
    return ranked.select(
        "id", "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), own.alias("copies")
    ).withColumn("taken", F.col("copies") * F.col("size"))


def take_mixture(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as many times as it has copies.

    Rows that repeat an id each take the mean of their copies, rounded.
    """
    plan = mixture(docs, key, **options).groupBy("id").agg(F.round(F.avg("copies")).cast("int").alias("_copies"))
    plan = plan.where("_copies > 0").select(F.col("id").alias("_of"), "_copies")
    drawn = docs.join(plan, F.col(key).eqNullSafe(F.col("_of")))
    return drawn.withColumn("_turn", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)
