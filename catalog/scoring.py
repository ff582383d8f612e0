"""Heads, scores, pooling and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import HEAD_SQL, big, head_and_rest, key_sql, predictions, r6, register, vectors
from handful.functions import vectors as V
from handful.operators import scoring as M
from handful.operators.sampling import fewshot_splits, sample_per_class


@register(
    "centroid_head_scores",
    f"""WITH {HEAD_SQL},
        per AS (SELECT CAST(true_label AS VARCHAR) AS label, count(*) AS support,
                       sum(CAST(true_label = pred_label AS BIGINT))::BIGINT AS n_right FROM preds GROUP BY 1)
        SELECT label, support, n_right, round(n_right / support, 6) AS accuracy FROM per
        UNION ALL SELECT 'all', sum(support)::BIGINT, sum(n_right)::BIGINT, round(sum(n_right) / sum(support), 6) FROM per""",
)
def centroid_head_scores(spark, sf):
    """Flagship: sample per class, class-mean head, accuracy in total and per class on all other rows."""
    right = F.sum(big(F.col("true_label") == F.col("pred_label")))
    counts = (
        predictions(spark, sf)
        .groupBy("true_label")
        .agg(F.count(F.lit(1)).alias("support"), right.alias("n_right"))
        .rollup("true_label")
        .agg(F.sum("support").alias("support"), F.sum("n_right").alias("n_right"))
    )
    return counts.select(
        F.coalesce(F.col("true_label").cast("string"), F.lit("all")).alias("label"),
        "support",
        "n_right",
        r6(F.col("n_right") / F.col("support")).alias("accuracy"),
    )


@register(
    "predict_labels",
    f"WITH {HEAD_SQL} SELECT row_id, true_label, CAST(pred_label AS INTEGER) AS pred_label, round(score, 6) AS score FROM preds",
)
def predict_labels(spark, sf):
    return predictions(spark, sf).withColumn("score", r6("score"))


@register(
    "linear_score",
    f"""WITH {HEAD_SQL} SELECT l.vec_id AS row_id, CAST(l.cls AS INTEGER) AS label, round(logit, 6) AS logit, round(p, 6) AS prob
        FROM logits l JOIN probs q ON l.vec_id = q.vec_id AND l.cls = q.cls""",
)
def linear_score(spark, sf):
    head, rest = head_and_rest(spark, sf)
    cells = F.arrays_zip(F.array(*[F.lit(v) for v in head.labels[0]]).alias("label"), "logits", "probs")
    scored = M.linear_score(rest, head)
    return scored.select("row_id", F.inline(cells).alias("label", "logit", "prob")).select(
        "row_id", "label", r6("logit").alias("logit"), r6("prob").alias("prob")
    )


@register(
    "rank_labels",
    f"""WITH {HEAD_SQL}
        SELECT vec_id AS row_id, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, cls) AS place,
               CAST(cls AS INTEGER) AS label, round(p, 6) AS score FROM probs""",
)
def rank_labels(spark, sf):
    head, rest = head_and_rest(spark, sf)
    ranked = M.rank_labels(M.linear_score(rest, head), head)
    return ranked.select("row_id", big("place").alias("place"), "label", r6("score").alias("score"))


@register(
    "head_loss",
    f"WITH {HEAD_SQL} SELECT round(avg(-ln(p)), 6) AS loss FROM probs WHERE cls = true_label",
)
def head_loss(spark, sf):
    head, rest = head_and_rest(spark, sf)
    places = F.array(*[F.lit(v) for v in head.labels[0]])
    scored = M.linear_score(rest, head).withColumn("true_pos", F.array_position(places, F.col("label")) - 1)
    return M.head_loss(scored).select(r6("loss").alias("loss"))


_MULTI = f"""WITH {HEAD_SQL},
    cells AS (SELECT vec_id, cls, CAST(cls = true_label AS INTEGER) AS t, 1 / (1 + exp(-logit)) AS p FROM logits)"""


@register(
    "head_loss_multi_target",
    _MULTI + " SELECT round(avg(-(t * ln(p) + (1 - t) * ln(1 - p))), 6) AS loss FROM cells",
)
def head_loss_multi_target(spark, sf):
    head, rest = head_and_rest(spark, sf)
    scored = M.linear_score(rest, head, multi_target=True)
    truth = F.array(*[(F.col("label") == v).cast("int") for v in head.labels[0]])
    return M.head_loss_multi(scored.withColumn("true_label", truth)).select(r6("loss").alias("loss"))


@register(
    "predict_multi_target",
    _MULTI + """ SELECT vec_id AS row_id, string_agg(CAST(p >= 0.5 AS INTEGER)::VARCHAR, '' ORDER BY cls) AS bits
                 FROM cells GROUP BY 1""",
)
def predict_multi_target(spark, sf):
    head, rest = head_and_rest(spark, sf)
    preds = M.predict(rest, head, multi_target=True)
    return preds.select("row_id", F.array_join(F.col("pred_label").cast("array<string>"), "").alias("bits"))


@register(
    "ensemble",
    f"""WITH {HEAD_SQL},
        scaled AS (SELECT vec_id, cls, t, logit * t AS z FROM logits, (VALUES (0.5), (1.0), (4.0)) AS v(t)),
        soft AS (SELECT vec_id, cls, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id, t) AS p FROM scaled),
        mean AS (SELECT vec_id, cls, avg(p) AS p FROM soft GROUP BY 1, 2)
        SELECT vec_id AS row_id, CAST(arg_max(cls, p) AS INTEGER) AS pred_label, round(max(p), 6) AS score
        FROM mean GROUP BY 1""",
)
def ensemble(spark, sf):
    head, rest = head_and_rest(spark, sf)
    scored = M.linear_score(rest, head)
    scales = F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(4.0)))
    patterns = scored.select("row_id", "logits", scales.alias("t")).select(
        "row_id", F.transform("logits", lambda x: x * F.col("t")).alias("logits")
    )
    labels = F.array(*[F.lit(v) for v in head.labels[0]])
    return M.ensemble(patterns).select(
        "row_id",
        F.element_at(labels, F.col("pred_pos") + 1).alias("pred_label"),
        r6(F.array_max("probs")).alias("score"),
    )


_UNNEST = "SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings"


@register(
    "l2_normalize",
    f"""WITH u AS ({_UNNEST}), n AS (SELECT vec_id, sqrt(sum(v * v)) AS size FROM u GROUP BY 1)
        SELECT vec_id AS row_id, pos, round(v / size, 6) AS x FROM u JOIN n USING (vec_id)""",
)
def l2_normalize(spark, sf):
    unit = vectors(spark, sf).select("row_id", F.posexplode(V.l2_normalize("embedding")).alias("p", "x"))
    return unit.select("row_id", big(F.col("p") + 1).alias("pos"), r6("x").alias("x"))


@register(
    "softmax_sigmoid_argmax",
    f"""WITH u AS ({_UNNEST}), t AS (SELECT vec_id, max(v) AS top FROM u GROUP BY 1),
        s AS (SELECT vec_id, pos, v, exp(v - top) AS e FROM u JOIN t USING (vec_id))
        SELECT vec_id AS row_id, min(pos) FILTER (v = m) - 1 AS best, round(max(e) / sum(e), 6) AS soft_max,
               round(sum(1 / (1 + exp(-v))), 5) AS sigmoid_sum
        FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM s) GROUP BY 1""",
)
def softmax_sigmoid_argmax(spark, sf):
    rows = vectors(spark, sf).select("row_id", F.col("embedding").cast("array<double>").alias("e"))
    total = F.aggregate(V.sigmoid("e"), F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "row_id",
        big(V.argmax("e")).alias("best"),
        r6(F.array_max(V.softmax("e"))).alias("soft_max"),
        F.round(total, 5).alias("sigmoid_sum"),
    )


@register(
    "class_means",
    f"""SELECT label, pos, round(avg(v), 6) AS weight FROM ({_UNNEST}) GROUP BY 1, 2""",
)
def class_means(spark, sf):
    means = M.class_means(vectors(spark, sf)).select("label", F.posexplode("weights").alias("p", "w"))
    return means.select("label", big(F.col("p") + 1).alias("pos"), r6("w").alias("weight"))


@register(
    "mean_pool",
    f"""WITH u AS ({_UNNEST})
        SELECT label AS row_id, pos, round(sum(v) / greatest(count(*), 1e-9), 6) AS x FROM u
        WHERE vec_id % 7 <> 0 GROUP BY 1, 2""",
)
def mean_pool(spark, sf):
    """Vectors pooled per class, every seventh masked out: long token tables are averaged map-side."""
    tokens = vectors(spark, sf).select(
        F.col("label").alias("row_id"), F.col("embedding").alias("vector"), (F.col("row_id") % 7 != 0).cast("int").alias("mask")
    )
    pooled = M.pool_tokens(tokens).select("row_id", F.posexplode("embedding").alias("p", "x"))
    return pooled.select("row_id", big(F.col("p") + 1).alias("pos"), r6("x").alias("x"))


@register(
    "predict_top_labels",
    f"""WITH {HEAD_SQL} SELECT vec_id AS row_id, place, cls AS label, round(p, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, cls::VARCHAR) AS place FROM probs) WHERE place <= 3""",
)
def predict_top_labels(spark, sf):
    """The three best labels of every row outside the sample, the head sent in blocks of four labels."""
    rows = vectors(spark, sf)
    picked = sample_per_class(rows.select("row_id", "label"), n=8, seed=42)
    heads = M.class_means(rows.drop("label").join(picked, "row_id"))
    rest = rows.join(picked.select("row_id"), "row_id", "left_anti")
    top = M.predict_top(rest, heads, ["row_id"], k=3, limit=4 * 65).select("row_id", F.posexplode("top").alias("place", "one"))
    return top.select("row_id", big(F.col("place") + 1).alias("place"), "one.label", r6("one.score").alias("score"))


@register(
    "grid_confusion",
    f"""WITH grid AS (SELECT unnest([1, 2, 3])::BIGINT AS seed),
    sample AS (SELECT seed, vec_id, label, embedding FROM (
        SELECT *, row_number() OVER (PARTITION BY seed, label ORDER BY {key_sql('seed', 'vec_id')}, vec_id) AS rn FROM embeddings, grid) WHERE rn <= 8),
    means AS (SELECT seed, label, pos, avg(v) AS m FROM (
        SELECT seed, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM sample) GROUP BY 1, 2, 3),
    bias AS (SELECT seed, label, -sum(m * m) / 2 AS b FROM means GROUP BY 1, 2),
    held AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    logits AS (SELECT means.seed, vec_id, held.label AS true_label, means.label AS cls, sum(v * m) + min(b) AS z
               FROM held JOIN means USING (pos) JOIN bias ON bias.label = means.label AND bias.seed = means.seed GROUP BY 1, 2, 3, 4)
    SELECT seed, true_label, pred_label, count(*) AS n FROM (
        SELECT seed, vec_id, true_label, arg_max(cls, z)::BIGINT AS pred_label FROM logits GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""",
)
def grid_confusion(spark, sf):
    """Confusion counts of three seeds' heads over the whole table, counted inside the tasks."""
    rows = vectors(spark, sf)
    splits = fewshot_splits(rows.select("row_id", "label"), [8], [1, 2, 3]).withColumn("seed", F.col("seed").cast("bigint"))
    heads = M.class_means(splits.select("seed", "row_id", "label").join(rows.drop("label"), "row_id"), ["seed"])
    return M.grid_confusion(rows, M.load_head(heads, ["seed"]), true="label")
