"""Embedding, fitted heads, batch losses, adapters, search and the benchmark grid."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LinearSVC
from pyspark.sql import functions as F

from catalog.base import big, documents, key_sql, number_sql, r6, register, table, vectors
from catalog.pairs import _drawn_sql
from handful.operators import heads as H, losses as L, metrics as E, sampling as S, scoring as M
from handful.operators.pairs import drawn_pairs
from handful.plans import benchmark as B, training as T

LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêàçñáíóú"


def letter_encoder():
    """A user's encoder: share of each letter in the text."""

    def run(texts):
        rows = [[t.count(c) / max(len(t), 1) for c in LETTERS] for t in (t.lower() for t in texts)]
        return np.array(rows, dtype=np.float64).reshape(len(texts), len(LETTERS))

    return run


def unit_letter_encoder():
    """The same as unit vectors."""
    shares = letter_encoder()

    def run(texts):
        rows = shares(texts)
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    return run


_LETTERS = f"""letters AS (SELECT unnest(string_split('{LETTERS}', '')) AS c, generate_subscripts(string_split('{LETTERS}', ''), 1) AS pos)"""
_EMBEDDED = f"""{_LETTERS},
    emb AS (SELECT doc_id, lang, pos, (length(t) - length(replace(t, c, ''))) / greatest(length(t), 1) AS v
            FROM (SELECT doc_id, lang, lower(text) AS t FROM documents), letters)"""


@register(
    "embed_with_encoder",
    f"WITH {_EMBEDDED} SELECT doc_id AS row_id, pos, round(v, 6) AS x FROM emb WHERE v > 0",
)
def embed_with_encoder(spark, sf):
    rows = M.embed(documents(spark, sf, "row_id", "text"), letter_encoder).select("row_id", F.posexplode_outer("embedding").alias("p", "x"))
    return rows.filter("x > 0").select("row_id", big(F.col("p") + 1).alias("pos"), r6("x").alias("x"))


@register("embed_hashed_words")
def embed_hashed_words(spark, sf):
    """The JVM encoder; its hash has no SQL counterpart, tests compare it word by word."""
    rows = M.embed(documents(spark, sf, "row_id", "text"), dim=64, normalize=True)
    return rows.select("row_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@register(
    "embed_hashed_words_totals",
    r"""SELECT doc_id AS row_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+'))::DOUBLE AS n_words FROM documents""",
)
def embed_hashed_words_totals(spark, sf):
    """Whatever the buckets, their counts add up to the words of the text."""
    rows = M.embed(documents(spark, sf, "row_id", "text"), dim=64)
    return rows.select("row_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("n_words"))


# --- heads ------------------------------------------------------------------------------


def _split_vectors(spark, sf):
    rows = S.train_test_split(vectors(spark, sf), 0.3, 42)
    return rows.filter("not is_test").drop("is_test"), rows.filter("is_test").drop("is_test")


def _report(preds):
    s = E.scores(preds.withColumnRenamed("label", "true_label"))
    return s.select(r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@register("fit_head")
def fit_head(spark, sf):
    train, test = _split_vectors(spark, sf)
    return _report(H.fit_head(train).predict(test))


@register("fit_custom_head")
def fit_custom_head(spark, sf):
    """A linear support vector machine in place of the default head, labels 0-4 against 5-9."""
    train, test = _split_vectors(spark, sf)
    half = (F.col("label") >= 5).cast("int")
    head = H.fit_head(train.withColumn("label", half), estimator=LinearSVC(featuresCol="features", labelCol="_y", maxIter=30))
    return _report(head.predict(test.withColumn("label", half)))


def _multi(df):
    return df.withColumn("label", F.array((F.col("label") % 2).cast("int"), (F.col("label") % 3 == 0).cast("int"), (F.col("label") > 4).cast("int")))


def _fit_multi(strategy):
    def run(spark, sf):
        train, test = _split_vectors(spark, sf)
        preds = H.fit_multi_head(_multi(train), 3, strategy).predict(_multi(test).withColumnRenamed("label", "true_label"))
        s = E.multilabel_scores(preds)
        return s.select(*[r6(c).alias(c) for c in s.columns])

    return run


for _name in H.STRATEGIES:
    register(f"fit_multi_head_{_name.replace('-', '_')}")(_fit_multi(_name))


# --- batch losses -----------------------------------------------------------------------

_BATCH = f"""batches AS (SELECT vec_id, label, embedding::DOUBLE[] AS e,
        (row_number() OVER (ORDER BY {key_sql(42, 'vec_id')}, vec_id) - 1) // 16 AS batch_id FROM embeddings),
    pairs AS (SELECT a.batch_id, a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, a.label % 2 = b.label % 2 AS same2,
                     list_cosine_similarity(a.e, b.e) AS c
              FROM batches a JOIN batches b ON a.batch_id = b.batch_id AND a.vec_id <> b.vec_id)"""


def _batched(spark, sf):
    return L.make_batches(vectors(spark, sf), 16)


@register(
    "supcon_anchor_losses",
    f"""WITH {_BATCH}, n AS (SELECT batch_id, a, ln(sum(exp(c / 0.07))) AS lse FROM pairs GROUP BY 1, 2)
        SELECT batch_id, a AS row_id, round(-avg(c / 0.07 - lse) FILTER (same), 6) AS loss FROM pairs JOIN n USING (batch_id, a) GROUP BY 1, 2""",
)
def supcon_anchor_losses(spark, sf):
    out = L.supcon_anchor_losses(_batched(spark, sf))
    loss = F.when(~F.isnan("loss"), r6("loss"))
    return out.select(big("batch_id").alias("batch_id"), "row_id", loss.alias("loss"))


@register(
    "supcon_loss",
    f"""WITH {_BATCH}, n AS (SELECT batch_id, a, ln(sum(exp(c / 0.07))) AS lse FROM pairs GROUP BY 1, 2),
        l AS (SELECT batch_id, a, -avg(c / 0.07 - lse) FILTER (same2) AS loss FROM pairs JOIN n USING (batch_id, a) GROUP BY 1, 2)
        SELECT batch_id, CASE WHEN count(*) = count(loss) THEN round(avg(loss), 6) END AS loss, count(*) - count(loss) AS n_without_positive FROM l GROUP BY 1""",
)
def supcon_loss(spark, sf):
    out = L.supcon_loss(_batched(spark, sf).withColumn("label", F.col("label") % 2))
    return out.select(big("batch_id").alias("batch_id"), r6("loss").alias("loss"), "n_without_positive")


@register(
    "mine_triplets_hard",
    f"""WITH {_BATCH}, t AS (SELECT batch_id, a, arg_min(b, c) FILTER (same) AS positive, arg_max(b, c) FILTER (NOT same) AS negative,
               max(1 - c) FILTER (same) AS dp, min(1 - c) FILTER (NOT same) AS dn FROM pairs GROUP BY 1, 2)
        SELECT batch_id, a AS row_id, positive, negative, round(greatest(dp - dn + 0.25, 0), 6) AS loss FROM t WHERE dp IS NOT NULL AND dn IS NOT NULL""",
)
def mine_triplets_hard(spark, sf):
    out = L.mine_triplets(_batched(spark, sf), "hard")
    return out.select(big("batch_id").alias("batch_id"), "row_id", "positive", "negative", r6("loss").alias("loss"))


@register(
    "triplet_loss_soft_margin",
    f"""WITH {_BATCH}, t AS (SELECT batch_id, a, max(1 - c) FILTER (same) AS dp, min(1 - c) FILTER (NOT same) AS dn FROM pairs GROUP BY 1, 2)
        SELECT batch_id, round(avg(ln(1 + exp(dp - dn))), 6) AS loss, count(*) AS n_triplets FROM t WHERE dp IS NOT NULL AND dn IS NOT NULL GROUP BY 1""",
)
def triplet_loss_soft_margin(spark, sf):
    out = L.triplet_loss(L.mine_triplets(_batched(spark, sf), "hard_soft_margin"))
    return out.select(big("batch_id").alias("batch_id"), r6("loss").alias("loss"), "n_triplets")


_TRIPLES = f"""{_BATCH}, trip AS (SELECT p.batch_id, p.a, p.b AS pos, n.b AS neg, (1 - p.c) AS dp, (1 - n.c) AS dn
    FROM pairs p JOIN pairs n ON p.batch_id = n.batch_id AND p.a = n.a WHERE p.same AND NOT n.same)"""


@register(
    "triplet_loss_semi_hard",
    f"""WITH {_TRIPLES}, s AS (SELECT batch_id, a, pos, dp, coalesce(min(dn) FILTER (dn > dp), max(dn)) AS dn FROM trip GROUP BY 1, 2, 3, 4)
        SELECT batch_id, round(avg(greatest(dp - dn + 0.25, 0)), 6) AS loss, count(*) AS n_triplets FROM s GROUP BY 1""",
)
def triplet_loss_semi_hard(spark, sf):
    out = L.triplet_loss(L.mine_triplets(_batched(spark, sf), "semi_hard"))
    return out.select(big("batch_id").alias("batch_id"), r6("loss").alias("loss"), "n_triplets")


@register(
    "triplet_loss_all",
    f"""WITH {_TRIPLES}, s AS (SELECT batch_id, greatest(dp - dn + 0.25, 0) AS l FROM trip)
        SELECT batch_id, round(coalesce(sum(l) / nullif(count(*) FILTER (l > 1e-16), 0), 0), 6) AS loss, count(*) FILTER (l > 1e-16) AS n_triplets FROM s GROUP BY 1""",
)
def triplet_loss_all(spark, sf):
    out = L.triplet_loss(L.mine_triplets(_batched(spark, sf), "all"))
    return out.select(big("batch_id").alias("batch_id"), r6("loss").alias("loss"), "n_triplets")


# --- training ---------------------------------------------------------------------------


@register("fit_adapter")
def fit_adapter(spark, sf):
    """Loss per epoch on pairs drawn over the whole table."""
    rows = vectors(spark, sf)
    _, losses = T.fit_adapter(drawn_pairs(rows.select("row_id", "label"), 2), rows, epochs=3)
    return spark.createDataFrame(list(enumerate(round(x, 6) for x in losses)), "epoch int, loss double")


@register(
    "fit_adapter_first_loss",
    f"""WITH {_drawn_sql('embeddings', 'vec_id', 'label')},
        s AS (SELECT drawn.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c
              FROM drawn JOIN embeddings a ON a.vec_id = id_1 JOIN embeddings b ON b.vec_id = id_2)
        SELECT round(avg((c - label) * (c - label)), 6) AS loss FROM s""",
)
def fit_adapter_first_loss(spark, sf):
    """Before the first step the map is the identity, so its loss is that of the raw pairs."""
    rows = vectors(spark, sf)
    _, losses = T.fit_adapter(drawn_pairs(rows.select("row_id", "label"), 3), rows, epochs=1)
    return spark.createDataFrame([(round(losses[0], 6),)], "loss double")

# Two epochs of mini-batch training in SQL. A loss gives coefficients k on ordered pairs of rows (its derivative by their
# cosine, in the mean of its batch); the gradient of the map is the mean over batches of sum du_i x_i^T with
# du_i = (g_i - (g_i n_i) n_i) / |x_i|, g_i = sum_j (k_ij + k_ji) n_j; the second epoch's rows are x - rate * G x.
_RATE = 0.1


def _label_batches_sql(seed: int, name: str) -> str:
    return f"""{name} AS (SELECT vec_id, label, (row_number() OVER (ORDER BY {key_sql(seed, "label, unit")}, label, unit, place) - 1) // 16 AS batch_id
        FROM (SELECT *, place // 2 AS unit FROM (
                SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {key_sql(seed, 'vec_id')}, vec_id) - 1 AS place,
                       count(*) OVER (PARTITION BY label) AS n FROM embeddings)
              WHERE place < n - n % 2))"""


def _cosines_sql(batches: str, rows: str, name: str) -> str:
    return f"""{name} AS (SELECT i.batch_id, i.vec_id AS a, j.vec_id AS b, i.label = j.label AS same,
            list_cosine_similarity(x.e, y.e) AS c
        FROM {batches} i JOIN {batches} j ON i.batch_id = j.batch_id AND i.vec_id <> j.vec_id
        JOIN {rows} x ON x.vec_id = i.vec_id JOIN {rows} y ON y.vec_id = j.vec_id)"""


def _descent_sql(k: str) -> str:
    """Rows after one update, from ``k`` (batch_id, a, b, k) and the number of batches in ``used``."""
    return f"""{k},
    unit AS (SELECT vec_id, sqrt(list_dot_product(e, e)) AS size, [v / sqrt(list_dot_product(e, e)) FOR v IN e] AS n FROM x0),
    both_ways AS (SELECT i, j, sum(k) AS k FROM (SELECT a AS i, b AS j, k FROM k UNION ALL SELECT b, a, k FROM k) GROUP BY 1, 2),
    flat AS (SELECT vec_id, generate_subscripts(n, 1) AS pos, unnest(n) AS v FROM unit),
    pull AS (SELECT i AS vec_id, pos, sum(k * v) AS g FROM both_ways JOIN flat ON flat.vec_id = j GROUP BY 1, 2),
    along AS (SELECT vec_id, sum(g * v) AS d FROM pull JOIN flat USING (vec_id, pos) GROUP BY 1),
    du AS (SELECT vec_id, pos, (g - d * v) / size AS u FROM pull JOIN flat USING (vec_id, pos) JOIN along USING (vec_id) JOIN unit USING (vec_id)),
    entries AS (SELECT vec_id, generate_subscripts(e, 1) AS col, unnest(e) AS w FROM x0),
    grad AS (SELECT pos, col, sum(u * w) / (SELECT n FROM used) AS g FROM du JOIN entries USING (vec_id) GROUP BY 1, 2),
    moved AS (SELECT vec_id, pos, sum(g * w) AS s FROM grad JOIN entries USING (col) GROUP BY 1, 2),
    x1 AS (SELECT vec_id, list(w - {_RATE} * s ORDER BY pos) AS e
           FROM moved JOIN (SELECT vec_id, col AS pos, w FROM entries) USING (vec_id, pos) GROUP BY 1)"""


_X0 = "x0 AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"

# Of each loss: per batch its value, as SQL over cosines {c}; and its coefficients.
_LOSS_SQL = {
    "supcon": (
        """SELECT batch_id, avg(l) AS l FROM (SELECT batch_id, a, -avg(c / 0.07 - s) FILTER (same) AS l
             FROM {c} JOIN (SELECT a, ln(sum(exp(c / 0.07))) AS s FROM {c} GROUP BY 1) USING (a) GROUP BY 1, 2) GROUP BY 1""",
        """SELECT batch_id, a, b, (exp(c / 0.07 - s) - CASE WHEN same THEN 1.0 / p ELSE 0 END) / 0.07 / m AS k
           FROM c0 JOIN (SELECT a, ln(sum(exp(c / 0.07))) AS s, count(*) FILTER (same) AS p FROM c0 GROUP BY 1) USING (a)
           JOIN (SELECT batch_id, count(DISTINCT a) AS m FROM c0 GROUP BY 1) USING (batch_id)""",
    ),
    "batch_hard": (
        """SELECT batch_id, avg(greatest(dp - dn + 0.25, 0)) AS l FROM (
             SELECT batch_id, a, max(1 - c) FILTER (same) AS dp, min(1 - c) FILTER (NOT same) AS dn FROM {c} GROUP BY 1, 2)
           WHERE dp IS NOT NULL AND dn IS NOT NULL GROUP BY 1""",
        """SELECT batch_id, a, b, k / m AS k FROM (
             SELECT batch_id, a, unnest([p, q]) AS b, unnest([-1.0, 1.0]) * (dp - dn + 0.25 > 0)::INT AS k, count(*) OVER (PARTITION BY batch_id) AS m
             FROM (SELECT batch_id, a, arg_min(b, c) FILTER (same) AS p, arg_max(b, c) FILTER (NOT same) AS q,
                          max(1 - c) FILTER (same) AS dp, min(1 - c) FILTER (NOT same) AS dn FROM c0 GROUP BY 1, 2)
             WHERE dp IS NOT NULL AND dn IS NOT NULL)""",
    ),
    "batch_hard_soft_margin": (
        """SELECT batch_id, avg(ln(1 + exp(dp - dn))) AS l FROM (
             SELECT batch_id, a, max(1 - c) FILTER (same) AS dp, min(1 - c) FILTER (NOT same) AS dn FROM {c} GROUP BY 1, 2)
           WHERE dp IS NOT NULL AND dn IS NOT NULL GROUP BY 1""",
        """SELECT batch_id, a, b, k / m AS k FROM (
             SELECT batch_id, a, unnest([p, q]) AS b, unnest([-1.0, 1.0]) / (1 + exp(dn - dp)) AS k, count(*) OVER (PARTITION BY batch_id) AS m
             FROM (SELECT batch_id, a, arg_min(b, c) FILTER (same) AS p, arg_max(b, c) FILTER (NOT same) AS q,
                          max(1 - c) FILTER (same) AS dp, min(1 - c) FILTER (NOT same) AS dn FROM c0 GROUP BY 1, 2)
             WHERE dp IS NOT NULL AND dn IS NOT NULL)""",
    ),
    "batch_semi_hard": (
        """SELECT batch_id, avg(greatest(dp - dn + 0.25, 0)) AS l FROM (
             SELECT p.batch_id, p.a, p.b, 1 - p.c AS dp, coalesce(min(1 - n.c) FILTER (1 - n.c > 1 - p.c), max(1 - n.c)) AS dn
             FROM {c} p JOIN {c} n ON p.a = n.a WHERE p.same AND NOT n.same GROUP BY 1, 2, 3, 4) GROUP BY 1""",
        """SELECT batch_id, a, unnest([p, q]) AS b, unnest([-1.0, 1.0]) * (dp - dn + 0.25 > 0)::INT / m AS k FROM (
             SELECT *, 1 - coalesce(near, far) AS dn, coalesce(q_near, q_far) AS q, count(*) OVER (PARTITION BY batch_id) AS m FROM (
               SELECT p.batch_id, p.a, p.b AS p, 1 - p.c AS dp, max(n.c) FILTER (1 - n.c > 1 - p.c) AS near, min(n.c) AS far,
                      arg_max(n.b, n.c) FILTER (1 - n.c > 1 - p.c) AS q_near, arg_min(n.b, n.c) AS q_far
               FROM c0 p JOIN c0 n ON p.a = n.a WHERE p.same AND NOT n.same GROUP BY 1, 2, 3, 4))""",
    ),
    "batch_all": (
        """SELECT batch_id, coalesce(sum(l) / nullif(count(*) FILTER (l > 1e-16), 0), 0) AS l FROM (
             SELECT p.batch_id, greatest(n.c - p.c + 0.25, 0) AS l FROM {c} p JOIN {c} n ON p.a = n.a WHERE p.same AND NOT n.same) GROUP BY 1""",
        """SELECT batch_id, a, unnest([p, q]) AS b, unnest([-1.0, 1.0]) / m AS k FROM (
             SELECT p.batch_id, p.a, p.b AS p, n.b AS q, count(*) OVER (PARTITION BY p.batch_id) AS m
             FROM c0 p JOIN c0 n ON p.a = n.a WHERE p.same AND NOT n.same AND n.c - p.c + 0.25 > 1e-16)""",
    ),
}


def _batch_training_sql(loss: str) -> str:
    value, k = _LOSS_SQL[loss]
    return f"""WITH {_X0}, {_label_batches_sql(42, 'b0')}, {_label_batches_sql(43, 'b1')}, {_cosines_sql('b0', 'x0', 'c0')},
        l0 AS ({value.format(c='c0')}), used AS (SELECT count(*) AS n FROM l0), {_descent_sql(f'k AS ({k})')},
        {_cosines_sql('b1', 'x1', 'c1')}, l1 AS ({value.format(c='c1')})
        SELECT 0 AS epoch, round(avg(l), 6) AS loss FROM l0 UNION ALL SELECT 1, round(avg(l), 6) FROM l1"""


def _losses_by_epoch(spark, losses):
    return spark.createDataFrame(list(enumerate(round(x, 6) for x in losses)), "epoch int, loss double")


def _batch_training(loss: str):
    def run(spark, sf):
        """Mean batch loss of all rows before each of two updates."""
        _, losses = T.fit_adapter(None, vectors(spark, sf), epochs=2, lr=_RATE, loss=loss, batch_size=16)
        return _losses_by_epoch(spark, losses)

    return run


for _name in _LOSS_SQL:
    register(f"fit_adapter_{_name}", _batch_training_sql(_name))(_batch_training(_name))


def _pair_batches_sql(seed: int, name: str) -> str:
    return f"""{name} AS (SELECT id_1, id_2, label, (row_number() OVER (ORDER BY {key_sql(seed, "id_1, id_2")}, id_1, id_2, label) - 1) // 32 AS batch_id
        FROM (SELECT DISTINCT id_1, id_2, label::DOUBLE AS label FROM drawn))"""


def _pair_cosines_sql(batches: str, rows: str, name: str) -> str:
    return f"""{name} AS (SELECT batch_id, id_1 AS a, id_2 AS b, label AS y, 1 - list_cosine_similarity(x.e, y.e) AS d
        FROM {batches} JOIN {rows} x ON x.vec_id = id_1 JOIN {rows} y ON y.vec_id = id_2)"""


# The distance beyond which, and below which, a pair of a batch is hard.
_HARD = """SELECT batch_id, CASE WHEN count(*) FILTER (y = 0) > 1 THEN min(d) FILTER (y = 0) ELSE coalesce(avg(d) FILTER (y = 1), 'inf') END AS near,
                  CASE WHEN count(*) FILTER (y = 1) > 1 THEN max(d) FILTER (y = 1) ELSE coalesce(avg(d) FILTER (y = 0), '-inf') END AS far
           FROM {c} GROUP BY 1"""
_PAIR_LOSS_SQL = {
    "cosine": (
        "SELECT batch_id, avg((1 - d - y) ** 2) AS l FROM {c} GROUP BY 1",
        "SELECT batch_id, a, b, 2 * (1 - d - y) / count(*) OVER (PARTITION BY batch_id) AS k FROM c0",
    ),
    "contrastive": (
        "SELECT batch_id, avg(0.5 * (y * d ** 2 + (1 - y) * greatest(0.5 - d, 0) ** 2)) AS l FROM {c} GROUP BY 1",
        "SELECT batch_id, a, b, ((1 - y) * greatest(0.5 - d, 0) - y * d) / count(*) OVER (PARTITION BY batch_id) AS k FROM c0",
    ),
    "online_contrastive": (
        f"""SELECT batch_id, coalesce(sum(CASE WHEN y = 1 AND d > near THEN d ** 2 WHEN y = 0 AND d < far THEN greatest(0.5 - d, 0) ** 2 END), 0) AS l
            FROM {{c}} JOIN ({_HARD}) USING (batch_id) GROUP BY 1""",
        f"""SELECT batch_id, a, b, CASE WHEN y = 1 AND d > near THEN -2 * d WHEN y = 0 AND d < far THEN 2 * greatest(0.5 - d, 0) ELSE 0 END AS k
            FROM c0 JOIN ({_HARD.format(c='c0')}) USING (batch_id)""",
    ),
}


def _pair_training_sql(loss: str) -> str:
    value, k = _PAIR_LOSS_SQL[loss]
    return f"""WITH {_drawn_sql('embeddings', 'vec_id', 'label')}, {_X0}, {_pair_batches_sql(42, 'b0')}, {_pair_batches_sql(43, 'b1')},
        {_pair_cosines_sql('b0', 'x0', 'c0')}, l0 AS ({value.format(c='c0')}), used AS (SELECT count(*) AS n FROM l0),
        {_descent_sql(f'k AS ({k})')}, {_pair_cosines_sql('b1', 'x1', 'c1')}, l1 AS ({value.format(c='c1')})
        SELECT 0 AS epoch, round(avg(l), 6) AS loss FROM l0 UNION ALL SELECT 1, round(avg(l), 6) FROM l1"""


def _pair_training(loss: str):
    def run(spark, sf):
        """Mean batch loss of pairs drawn over the whole table before each of two updates."""
        rows = vectors(spark, sf)
        pairs = drawn_pairs(rows.select("row_id", "label"), 3).select("id_1", "id_2", "label").distinct()
        _, losses = T.fit_adapter(pairs, rows, epochs=2, lr=_RATE, loss=loss, batch_size=32)
        return _losses_by_epoch(spark, losses)

    return run


for _name in _PAIR_LOSS_SQL:
    register(f"fit_adapter_{_name}_pairs", _pair_training_sql(_name))(_pair_training(_name))


@register("train_and_evaluate")
def train_and_evaluate(spark, sf):
    train, test = _split_vectors(spark, sf)
    model = T.train(train, pairs="drawn", num_iterations=2, epochs=2)
    return T.evaluate(model, test, "accuracy").withColumn("value", r6("value"))


@register("evaluate_with_metric")
def evaluate_with_metric(spark, sf):
    """A user's metric function over the predictions."""
    train, test = _split_vectors(spark, sf)
    model = T.train(train, epochs=0)

    def near(preds):
        return preds.agg(F.avg((F.abs(F.col("true_label") - F.col("pred_label")) <= 1).cast("double")).alias("within_one"))

    return T.evaluate(model, test, near).withColumn("value", r6("value"))


@register("distill")
def distill(spark, sf):
    """A teacher on sampled documents labels all others; the student reads hashed words."""
    docs = documents(spark, sf, "row_id", "text", F.col("lang").alias("label"))
    split = S.train_test_split(docs, 0.5, 7)
    teacher = T.train(S.sample_per_class(split.filter("not is_test").drop("is_test"), n=8), letter_encoder, epochs=0)
    rest = split.filter("is_test").drop("is_test")
    student = T.distill(rest.select("row_id", "text"), teacher, dim=64, epochs=1, num_iterations=2)
    return T.evaluate(student, rest, "accuracy").withColumn("value", r6("value"))


# Class means of the learning rows as a head: every step of training, scoring and search has a closed form.
_MEANS = f"""flat AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos,
                             {number_sql(key_sql(42, 'vec_id'))} / 4294967296.0 < 0.3 AS is_test FROM embeddings),
    means AS (SELECT label, pos, avg(v) AS m FROM flat WHERE NOT is_test GROUP BY 1, 2),
    bias AS (SELECT label, -sum(m * m) / 2 AS b FROM means GROUP BY 1),
    logits AS (SELECT vec_id, f.label AS t, m.label AS cls, sum(v * m) + min(b) AS z
               FROM flat f JOIN means m USING (pos) JOIN bias ON bias.label = m.label WHERE is_test GROUP BY 1, 2, 3),
    preds AS (SELECT vec_id, t, arg_max(cls, z) AS p FROM logits GROUP BY 1, 2)"""


@register(
    "evaluate_means",
    f"""WITH {_MEANS} SELECT 'accuracy' AS metric, round(avg((t = p)::INTEGER), 6) AS value FROM preds
        UNION ALL SELECT 'within_one', round(avg((abs(t - p) <= 1)::INTEGER), 6) FROM preds""",
)
def evaluate_means(spark, sf):
    """Training without a pair phase, scored by a named metric and by a user's function."""
    train, test = _split_vectors(spark, sf)
    model = T.train(train, epochs=0, head="means")

    def near(preds):
        return preds.agg(F.avg((F.abs(F.col("true_label") - F.col("pred_label")) <= 1).cast("double")).alias("within_one"))

    both = T.evaluate(model, test).unionByName(T.evaluate(model, test, near))
    return both.withColumn("value", r6("value"))


@register(
    "distill_means",
    f"""WITH {_EMBEDDED},
    part AS (SELECT doc_id, lang, {number_sql(key_sql(7, 'doc_id'))} / 4294967296.0 < 0.5 AS is_test FROM documents),
    sample AS (SELECT doc_id, lang FROM part WHERE NOT is_test
               QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {key_sql(42, 'doc_id')}, doc_id) <= 8),
    tm AS (SELECT sample.lang AS cls, pos, avg(v) AS m FROM sample JOIN emb USING (doc_id) GROUP BY 1, 2),
    tb AS (SELECT cls, -sum(m * m) / 2 AS b FROM tm GROUP BY 1),
    tz AS (SELECT e.doc_id, tm.cls, sum(v * m) + min(b) AS z FROM emb e JOIN part p ON p.doc_id = e.doc_id AND p.is_test
           JOIN tm ON tm.pos = e.pos JOIN tb ON tb.cls = tm.cls GROUP BY 1, 2),
    judged AS (SELECT doc_id, arg_max(cls, z) AS cls FROM tz GROUP BY 1),
    sm AS (SELECT judged.cls, pos, avg(v) AS m FROM judged JOIN emb USING (doc_id) GROUP BY 1, 2),
    sb AS (SELECT cls, -sum(m * m) / 2 AS b FROM sm GROUP BY 1),
    sz AS (SELECT e.doc_id, e.lang AS t, sm.cls, sum(v * m) + min(b) AS z FROM emb e JOIN judged ON judged.doc_id = e.doc_id
           JOIN sm ON sm.pos = e.pos JOIN sb ON sb.cls = sm.cls GROUP BY 1, 2, 3)
    SELECT 'accuracy' AS metric, round(avg((t = p)::INTEGER), 6) AS value FROM (SELECT doc_id, t, arg_max(cls, z) AS p FROM sz GROUP BY 1, 2)""",
)
def distill_means(spark, sf):
    """A teacher of class means judges all other documents; the student's means are those of its judgements."""
    docs = documents(spark, sf, "row_id", "text", F.col("lang").alias("label"))
    split = S.train_test_split(docs, 0.5, 7)
    teacher = T.train(S.sample_per_class(split.filter("not is_test").drop("is_test"), n=8), letter_encoder, epochs=0, head="means")
    rest = split.filter("is_test").drop("is_test")
    student = T.distill(rest.select("row_id", "text"), teacher, encoder=letter_encoder, epochs=0, head="means")
    return T.evaluate(student, rest).withColumn("value", r6("value"))


_SHARE = "({} / 4294967296.0::DOUBLE)"


def _draw(name: str) -> str:
    return number_sql(f"md5(concat_ws(':', 42, '{name}', trial))")


@register(
    "draw_trials",
    f"""WITH t AS (SELECT unnest(range((SELECT count(*) // 100 FROM events))) AS trial)
        SELECT trial, round(exp(ln(1e-6) + {_SHARE.format(_draw('learning_rate'))} * (ln(1e-4) - ln(1e-6))), 9) AS learning_rate,
               (1 + {_draw('num_epochs')} % 5)::INTEGER AS num_epochs, [5, 10, 20][{_draw('num_iterations')} % 3 + 1] AS num_iterations,
               (1 + {_draw('seed')} % 40)::INTEGER AS seed, [4, 8, 16, 32, 64][{_draw('batch_size')} % 5 + 1] AS batch_size FROM t""",
)
def draw_trials(spark, sf):
    trials = T.draw_trials(spark, table(spark, sf, "events").count() // 100)
    return trials.withColumn("learning_rate", F.round("learning_rate", 9))


@register("grid_search")
def grid_search(spark, sf):
    """Two settings of the pair phase, scored on the held-out rows."""
    train, test = _split_vectors(spark, sf)
    space = {"num_iterations": ("choice", [1, 2]), "num_epochs": ("int", 1, 2)}

    def run(setting):
        model = T.train(train, pairs="drawn", num_iterations=setting["num_iterations"], epochs=setting["num_epochs"])
        return T.evaluate(model, test)

    search = T.grid_search(spark, run, n_trials=2, space=space)
    return search.trials.withColumn("objective", r6("objective"))


@register(
    "grid_search_means",
    f"""WITH t AS (SELECT unnest(range(4)) AS trial), trials AS (SELECT trial, [2, 4, 8, 16][{_draw('size')} % 4 + 1] AS size FROM t),
    ranked AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY {key_sql(42, 'vec_id')}, vec_id) AS rn FROM embeddings),
    sample AS (SELECT trial, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM ranked JOIN trials ON rn <= size),
    means AS (SELECT trial, label, pos, avg(v) AS m FROM sample GROUP BY 1, 2, 3),
    bias AS (SELECT trial, label, -sum(m * m) / 2 AS b FROM means GROUP BY 1, 2),
    flat AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    logits AS (SELECT means.trial, vec_id, flat.label AS t, means.label AS cls, sum(v * m) + min(b) AS z FROM flat JOIN means USING (pos)
               JOIN bias ON bias.trial = means.trial AND bias.label = means.label GROUP BY 1, 2, 3, 4),
    preds AS (SELECT trial, vec_id, t, arg_max(cls, z) AS p FROM logits GROUP BY 1, 2, 3)
    SELECT trial, any_value(size) AS size, round(avg((t = p)::INTEGER), 6) AS objective FROM preds JOIN trials USING (trial) GROUP BY 1""",
)
def grid_search_means(spark, sf):
    """Four drawn sample sizes, each scored by the accuracy of its class means over the whole table."""
    rows = vectors(spark, sf)

    def run(setting):
        picked = S.sample_per_class(rows.select("row_id", "label"), n=setting["size"], seed=42)
        sample = rows.drop("label").join(picked.select("row_id", "label"), "row_id")
        return T.evaluate(T.train(sample, epochs=0, head="means"), rows)

    search = T.grid_search(spark, run, n_trials=4, space={"size": ("choice", [2, 4, 8, 16])})
    return search.trials.withColumn("objective", r6("objective"))


# --- benchmark --------------------------------------------------------------------------


def _benchmark(spark, sf, head):
    docs = documents(spark, sf, "row_id", "text", F.col("lang").alias("label"))
    split = S.train_test_split(docs, 0.2, 42)
    return B.fewshot_benchmark(
        split.filter("not is_test").drop("is_test"), split.filter("is_test").drop("is_test"), "languages",
        unit_letter_encoder if head == "logistic" else letter_encoder, sizes=[4, 8], seeds=[0, 1, 2], head=head,
    )


_VANILLA = f"""{_EMBEDDED},
    part AS (SELECT doc_id, lang, {number_sql(key_sql(42, 'doc_id'))} / 4294967296.0 < 0.2 AS is_test FROM documents),
    ranked AS (SELECT seed, doc_id, lang, row_number() OVER (PARTITION BY seed, lang ORDER BY {key_sql('seed', 'doc_id')}, doc_id) AS rn
               FROM part, (SELECT CAST(range AS INTEGER) AS seed FROM range(3)) WHERE NOT is_test),
    cells AS (SELECT sample_size, seed, doc_id, lang FROM ranked JOIN (VALUES (4), (8)) AS z(sample_size) ON rn <= sample_size),
    means AS (SELECT sample_size, seed, cells.lang AS cls, pos, avg(v) AS m FROM cells JOIN emb USING (doc_id) GROUP BY 1, 2, 3, 4),
    bias AS (SELECT sample_size, seed, cls, -sum(m * m) / 2 AS b FROM means GROUP BY 1, 2, 3),
    logits AS (SELECT m.sample_size, m.seed, e.doc_id, e.lang, m.cls, sum(v * m) + min(b) AS z
               FROM emb e JOIN part p ON p.doc_id = e.doc_id AND p.is_test JOIN means m ON m.pos = e.pos
               JOIN bias USING (sample_size, seed, cls) GROUP BY 1, 2, 3, 4, 5),
    preds AS (SELECT sample_size, seed, doc_id, lang AS t, arg_max(cls, z) AS p FROM logits GROUP BY 1, 2, 3, 4)"""


@register(
    "benchmark_vanilla_confusion",
    f"WITH {_VANILLA} SELECT sample_size, seed::BIGINT AS seed, t AS true_label, p AS pred_label, count(*) AS n FROM preds GROUP BY 1, 2, 3, 4",
)
def benchmark_vanilla_confusion(spark, sf):
    counts = _benchmark(spark, sf, "means")["confusion"].filter("method = 'vanilla'").drop("method")
    return counts.withColumn("sample_size", F.col("sample_size").cast("int"))


@register("fewshot_benchmark")
def fewshot_benchmark(spark, sf):
    runs = _benchmark(spark, sf, "logistic")["runs"]
    return runs.select("dataset", "sample_size", "seed", "method", *[r6(c).alias(c) for c in ("accuracy", "macro_f1", "score")])


@register("run_records")
def run_records(spark, sf):
    records = B.run_records(_benchmark(spark, sf, "means"), "languages", settings={"classifier": "class means"})
    return records.select("dataset", "shot", "seed", "method", F.to_json(F.struct("*")).alias("record"))


@register(
    "run_record_scores",
    f"""WITH {_VANILLA} SELECT sample_size AS shot, seed::BIGINT AS seed, round(100 * avg((t = p)::INTEGER), 6) AS accuracy,
               count(*) FILTER (t <> p) AS num_errors, 0.0::DOUBLE AS accuracy_delta,
               round(100 * count(*) FILTER (t = p AND t = 'en') / count(*) FILTER (t = 'en')::DOUBLE, 6) AS accuracy_en FROM preds GROUP BY 1, 2""",
)
def run_record_scores(spark, sf):
    """Scores, errors and accuracy of one class inside the nested records of the vanilla runs."""
    records = B.run_records(_benchmark(spark, sf, "means"), "languages").filter("method = 'vanilla'")
    return records.select(
        F.col("shot").cast("int").alias("shot"), F.col("seed").cast("bigint").alias("seed"), r6("accuracy").alias("accuracy"),
        F.col("error_analysis.num_errors").cast("bigint").alias("num_errors"), r6("improvement_delta.accuracy_delta").alias("accuracy_delta"),
        r6(F.col("per_class_accuracy")["en"]).alias("accuracy_en"),
    )
