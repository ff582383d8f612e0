"""Contrastive pairs over few-shot samples, drawn pairs over whole tables, pair losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import key_sql, number_sql, r6, register, table, vectors
from handful.operators import pairs as P, sampling as S, scoring as M

_SAMPLE = f"""sample AS (SELECT vec_id AS row_id, label, embedding FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY {key_sql(42, 'vec_id')}, vec_id) AS rn FROM embeddings)
    WHERE rn <= 8)"""
_PAIRS = f"""{_SAMPLE},
    pairs AS (SELECT a.row_id AS id_1, b.row_id AS id_2, CASE WHEN a.label = b.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
              FROM sample a JOIN sample b ON a.row_id <= b.row_id)"""


def _sample(spark, sf):
    return S.sample_per_class(vectors(spark, sf), n=8, seed=42)


@register("contrastive_pairs", f"WITH {_PAIRS} SELECT * FROM pairs")
def contrastive_pairs(spark, sf):
    return P.contrastive_pairs(_sample(spark, sf))


@register("positive_pairs", f"WITH {_PAIRS} SELECT * FROM pairs WHERE label = 1")
def positive_pairs(spark, sf):
    return P.positive_pairs(_sample(spark, sf))


@register(
    "contrastive_pairs_grid",
    f"""WITH seeds AS (SELECT CAST(range AS INTEGER) AS seed FROM range(10)),
        cell AS (SELECT seed, vec_id AS row_id, label FROM (
            SELECT seed, vec_id, label, row_number() OVER (PARTITION BY seed, label
                   ORDER BY {key_sql('seed', 'vec_id')}, vec_id) AS rn FROM embeddings, seeds) WHERE rn <= 4)
        SELECT a.seed, a.row_id AS id_1, b.row_id AS id_2, CASE WHEN a.label = b.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
        FROM cell a JOIN cell b ON a.seed = b.seed AND a.row_id <= b.row_id""",
)
def contrastive_pairs_grid(spark, sf):
    grid = S.fewshot_splits(vectors(spark, sf).select("row_id", "label"), sizes=[4])
    return P.contrastive_pairs(grid, by=["seed"])


@register(
    "contrastive_pairs_multilabel",
    f"""WITH long AS (SELECT doc_id AS row_id, 'quality' AS c FROM labels WHERE quality = 1
                      UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1),
        picked AS (SELECT DISTINCT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY c
                   ORDER BY {key_sql(0, 'row_id')}, row_id) AS rn FROM long) WHERE rn <= 32),
        sample AS (SELECT row_id, quality, toxic FROM picked JOIN labels ON doc_id = row_id)
        SELECT a.row_id AS id_1, b.row_id AS id_2,
               CASE WHEN a.quality * b.quality + a.toxic * b.toxic > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
        FROM sample a JOIN sample b ON a.row_id <= b.row_id""",
)
def contrastive_pairs_multilabel(spark, sf):
    wide = table(spark, sf, "labels").withColumnRenamed("doc_id", "row_id")
    sample = S.fewshot_splits_multilabel(wide, ["quality", "toxic"], sizes=[32], seeds=[0])
    return P.contrastive_pairs(
        sample.select("row_id", F.array("quality", "toxic").alias("label")), multilabel=True
    )


_RANKED = f"""{_PAIRS},
    ranked AS (SELECT *, CAST(label = 0 AS INTEGER) AS side, row_number() OVER (PARTITION BY label
               ORDER BY md5(concat_ws(':', 42, id_1, id_2)), id_1, id_2) - 1 AS rank, count(*) OVER (PARTITION BY label) AS own FROM pairs),
    target AS (SELECT max(own) AS big, min(own) AS small FROM ranked)"""


@register(
    "balance_pairs_oversampling",
    f"""WITH {_RANKED}
        SELECT id_1, id_2, label, 2 * (rank + turn * own) + side AS pair_ix
        FROM ranked, target, range(100) AS t(turn) WHERE rank + turn * own < big""",
)
def balance_pairs_oversampling(spark, sf):
    return P.balance_pairs(P.contrastive_pairs(_sample(spark, sf)), "oversampling")


@register(
    "balance_pairs_undersampling",
    f"WITH {_RANKED} SELECT id_1, id_2, label, 2 * rank + side AS pair_ix FROM ranked, target WHERE rank < small",
)
def balance_pairs_undersampling(spark, sf):
    return P.balance_pairs(P.contrastive_pairs(_sample(spark, sf)), "undersampling")


@register(
    "balance_pairs_unique",
    f"WITH {_RANKED} SELECT id_1, id_2, label, 2 * rank + side AS pair_ix FROM ranked",
)
def balance_pairs_unique(spark, sf):
    return P.balance_pairs(P.contrastive_pairs(_sample(spark, sf)), "unique")


@register(
    "balance_pairs_iterations",
    f"""WITH {_RANKED}
        SELECT id_1, id_2, label, 2 * (rank + turn * own) + side AS pair_ix
        FROM ranked, range(100) AS t(turn) WHERE rank + turn * own < 10 * (SELECT count(*) FROM sample)""",
)
def balance_pairs_iterations(spark, sf):
    sample = _sample(spark, sf)
    return P.balance_pairs(P.contrastive_pairs(sample), n_per_side=10 * sample.count())


@register(
    "cap_pairs",
    f"WITH {_RANKED} SELECT id_1, id_2, label FROM ranked WHERE rank < 200",
)
def cap_pairs(spark, sf):
    return P.cap_pairs(P.contrastive_pairs(_sample(spark, sf)), 400)


@register(
    "pair_counts",
    """WITH c AS (SELECT l_returnflag, count(*)::HUGEINT AS n FROM lineitem GROUP BY 1),
            t AS (SELECT (sum(n * (n + 1)) // 2)::BIGINT AS p, (sum(n) * (sum(n) + 1) // 2)::BIGINT AS every FROM c)
       SELECT p AS n_positive, every - p AS n_negative, every AS n_unique, 2 * least(p, every - p) AS n_undersampling,
              2 * greatest(p, every - p) AS n_oversampling FROM t""",
)
def pair_counts(spark, sf):
    return P.pair_counts(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("label")))


_DRAWN = """
    ranked AS (SELECT {id} AS row_id, {label} AS label, row_number() OVER (PARTITION BY {label} ORDER BY {key}, {id}) - 1 AS rank FROM {t}),
    cls AS (SELECT label, n, coalesce(sum(n) OVER (ORDER BY CAST(label AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off,
                   (sum(n) OVER ())::BIGINT AS total FROM (SELECT label, count(*) AS n FROM ranked GROUP BY 1)),
    placed AS (SELECT row_id, n, off, total, off + rank AS place FROM ranked JOIN cls USING (label)),
    d AS (SELECT row_id AS id_1, n, off, total, draw, {pos} AS pp, {neg} % (total - n) AS np
          FROM placed, (SELECT CAST(range AS INTEGER) AS draw FROM range(3))),
    wanted AS (SELECT id_1, draw, 1.0::DOUBLE AS label, off + pp % n AS place FROM d
               UNION ALL SELECT id_1, draw, 0.0::DOUBLE, CASE WHEN np < off THEN np ELSE np + n END FROM d),
    drawn AS (SELECT id_1, row_id AS id_2, label, draw FROM wanted JOIN placed USING (place))"""


def _drawn_sql(t: str, id_: str, label: str) -> str:
    return _DRAWN.format(
        t=t,
        id=id_,
        label=label,
        key=key_sql(42, id_),
        pos=number_sql("md5(concat_ws(':', 42, 'p', row_id, draw))", 15),
        neg=number_sql("md5(concat_ws(':', 42, 'n', row_id, draw))", 15),
    )


@register("drawn_pairs", f"WITH {_drawn_sql('documents', 'doc_id', 'lang')} SELECT * FROM drawn")
def drawn_pairs(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("label"))
    return P.drawn_pairs(docs, 3)


@register(
    "drawn_pair_similarity",
    f"""WITH {_drawn_sql('embeddings', 'vec_id', 'label')}
        SELECT id_1, id_2, drawn.label, draw,
               round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
        FROM drawn JOIN embeddings a ON a.vec_id = id_1 JOIN embeddings b ON b.vec_id = id_2""",
)
def drawn_pair_similarity(spark, sf):
    rows = vectors(spark, sf)
    scored = M.pair_similarity(P.drawn_pairs(rows.select("row_id", "label"), 3), rows)
    return scored.withColumn("similarity", r6("similarity"))


@register(
    "drawn_pair_texts",
    f"""WITH {_drawn_sql('documents', 'doc_id', 'lang')}
        SELECT id_1, id_2, label, md5(a.text) AS md5_1, md5(b.text) AS md5_2
        FROM drawn JOIN documents a ON a.doc_id = id_1 JOIN documents b ON b.doc_id = id_2""",
)
def drawn_pair_texts(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("label"), "text")
    pairs = P.drawn_pairs(docs.select("row_id", "label"), 3)
    full = P.attach_texts(pairs, docs)
    return full.select("id_1", "id_2", "label", F.md5("sentence_1").alias("md5_1"), F.md5("sentence_2").alias("md5_2"))


@register(
    "teacher_pairs",
    f"""WITH {_SAMPLE}
        SELECT a.row_id AS id_1, b.row_id AS id_2,
               round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS label
        FROM sample a JOIN sample b ON a.row_id <= b.row_id""",
)
def teacher_pairs(spark, sf):
    return P.teacher_pairs(_sample(spark, sf)).withColumn("label", r6("label"))


_BUDGET = 20_000


@register(
    "capped_pairs_at_volume",
    f"""WITH ranked AS (SELECT event_id AS row_id, event_type AS label,
                row_number() OVER (PARTITION BY event_type ORDER BY {key_sql(42, 'event_id')}, event_id) - 1 AS rank FROM events),
        cls AS (SELECT label, n, off, total - off - n AS after, n::HUGEINT * (n + 1) // 2 AS p, n::HUGEINT * (total - off - n) AS q FROM (
            SELECT label, n, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off,
                   (sum(n) OVER ())::BIGINT AS total FROM (SELECT label, count(*) AS n FROM ranked GROUP BY 1))),
        runs AS (SELECT *, sum(p) OVER (ORDER BY label) AS rp, sum(p) OVER () AS tp, sum(q) OVER (ORDER BY label) AS rq, sum(q) OVER () AS tq FROM cls),
        marks AS (SELECT *, CASE WHEN {_BUDGET // 2} >= tp THEN rp WHEN rp = tp THEN {_BUDGET // 2}
                                 ELSE floor(rp::DOUBLE / tp::DOUBLE * {_BUDGET // 2}) END AS mp,
                            CASE WHEN {_BUDGET // 2} >= tq THEN rq WHEN rq = tq THEN {_BUDGET // 2}
                                 ELSE floor(rq::DOUBLE / tq::DOUBLE * {_BUDGET // 2}) END AS mq FROM runs),
        shares AS (SELECT label, n, off, after, (mp - coalesce(lag(mp) OVER (ORDER BY label), 0))::BIGINT AS kp,
                          (mq - coalesce(lag(mq) OVER (ORDER BY label), 0))::BIGINT AS kq FROM marks),
        placed AS (SELECT row_id, rank, off + rank AS place, n, off, after, kp, kq FROM ranked JOIN shares USING (label)),
        wanted AS (SELECT row_id, 1.0::DOUBLE AS label, off + (rank + turn) % n AS place
                   FROM (SELECT *, unnest(range((kp - rank + n - 1) // n)) AS turn FROM placed WHERE kp > rank)
                   UNION ALL
                   SELECT row_id, 0.0::DOUBLE, off + n + (floor(rank::DOUBLE / n * after)::BIGINT + turn) % after
                   FROM (SELECT *, unnest(range((kq - rank + n - 1) // n)) AS turn FROM placed WHERE kq > rank))
        SELECT least(w.row_id, b.row_id) AS id_1, greatest(w.row_id, b.row_id) AS id_2, w.label
        FROM wanted w JOIN placed b ON w.place = b.place""",
)
def capped_pairs_at_volume(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.col("event_type").alias("label"))
    return P.capped_pairs(rows, _BUDGET)


@register(
    "drawn_pairs_multilabel",
    f"""WITH ranked AS (SELECT doc_id AS row_id, quality, toxic, row_number() OVER (PARTITION BY quality, toxic
                               ORDER BY {key_sql(42, 'doc_id')}, doc_id) - 1 AS rank FROM labels),
        sets AS (SELECT quality, toxic, n, coalesce(sum(n) OVER (ORDER BY quality, toxic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
                 FROM (SELECT quality, toxic, count(*) AS n FROM ranked GROUP BY 1, 2)),
        pairs AS (SELECT a.quality, a.toxic, b.quality AS q2, b.toxic AS t2, b.n, b.off,
                         (a.quality * b.quality + a.toxic * b.toxic > 0) AS same FROM sets a JOIN sets b ON true),
        sides AS (SELECT *, (sum(n) OVER (PARTITION BY quality, toxic, same ORDER BY q2, t2))::BIGINT - n AS start,
                         (sum(n) OVER (PARTITION BY quality, toxic, same))::BIGINT AS size FROM pairs),
        d AS (SELECT row_id AS id_1, quality, toxic, draw, {number_sql("md5(concat_ws(':', 42, 'p', row_id, draw))", 15)} AS pp,
                     {number_sql("md5(concat_ws(':', 42, 'n', row_id, draw))", 15)} AS np
              FROM ranked, (SELECT CAST(range AS INTEGER) AS draw FROM range(3))),
        wanted AS (SELECT id_1, draw, CASE WHEN same THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
                          off + (CASE WHEN same THEN pp ELSE np END) % size - start AS place
                   FROM d JOIN sides USING (quality, toxic)
                   WHERE (CASE WHEN same THEN pp ELSE np END) % size >= start AND (CASE WHEN same THEN pp ELSE np END) % size < start + n),
        placed AS (SELECT row_id, off + rank AS place FROM ranked JOIN sets USING (quality, toxic))
        SELECT id_1, row_id AS id_2, label, draw FROM wanted JOIN placed USING (place)""",
)
def drawn_pairs_multilabel(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.array("quality", "toxic").alias("label"))
    return P.drawn_pairs_multilabel(rows, 3)


@register(
    "drawn_teacher_pairs",
    f"""WITH ranked AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY {key_sql(42, 'vec_id')}, vec_id) - 1 AS rank,
                               count(*) OVER () AS n FROM embeddings),
        wanted AS (SELECT row_id, e, (rank + t) % n AS rank FROM ranked, range(4) AS r(t))
        SELECT least(w.row_id, b.row_id) AS id_1, greatest(w.row_id, b.row_id) AS id_2, round(list_cosine_similarity(w.e, b.e), 6) AS label
        FROM wanted w JOIN ranked b USING (rank)""",
)
def drawn_teacher_pairs(spark, sf):
    return P.drawn_teacher_pairs(vectors(spark, sf), 4).withColumn("label", r6("label"))


@register(
    "cosine_pair_loss",
    f"""WITH {_drawn_sql('embeddings', 'vec_id', 'label')},
        s AS (SELECT drawn.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c
              FROM drawn JOIN embeddings a ON a.vec_id = id_1 JOIN embeddings b ON b.vec_id = id_2)
        SELECT round(avg((c - label) * (c - label)), 6) AS loss FROM s""",
)
def cosine_pair_loss(spark, sf):
    rows = vectors(spark, sf)
    scored = M.pair_similarity(P.drawn_pairs(rows.select("row_id", "label"), 3), rows)
    return P.cosine_pair_loss(scored).select(r6("loss").alias("loss"))
