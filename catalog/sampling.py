"""Sampling, grids, splits, balancing, set and order operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import big, documents, events, key_sql, number_sql, r6, register, table, vectors
from handful.functions.order import running_totals
from handful.operators import columns as C, sampling as S
from handful.session import cut_lineage


@register(
    "sample_per_class",
    f"""
    SELECT row_id, label FROM (
      SELECT event_id AS row_id, event_type AS label,
             row_number() OVER (PARTITION BY event_type ORDER BY {key_sql(42, 'event_id')}, event_id) AS rn
      FROM events) WHERE rn <= 8
    """,
)
def sample_per_class(spark, sf):
    return S.sample_per_class(events(spark, sf).select("row_id", "label"), n=8, seed=42)


@register(
    "sample_per_class_with_text",
    f"""
    SELECT row_id, label, md5(text) AS text_md5 FROM (
      SELECT doc_id AS row_id, lang AS label, text,
             row_number() OVER (PARTITION BY lang ORDER BY {key_sql(7, 'doc_id')}, doc_id) AS rn
      FROM documents) WHERE rn <= 16
    """,
)
def sample_per_class_with_text(spark, sf):
    docs = documents(spark, sf).select("row_id", F.col("lang").alias("label"), "text")
    return S.sample_per_class(docs, n=16, seed=7).select("row_id", "label", F.md5("text").alias("text_md5"))


@register(
    "sample_per_class_large_n",
    f"""
    SELECT row_id, label FROM (
      SELECT event_id AS row_id, event_type AS label,
             row_number() OVER (PARTITION BY event_type ORDER BY {key_sql(3, 'event_id')}, event_id) AS rn
      FROM events) WHERE rn <= 1500
    """,
)
def sample_per_class_large_n(spark, sf):
    return S.sample_per_class(events(spark, sf).select("row_id", "label"), n=1500, seed=3)


_GRID = f"""
    WITH sizes(sample_size) AS (VALUES (2), (4), (8), (16), (32), (64)),
         seeds AS (SELECT CAST(range AS INTEGER) AS seed FROM range(10)),
         ranked AS (
           SELECT seed, event_id AS row_id, event_type AS label,
                  row_number() OVER (PARTITION BY seed, event_type
                                     ORDER BY {key_sql('seed', 'event_id')}, event_id) AS rn
           FROM events, seeds),
         grid AS (SELECT sample_size, seed AS split_idx, seed, row_id, label
                  FROM ranked JOIN sizes ON rn <= sample_size)
"""


@register(
    "fewshot_splits",
    _GRID + "SELECT 'train-' || sample_size || '-' || split_idx AS split_name, seed, row_id, label FROM grid",
)
def fewshot_splits(spark, sf):
    grid = S.fewshot_splits(events(spark, sf).select("row_id", "label"))
    return grid.select(S.split_name().alias("split_name"), "seed", "row_id", "label")


@register(
    "fewshot_split_counts",
    _GRID + """SELECT sample_size, split_idx, count(*) AS n_rows, count(DISTINCT label) AS n_classes
               FROM grid GROUP BY 1, 2""",
)
def fewshot_split_counts(spark, sf):
    grid = S.fewshot_splits(events(spark, sf).select("row_id", "label"))
    return grid.groupBy("sample_size", "split_idx").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("label").alias("n_classes")
    )


@register(
    "fewshot_splits_multilabel",
    f"""
    WITH long AS (
           SELECT doc_id AS row_id, 'quality' AS c FROM labels WHERE quality = 1
           UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1),
         seeds AS (SELECT CAST(range AS INTEGER) AS seed FROM range(10)),
         ranked AS (SELECT seed, row_id, row_number() OVER (PARTITION BY seed, c
                           ORDER BY {key_sql('seed', 'row_id')}, row_id) AS rn FROM long, seeds),
         sizes(sample_size) AS (VALUES (4), (16), (64))
    SELECT DISTINCT sample_size, seed, row_id, quality, toxic
    FROM ranked JOIN sizes ON rn <= sample_size JOIN labels ON doc_id = row_id
    """,
)
def fewshot_splits_multilabel(spark, sf):
    wide = table(spark, sf, "labels").withColumnRenamed("doc_id", "row_id")
    grid = S.fewshot_splits_multilabel(wide, ["quality", "toxic"], sizes=[4, 16, 64])
    return grid.select("sample_size", "seed", "row_id", "quality", "toxic")


@register(
    "sample_uniform",
    f"""SELECT doc_id AS row_id, md5(text) AS text_md5 FROM documents
        ORDER BY {key_sql(42, 'doc_id')}, doc_id LIMIT 100""",
)
def sample_uniform(spark, sf):
    return S.sample_uniform(documents(spark, sf, "row_id", "text"), 100, 42).select(
        "row_id", F.md5("text").alias("text_md5")
    )


@register(
    "shortest_example",
    f"""WITH s AS (SELECT doc_id AS row_id, text FROM documents ORDER BY {key_sql(42, 'doc_id')}, doc_id LIMIT 5)
        SELECT row_id, text FROM s ORDER BY length(text), row_id LIMIT 1""",
)
def shortest_example(spark, sf):
    return S.shortest_example(S.sample_uniform(documents(spark, sf, "row_id", "text"), 5, 42))


@register(
    "train_test_split",
    f"""SELECT event_type AS label, count(*) AS n,
               sum(CAST({number_sql(key_sql(42, 'event_id'))} / 4294967296.0 < 0.2 AS BIGINT))::BIGINT AS n_test,
               sum(CASE WHEN {number_sql(key_sql(42, 'event_id'))} / 4294967296.0 < 0.2
                        THEN event_id ELSE 0 END)::BIGINT AS test_id_sum
        FROM events GROUP BY 1""",
)
def train_test_split(spark, sf):
    split = S.train_test_split(events(spark, sf).select("row_id", "label"), 0.2, 42)
    return split.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(big("is_test")).alias("n_test"),
        F.sum(F.when(F.col("is_test"), F.col("row_id")).otherwise(0)).alias("test_id_sum"),
    )


@register(
    "train_test_split_exact",
    f"""SELECT event_id AS row_id,
               row_number() OVER (ORDER BY {key_sql(42, 'event_id')}, event_id) <= 2000 AS is_test FROM events""",
)
def train_test_split_exact(spark, sf):
    return S.train_test_split_exact(events(spark, sf).select("row_id"), 2000, 42)


_BALANCED = """
    WITH src AS ({src}),
         cls AS (SELECT label, row_number() OVER (ORDER BY CAST(label AS VARCHAR)) - 1 AS pos,
                        count(*) OVER () AS k FROM (SELECT DISTINCT label FROM src)),
         ranked AS (SELECT src.*, {key} AS h,
                           row_number() OVER (PARTITION BY src.label ORDER BY {key}, row_id) AS rn,
                           {max} // k + CAST(pos < {max} % k AS INTEGER) AS quota
                    FROM src JOIN cls USING (label)),
         balanced AS (SELECT row_id, label FROM ranked
                  ORDER BY CAST(rn > quota AS INTEGER), h, row_id LIMIT {max})
"""


@register(
    "balanced_downsample",
    _BALANCED.format(src="SELECT doc_id AS row_id, lang AS label FROM documents", key=key_sql(5, "row_id"), max=450)
    + "SELECT row_id, label FROM balanced",
)
def balanced_downsample(spark, sf):
    docs = documents(spark, sf).select("row_id", F.col("lang").alias("label"))
    return S.balanced_downsample(docs, 450, seed=5)


@register(
    "class_counts",
    """SELECT l_returnflag AS label, count(*) AS n_samples FROM lineitem GROUP BY 1""",
)
def class_counts(spark, sf):
    return S.class_counts(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("label")))


@register(
    "imbalance_report",
    """WITH c AS (SELECT lang AS label, count(*) AS n_samples FROM documents GROUP BY 1)
       SELECT label, n_samples, (SELECT max(n_samples) > 1.5 * min(n_samples) FROM c) AS imbalanced FROM c""",
)
def imbalance_report(spark, sf):
    return S.imbalance_report(documents(spark, sf).select(F.col("lang").alias("label")))


def _regime_sql(kind: str) -> str:
    part, where, target = {
        "each": ("lang, ", "TRUE", "lang"),
        "en": ("", "lang = 'en'", "t"),
        "all": ("", "TRUE", "t"),
    }[kind]
    targets = "" if kind == "each" else ", (VALUES ('de'), ('en'), ('es'), ('fr')) AS x(t)"
    return f"""
    WITH seeds AS (SELECT CAST(range AS INTEGER) AS seed FROM range(3)),
         sizes(sample_size) AS (VALUES (4), (8)),
         ranked AS (SELECT seed, doc_id AS row_id, lang, source AS label,
                           row_number() OVER (PARTITION BY {part}seed, source
                                              ORDER BY {key_sql('seed', 'doc_id')}, doc_id) AS rn
                    FROM documents, seeds WHERE {where})
    SELECT '{kind}' AS regime, {target} AS test_lang, sample_size, seed, row_id, label
    FROM ranked JOIN sizes ON rn <= sample_size{targets}
    """


@register(
    "language_regimes",
    " UNION ALL ".join(f"({_regime_sql(k)})" for k in ("each", "en", "all")),
)
def language_regimes(spark, sf):
    docs = documents(spark, sf).select("row_id", "lang", F.col("source").alias("label"))
    parts = [
        S.language_regimes(docs, kind, ["de", "en", "es", "fr"], sizes=[4, 8], seeds=[0, 1, 2]).select(
            F.lit(kind).alias("regime"), "test_lang", "sample_size", "seed", "row_id", "label"
        )
        for kind in ("each", "en", "all")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(
    "seeded_shuffle",
    f"""SELECT vec_id AS row_id, row_number() OVER (ORDER BY {key_sql(42, 'vec_id')}, vec_id) - 1 AS place
        FROM embeddings""",
)
def seeded_shuffle(spark, sf):
    """The operator's order, read off as places of its range partitions."""
    ordered = C.seeded_shuffle(vectors(spark, sf).select("row_id"), 42)
    ordered = cut_lineage(ordered.withColumn("at", F.monotonically_increasing_id()), "shuffled")
    ranked = running_totals(ordered.withColumn("one", F.lit(1)), [], "at", ["one"])
    return ranked.select("row_id", big(F.col("one_run") - 1).alias("place"))


@register(
    "take_range",
    """SELECT doc_id AS row_id, lang FROM documents ORDER BY doc_id LIMIT 25 OFFSET 100""",
)
def take_range(spark, sf):
    return C.take_range(documents(spark, sf, "row_id", "lang"), 100, 125)
