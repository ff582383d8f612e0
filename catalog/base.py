"""Registry of queries, table access and SQL shared by many checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(run):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf, *columns) -> DataFrame:
    """Documents keyed by row_id."""
    df = table(spark, sf, "documents").withColumnRenamed("doc_id", "row_id")
    return df.select(*columns) if columns else df


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), F.col("event_type").alias("label"), "user_id", "value"
    )


def vectors(spark, sf) -> DataFrame:
    """Embedding rows as (row_id, embedding, label)."""
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "row_id")


def order_lines(spark, sf) -> DataFrame:
    """Order lines keyed by (order, line, part) text, labelled by return flag."""
    return table(spark, sf, "lineitem")


def big(column):
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def r6(column):
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def key_sql(seed, row_id: str) -> str:
    return f"md5(concat_ws(':', {seed}, {row_id}))"


def number_sql(key: str, digits: int = 8) -> str:
    return f"CAST('0x' || substr({key}, 1, {digits}) AS BIGINT)"


# Predictions of the class-mean head on all rows outside its few-shot sample.
HEAD_SQL = f"""
    sample AS (SELECT vec_id, label, embedding FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY {key_sql(42, 'vec_id')}, vec_id) AS rn
        FROM embeddings) WHERE rn <= 8),
    means AS (SELECT label, pos, avg(v) AS m FROM (
        SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM sample)
        GROUP BY 1, 2),
    bias AS (SELECT label, -sum(m * m) / 2 AS b FROM means GROUP BY 1),
    held AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos
             FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM sample)),
    logits AS (SELECT vec_id, held.label AS true_label, means.label AS cls, (sum(v * m) + min(b)) / (1 + 1e-5) AS logit
               FROM held JOIN means USING (pos) JOIN bias ON bias.label = means.label GROUP BY 1, 2, 3),
    tops AS (SELECT vec_id, max(logit) AS top FROM logits GROUP BY 1),
    probs AS (SELECT vec_id, true_label, cls, exp(logit - top) / sum(exp(logit - top)) OVER (PARTITION BY vec_id) AS p
              FROM logits JOIN tops USING (vec_id)),
    preds AS (SELECT vec_id AS row_id, true_label, arg_max(cls, p) AS pred_label, max(p) AS score
              FROM probs GROUP BY 1, 2)
"""


def head_and_rest(spark, sf):
    """(head, held-out rows) for the class-mean head of eight rows per class."""
    from handful.operators.sampling import sample_per_class
    from handful.operators.scoring import class_means, load_head
    from handful.session import join_checked

    rows = vectors(spark, sf)
    picked = sample_per_class(rows.select("row_id", "label"), n=8, seed=42)
    head = load_head(class_means(rows.drop("label").join(picked, "row_id")))
    return head, join_checked(rows, picked.select("row_id"), "row_id", "left_anti")


def predictions(spark, sf):
    """(row_id, true_label, pred_label, score) of the held-out rows."""
    from handful.operators.scoring import predict

    head, rest = head_and_rest(spark, sf)
    return predict(rest, head).select("row_id", F.col("label").alias("true_label"), "pred_label", "score")


# A rule that guesses the return flag of an order line from its status and quantity: predictions at volume.
RULE_SQL = """
    rule AS (SELECT l_linestatus AS run, l_returnflag AS true_label,
                    CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity > 25 THEN 'A' ELSE 'R' END AS pred_label,
                    l_orderkey, l_linenumber
             FROM lineitem)
"""


def rule_predictions(spark, sf):
    guess = F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_quantity") > 25, "A").otherwise("R")
    return table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("run"),
        F.col("l_returnflag").alias("true_label"),
        guess.alias("pred_label"),
        "l_orderkey",
        "l_linenumber",
    )
