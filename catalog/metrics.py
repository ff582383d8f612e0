"""Quality metrics on head predictions and, at volume, on rule predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    HEAD_SQL, RULE_SQL, big, documents, key_sql, predictions, r6, register, rule_predictions, table,
)
from handful.operators import augment as A, columns as C, metrics as E
from handful.functions import text as X

_TOTALS = """
    labs AS (SELECT true_label AS label FROM {src} UNION SELECT pred_label FROM {src}),
    tot AS (SELECT label, count(*) FILTER (true_label = label AND pred_label = label) AS tp,
                   count(*) FILTER (true_label <> label AND pred_label = label) AS fp,
                   count(*) FILTER (true_label = label AND pred_label <> label) AS fn
            FROM labs, {src} GROUP BY 1)"""
_SCORES = """
    SELECT round(sum(tp) / sum(tp + fn), 6) AS accuracy,
           round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS macro_f1,
           round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1,
           round(sum(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END * (tp + fn))
                 / sum(tp + fn), 6) AS weighted_f1,
           round((sum(tp)::DOUBLE * sum(tp + fn) - sum((tp + fp)::DOUBLE * (tp + fn)))
                 / sqrt((sum(tp + fn)::DOUBLE * sum(tp + fn) - sum((tp + fp)::DOUBLE * (tp + fp)))
                      * (sum(tp + fn)::DOUBLE * sum(tp + fn) - sum((tp + fn)::DOUBLE * (tp + fn)))), 6) AS mcc"""


@register(
    "confusion",
    f"""WITH {HEAD_SQL}, labs AS (SELECT DISTINCT label FROM embeddings)
        SELECT t.label AS true_label, CAST(p.label AS INTEGER) AS pred_label, count(preds.row_id) AS n
        FROM labs t CROSS JOIN labs p LEFT JOIN preds ON true_label = t.label AND pred_label = p.label GROUP BY 1, 2""",
)
def confusion(spark, sf):
    dense = E.confusion_dense(E.confusion(predictions(spark, sf)))
    return dense.select("true_label", "pred_label", "n")


@register(
    "confusion_at_volume",
    f"""WITH {RULE_SQL} SELECT run, true_label, pred_label, count(*) AS n FROM rule GROUP BY 1, 2, 3""",
)
def confusion_at_volume(spark, sf):
    return E.confusion(rule_predictions(spark, sf), by=["run"])


@register(
    "confusion_matrix",
    f"""WITH {RULE_SQL}, l(label) AS (VALUES ('A'), ('N'), ('R')),
        cells AS (SELECT t.label AS t, p.label AS p, count(rule.run) AS n FROM l t CROSS JOIN l p
                  LEFT JOIN rule ON true_label = t.label AND pred_label = p.label GROUP BY 1, 2),
        lines AS (SELECT t, '[' || string_agg(n::VARCHAR, ',' ORDER BY p) || ']' AS line FROM cells GROUP BY 1)
        SELECT string_agg(t, ',' ORDER BY t) AS labels, '[' || string_agg(line, ',' ORDER BY t) || ']' AS matrix FROM lines""",
)
def confusion_matrix(spark, sf):
    m = E.confusion_matrix(E.confusion(rule_predictions(spark, sf)))
    return m.select(F.array_join("labels", ",").alias("labels"), F.to_json("matrix").alias("matrix"))


@register(
    "accuracy",
    f"""WITH {RULE_SQL} SELECT run, round(avg(CAST(true_label = pred_label AS INTEGER)), 6) AS accuracy FROM rule GROUP BY 1""",
)
def accuracy(spark, sf):
    return E.accuracy(rule_predictions(spark, sf), by=["run"]).withColumn("accuracy", r6("accuracy"))


@register(
    "per_class_accuracy",
    f"""WITH {RULE_SQL}, {_TOTALS.format(src="rule")}
        SELECT label, round(CASE WHEN tp + fn > 0 THEN 100 * tp / (tp + fn) END, 6) AS accuracy FROM tot""",
)
def per_class_accuracy(spark, sf):
    return E.per_class_accuracy(rule_predictions(spark, sf)).withColumn("accuracy", r6("accuracy"))


@register(
    "f1_and_mcc",
    f"""WITH {HEAD_SQL}, {_TOTALS.format(src="preds")} {_SCORES},
        round(max(CASE WHEN label = 3 THEN 2 * tp / (2 * tp + fp + fn) END), 6) AS binary_f1 FROM tot""",
)
def f1_and_mcc(spark, sf):
    s = E.scores(predictions(spark, sf), positive=3)
    return s.select(*[r6(c).alias(c) for c in s.columns])


@register(
    "f1_and_mcc_at_volume",
    f"""WITH {RULE_SQL}, {_TOTALS.format(src="rule")} {_SCORES} FROM tot""",
)
def f1_and_mcc_at_volume(spark, sf):
    s = E.scores(rule_predictions(spark, sf))
    return s.select(*[r6(c).alias(c) for c in s.columns])


# The rule abstains on large orders, and some orders have no true label.
_GAPS = """gaps AS (SELECT run, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE true_label END AS true_label,
                           CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE pred_label END AS pred_label, l_orderkey, l_linenumber FROM rule)"""


def _gaps(spark, sf):
    rows = rule_predictions(spark, sf)
    gap = lambda c, n: F.when(F.col("l_orderkey") % n != 0, F.col(c)).alias(c)
    return rows.select("run", gap("true_label", 13), gap("pred_label", 7), "l_orderkey", "l_linenumber")


@register(
    "confusion_with_abstentions",
    f"""WITH {RULE_SQL}, {_GAPS}
        SELECT run, true_label, pred_label, count(*) AS n FROM gaps WHERE true_label IS NOT NULL GROUP BY 1, 2, 3""",
)
def confusion_with_abstentions(spark, sf):
    return E.confusion(_gaps(spark, sf), by=["run"])


@register(
    "accuracy_with_abstentions",
    f"""WITH {RULE_SQL}, {_GAPS}
        SELECT run, round(avg(CASE WHEN true_label IS NULL THEN NULL WHEN true_label = pred_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
               count(*) FILTER (true_label IS NULL) AS n_unlabelled FROM gaps GROUP BY 1""",
)
def accuracy_with_abstentions(spark, sf):
    rows = _gaps(spark, sf)
    judged = E.accuracy(rows, by=["run"]).join(E.unlabelled(rows, by=["run"]), "run")
    return judged.select("run", r6("accuracy").alias("accuracy"), "n_unlabelled")


@register(
    "scores_with_abstentions",
    f"""WITH {RULE_SQL}, {_GAPS}, own AS (SELECT * FROM gaps WHERE true_label IS NOT NULL),
        lab AS (SELECT true_label AS label FROM own UNION SELECT pred_label FROM own WHERE pred_label IS NOT NULL),
        tot AS (SELECT label, count(*) FILTER (true_label = label AND pred_label = label) AS tp,
                       count(*) FILTER (true_label <> label AND pred_label = label) AS fp,
                       count(*) FILTER (true_label = label AND pred_label IS DISTINCT FROM label) AS fn
                FROM own JOIN lab ON true_label = label OR pred_label = label GROUP BY 1)
        SELECT round((SELECT avg(CASE WHEN true_label = pred_label THEN 1.0 ELSE 0.0 END) FROM own), 6) AS accuracy,
               round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS macro_f1 FROM tot""",
)
def scores_with_abstentions(spark, sf):
    return E.scores(_gaps(spark, sf)).select(r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@register(
    "error_summary_with_abstentions",
    f"""WITH {RULE_SQL}, {_GAPS}
        SELECT CASE WHEN grouping(true_label) = 1 THEN 'all' WHEN grouping(pred_label) = 1 THEN 'class' ELSE 'pair' END AS level,
               true_label, pred_label, count(*) AS count
        FROM gaps WHERE true_label IS NOT NULL AND true_label IS DISTINCT FROM pred_label
        GROUP BY GROUPING SETS ((), (true_label), (true_label, pred_label))""",
)
def error_summary_with_abstentions(spark, sf):
    return E.error_summary(_gaps(spark, sf))


@register(
    "average_precision_with_gaps",
    """WITH s AS (SELECT l_linestatus AS run, CASE WHEN l_orderkey % 5 <> 0 THEN l_extendedprice END AS score,
                         CAST(l_returnflag = 'N' AS INTEGER) AS y FROM lineitem),
            steps AS (SELECT run, score, sum(y) AS pos, count(*) AS seen FROM s GROUP BY 1, 2),
            totals AS (SELECT run, pos, sum(pos) OVER w AS pos_run, sum(seen) OVER w AS seen_run, sum(pos) OVER (PARTITION BY run) AS pos_all
                       FROM steps WINDOW w AS (PARTITION BY run ORDER BY score DESC NULLS LAST ROWS UNBOUNDED PRECEDING))
       SELECT run, round(sum(pos / pos_all * pos_run / seen_run), 6) AS average_precision FROM totals GROUP BY 1""",
)
def average_precision_with_gaps(spark, sf):
    price = F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice")).alias("score")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("run"), price, (F.col("l_returnflag") == "N").alias("is_positive")
    )
    return E.average_precision(rows, by=["run"]).select("run", r6("average_precision").alias("average_precision"))


@register(
    "primary_score",
    f"""WITH {RULE_SQL}, {_TOTALS.format(src="rule")}, s AS ({_SCORES} FROM tot)
        SELECT measure, round(CASE measure WHEN 'matthews_correlation' THEN mcc WHEN 'macro_f1' THEN macro_f1
                                   ELSE accuracy END * 100, 3) AS score
        FROM s, (VALUES ('accuracy'), ('macro_f1'), ('matthews_correlation')) AS m(measure)""",
)
def primary_score(spark, sf):
    measures = F.explode(F.array(F.lit("accuracy"), F.lit("macro_f1"), F.lit("matthews_correlation")))
    s = E.scores(rule_predictions(spark, sf)).select("*", F.lit(None).cast("double").alias("mae"), measures.alias("measure"))
    return s.select("measure", F.round(E.primary_score("measure"), 3).alias("score"))


@register(
    "classification_report",
    f"""WITH {RULE_SQL}, {_TOTALS.format(src="rule")}
        SELECT label, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
               round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
               round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
               tp + fn AS support FROM tot""",
)
def classification_report(spark, sf):
    r = E.classification_report(rule_predictions(spark, sf))
    return r.select("label", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


@register(
    "mae",
    f"WITH {HEAD_SQL} SELECT round(avg(abs(true_label - pred_label)), 6) AS mae FROM preds",
)
def mae(spark, sf):
    return E.mae(predictions(spark, sf)).select(r6("mae").alias("mae"))


@register(
    "average_precision",
    """WITH s AS (SELECT l_linestatus AS run, l_discount AS score, sum(CAST(l_returnflag = 'R' AS INTEGER))::DOUBLE AS pos,
                         count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
            c AS (SELECT run, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY run) AS all_pos
                  FROM s WINDOW w AS (PARTITION BY run ORDER BY score DESC))
       SELECT run, round(coalesce(sum(pos / nullif(all_pos, 0) * tp / seen), 0), 6) AS average_precision
       FROM c GROUP BY 1""",
)
def average_precision(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("run"), F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").alias("is_positive")
    )
    return E.average_precision(rows, by=["run"]).select("run", r6("average_precision").alias("average_precision"))


@register(
    "average_precision_distinct_scores",
    """WITH s AS (SELECT l_extendedprice AS score, sum(CAST(l_returnflag = 'R' AS INTEGER))::DOUBLE AS pos,
                         count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
            c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER () AS all_pos
                  FROM s WINDOW w AS (ORDER BY score DESC))
       SELECT round(sum(pos / all_pos * tp / seen), 6) AS average_precision FROM c""",
)
def average_precision_distinct_scores(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").alias("is_positive")
    )
    return E.average_precision(rows).select(r6("average_precision").alias("average_precision"))


# Multi-label rows: the two label columns against what document length and source say.
_ML = """ml AS (SELECT doc_id, quality AS t0, toxic AS t1, CAST(n_chars > 1000 AS INTEGER) AS p0,
                       CAST(source IN ('src1', 'src2', 'src3') AS INTEGER) AS p1
                FROM labels JOIN documents USING (doc_id))"""


def _multilabel(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    return (
        table(spark, sf, "labels")
        .join(docs, "doc_id")
        .select(
            "doc_id",
            F.array("quality", "toxic").alias("true_label"),
            F.array(
                (F.col("n_chars") > 1000).cast("int"), F.col("source").isin("src1", "src2", "src3").cast("int")
            ).alias("pred_label"),
        )
    )


@register(
    "multilabel_scores",
    f"""WITH {_ML},
        c AS (SELECT 0 AS label, sum(t0 * p0) AS tp, sum((1 - t0) * p0) AS fp, sum(t0 * (1 - p0)) AS fn FROM ml
              UNION ALL SELECT 1, sum(t1 * p1), sum((1 - t1) * p1), sum(t1 * (1 - p1)) FROM ml)
        SELECT (SELECT round(avg(CAST(t0 = p0 AND t1 = p1 AS INTEGER)), 6) FROM ml) AS subset_accuracy,
               round(2 * sum(tp)::DOUBLE / (2 * sum(tp) + sum(fp) + sum(fn))::DOUBLE, 6) AS micro_f1,
               round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn)::DOUBLE ELSE 0 END), 6) AS macro_f1
        FROM c""",
)
def multilabel_scores(spark, sf):
    s = E.multilabel_scores(_multilabel(spark, sf))
    return s.select(*[r6(c).alias(c) for c in s.columns])


@register(
    "example_based_prf",
    f"""WITH {_ML}, x AS (SELECT t0 * p0 + t1 * p1 AS i, t0 + t1 AS t, p0 + p1 AS p,
                                greatest(t0, p0) + greatest(t1, p1) AS u FROM ml),
        m AS (SELECT avg(CASE WHEN p > 0 THEN i / p ELSE 0 END) AS precision, avg(CASE WHEN t > 0 THEN i / t ELSE 0 END) AS recall,
                     avg(CASE WHEN u > 0 THEN i / u ELSE 0 END) AS jaccard FROM x)
        SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(jaccard, 6) AS jaccard,
               round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM m""",
)
def example_based_prf(spark, sf):
    def members(v):
        return F.filter(F.transform(v, lambda x, i: F.when(x == 1, i)), lambda x: x.isNotNull())

    rows = _multilabel(spark, sf).select(members("true_label").alias("true_label"), members("pred_label").alias("pred_label"))
    s = E.example_based_prf(rows)
    return s.select(*[r6(c).alias(c) for c in s.columns])


@register(
    "merge_labels_by_document",
    """WITH s AS (SELECT conv_id, turn, role AS t, CASE WHEN length(text) > 200 THEN 'assistant' WHEN turn > 5 THEN NULL
                                                     ELSE 'user' END AS p FROM conversations)
       SELECT conv_id::VARCHAR AS document,
              coalesce(string_agg(DISTINCT t, ',' ORDER BY t), '') AS true_labels,
              coalesce(string_agg(DISTINCT p, ',' ORDER BY p), '') AS pred_labels FROM s GROUP BY 1""",
)
def merge_labels_by_document(spark, sf):
    guess = F.when(F.length("text") > 200, "assistant").when(F.col("turn") > 5, None).otherwise("user")
    rows = table(spark, sf, "conversations").select(
        F.concat_ws("_", "conv_id", "turn").alias("index"), F.col("role").alias("true_label"), guess.alias("pred_label")
    )
    merged = E.merge_labels_by_document(rows)
    return merged.select(
        "document", F.array_join("true_label", ",").alias("true_labels"), F.array_join("pred_label", ",").alias("pred_labels")
    )


_TURNS = """turns AS (SELECT conv_id, turn, role AS true_label,
                            CASE WHEN length(text) > 200 THEN 'assistant' ELSE 'user' END AS pred_label FROM conversations)"""


def _turns(spark, sf):
    guess = F.when(F.length("text") > 200, "assistant").otherwise("user")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("true_label"), guess.alias("pred_label"))


@register(
    "group_exact_match",
    f"""WITH {_TURNS}, g AS (SELECT conv_id, bool_and(true_label = pred_label) AS ok FROM turns GROUP BY 1)
        SELECT round(avg(CAST(ok AS INTEGER)), 3) AS exact_match FROM g""",
)
def group_exact_match(spark, sf):
    return E.group_exact_match(_turns(spark, sf), "conv_id")


@register(
    "first_prediction_accuracy",
    f"""WITH {_TURNS}, g AS (SELECT conv_id, arg_min(true_label = pred_label, turn) AS ok FROM turns GROUP BY 1)
        SELECT round(avg(CAST(ok AS INTEGER)), 3) AS accuracy FROM g""",
)
def first_prediction_accuracy(spark, sf):
    return E.first_prediction_accuracy(_turns(spark, sf), "conv_id", "turn")


def _bare(c: str) -> str:
    return "translate(lower(" + c + "), '" + X.PUNCTUATION.replace("'", "''") + "', '')"


def _no_articles(c: str) -> str:
    return f"regexp_replace({c}, '(^|[^\\p{{L}}\\p{{N}}])(a|an|the)([^\\p{{L}}\\p{{N}}]|$)', '\\1 \\3', 'g')"


@register(
    "token_f1",
    """WITH base AS (SELECT d.doc_id, d.text AS a, b.text AS g FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id),
       bare AS (SELECT doc_id, {bare_a} AS a, {bare_g} AS g FROM base),
       once AS (SELECT doc_id, {drop_a} AS a, {drop_g} AS g FROM bare),
       norm AS (SELECT doc_id, {drop_a} AS a, {drop_g} AS g FROM once),
       wa AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(a, '\\s+')) AS w FROM norm) WHERE w <> '' GROUP BY 1, 2),
       wg AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(g, '\\s+')) AS w FROM norm) WHERE w <> '' GROUP BY 1, 2),
       sa AS (SELECT doc_id, sum(n) AS n FROM wa GROUP BY 1), sg AS (SELECT doc_id, sum(n) AS n FROM wg GROUP BY 1),
       both_ AS (SELECT doc_id, sum(least(wa.n, wg.n)) AS n FROM wa JOIN wg USING (doc_id, w) GROUP BY 1)
       SELECT doc_id AS row_id, round(coalesce(2 * both_.n::DOUBLE / (sa.n + sg.n)::DOUBLE, 0), 6) AS f1
       FROM base LEFT JOIN both_ USING (doc_id) LEFT JOIN sa USING (doc_id) LEFT JOIN sg USING (doc_id)""".format(
        bare_a=_bare("a"), bare_g=_bare("g"), drop_a=_no_articles("a"), drop_g=_no_articles("g")
    ),
)
def token_f1(spark, sf):
    gold = table(spark, sf, "benchmark").withColumnRenamed("text", "gold")
    docs = table(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % gold.count()).alias("item_id"))
    return docs.join(gold, "item_id").select(F.col("doc_id").alias("row_id"), r6(X.token_f1("text", "gold")).alias("f1"))


@register(
    "error_summary",
    f"""WITH {RULE_SQL}
        SELECT CASE WHEN grouping(true_label) = 1 THEN 'all' WHEN grouping(pred_label) = 1 THEN 'class' ELSE 'pair' END AS level,
               true_label, pred_label, count(*) AS count
        FROM rule WHERE true_label <> pred_label
        GROUP BY GROUPING SETS ((), (true_label), (true_label, pred_label))""",
)
def error_summary(spark, sf):
    return E.error_summary(rule_predictions(spark, sf)).select("level", "true_label", "pred_label", big("count").alias("count"))


@register(
    "errors_of",
    f"WITH {HEAD_SQL} SELECT row_id, true_label, CAST(pred_label AS INTEGER) AS pred_label FROM preds WHERE true_label <> pred_label",
)
def errors_of(spark, sf):
    return C.errors_of(predictions(spark, sf)).select("row_id", "true_label", "pred_label")


_LINE_STATUS = """CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END"""


@register(
    "align_predictions",
    f"""WITH p AS (SELECT l_orderkey AS key, {_LINE_STATUS} AS pred_label FROM lineitem GROUP BY 1)
        SELECT o_orderstatus AS true_label, pred_label, count(*) AS n FROM orders JOIN p ON key = o_orderkey GROUP BY 1, 2""",
)
def align_predictions(spark, sf):
    """Order status against what the order's lines say, on the orders that have lines."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.expr(_LINE_STATUS).alias("pred_label"))
    gold = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("true_label"))
    gold = gold.join(lines.select("key"), "key", "left_semi")
    return E.align_predictions(gold, lines, "key").groupBy("true_label", "pred_label").agg(F.count("key").alias("n"))


@register(
    "label_domain",
    f"WITH {RULE_SQL} SELECT true_label AS label FROM rule UNION SELECT pred_label FROM rule",
)
def label_domain(spark, sf):
    return C.label_domain(rule_predictions(spark, sf))


@register(
    "text_profile",
    """WITH w AS (SELECT len(string_split(text, ' ')) AS w FROM documents)
       SELECT min(w) AS min_words, round(avg(w), 6) AS mean_words, median(w) AS median_words, max(w) AS max_words FROM w""",
)
def text_profile(spark, sf):
    p = E.text_profile(documents(spark, sf, "text"))
    return p.select(big("min_words").alias("min_words"), r6("mean_words").alias("mean_words"), "median_words", big("max_words").alias("max_words"))


@register(
    "label_profile",
    """WITH names AS (SELECT DISTINCT role AS label_name FROM conversations
                      UNION SELECT DISTINCT lang FROM documents),
            ids AS (SELECT label_name AS label_id, upper(label_name) AS label_name FROM names)
       SELECT label_id, label_name, count(documents.doc_id) AS n_samples
       FROM ids LEFT JOIN documents ON lang = label_id GROUP BY 1, 2""",
)
def label_profile(spark, sf):
    names = table(spark, sf, "conversations").select("role").union(table(spark, sf, "documents").select("lang")).distinct()
    labels = names.select(F.col("role").alias("label_id"), F.upper("role").alias("label_name"))
    return E.label_profile(documents(spark, sf).select(F.col("lang").alias("label")), labels)


@register(
    "label_examples",
    """SELECT lang AS label, string_agg(md5(text), ',' ORDER BY doc_id) AS examples FROM (
         SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3 GROUP BY 1""",
)
def label_examples(spark, sf):
    shown = E.label_examples(documents(spark, sf).withColumn("label", F.col("lang")))
    return shown.select("label", F.array_join(F.transform("examples", lambda t: F.md5(t)), ",").alias("examples"))


@register(
    "word_order_sensitivity",
    f"""WITH w AS (SELECT doc_id, lang, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents),
        ends AS (SELECT doc_id, lang, arg_max(w, i) AS last, arg_max(w, md5(concat_ws(':', 42, doc_id, i))) AS last_sh FROM w GROUP BY 1, 2),
        guess AS (SELECT lang AS t, CASE WHEN length(last) < 6 THEN 'en' ELSE 'de' END AS p,
                         CASE WHEN length(last_sh) < 6 THEN 'en' ELSE 'de' END AS ps FROM ends)
        SELECT round((100 - 100 * avg(CAST(t = ps AS INTEGER))) / (100 - 100 / 4), 6) AS word_order_sensitivity
        FROM guess WHERE t = p""",
)
def word_order_sensitivity(spark, sf):
    """A guess from the last word of a text, before and after its words are shuffled."""
    docs = documents(spark, sf, "row_id", "lang", "text")
    both = docs.withColumn("shuffled", A.shuffle_words("text", 42, "row_id"))

    def guess(column):
        last = F.element_at(F.split(F.col(column), " "), -1)
        return F.when(F.length(last) < 6, "en").otherwise("de")

    plain = both.select("row_id", F.col("lang").alias("true_label"), guess("text").alias("pred_label"))
    mixed = both.select("row_id", guess("shuffled").alias("pred_label"))
    out = E.word_order_sensitivity(plain, mixed, 4)
    return out.select(r6("word_order_sensitivity").alias("word_order_sensitivity"))
