"""Aspect spans over the documents, tagged by a simple rule."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from catalog.base import big, documents, r6, register, table
from handful.functions.text import nth_occurrence
from handful.operators import spans as P
from handful.session import cut_lineage


def rule_tagger():
    """Words between blanks: capitalised ones are proper nouns, long ones nouns."""

    def run(text: str):
        at = 0
        for word in text.split(" "):
            if word:
                tag = "PROPN" if word[0].isupper() else "NOUN" if len(word) >= 8 else "X"
                yield word, tag, at, at + len(word)
            at += len(word) + 1

    return run


def tagged(spark, sf, packed=False):
    return P.tag_tokens(documents(spark, sf, "row_id", "text", "lang"), rule_tagger, packed=packed)


_TOK = """
    raw AS (SELECT doc_id AS id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS k FROM documents),
    off AS (SELECT id, w, k, (coalesce(sum(length(w) + 1) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS s FROM raw),
    tok AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS i, w, s, s + length(w) AS e,
                   CASE WHEN upper(w[1]) = w[1] AND lower(w[1]) <> w[1] THEN 'PROPN' WHEN length(w) >= 8 THEN 'NOUN' ELSE 'X' END AS tag
            FROM off WHERE w <> ''),
    sizes AS (SELECT id, count(*) AS n FROM tok GROUP BY 1),
    asp AS (SELECT id, min(i) AS a, max(i) + 1 AS b FROM (
        SELECT id, i, i - row_number() OVER (PARTITION BY id ORDER BY i) AS g FROM tok WHERE tag <> 'X') GROUP BY id, g)"""


def _input_sql(source: str, context: int, extra: str = "") -> str:
    """Rows of ``source`` (id, a, b, ...) with their model input."""
    return f"""(SELECT q.*, substr(d.text, x.s + 1, y.e - x.s) || ':' || d.text AS input, substr(d.text, x0.s + 1, y0.e - x0.s) AS words
        FROM {source} q JOIN sizes USING (id) JOIN documents d ON d.doc_id = q.id
        JOIN tok x ON x.id = q.id AND x.i = greatest(q.a - {context}, 0) JOIN tok y ON y.id = q.id AND y.i = least(q.b + {context}, n) - 1
        JOIN tok x0 ON x0.id = q.id AND x0.i = q.a JOIN tok y0 ON y0.id = q.id AND y0.i = q.b - 1{extra})"""


@register("extract_aspects", f"WITH {_TOK} SELECT id AS row_id, a AS start, b AS stop FROM asp")
def extract_aspects(spark, sf):
    spans = P.explode_aspects(tagged(spark, sf), ["row_id"])
    return spans.select("row_id", big("span.start").alias("start"), big("span.stop").alias("stop"))


@register(
    "runs_of_true",
    """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value > 50 AS f FROM events)
       SELECT user_id, min(i) AS start, max(i) + 1 AS stop FROM (
         SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM e WHERE f) GROUP BY user_id, g""",
)
def runs_of_true(spark, sf):
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf, "events").select(
        "user_id", big(F.row_number().over(order) - 1).alias("i"), (F.col("value") > 50).alias("f")
    )
    return P.runs_of_true_rows(rows, ["user_id"], "i", "f")


@register(
    "prepend_span",
    f"WITH {_TOK} SELECT id AS row_id, a AS start, md5(input) AS input_md5 FROM {_input_sql('asp', 3)}",
)
def prepend_span(spark, sf):
    docs = P.explode_aspects(tagged(spark, sf), ["row_id", "text"])
    return P.prepend_span(docs, 3).select("row_id", big("span.start").alias("start"), F.md5("input").alias("input_md5"))


# A word of every document is annotated: its first or second occurrence, labelled with the language.
_ANN = """ann AS (SELECT tok.id, w AS span, tok.id % 2 AS ordinal, lang AS label FROM tok JOIN sizes USING (id) JOIN documents ON doc_id = tok.id
    WHERE i = (tok.id * 7) % n)"""
# Ordinals are 0 or 1, so the first match and the first one that begins behind its start are enough.
_OVER = """first_hit AS (SELECT id, text, span, strpos(text, span) AS at_1 FROM ann JOIN documents ON doc_id = id),
    both_hits AS (SELECT id, at_1, strpos(substr(text, at_1 + 1), span) AS at_2 FROM first_hit),
    hits AS (SELECT id, 0 AS o, at_1 - 1 AS p FROM both_hits UNION ALL SELECT id, 1, at_1 + at_2 - 1 FROM both_hits WHERE at_2 > 0)"""
_APART = """parts AS (SELECT id, span, string_split(text, span) AS ps FROM ann JOIN documents ON doc_id = id),
    hits AS (SELECT id, k - 1 AS o, (sum(length(pp)) OVER (PARTITION BY id ORDER BY k) + (k - 1) * length(span))::BIGINT AS p
             FROM (SELECT id, span, unnest(ps) AS pp, generate_subscripts(ps, 1) AS k, len(ps) AS n FROM parts) QUALIFY k < n)"""
_GOLD = """gold AS (SELECT ann.id, x.i AS a, y.i + 1 AS b, label FROM ann JOIN hits ON hits.id = ann.id AND o = ordinal
    JOIN tok x ON x.id = ann.id AND x.s = p JOIN tok y ON y.id = ann.id AND y.e = p + length(span))"""


def annotated(spark, sf):
    """(annotations, documents); the documents are tagged once, and an annotated word is cut while they are tagged."""
    docs = tagged(spark, sf, packed=True).withColumn("_word", P.packed_words("text", "tokens", F.col("row_id") * 7))
    docs = cut_lineage(docs, "tagged")
    rows = docs.filter("_word.n > 0").select(
        "row_id", "text", F.col("_word.words").alias("span"), (F.col("row_id") % 2).cast("int").alias("ordinal"), F.col("lang").alias("label")
    )
    return rows, docs.drop("_word")


@register(
    "nth_occurrence",
    f"""WITH {_TOK}, {_ANN}, {_OVER}, {_APART.replace('hits AS', 'hits_apart AS')}
        SELECT ann.id AS row_id, h.p AS overlapping, g.p AS apart FROM ann
        LEFT JOIN hits h ON h.id = ann.id AND h.o = ordinal LEFT JOIN hits_apart g ON g.id = ann.id AND g.o = ordinal""",
)
def nth_occurrences(spark, sf):
    rows, _ = annotated(spark, sf)
    return rows.select(
        "row_id",
        big(nth_occurrence("text", "span", "ordinal", True)).alias("overlapping"),
        big(nth_occurrence("text", "span", "ordinal", False)).alias("apart"),
    )


@register(
    "gold_spans",
    f"""WITH {_TOK}, {_ANN}, {_APART}, {_GOLD}
        SELECT ann.id AS row_id, a AS start, b AS stop FROM ann LEFT JOIN gold USING (id)""",
)
def gold_spans(spark, sf):
    rows, docs = annotated(spark, sf)
    placed = P.gold_spans(rows, docs, overlapping=False, key="row_id")
    return placed.select("row_id", big("gold.start").alias("start"), big("gold.stop").alias("stop"))


@register(
    "gold_spans_by_text",
    f"""WITH {_TOK}, {_ANN}, {_APART}, {_GOLD}
        SELECT ann.id AS row_id, a AS start, b AS stop FROM ann LEFT JOIN gold USING (id)""",
)
def gold_spans_by_text(spark, sf):
    """Texts as keys: copies of a text do not multiply its annotations."""
    rows, docs = annotated(spark, sf)
    placed = P.gold_spans(rows, docs, overlapping=False)
    return placed.select("row_id", big("gold.start").alias("start"), big("gold.stop").alias("stop"))


_FALSE = """fake AS (SELECT asp.id, asp.a, asp.b FROM asp JOIN ann USING (id)
    WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.id = asp.id AND asp.a <= g.b AND g.a <= asp.b))"""


@register(
    "non_overlapping",
    f"WITH {_TOK}, {_ANN}, {_OVER}, {_GOLD}, {_FALSE} SELECT id AS row_id, a AS start, b AS stop FROM fake",
)
def non_overlapping(spark, sf):
    rows, docs = annotated(spark, sf)
    gold = P.gold_spans(rows, docs, overlapping=True, key="row_id").filter("gold is not null")
    candidates = P.explode_aspects(docs, ["row_id"])
    free = P.non_overlapping(candidates, gold, key="row_id")
    return free.select("row_id", big("span.start").alias("start"), big("span.stop").alias("stop"))


@register(
    "span_training_sets",
    f"""WITH {_TOK}, {_ANN}, {_OVER}, {_GOLD}, {_FALSE},
        al AS (SELECT id, a, b, 'true' AS label FROM gold UNION ALL SELECT id, a, b, 'false' FROM fake)
        SELECT 'aspect' AS model, id AS row_id, a AS start, label, md5(input) AS input_md5 FROM {_input_sql('al', 0)}
        UNION ALL SELECT 'polarity', id, a, label, md5(input) FROM {_input_sql('gold', 3)}""",
)
def span_training_sets(spark, sf):
    rows, docs = annotated(spark, sf)
    aspect, polarity = P.span_training_sets(rows, docs, key="row_id", written=True)
    parts = [
        part.select(
            F.lit(name).alias("model"), "row_id", big("span.start").alias("start"),
            F.col("label").cast("string").alias("label"), F.md5("input").alias("input_md5"),
        )
        for name, part in (("aspect", aspect), ("polarity", polarity))
    ]
    return parts[0].unionByName(parts[1])


def _aspect_model(df):
    """Stand-in for a trained model: looks at the parity of the input's length."""
    return df.withColumn("pred_label", F.when(F.length("input") % 2 == 0, "aspect").otherwise("no aspect"))


def _polarity_model(df):
    return df.withColumn("pred_label", F.when(F.length("input") % 3 == 0, "negative").otherwise("positive"))


_POLARITY = "CASE WHEN length(input) % 3 = 0 THEN 'negative' ELSE 'positive' END"


@register(
    "predict_spans",
    f"""WITH {_TOK}, kept AS (SELECT id, a, b FROM {_input_sql('asp', 0)} WHERE length(input) % 2 = 0),
        judged AS (SELECT id, a, words, {_POLARITY} AS polarity FROM {_input_sql('kept', 3)})
        SELECT doc_id AS row_id, count(a) AS n_spans, md5(coalesce(string_agg(words || '=' || polarity, ';' ORDER BY a), '')) AS spans_md5
        FROM documents LEFT JOIN judged ON id = doc_id GROUP BY 1""",
)
def predict_spans(spark, sf):
    found = P.predict_spans(tagged(spark, sf, packed=True).select("row_id", "text", "tokens"), _aspect_model, _polarity_model)
    text = F.array_join(F.transform("spans", lambda s: F.concat(s["span"], F.lit("="), s["polarity"])), ";")
    return found.select("row_id", big(F.size("spans")).alias("n_spans"), F.md5(text).alias("spans_md5"))


@register(
    "predict_gold_polarity",
    f"""WITH {_TOK}, {_ANN}, {_APART}, {_GOLD}, judged AS (SELECT id, {_POLARITY} AS pred_polarity FROM {_input_sql('gold', 3)})
        SELECT ann.id AS row_id, span, pred_polarity FROM ann LEFT JOIN judged USING (id)""",
)
def predict_gold_polarity(spark, sf):
    rows, docs = annotated(spark, sf)
    return P.predict_gold_polarity(rows, docs, _polarity_model, key="row_id").select("row_id", "span", "pred_polarity")


@register(
    "span_evaluate",
    f"""WITH {_TOK}, {_ANN}, {_OVER}, {_GOLD}, {_FALSE},
        al AS (SELECT id, a, b, TRUE AS label FROM gold UNION ALL SELECT id, a, b, FALSE FROM fake)
        SELECT 'aspect' AS model, round(avg(CAST(label = (length(input) % 2 = 0) AS INTEGER)), 6) AS accuracy FROM {_input_sql('al', 0)}
        UNION ALL SELECT 'polarity', round(avg(CAST(({_POLARITY} = 'positive') = (label = 'en') AS INTEGER)), 6) FROM {_input_sql('gold', 3)}""",
)
def span_evaluate(spark, sf):
    rows, docs = annotated(spark, sf)
    aspect, polarity = P.span_training_sets(rows, docs, key="row_id", written=True)
    named = aspect.withColumn("true_label", F.when(F.col("label"), "aspect").otherwise("no aspect"))
    judged = polarity.withColumn("true_label", F.when(F.col("label") == "en", "positive").otherwise("negative"))
    both = P.span_evaluate(_aspect_model(named), _polarity_model(judged))
    return both.withColumn("accuracy", r6("accuracy"))


@register(
    "filter_aspects",
    f"WITH {_TOK} SELECT id AS row_id, a AS start, words AS span FROM {_input_sql('asp', 0)} WHERE length(input) % 2 = 0",
)
def filter_aspects(spark, sf):
    docs = P.explode_aspects(tagged(spark, sf), ["row_id", "text"])
    kept = P.filter_aspects(_aspect_model(P.prepend_span(docs, 0)))
    words = P.span_text("text", "at_0")
    return kept.select("row_id", big("span.start").alias("start"), words.alias("span"))


@register(
    "default_ordinal",
    f"WITH {_TOK}, {_ANN} SELECT id AS row_id, span, 0 AS ordinal FROM ann",
)
def default_ordinal(spark, sf):
    rows, _ = annotated(spark, sf)
    return P.with_default_ordinal(rows.drop("ordinal")).select("row_id", "span", "ordinal")
