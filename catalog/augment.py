"""Templates, synthetic rows, pseudo-labels, prompts and column operators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from catalog.base import (
    HEAD_SQL, RULE_SQL, big, documents, events, head_and_rest, key_sql, number_sql, predictions, register,
    rule_predictions, table, vectors,
)
from handful.functions import text as X
from handful.operators import augment as A, columns as C, prompts as Q, sampling as S, scoring as M

_NAMES = """names AS (SELECT label_id, label_name FROM (SELECT hash_id AS label_id, arg_min(role, k) AS label_name FROM (
    SELECT CAST(length(role) AS INTEGER) AS hash_id, role, conv_id * 100 + turn AS k FROM conversations) GROUP BY 1))"""


def _role_names(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.length("role").alias("label"), F.col("role").alias("label_text"), (F.col("conv_id") * 100 + F.col("turn")).alias("row_id")
    )
    return A.candidate_labels(rows)


@register("candidate_labels", f"WITH {_NAMES} SELECT * FROM names")
def candidate_labels(spark, sf):
    return _role_names(spark, sf)


@register(
    "templated_dataset",
    f"""WITH {_NAMES}
        SELECT text, CAST(length(role) AS INTEGER) AS label, 'row' AS kind FROM conversations
        UNION ALL SELECT 'This sentence is ' || label_name, label_id, 'row' FROM names, range(2)""",
)
def templated_dataset(spark, sf):
    rows = table(spark, sf, "conversations").select("text", F.length("role").alias("label"))
    return A.templated_dataset(spark, rows, reference=_role_names(spark, sf)).withColumn("kind", F.lit("row"))


@register(
    "templated_multi_label",
    """WITH l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS id FROM (SELECT DISTINCT lang FROM documents))
       SELECT 'It is written in ' || lang AS text, repeat('0', id::INTEGER) || '1' || repeat('0', 3 - id::INTEGER) AS bits FROM l, range(3)""",
)
def templated_multi_label(spark, sf):
    langs = documents(spark, sf, "lang").distinct()
    table_ = langs.agg(F.array_sort(F.collect_list("lang")).alias("l")).select(F.posexplode("l").alias("label_id", "label_name"))
    made = A.templated_dataset(spark, None, reference=table_, template="It is written in {}", sample_size=3, multi_label=True)
    return made.select("text", F.array_join(F.col("label").cast("array<string>"), "").alias("bits"))


@register(
    "fewshot_splits_augmented",
    f"""WITH seeds AS (SELECT CAST(range AS INTEGER) AS seed FROM range(3)), sizes(sample_size) AS (VALUES (2), (4)),
        ranked AS (SELECT seed, event_id AS row_id, event_type AS label, row_number() OVER (PARTITION BY seed, event_type
                   ORDER BY {key_sql('seed', 'event_id')}, event_id) AS rn FROM events, seeds),
        rows_ AS (SELECT sample_size, seed, label, row_id, 'value ' || label AS text FROM ranked JOIN sizes ON rn <= sample_size
                 UNION ALL SELECT sample_size, seed, t, NULL, 'This sentence is ' || upper(t)
                 FROM (SELECT DISTINCT event_type AS t FROM events), sizes, seeds, range(4) AS c(copy) WHERE copy < sample_size)
        SELECT sample_size, seed, label, text, count(*) AS n, count(row_id) AS n_real FROM rows_ GROUP BY ALL""",
)
def fewshot_splits_augmented(spark, sf):
    rows = events(spark, sf).select("row_id", "label", F.concat(F.lit("value "), "label").alias("text"))
    labels = rows.select(F.col("label").alias("label_id"), F.upper("label").alias("label_name")).distinct()
    grid = A.fewshot_splits_augmented(rows, labels, sizes=[2, 4], seeds=[0, 1, 2])
    return grid.groupBy("sample_size", "seed", "label", "text").agg(
        F.count(F.lit(1)).alias("n"), F.count("row_id").alias("n_real")
    )


_T = [t.replace("'", "''").replace("{name}", "' || name || '").replace("{others}", "' || others || '") for t in A.ERROR_TEMPLATES]


@register(
    "error_driven_synthetic",
    f"""WITH {HEAD_SQL},
        e AS (SELECT true_label AS label, 'class ' || true_label AS name, 'class ' || pred_label AS other FROM preds WHERE true_label <> pred_label),
        c AS (SELECT label, name, least(count(*) * 2, 7) AS wanted, string_agg(DISTINCT other, ', ' ORDER BY other) AS others FROM e GROUP BY 1, 2)
        SELECT label, CAST(i AS INTEGER) AS sample_idx,
               CASE i % 3 WHEN 0 THEN '{_T[0]}' WHEN 1 THEN '{_T[1]}' ELSE '{_T[2]}' END AS text
        FROM c, range(7) AS r(i) WHERE i < wanted""",
)
def error_driven_synthetic(spark, sf):
    names = [f"class {i}" for i in range(10)]
    errors = C.errors_of(predictions(spark, sf))
    return A.error_driven_synthetic(errors, names, per_error=2, cap=7)


_R = [t.replace("'", "''").replace("{name}", "' || label || '") for t in A.RANDOM_TEMPLATES]


@register(
    "random_synthetic",
    f"""WITH labs AS (SELECT list(DISTINCT l_returnflag ORDER BY l_returnflag) AS ls FROM lineitem),
        n AS (SELECT round_even(count(*) / 1000.0 * 1.5, 0)::BIGINT AS n FROM lineitem),
        d AS (SELECT i, ls[({number_sql(key_sql(9, 'i'))} % len(ls)) + 1] AS label FROM labs, n, range(100000) AS r(i) WHERE i < n)
        SELECT i AS sample_idx, label, CASE i % 3 WHEN 0 THEN '{_R[0]}' WHEN 1 THEN '{_R[1]}' ELSE '{_R[2]}' END AS text FROM d""",
)
def random_synthetic(spark, sf):
    """As many sentences as 1.5 per thousand order lines, labels drawn from the return flags."""
    counts = S.class_counts(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("label"))).collect()
    total = sum(r["n_samples"] for r in counts)
    n = spark.range(1).select(A.random_budget(F.lit(total / 1000.0), 1.5)).first()[0]
    return A.random_synthetic(spark, [r["label"] for r in counts], n, seed=9)


_SYN = """syn AS (SELECT event_id AS row_id, event_type AS label, 'row ' || event_id AS text FROM events)"""


@register(
    "cap_synthetic",
    f"""WITH {_SYN}, budget AS (SELECT least(90, floor(90 * 0.7::DOUBLE))::BIGINT AS m),
        r AS (SELECT *, {key_sql(3, 'row_id')} AS h, row_number() OVER (PARTITION BY label ORDER BY {key_sql(3, 'row_id')}, row_id) AS rn,
                     dense_rank() OVER (ORDER BY label) - 1 AS pos FROM syn),
        q AS (SELECT row_id, label, rn, h, m // 5 + CAST(pos < m % 5 AS INTEGER) AS quota FROM r, budget WHERE rn <= 100)
        SELECT row_id, label FROM q ORDER BY CAST(rn > quota AS INTEGER), h, row_id LIMIT (SELECT m FROM budget)""",
)
def cap_synthetic(spark, sf):
    rows = events(spark, sf).select("row_id", "label", F.concat(F.lit("row "), "row_id").alias("text"))
    return A.cap_synthetic(rows, n_train=90, ratio=0.7, seed=3, per_class=100).select("row_id", "label")


@register(
    "augment_train",
    f"""WITH src AS (SELECT doc_id::VARCHAR AS row_id, lang AS label, md5(text) AS m FROM documents
                    UNION ALL SELECT 'syn-s' || conv_id || '-' || turn, 'de', md5(text) FROM conversations),
        r AS (SELECT *, {key_sql(1, 'row_id')} AS h, row_number() OVER (PARTITION BY label ORDER BY {key_sql(1, 'row_id')}, row_id) AS rn,
                     dense_rank() OVER (ORDER BY label) - 1 AS pos FROM src),
        q AS (SELECT *, 700 // 4 + CAST(pos < 700 % 4 AS INTEGER) AS quota FROM r)
        SELECT row_id, label, m AS text_md5 FROM q ORDER BY CAST(rn > quota AS INTEGER), h, row_id LIMIT 700""",
)
def augment_train(spark, sf):
    train = documents(spark, sf).select("row_id", "text", F.col("lang").alias("label"))
    extra = table(spark, sf, "conversations").select(
        F.concat(F.lit("s"), F.concat_ws("-", "conv_id", "turn")).alias("row_id"), "text", F.lit("de").alias("label")
    )
    out = A.augment_train(train, extra, n_train=train.count(), max_examples=700, seed=1)
    return out.select("row_id", "label", F.md5("text").alias("text_md5"))


@register(
    "shuffle_words",
    f"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents)
        SELECT doc_id AS row_id, md5(string_agg(w, ' ' ORDER BY md5(concat_ws(':', 42, doc_id, i)), i)) AS text_md5 FROM w GROUP BY 1""",
)
def shuffle_words(spark, sf):
    return documents(spark, sf, "row_id", "text").select("row_id", F.md5(A.shuffle_words("text", 42, "row_id")).alias("text_md5"))


@register(
    "pseudo_label",
    f"""WITH {HEAD_SQL}
        SELECT vec_id AS row_id, label, FALSE AS pseudo FROM sample
        UNION ALL SELECT row_id, CAST(pred_label AS INTEGER), TRUE FROM preds""",
)
def pseudo_label(spark, sf):
    head, rest = head_and_rest(spark, sf)
    labelled = S.sample_per_class(vectors(spark, sf), n=8, seed=42).select("row_id", "label")
    return A.pseudo_label(labelled, M.predict(rest.select("row_id", "embedding"), head))


@register(
    "apply_pattern",
    """SELECT doc_id AS row_id, md5(text || ' this is ' || lang) AS prompt FROM documents""",
)
def apply_pattern(spark, sf):
    docs = documents(spark, sf).withColumnRenamed("text", "TEXT1")
    out = Q.apply_pattern(docs, Q.TASK_PATTERNS["single"], label="lang")
    return out.select("row_id", F.md5("prompt").alias("prompt"))


@register(
    "pair_pattern",
    """WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations)
       SELECT conv_id, turn, md5(text || ' and ' || next || ' imply [MASK]') AS prompt FROM p WHERE next IS NOT NULL""",
)
def pair_pattern(spark, sf):
    turns = table(spark, sf, "conversations")
    follow = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("TEXT2"))
    rows = turns.withColumnRenamed("text", "TEXT1").join(follow, ["conv_id", "turn"])
    return Q.masked_pattern(rows, Q.TASK_PATTERNS["pair"]).select("conv_id", "turn", F.md5("prompt").alias("prompt"))


@register(
    "pattern_label_grid",
    """SELECT doc_id AS row_id, lbl, md5(text || ' this is ' || name) AS prompt, quality = lbl AS is_true
       FROM documents JOIN labels USING (doc_id), (VALUES (0, 'bad'), (1, 'good')) AS v(lbl, name)""",
)
def pattern_label_grid(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("TEXT1"))
    rows = docs.join(table(spark, sf, "labels"), "doc_id").withColumnRenamed("doc_id", "row_id")
    grid = Q.pattern_label_grid(rows, Q.TASK_PATTERNS["single"], ["bad", "good"], label="quality")
    return grid.select("row_id", "lbl", F.md5("prompt").alias("prompt"), "is_true")


@register(
    "pattern_drawn_label",
    f"""WITH d AS (SELECT doc_id AS row_id, text, lang, ({number_sql(key_sql(4, 'doc_id'))} % 4)::INTEGER AS lbl FROM documents)
        SELECT row_id, lbl, md5(text || ' this is ' || ['de', 'en', 'es', 'fr'][lbl + 1]) AS prompt, ['de', 'en', 'es', 'fr'][lbl + 1] = lang AS is_true FROM d""",
)
def pattern_drawn_label(spark, sf):
    langs = ["de", "en", "es", "fr"]
    docs = documents(spark, sf).withColumnRenamed("text", "TEXT1")
    docs = docs.withColumn("label", F.array_position(F.array(*[F.lit(v) for v in langs]), F.col("lang")).cast("int") - 1)
    out = Q.pattern_drawn_label(docs, Q.TASK_PATTERNS["single"], langs, seed=4)
    return out.select("row_id", "lbl", F.md5("prompt").alias("prompt"), "is_true")


@register(
    "mirror_choices",
    """WITH c AS (SELECT event_id AS idx, event_type AS choice1, props AS choice2, CAST(value > 50 AS INTEGER) AS label FROM events)
       SELECT idx, choice1, choice2, label, FALSE AS mirrored FROM c
       UNION ALL SELECT idx, choice2, choice1, CASE WHEN label = 0 THEN 1 ELSE 0 END, TRUE FROM c""",
)
def mirror_choices(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("idx"),
        F.col("event_type").alias("choice1"),
        F.col("props").alias("choice2"),
        (F.col("value") > 50).cast("int").alias("label"),
    )
    return Q.mirror_choices(rows)


# --- columns ---------------------------------------------------------------------------


@register(
    "apply_column_mapping",
    "SELECT doc_id AS row_id, md5(text) AS text_md5, lang AS label, source AS feat_source, n_chars AS feat_n_chars FROM documents",
)
def apply_column_mapping(spark, sf):
    docs = documents(spark, sf).withColumnRenamed("text", "body")
    out = C.apply_column_mapping(docs, {"body": "text", "lang": "label"})
    return out.withColumn("text", F.md5("text")).withColumnRenamed("text", "text_md5")


@register(
    "label_names",
    """WITH names AS (SELECT n_nationkey AS id, n_name FROM nation WHERE n_nationkey < 20)
       SELECT c_custkey AS row_id, c_nationkey AS label, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS label_name
       FROM customer LEFT JOIN names ON id = c_nationkey""",
)
def label_names(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("label"))
    names = table(spark, sf, "nation").filter("n_nationkey < 20").select(
        F.col("n_nationkey").alias("label_id"), F.col("n_name").alias("label_name")
    )
    return C.label_names(rows, names).select("row_id", "label", "label_name")


@register(
    "relabel_stars",
    """WITH s AS (SELECT doc_id AS row_id, lang, CAST(n_chars % 5 AS INTEGER) AS stars FROM documents)
       SELECT row_id, stars, (stars + 1) || CASE lang WHEN 'de' THEN ' stern' WHEN 'fr' THEN ' étoile' WHEN 'es' THEN ' estrella' ELSE ' star' END
              || CASE WHEN stars = 0 THEN '' WHEN lang = 'de' THEN 'e' ELSE 's' END AS label_text FROM s""",
)
def relabel_stars(spark, sf):
    rows = documents(spark, sf).select("row_id", "lang", (F.col("n_chars") % 5).cast("int").alias("stars"))
    return rows.select("row_id", "stars", C.star_names("stars", "lang").alias("label_text"))


@register(
    "relabel_map",
    """SELECT event_id AS row_id, CASE event_type WHEN 'click' THEN 'a click' WHEN 'view' THEN 'a view' END AS label_text,
              replace(event_type || '_x', '_', ' ') AS spaced FROM events""",
)
def relabel_map(spark, sf):
    return events(spark, sf).select(
        "row_id",
        C.relabel("label", {"click": "a click", "view": "a view"}).alias("label_text"),
        C.spaced(F.concat("label", F.lit("_x"))).alias("spaced"),
    )


@register(
    "bucket_similarity",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_discount * 50, 0)::INTEGER AS sim_class FROM lineitem)
       SELECT sim_class, ['very different', 'different', 'dissimilar', 'somewhat similar', 'similar', 'very similar'][sim_class + 1] AS sim_name,
              count(*) AS n FROM s GROUP BY 1, 2""",
)
def bucket_similarity(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_discount") * 50).alias("label"))
    return C.bucket_similarity(rows).groupBy("sim_class", "sim_name").agg(F.count(F.lit(1)).alias("n"))


@register(
    "multi_hot",
    """WITH r AS (SELECT conv_id, string_agg(DISTINCT role, ',') AS roles FROM conversations GROUP BY 1)
       SELECT conv_id, CAST(contains(roles, 'assistant') AS INTEGER) || '' || CAST(contains(roles, 'system') AS INTEGER)
              || CAST(contains(roles, 'user') AS INTEGER) AS bits FROM r""",
)
def multi_hot(spark, sf):
    roles = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.array_join(F.array_sort(F.collect_set("role")), ",").alias("labels")
    )
    vector = C.multi_hot("labels", ["assistant", "system", "user"])
    return roles.select("conv_id", F.array_join(vector.cast("array<string>"), "").alias("bits"))


@register(
    "wide_to_vector",
    "SELECT doc_id AS row_id, quality || '' || toxic AS bits, 1 - quality || '' || quality AS one_hot FROM labels",
)
def wide_to_vector(spark, sf):
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("row_id"),
        F.array_join(C.wide_to_vector(["quality", "toxic"]).cast("array<string>"), "").alias("bits"),
        F.array_join(C.one_hot("quality", 2).cast("array<string>"), "").alias("one_hot"),
    )


@register(
    "encode_labels",
    f"""WITH {RULE_SQL}, c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (
            SELECT true_label AS label FROM rule UNION SELECT pred_label FROM rule))
        SELECT true_label, pred_label, t.code AS true_label_code, p.code AS pred_label_code, count(*) AS n
        FROM rule JOIN c t ON t.label = true_label JOIN c p ON p.label = pred_label GROUP BY ALL""",
)
def encode_labels(spark, sf):
    coded = C.encode_labels(rule_predictions(spark, sf).select("true_label", "pred_label"))
    return coded.groupBy("true_label", "pred_label", big("true_label_code").alias("true_label_code"), big("pred_label_code").alias("pred_label_code")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "slugify",
    "SELECT page_id, replace(replace(lower(url), '/', '-'), '_', '-') AS slug FROM pages",
)
def slugify(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.slugify("url").alias("slug"))


@register(
    "string_sorted",
    """SELECT label, row_number() OVER (ORDER BY CAST(label AS VARCHAR)) AS place
       FROM (SELECT DISTINCT c_nationkey AS label FROM customer)""",
)
def string_sorted(spark, sf):
    distinct = table(spark, sf, "customer").select(F.col("c_nationkey").alias("label")).distinct()
    ordered = C.string_sorted(distinct).withColumn("at", F.monotonically_increasing_id())
    return ordered.select("label", big(F.row_number().over(Window.orderBy("at"))).alias("place"))


@register(
    "preview",
    """SELECT string_agg(md5(text), ',' ORDER BY doc_id) AS texts FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 5)""",
)
def preview(spark, sf):
    first = C.preview(documents(spark, sf).withColumn("label", F.col("lang")))
    return first.select(F.array_join(F.transform("preview", lambda r: F.md5(r["text"])), ",").alias("texts"))


@register(
    "union_and_distinct",
    """SELECT DISTINCT * FROM (SELECT lang AS label, n_chars % 10 AS bucket FROM documents
       UNION ALL SELECT role, length(text) % 10 FROM conversations)""",
)
def union_and_distinct(spark, sf):
    one = documents(spark, sf).select(F.col("lang").alias("label"), (F.col("n_chars") % 10).alias("bucket"))
    two = table(spark, sf, "conversations").select(F.col("role").alias("label"), big(F.length("text") % 10).alias("bucket"))
    return one.unionByName(two).dropDuplicates()


@register(
    "label_set_operations",
    """WITH s AS (SELECT user_id, list(DISTINCT event_type) FILTER (value > 50) AS a, list(DISTINCT event_type) FILTER (value <= 50) AS b FROM events GROUP BY 1)
       SELECT user_id, coalesce(list_aggregate(list_sort(list_intersect(a, b)), 'string_agg', ','), '') AS both_sets,
              coalesce(list_aggregate(list_sort(list_filter(a, lambda x: NOT list_contains(coalesce(b, []), x))), 'string_agg', ','), '') AS only_high FROM s""",
)
def label_set_operations(spark, sf):
    high = F.collect_set(F.when(F.col("value") > 50, F.col("event_type")))
    low = F.collect_set(F.when(F.col("value") <= 50, F.col("event_type")))
    sets = table(spark, sf, "events").groupBy("user_id").agg(high.alias("a"), low.alias("b"))
    return sets.select(
        "user_id",
        F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("both_sets"),
        F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("only_high"),
    )
