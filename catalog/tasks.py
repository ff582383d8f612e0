"""Task readers and writers, over rows derived from documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from catalog.base import big, register, table
from handful.session import shared_path
from handful.sources import tables as T, tasks as Q


@register(
    "load_split",
    "SELECT lang, count(*) AS n FROM documents GROUP BY 1",
)
def load_split(spark, sf):
    rows = T.load_split(spark, sf, ["docs", "texts", "documents"], layout="{root}/{name}.parquet")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@register(
    "load_multilabel_split",
    "SELECT doc_id, quality || '' || toxic AS bits FROM labels",
)
def load_multilabel_split(spark, sf):
    rows = T.load_multilabel_split(spark, sf, "labels", keep=["doc_id"], layout="{root}/{name}.parquet")
    return rows.select("doc_id", F.array_join(F.col("label").cast("array<string>"), "").alias("bits"))


@register(
    "task_jsonl",
    """SELECT md5(text) AS text_md5, role AS label_text, CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 END AS lbl,
              CASE WHEN role = 'system' THEN 'unknown label system' END AS problem, count(*) AS n FROM conversations GROUP BY ALL""",
)
def task_jsonl(spark, sf):
    """Conversation turns written as task lines and read back, unknown labels set apart."""
    path = shared_path(spark, "task")
    T.write_task_jsonl(table(spark, sf, "conversations"), path, label="role")
    rows = T.read_prompt_jsonl(spark, path, 1, ["assistant", "user"], bad_rows="keep")
    return rows.groupBy(F.md5("TEXT1").alias("text_md5"), "label_text", "lbl", "problem").agg(F.count(F.lit(1)).alias("n"))


@register(
    "task_jsonl_pairs",
    """SELECT md5(a.text) AS md5_1, md5(b.text) AS md5_2, CAST(a.turn % 2 AS INTEGER) AS lbl, count(*) AS n
       FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 GROUP BY ALL""",
)
def task_jsonl_pairs(spark, sf):
    turns = table(spark, sf, "conversations")
    follow = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text2"))
    path = shared_path(spark, "task-pairs")
    pairs = turns.join(follow, ["conv_id", "turn"]).select(F.col("text").alias("text1"), "text2", (F.col("turn") % 2).alias("label"))
    T.write_task_jsonl(pairs, path, pair=True)
    rows = T.read_prompt_jsonl(spark, path, 2, ["0", "1"])
    return rows.groupBy(F.md5("TEXT1").alias("md5_1"), F.md5("TEXT2").alias("md5_2"), "lbl").agg(F.count(F.lit(1)).alias("n"))


@register(
    "tsv_to_task",
    """SELECT 'event ' || event_id AS "TEXT1", event_type AS "LBL" FROM events ORDER BY event_id LIMIT 32""",
)
def tsv_to_task(spark, sf):
    """The events written as tab-separated text, of which the first 32 lines are taken."""
    path = shared_path(spark, "tsv")
    rows = table(spark, sf, "events").select(F.format_string("event %d", "event_id").alias("sentence"), "event_type", "event_id")
    ordered = rows.orderBy("event_id").drop("event_id")
    ordered.write.option("sep", "\t").option("header", True).csv(path)
    return T.tsv_to_task(spark, path, 32)


@register(
    "read_sentence_tasks",
    """SELECT doc_id AS idx, md5(text) AS passage_md5, lang AS question,
              CASE quality WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE -1 END AS lbl FROM documents LEFT JOIN labels USING (doc_id)""",
)
def read_sentence_tasks(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    rows = rows.withColumn("label", F.col("quality") == 1)
    tasks = Q.read_sentence_tasks(rows, "yes_no_question", {"idx": "doc_id", "passage": "text", "question": "lang"})
    return tasks.select("idx", F.md5("passage").alias("passage_md5"), "question", "lbl")


@register(
    "read_entailment_tasks",
    """SELECT conv_id, turn, md5(text) AS premise_md5, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE -1 END AS lbl FROM conversations""",
)
def read_entailment_tasks(spark, sf):
    label = F.when(F.col("role") == "user", "entailment").when(F.col("role") == "assistant", "not_entailment")
    rows = table(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("idx"), F.col("text").alias("premise"), F.col("role").alias("hypothesis"), label.alias("label")
    )
    out = Q.read_sentence_tasks(rows, "entailment")
    part = F.split("idx", ":")
    return out.select(part[0].cast("bigint").alias("conv_id"), part[1].cast("bigint").alias("turn"), F.md5("premise").alias("premise_md5"), "lbl")


def _nested(spark, sf):
    """Conversations as passages: a question per role, its turns as answers, every third turn unlabelled."""
    turns = table(spark, sf, "conversations").withColumn(
        "label", F.when(F.col("turn") % 3 != 0, (F.length("text") % 2).cast("int"))
    )
    answers = turns.groupBy("conv_id", "role").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "text", "label"))),
            lambda a: F.struct(a["text"].alias("text"), a["label"].alias("label")),
        ).alias("answers")
    )
    question = F.struct(F.col("role").alias("question"), F.length("role").alias("idx"), "answers")
    nested = answers.groupBy("conv_id").agg(F.collect_list(question).alias("questions"))
    return nested.select(
        F.col("conv_id").alias("idx"),
        F.struct(F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("text"), "questions").alias("passage"),
    )


@register(
    "flatten_qa",
    """SELECT conv_id AS passage_idx, length(role)::INTEGER AS idx, role AS question, 'conversation ' || conv_id AS passage, md5(text) AS answer_md5,
              CASE WHEN turn % 3 <> 0 THEN (length(text) % 2)::INTEGER ELSE -1 END AS lbl,
              row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS answer_pos FROM conversations""",
)
def flatten_qa(spark, sf):
    flat = Q.flatten_qa(_nested(spark, sf))
    return flat.select(
        "passage_idx", "idx", "question", "passage", F.md5("answer").alias("answer_md5"), "lbl", big("answer_pos").alias("answer_pos")
    )


@register(
    "renest_qa",
    """WITH q AS (SELECT conv_id, length(role) AS qi, '{"idx":' || length(role) || ',"answers":[' ||
                         string_agg('{"idx":' || turn || ',"label":' || (length(text) % 2) || '}', ',' ORDER BY turn) || ']}' AS j
                  FROM conversations GROUP BY conv_id, role)
       SELECT conv_id AS idx, '{"questions":[' || string_agg(j, ',' ORDER BY qi) || ']}' AS passage FROM q GROUP BY 1""",
)
def renest_qa(spark, sf):
    preds = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("passage_idx"),
        F.length("role").alias("question_idx"),
        F.col("turn").alias("answer_idx"),
        (F.length("text") % 2).alias("label"),
    )
    return Q.renest_qa(preds).select("idx", F.to_json("passage").alias("passage"))


# Entities are the blank-separated words of a text of at least nine chars.
_WORDS = """w AS (SELECT {id} AS id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM {t}),
    placed AS (SELECT id, w, i, (coalesce(sum(length(w) + 1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS s FROM w)"""
_ENT = _WORDS.format(id="item_id", t="benchmark") + """,
    ents AS (SELECT id, w, s FROM placed WHERE length(w) >= 9)"""


def _entities(spark, sf):
    rows = table(spark, sf, "benchmark")
    words = rows.select("item_id", "text", F.posexplode(F.split("text", " ")).alias("i", "w"))
    before = Window.partitionBy("item_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = words.withColumn("s", F.coalesce(F.sum(F.length("w") + 1).over(before), F.lit(0)).cast("int")).filter(F.length("w") >= 9)
    span = F.struct(F.col("s").alias("start"), (F.col("s") + F.length("w") - 1).alias("end"), F.col("w").alias("text"))
    grouped = placed.groupBy("item_id", "text").agg(F.array_sort(F.collect_list(span)).alias("all"))
    right = F.filter("all", lambda e: e["start"] % 3 == 0)
    none = F.lit(None).cast("array<struct<start:int,end:int,text:string>>")
    return grouped.select(
        F.col("item_id").alias("idx"),
        F.struct("text", F.transform("all", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))).alias("entities")).alias("passage"),
        F.array(
            F.struct(
                F.lit("who is @placeholder").alias("query"), F.col("item_id").alias("idx"),
                F.when(F.col("item_id") % 4 != 0, right).otherwise(none).alias("answers"),
            )
        ).alias("qas"),
    )


@register(
    "entity_candidates_eval",
    f"""WITH {_ENT}, c AS (SELECT id, w, max(CAST(s % 3 = 0 AS INTEGER)) AS hit FROM ents GROUP BY 1, 2)
        SELECT id AS idx, 'who is [MASK]' AS question, w AS entity, CASE WHEN id % 4 <> 0 THEN hit END AS lbl FROM c""",
)
def entity_candidates_eval(spark, sf):
    rows = Q.entity_candidates(_entities(spark, sf), "eval")
    missing = F.transform("candidate_entity", lambda _: F.lit(None).cast("int"))
    both = F.arrays_zip(F.col("candidate_entity").alias("e"), F.coalesce("lbl", missing).alias("l"))
    return rows.select("idx", "question", F.inline(both).alias("entity", "lbl"))


@register(
    "entity_candidates_train",
    f"""WITH {_ENT}, c AS (SELECT id, w, bool_or(s % 3 = 0) AS hit, bool_or(s % 3 <> 0) AS miss FROM ents WHERE id % 4 <> 0 GROUP BY 1, 2),
        p AS (SELECT t.id, t.w AS true_entity, f.w AS false_entity, row_number() OVER (PARTITION BY t.id, t.w
                     ORDER BY md5(concat_ws(':', 42, t.id, t.id, t.w, f.w)), f.w) AS rn
              FROM c t LEFT JOIN c f ON t.id = f.id AND f.miss WHERE t.hit)
        SELECT id AS idx, true_entity, coalesce(string_agg(false_entity, ',' ORDER BY rn), '') AS false_entities FROM p WHERE rn <= 4 GROUP BY 1, 2""",
)
def entity_candidates_train(spark, sf):
    rows = Q.entity_candidates(_entities(spark, sf), "train", k=5)
    return rows.select("idx", "true_entity", F.array_join("false_entities", ",").alias("false_entities"))


def _mentions(spark, sf):
    """A word of every turn as pronoun, its stated place one off for two of three turns, cut short for one of five."""
    turns = table(spark, sf, "conversations").withColumn("words", F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    turns = turns.withColumn("n", F.size("words"))
    at = (F.col("conv_id") % F.col("n")).cast("int")
    word = F.get("words", at)
    short = F.when((F.col("conv_id") % 5 == 0) & (F.length(word) > 2), F.substr(word, F.lit(1), F.lit(2))).otherwise(word)
    return turns.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("idx"),
        "text",
        F.get("words", F.lit(0)).alias("noun"),
        (F.col("turn") % 2).cast("int").alias("noun_idx"),
        short.alias("pronoun"),
        F.when(F.col("conv_id") % 5 == 0, at).otherwise(at + (F.col("turn") % 3).cast("int") - 1).alias("pronoun_idx"),
        (F.length("text") % 2 == 0).alias("label"),
        at.alias("true_at"),
    )


_MENTION = """t AS (SELECT conv_id * 100 + turn AS idx, conv_id, turn, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM conversations),
    m AS (SELECT *, (conv_id % len(ws))::INTEGER AS spot, ws[(conv_id % len(ws)) + 1] AS word FROM t),
    p AS (SELECT *, CASE WHEN conv_id % 5 = 0 AND length(word) > 2 THEN substr(word, 1, 2) ELSE word END AS pronoun,
                 CASE WHEN conv_id % 5 = 0 THEN spot ELSE spot + (turn % 3)::INTEGER - 1 END AS said FROM m),
    f AS (SELECT *, CASE WHEN said >= 0 AND ws[said + 1] = pronoun THEN said WHEN said >= 1 AND ws[said] = pronoun THEN said - 1
                         WHEN said >= -1 AND ws[said + 2] = pronoun THEN said + 1 ELSE said END AS place FROM p),
    g AS (SELECT *, ws[place + 1] AS here, CASE WHEN lower(ws[(turn % 2) + 1]) = lower(ws[1]) THEN turn % 2 WHEN turn % 2 = 1 THEN 0 ELSE 0 END AS noun_at FROM f)"""


@register(
    "mark_mention",
    f"""WITH {_MENTION}
        SELECT idx, md5(list_aggregate(list_concat(ws[1:place], ['*' || pronoun || '*'],
                    CASE WHEN here <> pronoun THEN [substr(here, length(pronoun) + 1)] ELSE [] END, ws[place + 2:]), 'string_agg', ' ')) AS text_md5,
               pronoun, place < noun_at AS pronoun_idx_first, CAST(length(text) % 2 = 0 AS INTEGER) AS lbl
        FROM g WHERE here = pronoun OR starts_with(here, pronoun)""",
)
def mark_mention(spark, sf):
    marked = Q.mark_mention(_mentions(spark, sf), split="dev").filter("problem is null")
    return marked.select("idx", F.md5("text").alias("text_md5"), "pronoun", "pronoun_idx_first", "lbl")
