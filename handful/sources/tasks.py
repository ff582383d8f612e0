"""Task readers: sentence tasks, nested questions, entity questions, marked mentions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from handful.functions.cells import lookup
from handful.functions.order import draw_key

# Input fields of the sentence tasks and the numbers of their labels.
SENTENCE_TASKS = {
    "yes_no_question": (["question", "passage", "idx"], {"true": 0, "false": 1}),
    "commitment": (["premise", "hypothesis", "idx"], {"entailment": 0, "neutral": 1, "contradiction": 2}),
    "entailment": (["premise", "hypothesis", "idx"], {"entailment": 0, "not_entailment": 1}),
    "word_sense": (["idx", "word", "sentence1", "sentence2"], {"true": 0, "false": 1}),
    "choice": (["premise", "choice1", "choice2", "question", "idx"], None),
}
# The slot an entity question leaves open and the mask put there.
PLACEHOLDER, MASK = "@placeholder", "[MASK]"


def read_sentence_tasks(df: DataFrame, kind: str, fields: Mapping[str, str] | None = None) -> DataFrame:
    """Input fields of a task and ``lbl``, -1 where there is no label.

    ``fields`` maps input fields to column names that differ.  A label outside the task's
    set stops the job.
    """
    names, numbers = SENTENCE_TASKS[kind]
    fields = fields or {}
    inputs = [F.col(fields.get(n, n)).alias(n) for n in names]
    source = fields.get("label", "label")
    if source not in df.columns:
        return df.select(*inputs, F.lit(-1).alias("lbl"))
    label = F.col(source)
    if numbers is None:
        return df.select(*inputs, F.coalesce(label.cast("int"), F.lit(-1)).alias("lbl"))
    number = lookup(numbers, label.cast("string"))
    unknown = F.raise_error(F.concat(F.lit("unknown label "), label.cast("string"))).cast("int")
    return df.select(*inputs, F.when(label.isNull(), -1).when(number.isNull(), unknown).otherwise(number).alias("lbl"))


def flatten_qa(df: DataFrame) -> DataFrame:
    """One row per answer of passage STRUCT<text, questions ARRAY<STRUCT<question, idx, answers>>>; label -1 if absent."""
    questions = df.select(F.col("idx").alias("passage_idx"), F.col("passage.text").alias("passage"), F.explode("passage.questions").alias("q"))
    answers = questions.select(
        "passage_idx", "passage", F.col("q.idx").alias("idx"), F.col("q.question").alias("question"),
        F.posexplode("q.answers").alias("answer_pos", "a"),
    )
    return answers.select(
        "passage_idx", "idx", "passage", "question", "answer_pos",
        F.col("a.text").cast("string").alias("answer"), F.coalesce("a.label", F.lit(-1)).alias("lbl"),
    )


def renest_qa(preds: DataFrame) -> DataFrame:
    """(idx, passage): flat answer predictions (passage_idx, question_idx, answer_idx, label) nested again."""
    answers = preds.groupBy("passage_idx", "question_idx").agg(
        F.array_sort(F.collect_list(F.struct(F.col("answer_idx").alias("idx"), "label"))).alias("answers")
    )
    nested = answers.groupBy("passage_idx").agg(
        F.array_sort(F.collect_list(F.struct(F.col("question_idx").alias("idx"), "answers"))).alias("questions")
    )
    return nested.select(F.col("passage_idx").alias("idx"), F.struct("questions").alias("passage"))


def _same_place(e: Column, a: Column) -> Column:
    return (e["start"] == a["start"]) & (e["end"] == a["end"])


def entity_candidates(df: DataFrame, mode: str, k: int = 10, seed: int = 42) -> DataFrame:
    """Entity questions, one row per question or (training) per distinct right entity.

    ``df`` is (idx, passage STRUCT<text, entities ARRAY<STRUCT<start, end>>>, qas ARRAY<STRUCT<query,
    idx, answers ARRAY<STRUCT<start, end, text>>>>>), ends inclusive.  'train' gives ``true_entity``
    with at most k - 1 drawn ``false_entities``; 'eval' gives ``candidate_entity`` with a 0/1 label
    each, and NULL labels for a question without answers.
    """
    named = F.transform(
        F.array_distinct(F.transform("passage.entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end")))),
        lambda e: F.named_struct(
            F.lit("start"), e["start"],
            F.lit("end"), e["end"],
            F.lit("name"), F.substr(F.col("passage.text"), e["start"] + 1, e["end"] - e["start"] + 1),
        ),
    )
    asked = df.select("idx", F.col("passage.text").alias("text"), named.alias("named"), F.explode("qas").alias("qa")).select(
        "idx",
        F.col("text").alias("passage"),
        F.col("qa.idx").alias("qas_idx"),
        F.replace(F.col("qa.query"), F.lit(PLACEHOLDER), F.lit(MASK)).alias("question"),
        "named",
        F.col("qa.answers").alias("answers"),
    )
    if mode == "eval":
        names = F.array_distinct(F.transform("named", lambda e: e["name"]))
        right = F.transform("answers", lambda a: a["text"])
        return asked.withColumn("candidate_entity", names).withColumn(
            "lbl",
            F.when(
                F.col("answers").isNotNull(),
                F.transform("candidate_entity", lambda n: F.array_contains(right, n).cast("int")),
            ),
        ).drop("named", "answers")
    if mode != "train":
        raise ValueError("mode is 'train' or 'eval'")

    def is_answer(e: Column) -> Column:
        return F.exists("answers", lambda a: _same_place(e, a))

    split = asked.filter(F.col("answers").isNotNull()).select(
        "*",
        F.array_distinct(F.transform(F.filter("named", is_answer), lambda e: e["name"])).alias("_right"),
        F.array_distinct(F.transform(F.filter("named", lambda e: ~is_answer(e)), lambda e: e["name"])).alias("_wrong"),
    )
    rows = split.select("idx", "qas_idx", "passage", "question", F.explode("_right").alias("true_entity"), "_wrong")
    keyed = F.transform(
        "_wrong",
        lambda n: F.struct(draw_key(seed, F.col("idx"), F.col("qas_idx"), F.col("true_entity"), n).alias("k"), n.alias("n")),
    )
    drawn = F.transform(F.slice(F.array_sort(keyed), 1, max(k - 1, 0)), lambda s: s["n"])
    return rows.select(
        "idx", "qas_idx", "passage", "question", "true_entity", drawn.alias("false_entities"), F.lit(0).alias("lbl")
    )


def mark_mention(df: DataFrame, split: str = "train") -> DataFrame:
    """Put stars around the pronoun of a sentence.

    ``df`` is (idx, text, noun, noun_idx, pronoun, pronoun_idx, label).  Where the stated
    word index misses the noun or pronoun, the words before and after are tried; a pronoun
    with a suffix is cut off from it.  Rows whose pronoun is not found get ``problem`` and
    no text.  The training split keeps only true rows.
    """
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = df.withColumn("_words", words)
    rows = rows.withColumn("_lower", F.transform("_words", lambda w: F.lower(w)))
    rows = rows.withColumn("_noun", F.filter(F.split(F.lower("noun"), r"\s+"), lambda w: w != ""))
    size = F.size("_noun")

    def noun_at(offset: int) -> Column:
        place = F.col("noun_idx") + offset
        return (place >= 0) & (F.slice("_lower", F.greatest(place, F.lit(0)) + 1, F.greatest(size, F.lit(0))) == F.col("_noun"))

    def word_at(offset: int) -> Column:
        return F.coalesce(F.get("_words", F.col("pronoun_idx") + offset) == F.col("pronoun"), F.lit(False))

    def probe(index: str, test) -> Column:
        return (
            F.when(test(0), F.col(index)).when(test(-1), F.col(index) - 1).when(test(1), F.col(index) + 1).otherwise(F.col(index))
        )

    rows = rows.withColumn("_noun_at", probe("noun_idx", noun_at)).withColumn("_at", probe("pronoun_idx", word_at))
    word = F.get("_words", F.col("_at"))
    rows = rows.withColumn("_word", word)
    exact = F.col("_word") == F.col("pronoun")
    cut = F.col("_word").startswith(F.col("pronoun")) & ~exact
    before = F.slice("_words", F.lit(1), F.col("_at"))
    after = F.slice("_words", F.col("_at") + 2, F.size("_words"))
    rest = F.when(cut, F.array(F.substr("_word", F.length("pronoun") + 1))).otherwise(F.array().cast("array<string>"))
    found = F.coalesce(exact | cut, F.lit(False))

    def text_with(mention: Column) -> Column:
        return F.when(found, F.array_join(F.concat(before, F.array(mention), rest, after), " "))

    lbl = F.coalesce(F.col("label").cast("int"), F.lit(-1)) if "label" in df.columns else F.lit(-1)
    out = rows.select(
        "idx",
        text_with(F.concat(F.lit("*"), F.col("pronoun"), F.lit("*"))).alias("text"),
        text_with(F.col("pronoun")).alias("orig_text"),
        "pronoun",
        "noun",
        (F.col("_at") < F.col("_noun_at")).alias("pronoun_idx_first"),
        lbl.alias("lbl"),
        F.when(~found, F.concat(F.lit("pronoun not at word "), F.col("pronoun_idx").cast("string"))).alias("problem"),
    )
    return out.filter("lbl = 1") if split == "train" else out
