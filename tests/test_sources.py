import json

import pytest
from pyspark.sql import functions as F

from handful.session import shared_folder, shared_path
from handful.sources import tables as T, tasks as Q
from tests.conftest import rows


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
    assert shared_path(spark, "x") != shared_path(spark, "x")


def test_load_split(spark, tmp_path):
    df = spark.createDataFrame([(1, "t", 0, 1)], "row_id long, text string, one int, two int")
    df.write.parquet(str(tmp_path / "trec" / "train"))
    assert T.load_split(spark, str(tmp_path), "trec").count() == 1
    assert T.load_multilabel_split(spark, str(tmp_path), "trec").first()["label"] == [0, 1]
    with pytest.raises(RuntimeError, match="No readable split"):
        T.load_split(spark, str(tmp_path), "sst2")


def write(path, lines):
    path.write_text("".join(json.dumps(line) + "\n" for line in lines))
    return str(path)


def test_prompt_lines(spark, tmp_path):
    good = [{"TEXT1": "a", "TEXT2": "b", "LBL": "yes"}, {"TEXT1": "c", "TEXT2": "d", "LBL": "no"}]
    path = write(tmp_path / "good.jsonl", good)
    assert rows(T.read_prompt_jsonl(spark, path, 2, ["no", "yes"]), "TEXT1", "TEXT2", "lbl") == [("a", "b", 1), ("c", "d", 0)]
    bad = write(tmp_path / "bad.jsonl", good + [{"TEXT1": "e", "TEXT2": "f"}, {"TEXT1": "g", "TEXT2": "h", "LBL": "what"}])
    kept = T.read_prompt_jsonl(spark, bad, 2, ["no", "yes"], bad_rows="keep")
    assert [r["problem"] for r in kept.filter("problem is not null").orderBy("TEXT1").collect()] == ["no label", "unknown label what"]
    with pytest.raises(Exception, match="no label|unknown label"):
        T.read_prompt_jsonl(spark, bad, 2, ["no", "yes"]).collect()


def test_task_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('say "ü"', 3), ("two", None)], "text string, label int")
    path = str(tmp_path / "out")
    T.write_task_jsonl(df, path)
    lines = sorted(r[0] for r in spark.read.text(path).collect())
    assert [json.loads(x) for x in lines] == [{"TEXT1": 'say "ü"', "LBL": "3"}, {"TEXT1": "two", "LBL": None}]


def test_tsv(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text('sentence\tlabel\none "q\t1\ntwo\t0\nthree\t1\n')
    assert rows(T.tsv_to_task(spark, str(path), 2)) == [('one "q', "1"), ("two", "0")]


def test_sentence_tasks(spark):
    df = spark.createDataFrame([("q", "p", 1, True), ("q", "p", 2, False), ("q", "p", 3, None)], "question string, passage string, idx int, label boolean")
    assert [r["lbl"] for r in Q.read_sentence_tasks(df, "yes_no_question").orderBy("idx").collect()] == [0, 1, -1]
    assert Q.read_sentence_tasks(df.drop("label"), "yes_no_question").filter("lbl = -1").count() == 3
    odd = spark.createDataFrame([("p", "h", 1, "maybe")], "premise string, hypothesis string, idx int, label string")
    with pytest.raises(Exception, match="unknown label maybe"):
        Q.read_sentence_tasks(odd, "entailment").collect()


def test_nested_questions(spark):
    schema = (
        "idx int, passage struct<text string, questions array<struct<question string, idx int, "
        "answers array<struct<text string, label int>>>>>"
    )
    data = [(0, ("p", [("q0", 0, [("a", 1), ("b", 0)]), ("q1", 1, [("c", None), ("d", 1), ("e", 0)])]))]
    flat = Q.flatten_qa(spark.createDataFrame(data, schema))
    assert [r["lbl"] for r in flat.orderBy("idx", "answer_pos").collect()] == [1, 0, -1, 1, 0]
    preds = flat.select("passage_idx", F.col("idx").alias("question_idx"), (F.col("answer_pos") + F.col("idx") * 2).alias("answer_idx"), F.lit(1).alias("label"))
    nested = Q.renest_qa(preds).first()
    assert [(q["idx"], len(q["answers"])) for q in nested["passage"]["questions"]] == [(0, 2), (1, 3)]


def test_entities(spark):
    schema = (
        "idx int, passage struct<text string, entities array<struct<start int, end int>>>, "
        "qas array<struct<query string, idx int, answers array<struct<start int, end int, text string>>>>"
    )
    text = "Ann met Bob and Ann left Cy"
    entities = [(0, 2), (8, 10), (16, 18), (25, 26)]
    qas = [("@placeholder left", 5, [(16, 18, "Ann")]), ("who is @placeholder", 6, None)]
    df = spark.createDataFrame([(1, (text, entities), qas)], schema)
    train = Q.entity_candidates(df, "train", k=3).collect()
    assert len(train) == 1 and train[0]["true_entity"] == "Ann" and train[0]["question"] == "[MASK] left"
    assert len(train[0]["false_entities"]) == 2 and set(train[0]["false_entities"]) <= {"Ann", "Bob", "Cy"}
    judged = {r["qas_idx"]: r for r in Q.entity_candidates(df, "eval").collect()}
    assert judged[5]["candidate_entity"] == ["Ann", "Bob", "Cy"] and judged[5]["lbl"] == [1, 0, 0]
    assert judged[6]["lbl"] is None


def test_mentions(spark):
    text = "The cup fell since it's old and the cup broke"
    data = [
        (1, text, "the cup", 0, "it", 4, True),  # suffix cut off
        (2, text, "The cup", 1, "since", 4, True),  # both one word off
        (3, text, "cup", 1, "nothing", 2, True),  # not found
        (4, text, "cup", 1, "fell", 2, False),  # not true: left out of training
        (5, "It works", "works", 1, "It", 0, True),  # first word
    ]
    df = spark.createDataFrame(data, "idx int, text string, noun string, noun_idx int, pronoun string, pronoun_idx int, label boolean")
    out = {r["idx"]: r for r in Q.mark_mention(df, "train").collect()}
    assert sorted(out) == [1, 2, 3, 5]
    assert out[1]["text"] == "The cup fell since *it* 's old and the cup broke" and not out[1]["pronoun_idx_first"]
    assert out[2]["text"].startswith("The cup fell *since* it's")
    assert out[3]["text"] is None and out[3]["problem"] == "pronoun not at word 2"
    assert out[5]["text"] == "*It* works" and out[5]["pronoun_idx_first"]
    assert Q.mark_mention(df, "dev").count() == 5
