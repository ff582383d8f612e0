import pytest
from pyspark.sql import functions as F

from handful.operators import spans as P
from tests.conftest import rows

NOUNS = {"food", "ambiance", "service", "bagels", "cream", "cheese", "staff", "kitchen", "menu"}


def tagger():
    def run(text):
        at = 0
        for word in text.split():
            begin = text.index(word, at)
            yield word, "NOUN" if word.lower() in NOUNS else "X", begin, begin + len(word)
            at = begin + len(word)

    return run


def docs_of(spark, *texts):
    return P.tag_tokens(spark.createDataFrame([(t,) for t in texts], "text string"), tagger)


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, "The food and cream cheese were great .", "Nothing here .", "bagels").cache()


def test_extraction(docs):
    got = {r["text"]: [tuple(s) for s in r["aspects"]] for r in P.extract_aspects(docs).collect()}
    assert got == {"The food and cream cheese were great .": [(1, 2), (3, 5)], "Nothing here .": [], "bagels": [(0, 1)]}


@pytest.mark.parametrize("flags,want", [([], []), ([True], [(0, 1)]), ([True, True, False, True], [(0, 2), (3, 4)]), ([False, None, True], [(2, 3)])])
def test_runs(spark, flags, want):
    df = spark.createDataFrame([(flags,)], "f array<boolean>")
    assert [tuple(s) for s in df.select(P.runs_of_true("f")).first()[0]] == want
    long = spark.createDataFrame([(1, i, bool(f)) for i, f in enumerate(flags)] or [(1, 0, False)], "g int, i int, f boolean")
    assert rows(P.runs_of_true_rows(long, ["g"], "i", "f"), "start", "stop") == want


def test_inputs_with_context(docs):
    spans = P.explode_aspects(docs, ["text"])
    near = {r["input"].split(":")[0] for r in P.prepend_span(spans, 0).collect()}
    wide = {r["input"].split(":")[0] for r in P.prepend_span(spans, 3).collect()}
    assert near == {"food", "cream cheese", "bagels"}
    assert wide == {"The food and cream cheese", "The food and cream cheese were great .", "bagels"}


def test_training_sets(spark, docs):
    text = "The food and cream cheese were great ."
    df = spark.createDataFrame([(text, "food", "positive", 0)], "text string, span string, label string, ordinal int")
    aspect, polarity = P.span_training_sets(df, docs)
    assert rows(aspect, "input", "label") == [("cream cheese:" + text, False), ("food:" + text, True)]
    assert rows(polarity, "input", "label") == [("The food and cream cheese:" + text, "positive")]


def test_too_high_ordinal_keeps_the_candidates(spark):
    text = "The food , service and ambiance were great ."
    docs = docs_of(spark, text)
    df = spark.createDataFrame([(text, "food", "positive", 1)], "text string, span string, label string, ordinal int")
    aspect, polarity = P.span_training_sets(df, docs)
    assert [r["label"] for r in aspect.collect()] == [False] * 3 and polarity.count() == 0


def test_touching_spans_overlap(spark):
    c = spark.createDataFrame([("t", (0, 2)), ("t", (5, 6)), ("u", (0, 1))], "text string, span struct<start:int,stop:int>")
    g = spark.createDataFrame([("t", (2, 4))], "text string, gold struct<start:int,stop:int>")
    assert rows(P.non_overlapping(c, g)) == [("t", (5, 6)), ("u", (0, 1))]


def polarity(df):
    return df.withColumn("pred_label", F.when(F.col("input").contains("great"), "positive").otherwise("neutral"))


def test_prediction(docs):
    def aspect(df):
        return df.withColumn("pred_label", F.when(F.col("input").startswith("food"), "no aspect").otherwise("aspect"))

    got = {r["text"]: [tuple(s) for s in r["spans"]] for r in P.predict_spans(docs, aspect, polarity, key="text").collect()}
    assert got == {"The food and cream cheese were great .": [("cream cheese", "positive")], "Nothing here .": [], "bagels": [("bagels", "neutral")]}


def test_gold_polarity_stays_with_its_row(spark):
    first, second = "The staff was great .", "The kitchen closed ."
    docs = docs_of(spark, first, second)
    data = [(1, first, "staff", 0), (2, second, "kitchen", 0), (3, first, "staff", 1), (4, first, "staf", 0), (5, first, "great", 0)]
    df = spark.createDataFrame(data, "row_id int, text string, span string, ordinal int")
    got = dict(rows(P.predict_gold_polarity(df, docs, polarity), "row_id", "pred_polarity"))
    assert got == {1: "positive", 2: "neutral", 3: None, 4: None, 5: "positive"}
    assert P.predict_gold_polarity(df.drop("ordinal"), docs, polarity).count() == 5


def test_evaluate(spark):
    a = spark.createDataFrame([("aspect", "aspect"), ("no aspect", "aspect")], "true_label string, pred_label string")
    assert dict(rows(P.span_evaluate(a, a.limit(1)))) == {"aspect": 0.5, "polarity": 1.0}


class Word(str):
    """A token that counts how many of its kind are alive."""

    live = 0

    def __new__(cls, value):
        Word.live += 1
        return super().__new__(cls, value)

    def __del__(self):
        Word.live -= 1


def counting_tagger():
    def run(text):
        yield Word("w"), "X", Word.live, len(text or "")

    return run


def test_tokens_of_few_texts_are_held_at_once(spark):
    """Long texts of one batch are tagged in pieces; all of them come back in their order."""
    texts = [(i, "a" * (600_000 + i) if i % 5 else None) for i in range(20)]
    df = spark.createDataFrame(texts, "id int, text string").coalesce(1)
    got = {r["id"]: r["tokens"][0] for r in P.tag_tokens(df, counting_tagger).select("id", "tokens").collect()}
    assert [got[i]["end"] for i in range(20)] == [len(t or "") for _, t in texts]
    assert max(t["start"] for t in got.values()) <= 4
    assert P.tag_tokens(df.limit(0), counting_tagger).count() == 0


def packed_docs(spark, *texts):
    return P.tag_tokens(spark.createDataFrame([(t,) for t in texts], "text string"), tagger, packed=True)


def test_packed_tokens_come_back():
    tags, starts, ends = ["NOUN", None, "X", "NOUN"], [0, 5, 4, 70_000], [4, 9, 9, 140_003]
    own_starts, own_ends, numbers, names = P.unpack(P.pack(tags, starts, ends))
    assert own_starts.tolist() == starts and own_ends.tolist() == ends and [names[k] for k in numbers] == tags
    assert [x.tolist() if hasattr(x, "tolist") else x for x in P.unpack(P.pack([], [], []))] == [[], [], [], []]
    many = [7 * k for k in range(2000)]
    assert len(P.pack(["X"] * 2000, many, [k + 6 for k in many])) < 2000


def test_packed_tokens_give_the_same_spans(spark):
    """Tokens as arrays, packed later, and packed by the tagger agree in every operator."""
    texts = ["The food and cream cheese were great .", "Nothing here .", "bagels", "", "Ärger über kitchen staff é food", "food food food"]
    made = [docs_of(spark, *texts), P.pack_tokens(docs_of(spark, *texts)), packed_docs(spark, *texts)]
    asked = [(i, t, w, o, "l") for i, t in enumerate(texts) for w in ("food", "staff é", "bage") for o in (0, 1)]
    df = spark.createDataFrame(asked, "row_id int, text string, span string, ordinal int, label string")
    got = []
    for docs in made:
        spans = P.explode_aspects(docs, ["text"])
        near, wide = P.prepend_span(spans, 0, out="near"), P.prepend_span(spans, 3, out="wide")
        aspect, polar = P.span_training_sets(df, docs)
        got.append(
            [
                rows(P.extract_aspects(docs), "text", "aspects"),
                rows(near, "text", "span", "near"),
                rows(wide, "text", "span", "wide"),
                rows(P.gold_spans(df, docs, overlapping=True).selectExpr("row_id", "span", "ordinal", "coalesce(gold.start, -1)", "coalesce(gold.stop, -1)")),
                rows(P.predict_gold_polarity(df, docs, polarity).selectExpr("row_id", "span", "ordinal", "coalesce(pred_polarity, '')")),
                rows(aspect),
                rows(polar),
            ]
        )
    assert got[0] == got[1] == got[2] and all(got[0])


def shuffled_columns(df):
    """Names of the columns that the plan's exchanges pass on."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    parts = [p for p in plan.split("\n\n") if p.lstrip().startswith("(") and " Exchange" in p.split("\n")[0]]
    return {c.split("#")[0].strip() for p in parts for c in p.split("Input", 1)[1].split("[", 2)[2].split("]")[0].split(",")}


@pytest.mark.parametrize("key", ["row_id", "text"])
def test_gold_spans_shuffle_neither_texts_nor_token_arrays(spark, tmp_path, key):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = spark.createDataFrame([(1, "The food was great ."), (2, "bagels")], "row_id int, text string")
        P.tag_tokens(base, tagger, packed=True).write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
        df = docs.selectExpr("row_id", "text", "'food' AS span", "0 AS ordinal")
        placed = P.gold_spans(df, docs, overlapping=False, key=key).select("row_id", "gold")
        moved = shuffled_columns(placed)
        assert "_begin" in moved and not moved & {"text", "tokens"}
        assert rows(placed.selectExpr("row_id", "gold.start")) == [(1, 1), (2, None)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_training_sets_shuffle_the_documents_once(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = spark.createDataFrame([(1, "The food and staff was great ."), (2, "bagels")], "row_id int, text string")
        P.tag_tokens(base, tagger, packed=True).write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
        df = docs.selectExpr("row_id", "text", "'food' AS span", "0 AS ordinal", "'p' AS label")
        aspect, polar = P.span_training_sets(df, docs, key="row_id", written=True)
        both = aspect.selectExpr("row_id", "string(label) AS label").unionByName(polar.selectExpr("row_id", "string(label) AS label"))
        assert rows(both) == [(1, "false"), (1, "p"), (1, "true"), (2, "false")]
        plan = both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("ReusedExchange") >= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
