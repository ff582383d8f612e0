"""Loading splits by alias and small task files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from handful.functions.cells import lookup
from handful.operators.columns import wide_to_vector

# Other names a benchmark dataset may be stored under, tried in order.
SPLIT_ALIASES = {
    "sst2": ["sst2"],
    "ag_news": ["ag_news"],
    "trec": ["TREC-QC", "trec"],
    "TREC-QC": ["TREC-QC"],
    "SentEval-CR": ["SentEval-CR"],
    "dbpedia": ["dbpedia", "dbpedia_14"],
}


def load_split(
    spark: SparkSession,
    root: str,
    names: str | Sequence[str],
    split: str = "train",
    layout: str = "{root}/{name}/{split}",
) -> DataFrame:
    """The first readable Parquet split among the aliases of a dataset."""
    aliases = SPLIT_ALIASES.get(names, [names]) if isinstance(names, str) else list(names)
    last: Exception | None = None
    for name in aliases:
        try:
            return spark.read.parquet(layout.format(root=root, name=name, split=split))
        except AnalysisException as problem:
            last = problem
    raise RuntimeError(f"No readable split {split!r} under the names {aliases}.") from last


def load_multilabel_split(
    spark: SparkSession,
    root: str,
    name: str,
    split: str = "train",
    keep: Sequence[str] = ("row_id", "text"),
    layout: str = "{root}/{name}/{split}",
) -> DataFrame:
    """A split with one 0/1 column per label, plus ``label`` as one 0/1 vector."""
    df = load_split(spark, root, [name], split, layout)
    labels = [c for c in df.columns if c not in keep]
    return df.withColumn("label", wide_to_vector(labels))


def label_index(value, verbalizer: Sequence[str]):
    """Place of a label in the verbalizer, NULL if it is not there."""
    return lookup({str(name): i for i, name in enumerate(verbalizer)}, value)


def read_prompt_jsonl(
    spark: SparkSession, path: str, n_text: int, verbalizer: Sequence[str], bad_rows: str = "fail"
) -> DataFrame:
    """JSON lines with TEXT1..n and LBL -> (TEXT1..n, LBL, lbl).

    A line without LBL or with an unknown one stops the job ('fail'), or is kept with a
    ``problem`` text and a NULL lbl ('keep') so that it can be split off.
    """
    columns = [f"TEXT{i}" for i in range(1, n_text + 1)]
    schema = ", ".join(f"{c} string" for c in [*columns, "LBL"])
    rows = spark.read.schema(schema).json(path).withColumn("lbl_", label_index(F.col("LBL"), verbalizer))
    problem = F.when(F.col("LBL").isNull(), F.lit("no label")).when(
        F.col("lbl_").isNull(), F.concat(F.lit("unknown label "), F.col("LBL"))
    )
    if bad_rows == "keep":
        return rows.select(*columns, F.col("LBL").alias("label_text"), F.col("lbl_").alias("lbl"), problem.alias("problem"))
    checked = F.when(problem.isNotNull(), F.raise_error(problem).cast("int")).otherwise(F.col("lbl_"))
    return rows.select(*columns, F.col("LBL").alias("label_text"), checked.alias("lbl"))


def write_task_jsonl(
    df: DataFrame, path: str, pair: bool = False, text: str = "text", label: str = "label", mode: str = "overwrite"
) -> None:
    """JSON lines {TEXT1[, TEXT2], LBL} with the label as text."""
    texts = [F.col("text1").alias("TEXT1"), F.col("text2").alias("TEXT2")] if pair else [F.col(text).alias("TEXT1")]
    rows = df.select(*texts, F.col(label).cast("string").alias("LBL"))
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def tsv_to_task(spark: SparkSession, path: str, n: int = 32) -> DataFrame:
    """The first n lines after the header of tab-separated files, in the order of file name and line, as (TEXT1, LBL)."""
    lines = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    first, second = lines.columns[:2]
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    placed = lines.select(F.col(first).alias("TEXT1"), F.col(second).alias("LBL"), *[c.alias(f"_p{i}") for i, c in enumerate(place)])
    return placed.orderBy("_p0", "_p1", "_p2").limit(n).select("TEXT1", "LBL")
