"""Reading and writing run results: JSON documents, JSON lines, CSV files and logs.

Files are read as text with their path, so a broken file only loses its own rows.
Nested records are VARIANT values, unwrapped level by level as rows until none is left, however deep.
``position`` orders the rows of a file: its offset and line where it is read by lines, then the place at each level.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from handful.session import cut_lineage
from handful.functions.cells import normalize_dataset, normalize_method, parse_path, safe_float, safe_int
from handful.sources.files import csv_rows, file_facts

# Keys that may hold further records, per kind of search.
CONTAINERS = ("results", "records", "runs", "items", "summary", "metrics")
RECORD_CONTAINERS = ("results", "records", "runs", "benchmark", "items")
AUDIT_CONTAINERS = ("results", "rows", "data", "records")
# Files written by the summaries themselves, which are never read back as runs.
GENERATED_FILES = ["raw_results.csv", "summary_results.csv", "comparison_results.csv"]
# The log line of a finished run, its shorter audit form, and the error marks.
COMPLETED = (
    r"Completed dataset=(\S+) shot=(\d+) seed=(\d+): vanilla=([-+]?\d+(?:\.\d+)?), "
    r"random=([-+]?\d+(?:\.\d+)?), error-driven=([-+]?\d+(?:\.\d+)?)"
)
COMPLETED_SHORT = r"Completed dataset=(\S+) shot=(\d+) seed=(\d+)"
ERROR_MARKS = ["CUDA out of memory", "OutOfMemoryError", "RuntimeError"]
LOG_METHODS = ["vanilla", "random_aug", "error_driven"]


def _has(record: Column, key: str) -> Column:
    return F.try_variant_get(record, f"$.{key}", "variant").isNotNull()


def _text(record: Column, key: str) -> Column:
    return F.try_variant_get(record, f'$["{key}"]', "string")


def _first_present(record: Column, keys: Sequence[str]) -> Column:
    """Text of the first key that exists, even if its value is null."""
    out = F.lit(None).cast("string")
    for key in reversed(keys):
        out = F.when(F.try_variant_get(record, f'$["{key}"]', "variant").isNotNull(), _text(record, key)).otherwise(out)
    return out


def run_fields(record: Column, file: Column) -> Column:
    """Struct of the run fields of one record, under whichever names it uses them."""
    dataset = F.coalesce(F.nullif(_text(record, "dataset"), F.lit("")), _text(record, "task"))
    delta = F.coalesce(
        F.to_json(F.try_variant_get(record, "$.improvement_delta.per_class_accuracy_delta", "map<string,double>")),
        F.to_json(F.try_variant_get(record, "$.per_class_accuracy_delta", "map<string,double>")),
        F.nullif(_text(record, "per_class_accuracy_delta"), F.lit("")),
    )
    return F.struct(
        dataset.alias("dataset"),
        safe_int(_first_present(record, ["sample_size", "shot", "shots"])).alias("sample_size"),
        safe_int(_text(record, "seed")).alias("seed"),
        safe_int(_first_present(record, ["iteration", "iter"])).alias("iteration"),
        F.coalesce(_text(record, "split"), F.lit("")).alias("split"),
        normalize_method(_text(record, "method"), file).alias("method"),
        safe_float(_first_present(record, ["accuracy", "acc", "score"])).alias("accuracy"),
        safe_float(_first_present(record, ["macro_f1", "macro-F1", "macro_f1_score"])).alias("macro_f1"),
        delta.alias("per_class_accuracy_delta"),
    )


def is_run(fields: Column) -> Column:
    return (
        fields["dataset"].isNotNull()
        & fields["method"].isNotNull()
        & fields["sample_size"].isNotNull()
        & fields["accuracy"].isNotNull()
    )


def is_run_record(record: Column, file: Column) -> Column:
    """``is_run`` of a record, reading only the fields it needs, dataset first."""
    dataset = F.coalesce(F.nullif(_text(record, "dataset"), F.lit("")), _text(record, "task"))
    size = safe_int(_first_present(record, ["sample_size", "shot", "shots"]))
    accuracy = safe_float(_first_present(record, ["accuracy", "acc", "score"]))
    method = normalize_method(_text(record, "method"), file)
    return F.coalesce(dataset.isNotNull() & size.isNotNull() & accuracy.isNotNull() & method.isNotNull(), F.lit(False))


def is_full_record(record: Column) -> Column:
    """A record that names dataset, shot, seed and method."""
    return _has(record, "dataset") & _has(record, "shot") & _has(record, "seed") & _has(record, "method")


def _objects(record: Column, key: str, single: bool) -> Column:
    listed = F.try_variant_get(record, f"$.{key}", "array<variant>")
    if not single:
        return F.coalesce(listed, F.array().cast("array<variant>"))
    one = F.try_variant_get(record, f"$.{key}", "variant")
    alone = F.when(F.try_variant_get(record, f"$.{key}", "map<string,variant>").isNotNull(), F.array(one))
    return F.coalesce(listed, alone, F.array().cast("array<variant>"))


def unwrap_records(
    payloads: DataFrame,
    found: Callable[[Column], Column],
    containers: Sequence[str] = CONTAINERS,
    single: bool = True,
    payload: str = "payload",
    position: str = "position",
) -> DataFrame:
    """All records inside VARIANT payloads: the other columns, ``position`` and the VARIANT ``record``.

    A list is searched item by item; an object that is no record itself is searched
    in its container keys (``single`` also lets a container be one object).  Each round looks
    one level deeper into what is still open, and the search ends when nothing is.  ``position``, an array that the
    frame may already have, gets the place at every level.
    """
    keep = [c for c in payloads.columns if c not in (payload, position)]
    start = F.col(position).cast("array<bigint>") if position in payloads.columns else F.array().cast("array<bigint>")
    level = payloads.select(*keep, start.alias(position), F.col(payload).alias("record"))
    done = []
    while True:
        v = F.col("record")
        listed = F.try_variant_get(v, "$", "array<variant>")
        # A list holds records, it is none.
        level = level.withColumn("_listed", listed)
        level = level.withColumn("_done", F.col("_listed").isNull() & found(v))
        inside = F.flatten(F.array(*[_objects(v, key, single) for key in containers]))
        below = F.when(F.col("_done"), F.array().cast("array<variant>")).otherwise(F.coalesce("_listed", inside))
        level = cut_lineage(level.select(*keep, position, "record", "_done", below.alias("_below")), "unwrapped")
        done.append(level.filter("_done").select(*keep, position, "record"))
        deeper = level.filter(F.size("_below") > 0)
        if deeper.isEmpty():
            break
        level = deeper.select(*keep, F.col(position).alias("_up"), F.posexplode("_below").alias("_at", "record"))
        level = level.withColumn(position, F.concat("_up", F.array(F.col("_at").cast("bigint")))).drop("_up", "_at")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def json_runs(texts: DataFrame, text: str = "value", file: str = "result_file", order: Sequence[str] = ()) -> DataFrame:
    """Run rows of JSON texts; unreadable texts give none."""

    def found(v: Column) -> Column:
        return is_run_record(v, F.col("result_file"))

    first = [F.col("position")] if "position" in texts.columns else []
    parsed = texts.select(F.col(file).alias("result_file"), *order, *first, F.try_parse_json(F.col(text)).alias("payload"))
    rows = unwrap_records(parsed.filter(F.col("payload").isNotNull()), found)
    return (
        rows.withColumn("_f", run_fields(F.col("record"), F.col("result_file")))
        .filter(is_run(F.col("_f")))
        .select("_f.*", "result_file", *order, "position")
    )


def rejected_json(texts: DataFrame, text: str = "value") -> DataFrame:
    """Texts that are no JSON, blank lines left out."""
    return texts.filter((F.trim(F.col(text)) != "") & F.try_parse_json(F.col(text)).isNull())


def json_documents(texts: DataFrame, text: str = "value") -> DataFrame:
    """Texts of ``.json`` files, cut into lines where the first line of several is a whole JSON value."""
    lines = F.filter(F.split(F.col(text), "\r?\n"), lambda line: F.trim(line) != "")
    whole = F.array(F.col(text))
    by_line = (F.size("_lines") > 1) & F.try_parse_json(F.col("_lines")[0]).isNotNull()
    cut = texts.withColumn("_lines", lines).withColumn("_lines", F.when(by_line, F.col("_lines")).otherwise(whole))
    rest = [c for c in texts.columns if c not in (text, "position")]
    return cut.select(*rest, F.posexplode("_lines").alias("_at", text)).withColumn(
        "position", F.array(F.col("_at").cast("bigint"))
    ).drop("_at")


def _csv_read(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows with their run fields ``_f``; files made by the summaries are skipped."""
    rows = csv_rows(spark, path, GENERATED_FILES)
    return rows.withColumn("_f", run_fields(F.to_variant_object("cells"), F.col("result_file")))


def csv_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run rows of the CSV files below ``path``, each with its own header."""
    rows = _csv_read(spark, path).filter(F.col("reason").isNull() & is_run(F.col("_f")))
    return rows.select("_f.*", "result_file", "position")


def rejected_csv(spark: SparkSession, path: str) -> DataFrame:
    """(result_file, value, reason) of every CSV row that gives no run."""
    lacks = F.concat_ws(", ", *[F.when(F.col("_f")[c].isNull(), F.lit(c)) for c in ("dataset", "method", "sample_size", "accuracy")])
    reason = F.coalesce("reason", F.when(~F.coalesce(is_run(F.col("_f")), F.lit(False)), F.concat(F.lit("no run without "), lacks)))
    rows = _csv_read(spark, path).select("result_file", F.concat_ws(",", F.map_values("cells")).alias("value"), reason.alias("reason"))
    return rows.filter("reason is not null")


def log_runs(texts: DataFrame, text: str = "value", file: str = "result_file") -> DataFrame:
    """Three run rows, one per method, for every finished run in a log text."""
    groups = [F.regexp_extract_all(F.col(text), F.lit(COMPLETED), F.lit(i)).alias(f"g{i}") for i in range(1, 7)]
    first = F.col("position") if "position" in texts.columns else F.array().cast("array<bigint>")
    runs = texts.select(F.col(file).alias("result_file"), first.alias("_line"), F.arrays_zip(*groups).alias("_m")).select(
        "result_file", "_line", F.posexplode("_m").alias("_at", "_m")
    ).withColumn("position", F.concat("_line", F.array(F.col("_at").cast("bigint"))))
    per_method = F.array(
        *[
            F.struct(F.lit(m).alias("method"), F.col(f"_m.g{4 + i}").cast("double").alias("accuracy"))
            for i, m in enumerate(LOG_METHODS)
        ]
    )
    return runs.select(
        F.col("_m.g1").alias("dataset"),
        safe_int(F.col("_m.g2")).alias("sample_size"),
        safe_int(F.col("_m.g3")).alias("seed"),
        F.lit(None).cast("string").alias("iteration"),
        F.lit("").alias("split"),
        F.inline(per_method),
        F.lit(None).cast("double").alias("macro_f1"),
        F.lit(None).cast("string").alias("per_class_accuracy_delta"),
        "result_file",
        "position",
    )


def read_texts(spark: SparkSession, path: str, glob: str, whole: bool = True) -> DataFrame:
    """(value, result_file) of all files below ``path`` that match ``glob``, also (``position``) by lines.

    Suffixes match without case; vanished and broken files are skipped.
    """
    anycase = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in glob)
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", anycase)
    reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    texts = reader.text(path, wholetext=whole).select("value", F.col("_metadata.file_path").alias("result_file"), "_metadata")
    if whole:
        return texts.select("value", "result_file")
    # Lines of one block of a file follow each other in one partition.
    place = F.array(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return texts.select("value", "result_file", place.alias("position"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run rows of every json, jsonl, csv, log and txt file below ``path``; logs and JSON lines are read by lines."""
    parts = [
        json_runs(json_documents(read_texts(spark, path, "*.json"))),
        json_runs(read_texts(spark, path, "*.jsonl", whole=False)),
        csv_runs(spark, path),
        log_runs(read_texts(spark, path, "*.{log,txt}", whole=False)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rejected_inputs(spark: SparkSession, path: str) -> DataFrame:
    """(result_file, line, reason) of what ``read_runs`` cannot read; ``line`` is the start of the text."""

    def told(texts: DataFrame, reason: str) -> DataFrame:
        return texts.select("result_file", F.substring("value", 1, 200).alias("line"), F.lit(reason).alias("reason"))

    logs = read_texts(spark, path, "*.{log,txt}", whole=False)
    facts = file_facts(spark, path, ["json", "jsonl", "csv", "log", "txt"])
    unread = facts.filter(~F.col("read_error").startswith("UnicodeDecodeError"))
    return (
        told(rejected_json(json_documents(read_texts(spark, path, "*.json"))), "no JSON")
        .unionByName(told(rejected_json(read_texts(spark, path, "*.jsonl", whole=False)), "no JSON line"))
        .unionByName(rejected_csv(spark, path).select("result_file", F.substring("value", 1, 200).alias("line"), "reason"))
        .unionByName(told(logs.filter(F.col("value").startswith("Completed") & ~F.col("value").rlike(COMPLETED)), "no finished run"))
        .unionByName(unread.select("result_file", F.lit(None).cast("string").alias("line"), F.col("read_error").alias("reason")))
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Full result records (dataset, shot, seed, method named) of all JSON files, as VARIANT ``record``."""
    texts = json_documents(read_texts(spark, path, "*.json"))
    parsed = texts.select(F.col("result_file").alias("source_file"), "position", F.try_parse_json("value").alias("payload"))
    return unwrap_records(parsed.filter("payload is not null"), is_full_record, RECORD_CONTAINERS, single=False)


def write_runs(df: DataFrame, path: str, fields: Sequence[str], mode: str = "overwrite") -> None:
    """CSV with the given columns in order; columns the frame lacks and missing values are blank."""
    columns = [F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields]
    df.select(*columns).write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_summary_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; ``read_runs`` reads them back line by line."""
    df.write.mode(mode).json(path)


def file_targets(spark: SparkSession, path: str, glob: str = "*.{csv,json,log}") -> DataFrame:
    """(path, size_bytes, mtime) of the files below ``path``, contents not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    )
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))


# Names a field may have in audited files.
AUDIT_NAMES = {
    "dataset": ("dataset", "task", "task_name"),
    "shot": ("shot", "sample_size", "shots", "k", "num_shots"),
    "method": ("method", "strategy", "variant"),
    "seed": ("seed", "random_seed"),
}


def audit_records(records: DataFrame, record: str = "record", file: str = "result_file") -> DataFrame:
    """(file, dataset, shot, method, seed, has_seed_field, keys) of VARIANT objects.

    Names are matched without case; what a record lacks is taken from its path.
    """
    cells = F.try_variant_get(F.col(record), "$", "map<string,variant>")
    lower = F.transform_keys("_cells", lambda k, _: F.lower(k))
    back = parse_path(F.col(file))

    def field(kind: str) -> Column:
        out = F.lit("")
        for name in reversed(AUDIT_NAMES[kind]):
            value = F.try_variant_get(F.try_element_at(F.col("_lower"), F.lit(name)), "$", "string")
            clean = F.regexp_replace(F.coalesce(F.trim(value), F.lit("")), r"^(\d+)\.0$", "$1")
            out = F.when(F.map_contains_key("_lower", name), clean).otherwise(out)
        return out

    def filled(kind: str) -> Column:
        value = normalize_dataset(field(kind)) if kind == "dataset" else field(kind)
        return F.when(value != "", value).otherwise(F.col("_back")[kind])

    base = records.withColumn("_cells", cells).filter("_cells is not null")
    base = base.withColumn("_lower", lower).withColumn("_back", back)
    return base.select(
        F.col(file).alias("result_file"),
        *[filled(k).alias(k) for k in AUDIT_NAMES],
        (F.map_contains_key("_lower", "seed") | F.map_contains_key("_lower", "random_seed")).alias("has_seed_field"),
        F.array_sort(F.map_keys("_cells")).alias("keys"),
    )


def run_files(audited: DataFrame) -> DataFrame:
    """Per file: rows, column names and the distinct datasets, shots, methods and seeds.

    Values are made distinct per file before they are collected.
    """
    return audited.groupBy("result_file").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("keys")))).alias("columns"),
        *[F.collect_set(F.nullif(F.col(c), F.lit(""))).alias(f"unique_{c}") for c in ("dataset", "shot", "method", "seed")],
        F.bool_or("has_seed_field").alias("has_seed_field"),
    )


def log_status(texts: DataFrame, text: str = "value", file: str = "result_file") -> DataFrame:
    """Per log text: lines, whether a run finished or failed, and the finished runs as 'dataset:shot:seed'."""
    groups = [F.regexp_extract_all(F.col(text), F.lit(COMPLETED_SHORT), F.lit(i)).alias(f"g{i}") for i in (1, 2, 3)]
    named = F.transform(
        F.arrays_zip(*groups), lambda m: F.concat_ws(":", normalize_dataset(m["g1"]), m["g2"], m["g3"])
    )
    broken = F.lit(False)
    for mark in ERROR_MARKS:
        broken = broken | F.col(text).contains(mark)
    breaks = F.regexp_count(F.col(text), F.lit("\n"))
    whole = F.when((F.col(text) == "") | F.col(text).endswith("\n"), 0).otherwise(1)
    return texts.select(
        F.col(file).alias("result_file"),
        (breaks + whole).alias("line_count"),
        F.col(text).contains("Completed dataset=").alias("contains_completed"),
        broken.alias("contains_error"),
        named.alias("completed_runs"),
    )
