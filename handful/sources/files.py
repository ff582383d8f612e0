"""Facts about files, CSV rows under any header, and an audit of a folder of run files.

``file_facts`` is a Python data source with a partition for each group of files: executors read every file as a stream and
report its size, age, lines, CSV header and what kept it from being read. CSV rows themselves come from Spark's
reader, all files in one scan; the header of each file names its cells.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from handful.functions.cells import parse_log_name
from handful.functions.order import unique_lists
from handful.operators.runs import stale_files
from handful.session import join_checked

# Fixed value: the longest cell that a row may have and still be read.
LONGEST_CELL = 131_072
PIECE = 1 << 20
GROUP_BYTES, GROUP_FILES = 64 << 20, 1000
FACTS = "path string, result_file string, kind string, size_bytes bigint, mtime timestamp, line_count bigint, header array<string>, read_error string"


def file_system(path: str):
    """(file system, path inside it, what Spark writes before that path) of a folder."""
    from pyarrow import fs

    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if not found or found[1].lower() == "file":
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:/*", "", path, flags=re.I).lstrip("/").rstrip("/"), "file://"
    if "://" not in path:
        raise ValueError(f"no file system is known for {path}")
    # s3a is the name that Hadoop gives the client of the same store.
    files, base = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path, flags=re.I))
    return files, base.rstrip("/"), path[: path.rfind(base)] if base and base in path else path


class FileGroup(InputPartition):
    def __init__(self, files: list[tuple]):
        self.files = files


class FileFacts(DataSource):
    """Options: path, suffixes (comma-separated, any case), contents ('false': only names, sizes and headers)."""

    @classmethod
    def name(cls) -> str:
        return "file_facts"

    def schema(self) -> str:
        return FACTS

    def reader(self, schema) -> DataSourceReader:
        return FileFactsReader(self.options)


class FileFactsReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.suffixes = {s.strip().lower() for s in options["suffixes"].split(",")}
        self.contents = options.get("contents", "true") != "false"

    def partitions(self) -> list[FileGroup]:
        from pyarrow import fs

        files, base, _ = file_system(self.path)
        listed = files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        wanted = sorted(
            (f.path, f.size or 0, f.mtime)
            for f in listed
            if f.type == fs.FileType.File and f.extension.lower() in self.suffixes
        )
        groups, held = [[]], 0
        for one in wanted:
            if groups[-1] and (held + one[1] > GROUP_BYTES or len(groups[-1]) >= GROUP_FILES):
                groups.append([])
                held = 0
            groups[-1].append(one)
            held += one[1]
        return [FileGroup(g) for g in groups]

    def read(self, partition: FileGroup):
        files, base, prefix = file_system(self.path)
        for name, size, mtime in partition.files:
            kind = name.rsplit(".", 1)[-1].lower()
            lines = header = error = None
            try:
                with files.open_input_stream(name, compression=None) as stream:
                    if kind == "csv":
                        header = csv_header(stream.read(PIECE))
                if self.contents:
                    with files.open_input_stream(name, compression=None) as stream:
                        lines, error = scanned(stream, kind)
            except Exception as exc:  # noqa: BLE001 - the reason is the result
                error = f"{type(exc).__name__}: {exc}"
            yield (name[len(base) :].lstrip("/"), prefix + name, kind, size, mtime, lines, header, error)


def csv_header(start: bytes) -> list[str]:
    """Column names of a CSV file from its first bytes."""
    text = start.decode("utf-8-sig", "replace")
    return next(csv.reader(io.StringIO(text, newline="")), [])


def scanned(stream, kind: str) -> tuple[int, str | None]:
    """Lines of a stream, and what is wrong with its text; logs may hold any bytes."""
    decode = codecs.getincrementaldecoder("utf-8")("strict" if kind not in ("log", "txt") else "replace").decode
    lines, last, error = 0, b"\n", None
    while piece := stream.read(PIECE):
        lines, last = lines + piece.count(b"\n"), piece[-1:]
        if error is None:
            try:
                decode(piece)
            except UnicodeDecodeError as exc:
                error = f"UnicodeDecodeError: {exc.reason}"
    if error is None:
        try:
            decode(b"", True)
        except UnicodeDecodeError as exc:
            error = f"UnicodeDecodeError: {exc.reason}"
    return lines + (last != b"\n"), error


def file_facts(spark: SparkSession, path: str, suffixes: Sequence[str], contents: bool = True) -> DataFrame:
    """One row per file below ``path`` with one of the suffixes: see ``FACTS``; unread parts are NULL."""
    spark.dataSource.register(FileFacts)
    reader = spark.read.format("file_facts").option("path", path).option("suffixes", ",".join(suffixes))
    return reader.option("contents", str(contents).lower()).load()


def write_texts(texts: DataFrame, path: str, name: str = "name", value: str = "value") -> int:
    """Write one file per row below ``path`` and return their number; names are relative, folders are made.

    A name holds one text, so a task that runs twice writes the same file again.
    """
    written = "name string"

    def write(batches):
        import pyarrow as pa

        files, base, _ = file_system(path)
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place = f"{base}/{own}"
                files.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(place, compression=None) as out:
                    out.write(text if isinstance(text, bytes) else (text or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])

    return texts.select(name, value).mapInArrow(write, written).count()


def plain_name(path: Column) -> Column:
    """A file's name in one spelling, without the escapes of addresses, so that names from two readers meet."""
    return F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def csv_rows(spark: SparkSession, path: str, skip: Sequence[str] = ()) -> DataFrame:
    """(result_file, position, cells, reason) of all data rows of the CSV files below ``path``.

    ``cells`` maps column names to text. Rows may be shorter or longer than the header; of equal names
    the last counts, cells without a name are left out, and empty or missing cells are NULL. ``reason`` is set on rows with a cell that is too long. Every
    file is one stream of rows, in its order.
    """
    heads = file_facts(spark, path, ["csv"], contents=False).select("result_file", "header")
    widest = heads.agg(F.max(F.size("header"))).first()[0] or 0
    if widest < 1:
        return spark.createDataFrame([], "result_file string, position array<bigint>, cells map<string,string>, reason string")
    names = [f"c{i}" for i in range(widest)]
    reader = spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", True).option("multiLine", True)
    reader = reader.option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("emptyValue", "")
    reader = reader.option("maxColumns", max(20_480, widest + 1)).option("recursiveFileLookup", True)
    rows = reader.option("pathGlobFilter", "*.[cC][sS][vV]").option("ignoreMissingFiles", True).csv(path)
    rows = rows.select(
        F.col("_metadata.file_path").alias("result_file"),
        F.array(F.monotonically_increasing_id()).alias("position"),
        F.array(*names).alias("_cells"),
    )
    if skip:
        rows = rows.filter(~F.element_at(F.split("result_file", "/"), -1).isin(*skip))
    heads = heads.select(plain_name(F.col("result_file")).alias("_of"), "header")
    named = join_checked(rows.withColumn("_of", plain_name(F.col("result_file"))), heads, "_of", "left")
    pairs = F.arrays_zip(F.col("header").alias("k"), F.slice("_cells", 1, F.size("header")).alias("v"))
    # Of a repeated name the last cell counts.
    last = F.filter(pairs, lambda p: p["k"] != "")
    cells = F.aggregate(
        last,
        F.create_map().cast("map<string,string>"),
        lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])),
    )
    repeated = F.size(F.array_distinct("header")) < F.size("header")
    too_long = F.exists("_cells", lambda c: F.length(c) > LONGEST_CELL)
    return named.select(
        "result_file",
        "position",
        F.when(repeated, cells).otherwise(F.map_from_entries(last)).alias("cells"),
        F.when(too_long, F.lit(f"cell of more than {LONGEST_CELL} characters")).alias("reason"),
    )


def first_records(document: Column, containers: Sequence[str]) -> Column:
    """Objects of a VARIANT document: of a list, else of its first container that holds some, else itself."""

    def objects(items: Column) -> Column:
        return F.filter(items, lambda v: F.schema_of_variant(v).startswith("OBJECT"))

    listed = F.try_variant_get(document, "$", "array<variant>")
    found = F.when(F.schema_of_variant(document).startswith("OBJECT"), F.array(document))
    for key in reversed(containers):
        inside = objects(F.try_variant_get(document, f"$.{key}", "array<variant>"))
        found = F.when(F.size(inside) > 0, inside).otherwise(found)
    return F.when(listed.isNotNull(), objects(listed)).otherwise(found)


VALUES = ["dataset", "shot", "method", "seed"]


def audited_records(spark: SparkSession, path: str) -> DataFrame:
    """The fields of every record in the CSV and JSON files below ``path``, filled up from the file's path."""
    from handful.sources.runs import AUDIT_CONTAINERS, audit_records, read_texts

    rows = csv_rows(spark, path).select("result_file", F.to_variant_object("cells").alias("record"))
    texts = read_texts(spark, path, "*.json").select("result_file", F.try_parse_json("value").alias("doc"))
    found = texts.select("result_file", F.explode(first_records(F.col("doc"), AUDIT_CONTAINERS)).alias("record"))
    return audit_records(rows.unionByName(found))


def audit_files(spark: SparkSession, path: str, limit: int = 30) -> DataFrame:
    """One row per csv, json and log file below ``path``: what it is, what it holds, and why it may be broken or old.

    ``line_count`` of a CSV counts its records and header. ``unique_*`` are joined lists of at most ``limit``
    values with the number of the others. A file that cannot be read has ``read_error`` and no values.
    """
    from handful.sources.runs import log_status, read_texts

    facts = file_facts(spark, path, ["csv", "json", "log"]).withColumn("_of", plain_name(F.col("result_file")))
    records = audited_records(spark, path).withColumn("_of", plain_name(F.col("result_file")))
    sums = records.groupBy("_of").agg(F.count(F.lit(1)).alias("n_rows"), F.bool_or("has_seed_field").alias("has_seed_field"))
    lists = unique_lists(records, ["_of"], VALUES, limit).withColumnsRenamed({v: f"unique_{v}" for v in VALUES})
    keys = records.select("_of", F.explode("keys").alias("key"))
    columns = unique_lists(keys, ["_of"], ["key"], 1000).withColumnRenamed("key", "columns")
    json = read_texts(spark, path, "*.json").select(plain_name(F.col("result_file")).alias("_of"), F.try_parse_json("value").isNull().alias("no_json"))
    logs = log_status(read_texts(spark, path, "*.log")).select(
        plain_name(F.col("result_file")).alias("_of"), "contains_completed", "contains_error", F.size("completed_runs").alias("n_completed")
    )
    out = facts
    for part in (sums, lists, columns, json, logs):
        out = out.join(part, "_of", "left")
    parsed = parse_log_name(F.col("path"))
    error = F.coalesce("read_error", F.when(F.col("no_json"), F.lit("no JSON")))
    readable = error.isNull()
    is_log = F.col("kind") == "log"
    unique = [
        F.when(readable & ~is_log, F.coalesce(f"unique_{v}", F.lit(""))).alias(f"unique_{v}") for v in VALUES
    ]
    header = F.array_join(F.array_sort(F.array_distinct(F.filter("header", lambda h: h != ""))), ";")
    lines = F.when((F.col("kind") == "csv") & readable, F.coalesce("n_rows", F.lit(0)) + (F.size("header") > 0).cast("int")).otherwise(F.col("line_count"))
    table = out.select(
        "path",
        "kind",
        "size_bytes",
        "mtime",
        lines.cast("bigint").alias("line_count"),
        F.when(readable & ~is_log, F.coalesce("n_rows", F.lit(0))).alias("n_rows"),
        F.when(readable & ~is_log, F.coalesce(F.when(F.col("kind") == "csv", header), "columns", F.lit(""))).alias("columns"),
        *unique,
        F.when(readable & ~is_log, F.coalesce("has_seed_field", F.lit(False))).alias("has_seed_field"),
        "contains_completed",
        "contains_error",
        F.col("n_completed").cast("bigint").alias("n_completed"),
        *[F.when(is_log, parsed[v]).alias(f"parsed_{v}") for v in ("dataset", "shot", "seed")],
        error.alias("read_error"),
    )
    return stale_files(table)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Runs per file, dataset, shot and method below ``path``: (path, kind, dataset, shot, method, n_rows, n_seeds).

    Values that a record lacks come from its path; records that name no dataset, shot or method there either are
    left out. A finished run of a log counts for each of the three methods. Every record keeps its own seed.
    """
    from handful.sources.runs import LOG_METHODS, log_status, read_texts

    facts = file_facts(spark, path, ["csv", "json", "log"], contents=False).select(plain_name(F.col("result_file")).alias("_of"), "path", "kind")
    rows = audited_records(spark, path).select("result_file", *VALUES)
    done = log_status(read_texts(spark, path, "*.log")).select("result_file", F.explode("completed_runs").alias("run"))
    # A dataset name may hold ':', shot and seed are digits.
    part = lambda i: F.regexp_extract("run", r"^(.*):(\d+):(\d+)$", i)
    logged = done.select("result_file", part(1).alias("dataset"), part(2).alias("shot"), F.explode(F.array(*map(F.lit, LOG_METHODS))).alias("method"), part(3).alias("seed"))
    every = rows.unionByName(logged).filter("dataset <> '' and shot <> '' and method <> ''")
    counted = every.groupBy("result_file", "dataset", "shot", "method").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.nullif("seed", F.lit(""))).alias("n_seeds")
    )
    counted = counted.withColumn("_of", plain_name(F.col("result_file"))).join(facts, "_of")
    return counted.select("path", "kind", "dataset", "shot", "method", "n_rows", "n_seeds")
