"""Cleaning of loosely typed run fields: numbers, method and dataset names, path parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Spellings of the three methods and their common names.
METHOD_ALIASES = {
    "vanilla": "vanilla",
    "baseline": "vanilla",
    "random_aug": "random_aug",
    "random": "random_aug",
    "random_augmentation": "random_aug",
    "augmented": "error_driven",
    "error_driven": "error_driven",
    "error-driven": "error_driven",
    "error_driven_aug": "error_driven",
    "error-driven_augmentation": "error_driven",
}
METHODS = ["vanilla", "random_aug", "error_driven"]
# Spellings of the benchmark datasets.
DATASET_ALIASES = {
    "ag-news": "ag_news",
    "ag_news": "ag_news",
    "sst2": "sst2",
    "sst-2": "sst2",
    "trec": "trec",
    "trec-qc": "trec",
    "imdb": "imdb",
}
# Method names recognised in file names, and the log file name pattern.
METHOD_FILES = ["vanilla", "random_aug", "error_driven", "augmented"]
LOG_NAME = r"(?i)(ag[_-]news|sst-?2|trec|imdb).*?shot(\d+).*?seed(\d+)"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lookup(table: dict, key) -> Column:
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), _col(key))


def safe_float(value) -> Column:
    """Number or NULL; blank and unreadable text give NULL."""
    return F.trim(_col(value).cast("string")).try_cast("double")


def safe_int(value) -> Column:
    """Whole number as text when the cell is one, else the text itself; blank gives NULL."""
    text = _col(value).cast("string")
    number = F.trim(text).try_cast("bigint")
    return F.when(text != "", F.coalesce(number.cast("string"), text))


def clean_scalar(value) -> Column:
    """Trimmed text without a trailing '.0'; missing gives ''."""
    text = F.coalesce(F.trim(_col(value).cast("string")), F.lit(""))
    return F.regexp_replace(text, r"^(\d+)\.0$", "$1")


def file_stem(path) -> Column:
    """File name without its last suffix."""
    name = F.element_at(F.split(_col(path), "/"), -1)
    return F.regexp_replace(name, r"(.)\.[^.]*$", "$1")


def normalize_method(method, file=None) -> Column:
    """Common method name from a cell, else from the file stem, else NULL."""
    key = F.replace(F.lower(F.trim(_col(method).cast("string"))), F.lit(" "), F.lit("_"))
    found = lookup(METHOD_ALIASES, key)
    if file is None:
        return found
    return F.coalesce(found, lookup(METHOD_ALIASES, F.lower(file_stem(file))))


def normalize_dataset(value) -> Column:
    """Common dataset name; unknown names stay as they are, missing gives ''."""
    text = F.trim(_col(value).cast("string"))
    return F.coalesce(lookup(DATASET_ALIASES, F.lower(text)), text, F.lit(""))


def parse_path(path) -> Column:
    """Struct (dataset, shot, seed, method) read from folder and file names; last match wins, '' if none."""
    path = _col(path)
    parts = F.split(path, "/")

    def last(array: Column) -> Column:
        return F.coalesce(F.try_element_at(array, F.lit(-1)), F.lit(""))

    datasets = F.filter(F.transform(parts, lambda p: lookup(DATASET_ALIASES, F.lower(p))), lambda d: d.isNotNull())
    shots = F.transform(F.filter(parts, lambda p: p.rlike(r"^\d+-shot$")), lambda p: F.regexp_extract(p, r"(\d+)", 1))
    seeds = F.transform(
        F.filter(parts, lambda p: p.rlike(r"^seed[-_]?\d+$")), lambda p: F.regexp_extract(p, r"(\d+)", 1)
    )
    stem = file_stem(path)
    method = F.when(path.endswith(".json") & stem.isin(*METHOD_FILES), stem).otherwise(F.lit(""))
    return F.struct(
        last(datasets).alias("dataset"), last(shots).alias("shot"), last(seeds).alias("seed"), method.alias("method")
    )


def parse_log_name(path) -> Column:
    """Struct (dataset, shot, seed) read from a log file name; '' if it does not match."""
    name = F.element_at(F.split(_col(path), "/"), -1)
    dataset = F.replace(F.regexp_extract(name, LOG_NAME, 1), F.lit("-"), F.lit("_"))
    return F.struct(
        normalize_dataset(dataset).alias("dataset"),
        F.regexp_extract(name, LOG_NAME, 2).alias("shot"),
        F.regexp_extract(name, LOG_NAME, 3).alias("seed"),
    )
