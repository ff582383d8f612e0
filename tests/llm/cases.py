"""Small tables with the cases that every corpus operator must define."""

from __future__ import annotations

import random

WORDS = "the of and idiot river stone cloud market paper window garden music night".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def documents(seed: int = 1, n: int = 30) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls in all columns, empty and long texts, copies, ties, rows twice."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(1, 60)), "en", f"s{i % 4}", i) for i in range(n)]
    shared = prose(rng, 40)
    rows += [
        (100, None, None, None, None),
        (101, "", "en", "s1", 0),
        (102, " \t\n", "en", "s1", 3),
        (103, rows[3][1], "en", "s2", 1),
        (104, rows[3][1].upper(), "fr", None, 1),
        (105, rows[5][1] + " x", "en", "s2", 1),
        (106, "start " + shared + " é日本 end", "en", "s0", 1),
        (107, "other\n" + shared + "\nline", "en", "s3", 1),
        (108, "É é " + shared, "en", "s3", 1),
        (109, prose(rng, 3000), "en", "s0", 1),
        (110, "ab" * 4000, "en", "s0", 1),
        (None, "no id but some words here", "en", "s0", 1),
        (7, rows[7][1], "en", "s3", 7),
    ]
    rows += [(200 + i, "Same  line \nown line " + str(i), "en", "s0", 1) for i in range(11)]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows=None, extra: bool = False):
    """The documents as a frame; ``extra`` adds columns whose names the operators use inside."""
    frame = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    if extra:
        for name in ("id", "key", "size", "rank", "score", "run", "digest", "keep", "copies", "label", "content", "print"):
            from pyspark.sql import functions as F

            frame = frame.withColumn(name, F.lit(f"own {name}"))
    return frame


def labels(spark, rows=None):
    """Labels of the documents: some null, some of no document, one id with two labels."""
    rows = [(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(30)] + [(5000, 1, 0), (101, None, None), (4, 0, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
