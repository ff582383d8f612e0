"""Exact duplicates by a stateful stream: DataFrame functions only.

Normalised texts are stored as arrival files, and their digests arrive as a file stream. Keyed state on disk (RocksDB),
never expired, retains for each digest the stable id of the row that stays, the locator of its content (arrival file
and row) and the number of arrivals. With a ``state`` folder of the caller a later call adds its rows to the same files and goes on
from the same state, and its result covers all rows that ever arrived; else the folder is one of its own.

Every digest that was hit again is checked on full bytes: a bitmap of the hits, of bounded size, is held against the arrivals
where they are read, so that texts without a copy are never shuffled; the others are compared by digest and content, and
a digest with two contents is taken apart.

Defined results: a null text is the empty text, and equal to it. Rows without id count in their
group and stay only where no row of the group has an id. Of rows that agree in id and text,
one stays. An empty table gives no rows. Columns other than id and text take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from handful.llm.common import among, ascii_lower, keep_rows
from handful.session import cut_lineage, shared_path

# Keyed state on disk; without preallocated files, which would take megabytes for every partition.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def arrivals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, content): the normalised text and its digest."""
    content = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(key).alias("key"), content.alias("content")).select(
        "key", F.sha2("content", 256).alias("digest"), "content"
    )


def stream_groups(path: str, staged: DataFrame, state: str, files_per_batch: int) -> DataFrame:
    """(digest, keep, locator, n) of every digest, kept in the state of one stream over the arrival files at ``path``.

    Each micro-batch takes ``files_per_batch`` new files and writes the groups it changed; a repeated batch replaces its own
    output.
    """
    spark = staged.sparkSession
    out = f"{state}/groups"
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        locator = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        groups = (
            spark.readStream.schema("key bigint, digest string")
            .option("maxFilesPerTrigger", files_per_batch)
            .parquet(path)
            .select("key", "digest", locator.alias("locator"))
            .groupBy("digest")
            .agg(F.max(F.struct("key", "locator")).alias("kept"), F.count(F.lit(1)).alias("n"))
        )
        query = (
            groups.writeStream.outputMode("update")
            .option("checkpointLocation", f"{state}/stream")
            .trigger(availableNow=True)
            .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    schema = "digest string, kept struct<key: bigint, locator: struct<file: string, row: bigint>>, n bigint, batch int"
    changes = spark.createDataFrame([], schema) if staged.isEmpty() else spark.read.schema(schema).parquet(out)
    # Counts only grow, so the largest is the last state of a digest.
    last = changes.groupBy("digest").agg(F.max(F.struct("n", "kept")).alias("last"))
    return last.select(
        "digest",
        F.col("last.kept.key").alias("keep"),
        F.col("last.kept.locator").alias("locator"),
        F.col("last.n").alias("n"),
    )


def exact_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", files_per_batch: int = 64, state: str | None = None
) -> DataFrame:
    """One row per arrived row: key, digest, keep, locator, n, kept, and ``alike``, its rows of equal id and text."""
    spark = docs.sparkSession
    state = state or shared_path(spark, "exact-state")
    path = f"{state}/arrivals"
    arrivals(docs, key, text).withColumn("key", F.col("key").cast("bigint")).write.mode("append").parquet(path)
    stored = spark.read.schema("key bigint, digest string, content string").parquet(path)
    staged = stored.select("key", "digest")
    groups = cut_lineage(stream_groups(path, staged, state, files_per_batch), "exact-groups")

    hits = groups.where("n > 1").select("digest")
    found = numbered(staged, "key", "digest").join(groups, "digest")
    contents = among(stored, hits, "digest").select("digest", "content").distinct()
    doubted = contents.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("digest")
    doubted = cut_lineage(doubted, "exact-doubted")
    if not doubted.isEmpty():
        # Different bytes under one digest: their groups are those of the bytes.
        bytes_of = among(stored, doubted, "digest").join(doubted, "digest", "left_semi")
        own = bytes_of.groupBy("digest", "content").agg(F.max("key").alias("keep"), F.count(F.lit(1)).alias("n"))
        split = (
            numbered(bytes_of, "key", "digest", "content")
            .join(own, ["digest", "content"])
            .select("key", "digest", "number", "alike", "keep", F.lit(None).cast(groups.schema["locator"].dataType).alias("locator"), "n")
        )
        found = found.join(doubted, "digest", "left_anti").unionByName(split)
    return found.withColumn("kept", F.col("key").eqNullSafe(F.col("keep")) & (F.col("number") == 1))


def numbered(rows: DataFrame, *same: str) -> DataFrame:
    """Rows with their ``number`` among those that agree in some columns, and how many do (``alike``).

    Rows are numbered before they meet their group, so that a large group can be split over tasks.
    """
    window = W.partitionBy(*same)
    number = F.row_number().over(window.orderBy("key"))
    return rows.select(*same, number.alias("number"), F.count(F.lit(1)).over(window).alias("alike"))


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = exact_groups(docs, key, text, **options)
    stay = rows.where("kept").select(F.col("key").alias("id"), F.col("digest").alias("mark"), F.col("alike").alias("n"))
    return keep_rows(docs, key, F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))), 256), stay)
