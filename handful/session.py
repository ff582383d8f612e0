"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is broadcast only after a check shows it has at most this many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def build_session(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for local runs; a cluster passes its own settings instead."""
    return (
        SparkSession.builder.master(master)
        .appName("handful")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a local master.

    On a cluster every executor would write to a temporary folder of its own, so without a
    shared folder the job stops.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="handful-")
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write the frame as a table in the shared folder and read it back.

    Later steps read only the columns they need, and a lost executor costs a re-read, not
    the steps before.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_checked(
    big: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Join, broadcasting ``small`` only if it is checked to have few rows and few bytes.

    ``small`` is written first, so that check and join read it without its lineage; the check reads at
    most ``limit`` + 1 rows and takes them at the size of their JSON text.
    """
    small = cut_lineage(small, "small-side")
    head = small.limit(limit + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("size"))
    rows, size = head.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if rows <= limit and size <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)
