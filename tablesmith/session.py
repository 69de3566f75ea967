"""Session set-up and the few cluster settings the library depends on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A lookup side is broadcast only below both of these measured sizes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024

#: Up to this many rows an in-memory exact aggregate (``percentile``) or one
#: sorted task is bounded; beyond it the multi-pass / range-split forms run.
SINGLE_TASK_ROWS = 2_000_000


def get_session(app_name: str = "tablesmith", master: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a private one only in local mode."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tablesmith-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows written once under the checkpoint folder and read back."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_rows(df: DataFrame, part: str, place: str, before: str | None = None) -> DataFrame:
    """A stored copy of the rows with the number of the file each lies in, in written order, and its place there.

    ``before`` names a column for the count of rows in all earlier files. A task writes one file or, where
    ``spark.sql.files.maxRecordsPerFile`` limits them, several: files are ordered by the task, then by the task's own count.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    file, held = free_names(df, "file_name", "held")
    rows = spark.read.schema(df.schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(place))
    task, nth = (F.regexp_extract(F.col(file), rf"{mark}(\d+)", 1).cast("long") for mark in ("^part-", "-c"))
    order = Window.orderBy(task, nth)  # one row for each written file
    files = rows.groupBy(file).agg(F.count("*").alias(held)).select(
        file, (F.row_number().over(order) - 1).cast("long").alias(part),
        *([(F.sum(held).over(order) - F.col(held)).alias(before)] if before else []))
    return rows.join(files, file).drop(file)


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Rows with a number of their own, copies included. Stored once, so every later read sees the same numbers."""
    part, place, before = free_names(df, "part", "place", "before")
    rows = stored_rows(df, part, place, before)
    return rows.withColumn(name, F.col(before) + F.col(place)).drop(part, place, before)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names close to the wanted ones that no column of the frame has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
