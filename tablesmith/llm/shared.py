"""Small pieces that several operators need: shared folders, stored tables, global row numbers."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rules: blank and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch where each row holds a whole text or its words: a batch is held by Spark and by the Python worker at once.
BATCH = 1_000


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh folder that driver and executors share.

    It lies under ``spark.checkpoint.dir``. Only a local session without that
    setting gets a private temporary folder; elsewhere a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tablesmith-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for the plans made inside; what was set before holds again afterwards."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def store(df: DataFrame, path: str, batch: int | None = None) -> DataFrame:
    """Write a table once and read it back: cuts lineage and survives lost executors.

    Once the table is written nothing reads the shuffle files of its plan, so Spark deletes them then and not when the driver
    happens to collect garbage. ``batch`` bounds the rows of an Arrow batch.
    """
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch:
        wanted["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch)
    with settings(df.sparkSession, wanted):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def erase(spark: SparkSession, path: str) -> None:
    """Delete a stored table that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to the given ones that the frame does not use."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str):
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, order: list[str], path: str, name: str = "row") -> tuple[DataFrame, int]:
    """Stored copy of a narrow frame with a gapless global row number, and the row count.

    The number is the place in the order of ``order``; rows equal there are
    numbered in any way. The sorted table is written once, so every later read
    sees the same numbers. A last sort key of the row's own splits large groups
    of equal rows over many tasks. Nulls sort first; an empty frame gives no rows.
    """
    spark = df.sparkSession
    tie, = fresh(df, "tie")
    flat = store(df.withColumn(tie, F.monotonically_increasing_id()), f"{path}/flat")
    flat.orderBy(*[col(c) for c in order], tie).drop(tie).write.parquet(f"{path}/sorted")
    erase(spark, f"{path}/flat")
    rows = spark.read.schema(df.schema).parquet(f"{path}/sorted")
    file, before = fresh(df, "file", "before")
    rows = rows.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(name))
    files = rows.groupBy(file).count().select(file, F.col("count").alias(before))
    total = files.agg(F.sum(before)).first()[0] or 0
    # A task writes one file or, where their length is limited, several: the task's number, then the file's.
    # One row for each written file, so this running sum stays small in one task.
    task, nth = (F.regexp_extract(col(file), rf"{p}(\d+)", 1).cast("long") for p in ("^part-", "-c"))
    starts = files.withColumn(before, F.sum(before).over(Window.orderBy(task, nth)) - F.col(before))
    out = rows.join(starts, file).withColumn(name, F.col(name) + F.col(before)).drop(file, before)
    return out, int(total)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, across tasks."""
    return sys.modules.setdefault("tablesmith_worker_cache", types.ModuleType("tablesmith_worker_cache")).__dict__
