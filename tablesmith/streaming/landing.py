"""Land raw files as versioned tables: one file, a folder, or a file stream."""

from __future__ import annotations

import functools
import time
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions.names import base_name, stem
from tablesmith.session import checkpoint_dir
from tablesmith.sources.delimited import FILE_TYPES, ReadInfo, file_type
from tablesmith.sources.events import event, log_events, make_run_id
from tablesmith.sources.tables import read_table

METADATA_SCHEMA = (
    "original_filename string, stored_filename string, stored_path string, version_id string, "
    "timestamp string, file_type string, rows long, columns_count int, columns array<string>"
)
ROW_ID = "_row_id"
#: Files that are landed at the same time.
POOL = 8


def version_stamp(spark: SparkSession, path: str) -> dict:
    """Version of a file from its path, time and size: landing it twice gives the same version."""
    f = spark.read.format("binaryFile").load(path)
    key = F.concat_ws("|", F.col("path"), F.col("modificationTime").cast("string"), F.col("length").cast("string"))
    row = f.select(
        "path", base_name("path").alias("name"), stem("path").alias("stem"),
        F.substring(F.sha2(key, 256), 1, 8).alias("version"),
        F.date_format("modificationTime", "yyyyMMdd_HHmmss").alias("at")).first()
    if row is None:
        raise FileNotFoundError(path)
    return row.asDict()


def ingest_metadata(df: DataFrame, name: str, stored: str, path: str, version: str, at: str, suffix: str,
                    n_rows: int) -> DataFrame:
    cols = [c for c in df.columns if c != ROW_ID]
    return df.sparkSession.createDataFrame(
        [(name, stored, path, version, at, suffix, n_rows, len(cols), cols)], METADATA_SCHEMA)


def ingest(spark: SparkSession, path: str, root: str, strategy: str = "sniff") -> tuple[DataFrame, ReadInfo]:
    """Land one file under ``root/raw`` and record it under ``root/metadata``.

    The target folder is a function of the file, and it is overwritten, so a
    repeated or retried landing leaves one copy. Row ids are stored, not recomputed.
    """
    suffix = file_type(path)
    v = version_stamp(spark, path)
    df, info = read_table(spark, path, strategy)
    stored = f"{v['at']}_{v['version']}_{v['name']}"
    target = f"{root}/raw/dataset_name={v['stem']}/version_id={v['version']}"
    df.withColumn(ROW_ID, F.monotonically_increasing_id()).write.mode("overwrite").parquet(target)
    landed = spark.read.parquet(target)
    n = landed.count()
    info.rows_read = n
    meta = ingest_metadata(df, v["name"], stored, target, v["version"], v["at"], suffix, n)
    meta.write.mode("overwrite").json(f"{root}/metadata/{v['at']}_{v['version']}_metadata.json")
    return meta, info


def ingest_paths(spark: SparkSession, paths: list[str], root: str, strategy: str = "sniff") -> DataFrame:
    """Land many files, several at a time; a failing file becomes a failed event and the rest goes on.

    Each event carries the milliseconds its file took; all events of a call are one append.
    """
    run_id = make_run_id(spark)

    def land(path: str) -> tuple[tuple, tuple]:
        begun = time.monotonic()
        took = lambda: int(1000 * (time.monotonic() - begun))
        name = path.rsplit("/", 1)[-1]
        short = name.rsplit(".", 1)[0]
        try:
            meta, _ = ingest(spark, path, root, strategy)
            m = meta.first().asDict()
            details = {k: m[k] for k in ("original_filename", "stored_filename", "stored_path", "rows",
                                         "columns_count", "file_type")}
            return (name, m["version_id"], "completed", None), ("completed", took(), short, m["version_id"], None, details)
        except Exception as e:  # recorded per file
            return (name, None, "failed", str(e)), ("failed", took(), short, None, str(e), {"input_file": path})

    with ThreadPoolExecutor(POOL) as pool:
        done = list(pool.map(land, paths))
    if done:
        log_events(functools.reduce(DataFrame.union, [
            event(spark, run_id, "ingestion", *e) for _, e in done]).coalesce(1), f"{root}/events")
    return spark.createDataFrame([r for r, _ in done], "file string, version_id string, status string, error string")


def folder_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the supported files of a folder, empty ones included (names only)."""
    names = sorted(unquote(p) for p in spark.read.format("binaryFile").load(folder).inputFiles())
    return [n for n in names if n.lower().endswith(tuple(FILE_TYPES))]


def ingest_folder(spark: SparkSession, folder: str, root: str, strategy: str = "sniff") -> DataFrame:
    return ingest_paths(spark, folder_files(spark, folder), root, strategy)


def ingest_stream(spark: SparkSession, folder: str, root: str, strategy: str = "sniff",
                  checkpoint: str | None = None, max_files: int = 100):
    """Land files not seen before; the stream's checkpoint remembers which ones were.

    Runs over what is available and stops. Each micro-batch carries file names only.
    """
    location = checkpoint or f"{checkpoint_dir(spark)}/landing"
    source = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.{csv,xlsx,xls,CSV,XLSX,XLS}").option("maxFilesPerTrigger", max_files)
        .load(folder).select("path")
    )

    def land(batch: DataFrame, _: int) -> None:
        paths = [r[0] for r in batch.orderBy("path").collect()]  # at most max_files names
        if paths:
            ingest_paths(spark, paths, root, strategy)

    return (
        source.writeStream.foreachBatch(land).option("checkpointLocation", location)
        .trigger(availableNow=True).start()
    )


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).json(f"{root}/metadata/*_metadata.json")


def read_raw(spark: SparkSession, root: str, dataset: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/raw/dataset_name={dataset}/version_id={version}")
