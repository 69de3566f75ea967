"""JSON artifacts (profiles, plans, reports, logs) and table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.names import base_name
from tablesmith.functions.numeric import quoted
from tablesmith.sources.delimited import promote_header

COLUMN_INFO = (
    "struct<name:string,dtype:string,missing_count:bigint,missing_percentage:double,unique_count:bigint,"
    "is_target:boolean,min:double,max:double,mean:double,skewness:double,outlier_count:bigint,"
    "outlier_percentage:double,sample_values:array<string>>"
)
META_INFO = (
    "struct<target_column:string,target_detection_method:string,target_confidence:int,row_count:bigint,"
    "column_count:bigint,time_series_column:string,time_series_frequency:string,skewed_columns:array<string>,"
    "columns_with_outliers:array<string>,total_missing_values:bigint,missing_percentage:double,"
    "total_outliers:bigint,quality_score:double>"
)


def read_artifacts(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, file_name, json): one row per file, json is null when the file is corrupt."""
    try:
        files = spark.read.text(pattern, wholetext=True).select(
            F.col("_metadata.file_path").alias("path"), "value")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "path string, file_name string, json string")
        raise
    return files.select("path", base_name("path").alias("file_name"),
                        F.when(F.try_parse_json("value").isNotNull(), F.col("value")).alias("json"))


def json_text(c: Column) -> Column:
    """A string as a quoted JSON token."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def profile_documents(profile: DataFrame, meta: DataFrame) -> DataFrame:
    """(dataset, json): one profile document per dataset, ``_meta`` last, absent keys left out."""
    p = profile.join(meta.select("dataset", "target_column"), "dataset", "left")
    some = F.when(F.col("outlier_count") > 0, F.col("outlier_count"))
    info = F.to_json(F.struct(
        "name", "dtype", "missing_count", "missing_percentage", "unique_count",
        F.coalesce(F.col("name") == F.col("target_column"), F.lit(False)).alias("is_target"),
        "min", "max", "mean", "skewness", some.alias("outlier_count"),
        F.when(some.isNotNull(), F.col("outlier_percentage")).alias("outlier_percentage"), "sample_values"))
    entry = F.struct("ordinal", F.concat(json_text(F.col("name")), F.lit(":"), info).alias("text"))
    columns = p.groupBy("dataset").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    names = [c for c in meta.columns if c != "dataset"]
    tail = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return columns.join(meta, "dataset").select("dataset", F.concat(
        F.lit("{"), F.array_join(F.transform("entries", lambda e: e["text"]), ","),
        F.lit(',"_meta":'), tail, F.lit("}")).alias("json"))


def profiles_from_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profile rows and ``_meta`` rows back from (dataset, json) documents."""
    entries = docs.select("dataset", F.posexplode(F.map_entries(
        F.from_json("json", f"map<string,{COLUMN_INFO}>"))).alias("ordinal", "e"))
    real = entries.where((F.col("e.key") != "_meta") & F.col("e.value").isNotNull())
    rows = real.select("dataset", "ordinal", F.col("e.key").alias("column"), "e.value.*")
    meta = docs.select("dataset", F.from_json(
        F.get_json_object("json", "$._meta"), META_INFO).alias("m")).select("dataset", "m.*")
    return rows.drop("name").withColumnRenamed("column", "name"), meta


# --- sinks ----------------------------------------------------------------------------

def put_documents(df: DataFrame, path: str, keys: tuple[str, ...] = ("dataset", "version")) -> None:
    """Write one document a key, replacing the one of that key and no other.

    Rows are staged beside the table and their partitions swapped in when the job commits, so a failed or repeated write
    leaves one whole copy of each document. All documents of a run go in one job; nulls in a key are one key of their own.
    """
    shown = df.select(*[c for c in df.columns if c not in keys], *keys)
    (shown.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).json(path))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of :func:`put_documents`; their keys stay text. A table not yet written is an empty frame."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


PROFILE_DOCUMENT = "json string, dataset string, version string"
REPORT_DOCUMENT = ("is_valid boolean, errors array<string>, warnings array<string>, raw_file_path string, schema_path string, "
                   "validation_status string, name string, version string")


def put_profiles(profile: DataFrame, meta: DataFrame, version: str, root: str) -> None:
    """Profile documents under ``root/profiles``, one a dataset and version."""
    put_documents(profile_documents(profile, meta).withColumn("version", F.lit(version)), f"{root}/profiles")


def put_reports(reports: DataFrame, root: str) -> None:
    """Validation reports, valid and invalid, under ``root/reports``, one a name and version."""
    put_documents(reports, f"{root}/reports", ("name", "version"))


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Curated or feature table; CSV keeps a header and quotes."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.options(header=True, quote='"', escape='"')
    if partition:
        w = w.partitionBy(*partition)
    w.save(path)


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Feature table, one folder per split side when it has been split."""
    write_table(df, path, fmt, ["split"] if "split" in df.columns else None)


def features_and_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """X and y of a feature table: all columns but the target and the split mark, and the target alone."""
    mark = [c for c in ("split",) if c in df.columns and c != target]
    return df.drop(quoted(target), *map(quoted, mark)), df.select(quoted(target))


def write_train_test(df: DataFrame, target: str, path: str, fmt: str = "parquet") -> None:
    """X_train, y_train, X_test and y_test of a split feature table, each as a table of its own."""
    for side in ("train", "test"):
        x, y = features_and_target(df.where(F.col("split") == side), target)
        write_table(x, f"{path}/X_{side}", fmt)
        write_table(y, f"{path}/y_{side}", fmt)


def curate(df: DataFrame, name: str, path: str, encoding: str = "utf-8", position: Column | None = None) -> DataFrame:
    """Curated pass-through: header repair (where a row position is given), the written table, and its appended log row."""
    before = df.count()
    done = df if position is None else promote_header(df, position)
    write_table(done, f"{path}/curated/{name}")
    n = df.sparkSession.read.parquet(f"{path}/curated/{name}").count()
    log = transform_log(done, name, encoding, n, before, ["promote_header"] if done.columns != df.columns else [])
    write_json(log, f"{path}/transform_log")
    return log


def head_sample(df: DataFrame, order: list[Column], n: int = 50) -> DataFrame:
    """First n rows in a stated order (top-n per partition, then merged)."""
    return df.orderBy(*order).limit(n)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Pairs as JSON lines and as quoted CSV (multi-line fields survive)."""
    pairs.write.mode("overwrite").json(f"{path}/jsonl")
    pairs.write.mode("overwrite").options(
        header=True, quoteAll=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/csv")


def read_pairs(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "jsonl") -> DataFrame:
    """Pairs of :func:`write_pairs` back from either form, line breaks inside a field included."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.options(header=True, quote='"', escape='"', multiLine=True).csv(f"{path}/csv")
    return reader.json(f"{path}/jsonl")


def transform_log(df: DataFrame, name: str, encoding: str, n_rows: int, original_rows: int | None = None,
                  steps: list[str] | None = None, duplicates_removed: int = 0,
                  constants: list[str] | None = None) -> DataFrame:
    """Log row of a curated copy."""
    shape = [n_rows, len(df.columns)]
    return df.sparkSession.createDataFrame(
        [(name, encoding, [original_rows if original_rows is not None else n_rows, len(df.columns)], shape,
          df.columns, "success", steps or [], duplicates_removed, constants or [])],
        "name string, encoding_used string, original_shape array<long>, final_shape array<long>, "
        "columns array<string>, status string, steps array<string>, duplicates_removed long, "
        "constant_columns_dropped array<string>")
