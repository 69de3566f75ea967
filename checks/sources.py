"""Delimited scans of the given tables, documents written and read back, grouped validation and the folded run log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.common import columns_of, gappy, gappy_sql, plain, r6, table, time_text
from tablesmith.facade import run_validation
from tablesmith.operators.profile import profile_many
from tablesmith.session import checkpoint_dir
from tablesmith.sources.artifacts import (
    PROFILE_DOCUMENT, profiles_from_documents, put_profiles, read_documents, read_pairs, write_pairs,
)
from tablesmith.sources.delimited import read_delimited
from tablesmith.sources.events import stage_states, step_durations

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, sep: str, encoding: str = "UTF-8") -> str:
    """The table as CSV files with headers."""
    path = folder(df.sparkSession, "csv")
    shown = df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes])
    shown.write.options(header=True, sep=sep, quote='"', escape='"', encoding=encoding, emptyValue="",
                        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def cells_sql(name: str, relation: str | None = None) -> str:
    shown = {"double": r6, "int": lambda c: f"{c}::BIGINT", "ts": time_text, "str": lambda c: c}
    return f"SELECT {', '.join(f'{shown[k](c)} AS {c}' for c, k in columns_of(name))} FROM {relation or name}"


@query("scan_csv_sniffed", cells_sql("lineitem", gappy_sql("lineitem")))
def sniffed(spark, sf):
    return plain(read_delimited(spark, written(gappy(spark, sf, "lineitem"), ";"), "sniff")[0])


@query("scan_csv_first_line", cells_sql("orders", gappy_sql("orders")))
def first_line(spark, sf):
    return plain(read_delimited(spark, written(gappy(spark, sf, "orders"), ";"), "first_line")[0])


@query("scan_csv_schema_match", cells_sql("part"))
def schema_match(spark, sf):
    """The separator is the one of five attempts whose header fits the expected names best."""
    df = table(spark, sf, "part")
    return plain(read_delimited(spark, written(df, "\t"), "schema_match", df.columns)[0])


@query("scan_csv_first_multicolumn", cells_sql("customer", gappy_sql("customer")))
def first_multicolumn(spark, sf):
    return plain(read_delimited(spark, written(gappy(spark, sf, "customer"), "|"), "first_multicolumn")[0])


@query("scan_csv_encoding_only", """SELECT doc_id::BIGINT AS doc_id, lang, source, n_chars::BIGINT AS n_chars, md5(text) AS text_md5
    FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7F\\xA0-\\xFF]')""")
def encoding_only(spark, sf):
    """Whole texts with quotes and line breaks, stored in a one-byte encoding that is found out from the bytes."""
    docs = table(spark, sf, "documents").where("NOT text RLIKE '[^\\\\x00-\\\\x7F\\\\xA0-\\\\xFF]'").select("doc_id", "lang", "source", "n_chars", "text")
    got, _ = read_delimited(spark, written(docs, ",", "ISO-8859-1"), "encoding_only")
    return plain(got.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5")))


VALIDATED = ["region", "nation", "supplier", "part", "customer"]
STAMP = "20240101_000000_0a1b2c3d"


def single_file(df: DataFrame, name: str) -> str:
    """The table as one CSV file of a chosen name."""
    spark = df.sparkSession
    made = written(df.coalesce(1), ",")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(made).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(fs_path(made)) if s.getPath().getName().startswith("part-"))
    fs.rename(part, fs_path(f"{made}/{name}"))
    return f"{made}/{name}"


def validated_sql() -> str:
    """Whole numbers of a file are 64 bits wide, so 32-bit columns differ; the customers' file has gaps that the profile lacks."""
    narrow = "(SELECT count(*) FROM (DESCRIBE SELECT * FROM {t}) WHERE column_type = 'INTEGER')"
    parts = [f"SELECT '{t}' AS dataset_name, ({narrow.format(t=t)} + {2 if t == 'customer' else 0})::BIGINT AS errors" for t in VALIDATED]
    return ("SELECT dataset_name, '0a1b2c3d' AS version, CASE WHEN errors = 0 THEN 'valid' ELSE 'invalid' END AS status, "
            f"errors AS errors_count FROM ({' UNION ALL '.join(parts)})")


@query("validate_files", validated_sql())
def files_validated(spark, sf):
    """Five files judged in one group of jobs against the profiles of their tables."""
    tables = {t: table(spark, sf, t) for t in VALIDATED}
    profiles = profile_many(spark, {f"{STAMP}_{t}": df for t, df in tables.items()})[0]
    paths = [single_file(gappy(spark, sf, t) if t == "customer" else df, f"{STAMP}_{t}.csv") for t, df in tables.items()]
    return plain(run_validation(spark, paths, profiles, folder(spark, "validated"))[1].select("dataset_name", "version", "status", "errors_count"))


@query("profile_document_sink", "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS dataset, '{c}' AS name, count(*) - count({c}) AS missing_count, count(DISTINCT {c}) AS unique_count,
    (SELECT count(*) FROM {t}) AS row_count FROM {gappy_sql(t)}""" for t in ("customer", "orders") for c, _ in columns_of(t)))
def profile_sink(spark, sf):
    """Profile documents written twice under one version and read back: one copy of each."""
    from tablesmith.facade import dataset_meta

    root = folder(spark, "documents")
    p = profile_many(spark, {t: gappy(spark, sf, t) for t in ("customer", "orders")})[0]
    for _ in range(2):
        put_profiles(p, dataset_meta(p), "1", root)
    rows, meta = profiles_from_documents(read_documents(spark, f"{root}/profiles", PROFILE_DOCUMENT))
    return plain(rows.join(meta.select("dataset", "row_count"), "dataset").select("dataset", "name", "missing_count", "unique_count", "row_count"))


LOGGED = """SELECT user_id::VARCHAR AS run_id, event_type AS step, CASE WHEN event_id % 3 = 0 THEN 'started' WHEN event_id % 7 = 0 THEN 'failed'
    ELSE 'completed' END AS status, ts AS timestamp, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id * 37 % 5000 END::BIGINT AS duration_ms,
    CASE WHEN event_id % 3 <> 0 AND event_id % 7 = 0 THEN 'error in ' || props END AS error_detail, event_id FROM events"""


def logged(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as the log of runs: a run for each user, a step for each type."""
    status = F.when(F.col("event_id") % 3 == 0, "started").when(F.col("event_id") % 7 == 0, "failed").otherwise("completed")
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("step"), status.alias("status"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(status == "started", 0).otherwise(F.col("event_id") * 37 % 5000).cast("long").alias("duration_ms"),
        F.when(status == "failed", F.concat(F.lit("error in "), "props")).alias("error_detail"),
        F.lit(None).cast("string").alias("dataset_name"), F.lit(None).cast("string").alias("version"))


@query("event_stages", f"""SELECT run_id, step, coalesce(arg_max(status, timestamp) FILTER (WHERE status <> 'started'), 'started') AS status,
    {time_text("min(timestamp) FILTER (WHERE status = 'started')")} AS started_at,
    {time_text("max(timestamp) FILTER (WHERE status <> 'started')")} AS ended_at,
    arg_max(duration_ms, timestamp) FILTER (WHERE status <> 'started') AS duration_ms,
    substr(arg_max(coalesce(error_detail, ''), timestamp) FILTER (WHERE status <> 'started'), 1, 500) AS error_detail
    FROM ({LOGGED}) GROUP BY run_id, step""")
def stages(spark, sf):
    got = stage_states(logged(spark, sf)).drop("dataset_name", "version")
    return plain(got.withColumn("error_detail", F.when(F.col("ended_at").isNotNull(), F.coalesce("error_detail", F.lit("")))))


@query("event_durations", f"""SELECT step, status, count(*) AS events, sum(duration_ms)::BIGINT AS total_ms, max(duration_ms) AS longest_ms
    FROM ({LOGGED}) WHERE status <> 'started' GROUP BY step, status""")
def durations(spark, sf):
    return plain(step_durations(logged(spark, sf)))


@query("pair_files", "SELECT doc_id::BIGINT AS doc_id, md5(coalesce(text, '')) AS text_md5, 2::BIGINT AS forms FROM documents")
def pair_files(spark, sf):
    """Multi-line fields written as JSON lines and as CSV and read back alike."""
    path = folder(spark, "pairs")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    write_pairs(docs, path)
    both = read_pairs(spark, path, docs.schema).unionByName(read_pairs(spark, path, docs.schema, "csv"))
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return plain(both.groupBy("doc_id", text.alias("text_md5")).agg(F.count("*").alias("forms")))
