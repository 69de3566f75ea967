"""Registry of datasets, plans, runs and metrics as append-only tables.

State is the latest row per key; nothing is updated in place. Ids come from
``uuid()`` or a hash, never from a counter.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions.names import stem
from tablesmith.sources.events import ERROR_LIMIT

SCHEMAS = {
    "datasets": "dataset_id string, dataset_name string, original_filename string, stored_path string, "
                "version_id string, file_type string, row_count long, column_count int, target_column string, "
                "task_type string, created_at timestamp, updated_at timestamp",
    "plans": "plan_id string, dataset_id string, plan_json string, plan_source string, target_column string, "
             "task_type string, is_ai_generated boolean, created_at timestamp, updated_at timestamp",
    "runs": "run_id string, dataset_id string, plan_id string, status string, step string, message string, "
            "started_at timestamp, completed_at timestamp, execution_time_seconds double, "
            "rows_processed long, error_message string",
    "metrics": "metric_id string, run_id string, model_name string, accuracy double, f1_score double, "
               "precision double, recall double, training_time_seconds double, created_at timestamp",
}
RUN_STATUSES = ["started", "running", "completed", "failed", "success"]
TASKS = ["classification", "regression"]
MAX_LIMIT = 100
DEFAULT_LIMIT = 20


def append(df: DataFrame, root: str, table: str) -> None:
    """Append rows to a registry table; missing columns become nulls, domains are checked."""
    spark = df.sparkSession
    shape = spark.createDataFrame([], SCHEMAS[table]).schema
    have = set(df.columns)
    extra = have - set(shape.names)
    if extra:
        raise ValueError(f"unknown columns for {table}: {sorted(extra)}")
    cols = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in shape]
    out = df.select(*[c.alias(f.name) for c, f in zip(cols, shape)])
    if table == "runs":
        out = out.withColumn("status", _checked("status", RUN_STATUSES))
    if table in ("datasets", "plans"):
        out = out.withColumn("task_type", _checked("task_type", TASKS))
    out.write.mode("append").parquet(f"{root}/{table}")


def _checked(column: str, allowed: list[str]) -> Column:
    bad = F.col(column).isNotNull() & ~F.col(column).isin(allowed)
    return F.when(bad, F.raise_error(F.concat(F.lit(f"invalid {column}: "), F.col(column)))).otherwise(F.col(column))


#: Key, and the time by which the latest row of a key is told.
LATEST = {"datasets": ("dataset_id", "updated_at"), "plans": ("plan_id", "updated_at"),
          "runs": ("run_id", "completed_at"), "metrics": ("metric_id", "created_at")}


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The latest row of each key."""
    return latest_by(read_all(spark, root, table), *LATEST[table])


def read_all(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Every appended row."""
    try:
        return spark.read.schema(SCHEMAS[table]).parquet(f"{root}/{table}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], SCHEMAS[table])
        raise


def dataset_key(name: Column | str) -> Column:
    """Stable dataset id from its name."""
    return F.sha2(F.col(name) if isinstance(name, str) else name, 256)


# --- latest row per key --------------------------------------------------------------

def newest_first(at: str, columns: list[str]) -> Column:
    """Order of rows by time: one without a time is older than all others, equal times go by the row's text."""
    return F.struct(F.col(at).isNotNull(), F.col(at), F.to_json(F.struct(*[F.col(c) for c in columns])))


def latest_by(df: DataFrame, key: str, at: str) -> DataFrame:
    """Latest row per key. ``max_by`` combines on the map side: no per-key sort, no hot group."""
    rest = [c for c in df.columns if c != key]
    order = newest_first(at, rest)
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return picked.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in df.columns])


def upsert_datasets(current: DataFrame, new: DataFrame) -> DataFrame:
    """Newest fields win, the first ``created_at`` stays, a missing target keeps the old one."""
    rows = current.unionByName(new, allowMissingColumns=True)
    keep = [c for c in rows.columns if c not in ("dataset_name", "created_at", "target_column")]
    at = newest_first("updated_at", keep)
    target = F.nullif("target_column", F.lit(""))
    out = rows.groupBy("dataset_name").agg(
        F.max_by(F.struct(*keep), at).alias("r"),
        F.min("created_at").alias("created_at"),
        F.max_by("target_column", F.when(target.isNotNull(), F.struct(
            F.col("updated_at").isNotNull(), F.col("updated_at"), F.col("target_column")))).alias("target_column"),
    )
    done = {"dataset_name", "created_at", "target_column"}
    return out.select(*[F.col(c) if c in done else F.col(f"r.{c}").alias(c) for c in rows.columns])


def upsert_plans(current: DataFrame, new: DataFrame, datasets: DataFrame) -> DataFrame:
    """Latest plan per dataset; plans of unknown datasets are refused."""
    accepted = new.join(datasets.select("dataset_id").distinct(), "dataset_id", "left_semi")
    rows = current.unionByName(accepted, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in ("dataset_id", "created_at", "plan_id")]
    out = rows.groupBy("dataset_id").agg(
        F.max_by(F.struct(*rest), newest_first("updated_at", rest)).alias("r"),
        F.min("created_at").alias("created_at"),
        F.min_by("plan_id", F.struct(F.col("created_at").isNull(), F.col("created_at"), F.col("plan_id"))).alias("plan_id"))
    own = {"dataset_id", "created_at", "plan_id"}
    return out.select(*[F.col(c) if c in own else F.col(f"r.{c}").alias(c) for c in rows.columns])


def run_state(events: DataFrame) -> DataFrame:
    """Current state per run from its appended events (run_id, status, at, rows_processed, error)."""
    final = F.col("status").isin("completed", "failed", "success")
    g = events.groupBy("run_id").agg(
        F.max_by("status", "at").alias("status"),
        F.min("at").alias("started_at"),
        F.max(F.when(final, F.col("at"))).alias("completed_at"),
        F.max_by("rows_processed", "at").alias("rows_processed"),
        F.max_by("error_message", "at").alias("error_message"),
    )
    seconds = (F.unix_micros(F.col("completed_at").cast("timestamp"))
               - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return g.withColumn("execution_time_seconds", seconds).withColumn(
        "error_message", F.substring("error_message", 1, ERROR_LIMIT))


# --- reads ------------------------------------------------------------------------------

def check_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    return limit


def _latest(df: DataFrame, key: str) -> DataFrame:
    """Latest row per key; frames without a time of change go by their own text."""
    at = next((c for c in ("updated_at", "created_at") if c in df.columns), None)
    return latest_by(df, key, at) if at else latest_by(df.withColumn("updated_at", F.lit(None).cast("timestamp")), key, "updated_at").drop("updated_at")


def recent_runs(runs: DataFrame, datasets: DataFrame, plans: DataFrame, limit: int = DEFAULT_LIMIT,
                newest: str = "started_at") -> DataFrame:
    """Newest runs with their dataset and, if any, their plan.

    The newest runs of known datasets are cut first, so the plan join sees ``limit`` rows. Of several
    rows of a dataset or plan the latest counts, so no run comes twice.
    """
    known = runs.join(_latest(datasets, "dataset_id"), "dataset_id")
    order = [F.desc(newest), F.desc("run_id")]
    top = known.orderBy(*order).limit(check_limit(limit))
    return top.join(_latest(plans, "plan_id"), "plan_id", "left").orderBy(*order)


def recent_runs_with_metrics(runs: DataFrame, datasets: DataFrame, metrics: DataFrame,
                             limit: int = 5, newest: str = "started_at") -> DataFrame:
    """Newest runs with dataset and metrics where present; the limit counts joined rows."""
    order = [F.desc(newest), F.desc("run_id")]
    top = runs.orderBy(*order).limit(check_limit(limit))
    return top.join(_latest(datasets, "dataset_id"), "dataset_id", "left").join(metrics, "run_id", "left").orderBy(*order).limit(limit)


def lookup(df: DataFrame, **equals) -> DataFrame:
    """Point lookup; the equalities are pushed to the scan."""
    return functools.reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), equals.items(), df)


def list_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.select("dataset_id", "original_filename", "row_count", "task_type")


def plans_from_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Bulk load of ``*_plan.json`` files as plan rows; unreadable files are left out."""
    files = spark.read.text(pattern, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    name = F.regexp_replace(stem("path"), "_plan$", "")
    return files.where(F.try_parse_json("value").isNotNull()).select(
        F.uuid().alias("plan_id"), name.alias("dataset_id"), F.col("value").alias("plan_json"),
        F.get_json_object("value", "$.target_column").alias("target_column"),
        F.get_json_object("value", "$.task_type").alias("task_type"),
        F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))


def manual_plan(spark: SparkSession, dataset_id: str, plan_json: str, target: str | None = None,
                task: str | None = None) -> DataFrame:
    """A hand-written plan as a plan row without a run."""
    return spark.createDataFrame(
        [(dataset_id, plan_json, target, task)], "dataset_id string, plan_json string, target_column string, "
        "task_type string").withColumns({
            "plan_id": F.uuid(), "plan_source": F.lit("manual"), "is_ai_generated": F.lit(False),
            "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
