"""One call from a file to a registered plan, and the whole batch over a folder."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions.names import parse_filename, short_name
from tablesmith.operators.correlate import class_imbalance, high_correlation, low_correlation
from tablesmith.operators.features import Build, build_features
from tablesmith.operators.infer import (
    detect_time_profile, priority_target, profile_target, time_frequency, time_steps,
)
from tablesmith.operators.profile import dataset_totals, profile, quality_score
from tablesmith.operators.validate import judge, validate
from tablesmith.plans.normalize import dispatch, plan_struct
from tablesmith.plans.rules import rule_plans
from tablesmith.session import cut_lineage
from tablesmith.sources import registry
from tablesmith.sources.artifacts import (
    REPORT_DOCUMENT, head_sample, put_profiles, put_reports, read_documents, write_features, write_table, write_train_test,
)
from tablesmith.sources.events import ERROR_LIMIT, RunLog, log_events
from tablesmith.sources.grouped import group_cells, group_columns, layouts
from tablesmith.streaming.landing import ROW_ID, ingest

META_COLUMNS = [
    "dataset", "target_column", "target_detection_method", "target_confidence", "row_count", "column_count",
    "time_series_column", "time_series_frequency", "skewed_columns", "columns_with_outliers",
    "total_missing_values", "missing_percentage", "total_outliers", "quality_score",
]


def time_facts(df: DataFrame, dataset: str, position: Column) -> DataFrame:
    """(dataset, time_series_column, time_series_frequency); nulls without a time column."""
    column = detect_time_profile(df, position)
    if column is None:
        return df.sparkSession.createDataFrame(
            [(dataset, None, None)], "dataset string, time_series_column string, time_series_frequency string")
    return time_frequency(time_steps(df, column, position)).select(
        F.lit(dataset).alias("dataset"), F.col("time_column").alias("time_series_column"),
        F.col("frequency").alias("time_series_frequency"))


def dataset_meta(p: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """One meta row per dataset: target, time column, totals and quality score."""
    totals = dataset_totals(p).join(profile_target(p), "dataset", "left")
    out = quality_score(totals)
    if times is None:
        out = out.withColumns({"time_series_column": F.lit(None).cast("string"),
                               "time_series_frequency": F.lit(None).cast("string")})
    else:
        out = out.join(times, "dataset", "left")
    return out.select(*META_COLUMNS)


def data_facts(df: DataFrame, dataset: str, target: str) -> dict[str, DataFrame]:
    """Correlation and balance facts of a table, shaped for the rule plan."""
    tag = lambda d: d.withColumn("dataset", F.lit(dataset))
    return {
        "low": tag(low_correlation(df, target)),
        "high": tag(high_correlation(df)),
        "balance": tag(class_imbalance(df, target)).select("dataset", "enabled", "reason"),
    }


@dataclass
class Prepared:
    metadata: DataFrame
    data: DataFrame
    profile: DataFrame
    meta: DataFrame
    validation: DataFrame
    plan: DataFrame
    rules: DataFrame


def prepare(spark: SparkSession, path: str, root: str, target: str | None = None,
            outputs: DataFrame | None = None, strategy: str = "sniff") -> Prepared:
    """Land a file, profile it, validate it against its profile, plan it, register all of it.

    Leaves the profile document, the report and an event for the start and end of each stage under ``root``;
    a second run of the same file replaces its documents. A failing stage is recorded and raised.
    """
    log = RunLog(spark, f"{root}/events")
    with log.stage("ingestion", path.rsplit("/", 1)[-1].rsplit(".", 1)[0]) as found:
        metadata, _ = ingest(spark, path, root, strategy)
        m = metadata.first()
        found |= {k: m[k] for k in ("stored_path", "rows", "columns_count")}
    dataset, version = m["stored_filename"].rsplit(".", 1)[0], m["version_id"]
    with log.stage("profile", dataset, version):
        landed = spark.read.parquet(m["stored_path"])
        data, position = landed.drop(ROW_ID), F.col(ROW_ID)
        p = profile(data, dataset)
        texts = profile_samples(landed, p)
        meta = dataset_meta(texts, time_facts(landed, dataset, position))
        put_profiles(texts, meta, version, root)
    with log.stage("validation", dataset, version) as found:
        report = validate(data, p, dataset, version, target, m["stored_path"])
        put_reports(report, root)
        found["validation_status"] = report.first()["validation_status"]
    with log.stage("plan", dataset, version):
        chosen = (spark.createDataFrame([(dataset, target)], "dataset string, target_column string")
                  if target and target in data.columns else priority_target(p, meta))
        goal = chosen.first()
        facts = data_facts(data, dataset, goal["target_column"]) if goal and goal["target_column"] else {}
        rules = rule_plans(p, chosen, **facts)
        plan = cut_lineage(dispatch(p, outputs, rules))  # one row, read several times below
        _register(spark, root, m, dataset, plan)
    return Prepared(metadata, data, texts, meta, report, plan, rules)


def run_validation(spark: SparkSession, paths: list[str], profiles: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Validate raw files on disk against the stored profiles of their names, all in a few jobs.

    Leaves a report of every well-named file and its event under ``root``; reports of a repeated run replace the earlier ones.
    Returns the stored reports and one result row per file.
    """
    log = RunLog(spark, f"{root}/events")
    begun = time.monotonic()
    with log.stage("validation_run", details={"files": len(paths)}) as found:
        base = {r["file"]: r["b"] for r in spark.createDataFrame([(p,) for p in paths], "file string").select(
            "file", parse_filename("file")["base_name"].alias("b")).collect()}
        wanted = {r["dataset"]: r["names"] for r in profiles.where(F.col("dataset").isin(*set(base.values()))).groupBy("dataset").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]).alias("names")).collect()}
        group = layouts(spark, paths, expected={p: wanted.get(b) for p, b in base.items()})
        actual = cut_lineage(group_columns(group_cells(spark, group)))
        # a file with a header alone has no cells: its columns are there without values
        seen = {r["file"] for r in actual.select("file").distinct().collect()}
        bare = [(p, n, "double", 0) for p, x in group.layouts.items() if p not in seen for n in x.names]
        columns = actual.select("file", "name", "spark_type", "missing_count").unionByName(
            spark.createDataFrame(bare, "file string, name string, spark_type string, missing_count long"))
        files = spark.createDataFrame([(p,) for p in paths], "file string")
        problems = spark.createDataFrame(list(group.problems.items()), "file string, problem string")
        reports, results = judge(files, profiles, columns, problems)
        reports, results = cut_lineage(reports), cut_lineage(results)
        put_reports(reports, root)
        found |= {r["status"]: r["count"] for r in results.groupBy("status").count().collect()}
        took = int(1000 * (time.monotonic() - begun))
        events = reports.select(
            F.lit(log.run_id).alias("run_id"), F.lit("validation").alias("step"),
            F.when(F.col("schema_path").isNull(), "failed").otherwise("completed").alias("status"), F.current_timestamp().alias("timestamp"),
            F.lit(took).cast("long").alias("duration_ms"),
            F.when(F.col("schema_path").isNull(), F.get("errors", F.lit(0)))
            .when(~F.col("is_valid"), "Dataset validation returned invalid").alias("error_detail"),
            F.col("name").alias("dataset_name"), "version", F.create_map(
                F.lit("raw_file_path"), F.col("raw_file_path"), F.lit("validation_status"), F.col("validation_status"),
                F.lit("errors_count"), F.size("errors").cast("string")).alias("details"))
        log_events(events, log.path)
    return read_documents(spark, f"{root}/reports", REPORT_DOCUMENT), results


def run_features(spark: SparkSession, df: DataFrame, root: str, dataset: str, version: str | None = None, keys: list[str] | None = None,
                 plan: dict | None = None, sample_rows: int | None = None) -> Build:
    """Build, write and register the features of one dataset; the run's start, end or failure are in the registry and the event log.

    Writes the feature table under ``root/features``, the X and y of both sides of a split under ``root/splits``, and with
    ``sample_rows`` the first rows by key under ``root/samples``. The run's rows in the registry tell the measured seconds.
    """
    log, begun = RunLog(spark, f"{root}/events"), time.monotonic()
    key = spark.range(1).select(registry.dataset_key(F.lit(dataset))).first()[0]
    start = spark.range(1).select(F.current_timestamp()).first()[0]

    def record(status: str, rows: int | None = None, error: str | None = None) -> None:
        over = status != "running"
        registry.append(spark.createDataFrame(
            [(log.run_id, key, status, "features", start, time.monotonic() - begun if over else None, rows, error)],
            "run_id string, dataset_id string, status string, step string, started_at timestamp, execution_time_seconds double, "
            "rows_processed long, error_message string").withColumn(
            "completed_at", F.current_timestamp() if over else F.lit(None).cast("timestamp")), f"{root}/registry", "runs")

    record("running")
    n = 0
    try:
        with log.stage("features", dataset, version) as found:
            n = df.count()
            built = build_features(df, keys or [], plan)
            path = f"{root}/features/{dataset}"
            write_features(built.frame, path)
            built.frame = spark.read.parquet(path)
            if built.has_split:
                write_train_test(built.frame, built.target, f"{root}/splits/{dataset}")
            if sample_rows:
                order = [F.col(f"`{c}`") for c in keys or [] if c in built.frame.columns] or [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
                write_table(head_sample(built.frame, order, sample_rows), f"{root}/samples/{dataset}")
            found |= {"rows": n, "columns": len(built.frame.columns), "target_column": built.target, "task_type": built.task_type}
    except Exception as e:
        record("failed", n, str(e)[:ERROR_LIMIT])
        raise
    record("completed", n, "No error")
    return built


def profile_samples(landed: DataFrame, p: DataFrame) -> DataFrame:
    """The profile with the first distinct text values in landing order filled in."""
    from tablesmith.operators.profile import sample_values

    data_fields = [f for f in landed.schema.fields if f.name != ROW_ID]
    texts = [f.name for f in data_fields if f.dataType.simpleString() == "string"]
    if not texts:
        return p
    rows = sample_values(landed, texts, F.col(ROW_ID))
    names = F.array(*[F.lit(t) for t in texts])
    per = rows.groupBy(F.get(names, F.col("ordinal")).alias("name")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("s"))
    return p.join(F.broadcast(per), "name", "left").withColumn("sample_values", F.col("s")).select(*p.columns)


def _register(spark: SparkSession, root: str, m, dataset: str, plan: DataFrame) -> None:
    now = F.current_timestamp()
    name = spark.range(1).select(short_name(F.lit(dataset))).first()[0]
    base = spark.range(1).select(registry.dataset_key(F.lit(dataset)).alias("dataset_id"))
    chosen = plan.select("target_column", "task_type", F.to_json(plan_struct()).alias("plan_json")).first()
    known = registry.read(spark, f"{root}/registry", "datasets").join(base, "dataset_id", "left_semi")
    new = base.select(
        "dataset_id", F.lit(name).alias("dataset_name"), F.lit(m["original_filename"]).alias("original_filename"),
        F.lit(m["stored_path"]).alias("stored_path"), F.lit(m["version_id"]).alias("version_id"),
        F.lit(m["file_type"]).alias("file_type"), F.lit(m["rows"]).alias("row_count"),
        F.lit(m["columns_count"]).alias("column_count"), F.lit(chosen["target_column"]).alias("target_column"),
        F.lit(chosen["task_type"]).alias("task_type"), now.alias("created_at"), now.alias("updated_at"))
    # One row, worked out before its own table is appended to.
    merged = spark.createDataFrame(registry.upsert_datasets(known, new).collect(), known.schema)
    registry.append(merged, f"{root}/registry", "datasets")
    plan_id, run_id = (r[0] for r in spark.range(2).select(F.uuid()).collect())
    registry.append(base.select(
        F.lit(plan_id).alias("plan_id"), "dataset_id", F.lit(chosen["plan_json"]).alias("plan_json"),
        F.lit("auto").alias("plan_source"), F.lit(chosen["target_column"]).alias("target_column"),
        F.lit(chosen["task_type"]).alias("task_type"), F.lit(False).alias("is_ai_generated"),
        now.alias("created_at"), now.alias("updated_at")), f"{root}/registry", "plans")
    registry.append(base.select(
        F.lit(run_id).alias("run_id"), "dataset_id", F.lit(plan_id).alias("plan_id"), F.lit("success").alias("status"),
        F.lit("generate-plan").alias("step"), F.lit("Schema extracted and plan generated successfully").alias("message"),
        now.alias("started_at"), now.alias("completed_at")), f"{root}/registry", "runs")


