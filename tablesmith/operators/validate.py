"""Validation of data against a stored profile, and of folders against reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.names import base_name, parse_filename
from tablesmith.functions.numeric import observed
from tablesmith.operators.profile import dtype_label
from tablesmith.operators.ranks import agg_row


def actual_columns(df: DataFrame) -> DataFrame:
    """(name, dtype, spark_type, missing_count) of the data at hand, one aggregate pass."""
    gaps = agg_row(df, {str(i): F.count_if(observed(f.name, f.dataType).isNull())
                        for i, f in enumerate(df.schema.fields)})
    return df.sparkSession.createDataFrame(
        [(i, f.name, dtype_label(f.dataType, gaps[str(i)] > 0), f.dataType.simpleString(), gaps[str(i)])
         for i, f in enumerate(df.schema.fields)],
        "ordinal int, name string, dtype string, spark_type string, missing_count long")


def compare_profiles(expected: DataFrame, actual: DataFrame, target: str | None = None,
                     type_column: str = "spark_type", by: list[str] | None = None) -> DataFrame:
    """One row per problem: (by..., kind, name, message), from a full outer join by column name.

    ``by`` names columns that tell many tables apart in one go.
    """
    by = by or []
    e = expected.select(*by, "name", F.col(type_column).alias("e_type"), F.col("missing_count").alias("e_missing"),
                        F.lit(True).alias("e"))
    a = actual.select(*by, "name", F.col(type_column).alias("a_type"), F.col("missing_count").alias("a_missing"),
                      F.lit(True).alias("a"))
    both = e.join(a, [*by, "name"], "full_outer")
    in_e, in_a = F.col("e").isNotNull(), F.col("a").isNotNull()

    def issue(cond: Column, kind: str, text: str) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), F.col("name"),
                                     F.concat(F.lit(text), F.col("name")).alias("message")))

    issues = F.array_compact(F.array(
        issue(in_e & ~in_a, "missing_column", "Missing column: "),
        issue(in_a & ~in_e, "extra_column", "Extra column: "),
        issue(in_e & in_a & (F.col("e_type") != F.col("a_type")), "type_mismatch", "Type mismatch in "),
        issue(in_e & in_a & (F.col("e_missing") != F.col("a_missing")), "missing_mismatch",
              "Missing mismatch in "),
    ))
    out = both.select(*by, F.explode(issues).alias("i")).select(*by, "i.*")
    if target is None:
        return out
    absent = actual.groupBy(*by).agg(F.count_if(F.col("name") == target).alias("n")).where("n = 0").select(
        *by, F.lit("target_missing").alias("kind"), F.lit(target).alias("name"),
        F.lit(f"Target column missing: {target}").alias("message"))
    return out.unionByName(absent)


def error_lists(issues: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., errors): messages ordered by kind; missing and extra columns are listed once each."""
    by = by or []
    order = F.create_map(*[x for i, k in enumerate(
        ["missing_column", "extra_column", "target_missing", "type_mismatch", "missing_mismatch"])
        for x in (F.lit(k), F.lit(i))])
    listed = issues.withColumn("_o", order[F.col("kind")])
    folded = listed.groupBy(*by, "_o", "kind", F.when(F.col("_o") >= 2, F.col("name")).alias("who")).agg(
        F.array_sort(F.collect_set("name")).alias("names"), F.min("message").alias("message"))
    text = (
        F.when(F.col("kind") == "missing_column", F.concat(F.lit("Missing columns: "), F.array_join("names", ", ")))
        .when(F.col("kind") == "extra_column", F.concat(F.lit("Extra columns: "), F.array_join("names", ", ")))
        .otherwise(F.col("message")))
    errors = folded.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_o", text.alias("t")))).alias("e"))
    return errors.select(*by, F.transform("e", lambda s: s["t"]).alias("errors"))


def report_columns(name: Column, version: Column, raw_path: Column, schema_path: Column) -> list[Column]:
    """The columns of a report around its ``errors``: valid exactly when there is none."""
    ok = F.size("errors") == 0
    return [
        ok.alias("is_valid"), F.col("errors"), F.array().cast("array<string>").alias("warnings"), name.cast("string").alias("name"),
        version.cast("string").alias("version"), raw_path.cast("string").alias("raw_file_path"),
        schema_path.cast("string").alias("schema_path"), F.when(ok, "valid").otherwise("invalid").alias("validation_status")]


def validation_report(issues: DataFrame, name: str, version: str | None = None,
                      raw_path: str | None = None, schema_path: str | None = None) -> DataFrame:
    """One report row: valid exactly when there is no problem."""
    return error_lists(issues).select(*report_columns(F.lit(name), F.lit(version), F.lit(raw_path), F.lit(schema_path)))


def validate(df: DataFrame, expected: DataFrame, name: str, version: str | None = None,
             target: str | None = None, raw_path: str | None = None, schema_path: str | None = None) -> DataFrame:
    return validation_report(compare_profiles(expected, actual_columns(df), target),
                             name, version, raw_path, schema_path)


def failed_report(spark, name: str, version: str | None, error: str, raw_path: str | None = None,
                  schema_path: str | None = None) -> DataFrame:
    return spark.createDataFrame(
        [(False, [error], [], name, version, raw_path, schema_path, "invalid")],
        "is_valid boolean, errors array<string>, warnings array<string>, name string, version string, "
        "raw_file_path string, schema_path string, validation_status string")


RESULT = "dataset_name string, version string, status string, errors_count int, warnings_count int, first_error string"
MISSING_SCHEMA, BAD_NAME = "Schema file not found", "Unexpected filename format"


def _known_files(paths: DataFrame, profiles: DataFrame) -> DataFrame:
    """(file, p, known): the parts of each raw file name and whether a profile of its name is stored."""
    names = profiles.select(F.col("dataset").alias("base")).distinct().withColumn("known", F.lit(True))
    files = paths.withColumn("p", parse_filename("file"))
    return files.join(names, F.col("p.base_name") == F.col("base"), "left").select(
        "file", "p", F.coalesce("known", F.lit(False)).alias("known"))


def judge(files: DataFrame, profiles: DataFrame, actual: DataFrame, problems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports and result rows of many files at once: one comparison joined by file and column.

    ``actual`` has (file, name, spark_type, missing_count) of the files that could be read, ``problems`` (file, problem) of the others.
    A name of another shape is skipped and has no report.
    """
    files = _known_files(files, profiles).join(problems, "file", "left")
    named = F.col("p.version").isNotNull()
    ready = files.where(named & F.col("known") & F.col("problem").isNull())
    expected = ready.select("file", F.col("p.base_name").alias("dataset")).join(profiles, "dataset").select(
        "file", "name", "spark_type", "missing_count")
    errors = error_lists(compare_profiles(expected, actual.join(ready.select("file"), "file", "left_semi"), by=["file"]), ["file"])
    failed = F.concat(F.lit("Failed to read or validate dataset: "), F.col("problem"))
    own = F.when(~F.col("known"), F.lit(MISSING_SCHEMA)).when(F.col("problem").isNotNull(), failed)
    judged = files.where(named).join(errors, "file", "left").withColumn("errors", F.coalesce(
        F.when(own.isNotNull(), F.array(own)), F.col("errors"), F.array().cast("array<string>")))
    schema_path = F.when(F.col("known") & F.col("problem").isNull(), F.concat(F.col("p.base_name"), F.lit("_schema")))
    reports = judged.select(*report_columns(F.col("p.name"), F.col("p.version"), F.col("file"), schema_path))
    status = F.when(F.col("known") & F.col("problem").isNotNull(), "failed").when(F.size("errors") == 0, "valid").otherwise("invalid")
    results = judged.select(
        F.col("p.name").alias("dataset_name"), F.col("p.version").alias("version"), status.alias("status"),
        F.size("errors").alias("errors_count"), F.lit(0).alias("warnings_count"), F.get("errors", F.lit(0)).alias("first_error"))
    skipped = files.where(~named).select(
        F.col("p.base_name").alias("dataset_name"), F.lit(None).cast("string").alias("version"), F.lit("skipped").alias("status"),
        F.lit(1).alias("errors_count"), F.lit(0).alias("warnings_count"), F.lit(BAD_NAME).alias("first_error"))
    return reports, results.unionByName(skipped)


def validate_many(spark, tables: dict[str, tuple], profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validate many tables at hand; nothing aborts the run. Files on disk go through ``facade.run_validation``, in a few jobs for all.

    ``tables`` maps a raw file name to (DataFrame or None, error or None). Returns
    the reports and one result row per file (skipped names included).
    """
    rows, problems = [], []
    for path, (df, problem) in sorted(tables.items()):
        try:
            if df is None:
                raise ValueError(problem or "no data")
            rows += [(path, r["name"], r["spark_type"], r["missing_count"]) for r in actual_columns(df).collect()]
        except Exception as e:  # one bad table is one failed row
            problems.append((path, str(e)))
    files = spark.createDataFrame([(p,) for p in sorted(tables)], "file string")
    return judge(files, profiles, spark.createDataFrame(rows, "file string, name string, spark_type string, missing_count long"),
                 spark.createDataFrame(problems, "file string, problem string"))


def normalize_reports(reports: DataFrame) -> DataFrame:
    """Fill the defaults of older reports: lists, validity and status."""
    none = F.array().cast("array<string>")
    errors = F.coalesce("errors", none)
    valid = F.coalesce(F.col("is_valid"), F.size(errors) == 0)
    return reports.withColumns({
        "errors": errors, "warnings": F.coalesce("warnings", none), "is_valid": valid,
        "validation_status": F.coalesce("validation_status", F.when(valid, "valid").otherwise("invalid")),
    })


def validation_summary(reports: DataFrame) -> DataFrame:
    """Tallies per status; the reports of one status are a filter on ``validation_status``."""
    return reports.groupBy("validation_status").agg(
        F.count("*").alias("datasets"),
        F.count_if("is_valid").alias("valid_datasets"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("long").alias("errors_count"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("long").alias("warnings_count"))


def unvalidated(raw_files: DataFrame, schemas: DataFrame, reports: DataFrame) -> DataFrame:
    """(raw_file, problem, expected): bad names, missing profiles, missing reports."""
    parts = parse_filename("path")
    files = raw_files.select("path", base_name("path").alias("raw_file"), parts.alias("p"))
    bad = files.where(F.col("p.version").isNull()).select(
        "raw_file", F.lit("bad_name_format").alias("problem"), F.lit(None).cast("string").alias("expected"))
    good = files.where(F.col("p.version").isNotNull())
    want_schema = F.concat(F.col("p.base_name"), F.lit("_schema.json"))
    want_report = F.concat(F.col("p.name"), F.lit("_v"), F.col("p.version"), F.lit("_validation.json"))
    no_schema = good.withColumn("expected", want_schema).join(
        schemas.select(base_name("path").alias("expected")), "expected", "left_anti"
    ).select("raw_file", F.lit("missing_schema").alias("problem"), "expected")
    no_report = good.withColumn("expected", want_report).join(
        reports.select(base_name("path").alias("expected")), "expected", "left_anti"
    ).select("raw_file", F.lit("not_validated").alias("problem"), "expected")
    return bad.unionByName(no_schema).unionByName(no_report)


def parse_score(found: Column, expected: Column, n_rows: Column | None = None) -> Column:
    """How well a parsed header fits the expected columns (arrays of names)."""
    cols = F.array_distinct(F.transform(found, lambda c: F.trim(c)))
    want = F.array_distinct(expected)
    matched = F.size(F.array_intersect(cols, want))
    missing = F.size(F.array_except(want, cols))
    extra = F.size(F.array_except(cols, want))
    lone = (F.size(cols) == 1) & (F.size(want) > 1) & F.get(cols, F.lit(0)).rlike(r"[;,\t|]")
    score = matched * 10 - missing * 3 - extra - F.when(lone, 100).otherwise(0)
    score = F.when(F.size(want) == 0, F.size(cols)).otherwise(score)
    empty = F.size(cols) == 0 if n_rows is None else (F.size(cols) == 0) | (n_rows == 0)
    return F.when(empty, F.lit(-9999)).otherwise(score)


