"""Target, task and time-column detection over profile rows and over data."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.names import contains_any, date_rule, id_rule, normalize_name
from tablesmith.functions.numeric import is_numeric_type, is_time_type, quoted
from tablesmith.session import cut_lineage

HELD_STEPS = 100_000  # distinct steps that a task counts before it hands them on

# --- fixed values: word lists of the detectors --------------------------------
PROFILE_TARGETS = [
    "target", "label", "class", "species", "price", "output", "y",
    "churn", "attrition", "cardio", "diagnosis", "survived", "mpg",
    "sales", "expenses", "score", "rating", "grade", "income",
]
FEATURE_BAD = [
    "id", "Id", "ID", "customerID", "EmployeeNumber", "PassengerId",
    "index", "timestamp", "date", "time", "202", "created_at", "updated_at",
]
FEATURE_TARGETS = [
    "target", "label", "class", "output", "result", "outcome",
    "predict", "response", "survived", "churn", "attrition",
    "price", "charges", "sales", "mpg", "delay", "species",
    "cardio", "admit", "income", "salary",
]
DISPATCH_TEXT = [
    "filename", "file", "path", "url", "description", "comment", "notes", "competitors",
]
DISPATCH_EXACT = [
    "target", "label", "class", "species", "price", "sales", "churn", "attrition",
    "cardio", "survived", "mpg", "expenses", "charges", "area", "diagnosis", "score",
]
DISPATCH_CONTAINS = [
    "target", "label", "class", "species", "price", "sales", "churn", "attrition",
    "cardio", "survived", "mpg", "expenses", "charges", "diagnosis",
    "admit", "admission", "outcome", "result",
]
PRIORITY_TARGETS = [
    "target", "label", "class", "species", "price", "churn",
    "attrition", "cardio", "survived", "mpg", "sales", "expenses",
]
TIME_NAMES_PROFILE = [
    "date", "time", "timestamp", "year", "month", "day",
    "datetime", "created", "updated", "recorded",
]
TIME_NAMES_FEATURES = [
    "date", "time", "timestamp", "created_at", "updated_at",
    "datetime", "week", "hour", "minute",
]
GENERATOR_NUMERIC = ["int64", "float64", "int32", "float32", "int", "float"]
PAIR_NUMERIC = ["int64", "float64", "int32", "float32"]
# ------------------------------------------------------------------------------

# month first where both readings are possible
TEXT_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy/M/d", "yyyy/M/d H:m", "yyyy/M/d H:m:s", "M/d/yyyy", "M/d/yyyy H:m", "M/d/yyyy H:m:s",
                "d/M/yyyy", "d/M/yyyy H:m", "d/M/yyyy H:m:s", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy", "d.M.yyyy H:m",
                "yyyyMMdd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy"]


def points(cond: Column, value: int) -> Column:
    return F.when(cond, F.lit(value)).otherwise(F.lit(0))


def is_numeric_label(dtype: Column | str) -> Column:
    """Dispatcher's numeric test: the type label contains int, float or double."""
    d = F.lower(F.col(dtype) if isinstance(dtype, str) else dtype)
    return contains_any(d, ["int", "float", "double"])


def best_per_dataset(rows: DataFrame, score: Column) -> DataFrame:
    """Highest score per dataset, the first column wins a tie."""
    order = Window.partitionBy("dataset").orderBy(score.desc(), F.col("ordinal"))
    return rows.withColumn("_best", F.row_number().over(order)).where("_best = 1").drop("_best")


# --- T1: detector used while profiling ------------------------------------------

def profile_target_scores(p: DataFrame) -> DataFrame:
    name, unique = F.lower("name"), F.col("unique_count")
    exact = name.isin(PROFILE_TARGETS)
    partial = ~exact & contains_any(name, PROFILE_TARGETS)
    few = unique.between(2, 10)
    text = F.col("dtype") == "object"
    score = (
        points(exact, 100) + points(partial, 50) + points(F.col("is_last"), 30)
        + points(few, 20) + points(text, 10)
        + points(id_rule("name", "profile"), -100) + points(unique > 100, -30)
    )
    method = (
        F.when(exact, "exact_keyword").when(partial, "partial_keyword")
        .when(F.col("is_last"), "last_column").when(few, "low_cardinality")
        .when(text, "non_numeric").otherwise("unknown")
    )
    return p.withColumn("score", score).withColumn("method", method)


def profile_target(p: DataFrame) -> DataFrame:
    """(dataset, target_column, method, score); no target unless the score passes 20."""
    best = best_per_dataset(profile_target_scores(p), F.col("score"))
    ok = F.col("score") > 20
    return best.select(
        "dataset",
        F.when(ok, F.col("name")).alias("target_column"),
        F.when(ok, F.col("method")).otherwise("none").alias("target_detection_method"),
        F.when(ok, F.col("score")).otherwise(0).alias("target_confidence"),
    )


# --- T2: detector used by the feature stage ----------------------------------------

def feature_target_scores(p: DataFrame) -> DataFrame:
    name, unique = F.col("name"), F.col("unique_count")
    hopeless = contains_any(name, FEATURE_BAD) | (F.col("missing_count") == F.col("row_count"))
    score = (
        points(contains_any(F.lower(name), FEATURE_TARGETS), 50)
        + points(F.col("is_last"), 30) + points(unique.between(2, 10), 20)
        + points(unique > 100, -50) + points(F.col("dtype") == "object", 10)
        + points(contains_any(name, [" ", "$", "%", "@"]), -20)
    )
    return p.withColumn("score", F.when(hopeless, F.lit(-100)).otherwise(score))


def feature_target(p: DataFrame) -> DataFrame:
    best = best_per_dataset(feature_target_scores(p), F.col("score"))
    return best.select("dataset", F.when(F.col("score") > 0, F.col("name")).alias("target_column"),
                       "score")


# --- T3: dispatcher score -----------------------------------------------------------

def dispatch_scores(p: DataFrame) -> DataFrame:
    """Adds is_numeric, is_id, is_date and the dispatcher's target score."""
    lowered, unique = F.lower(F.trim("name")), F.col("unique_count")
    numeric = is_numeric_label("dtype")
    p = (
        p.withColumn("is_numeric", numeric)
        .withColumn("is_id", id_rule("name", "dispatcher"))
        .withColumn("is_date", date_rule("name", F.col("dtype")))
    )
    score = (
        points(normalize_name("name").isin(DISPATCH_EXACT), 120)
        + points(contains_any(lowered, DISPATCH_CONTAINS), 80)
        + points(lowered.contains("chance") & lowered.contains("admit"), 140)
        + points(F.col("is_last"), 35) + points(~numeric, 15)
        + points(unique.between(2, 10), 20) + points(numeric & (unique > 10), 10)
        + points((unique > 1000) & ~numeric, -80)
    )
    return p.withColumn(
        "target_score",
        F.when(F.col("is_id") | F.col("is_date"), F.lit(-500))
        .when(contains_any(lowered, DISPATCH_TEXT), F.lit(-120))
        .otherwise(score),
    )


def dispatch_target(p: DataFrame) -> DataFrame:
    """Best candidate above -100, else the last plain column, else the last column."""
    scored = dispatch_scores(p)
    plain = ~F.col("is_id") & ~F.col("is_date")
    return scored.groupBy("dataset").agg(
        F.max_by("name", F.when(F.col("target_score") > -100,
                                F.struct("target_score", -F.col("ordinal")))).alias("_scored"),
        F.max_by("name", F.when(plain, F.col("ordinal"))).alias("_plain"),
        F.max_by("name", "ordinal").alias("_last"),
    ).select("dataset", F.coalesce("_scored", "_plain", "_last").alias("target_column"))


# --- T4: priority order ---------------------------------------------------------------

def priority_target(p: DataFrame, meta: DataFrame | None = None,
                    registry: DataFrame | None = None) -> DataFrame:
    """Profile target, else keyword, else last non-ID column, else the registered target."""
    keyword = F.lower(F.trim("name")).isin(PRIORITY_TARGETS)
    plain = ~id_rule("name", "generator")
    out = p.groupBy("dataset").agg(
        F.collect_set("name").alias("_names"),
        F.min_by("name", F.when(keyword, F.col("ordinal"))).alias("_keyword"),
        F.max_by("name", F.when(plain, F.col("ordinal"))).alias("_plain"),
    )
    choices = []
    if meta is not None:
        out = out.join(meta.select("dataset", F.col("target_column").alias("_meta")), "dataset", "left")
        choices.append(F.when(F.array_contains("_names", F.col("_meta")), F.col("_meta")))
    choices += [F.col("_keyword"), F.col("_plain")]
    if registry is not None:
        known = registry.select(F.col("dataset_name").alias("dataset"),
                                F.col("target_column").alias("_known"))
        out = out.join(known, "dataset", "left")
        choices.append(F.when(F.array_contains("_names", F.col("_known")), F.col("_known")))
    return out.select("dataset", F.coalesce(*choices).alias("target_column"))


# --- T6, T7: task type -----------------------------------------------------------------

def task_from_profile(numeric: Column, unique: Column) -> Column:
    return F.when(numeric & (unique > 10), "regression").otherwise("classification")


def task_type_schema(p: DataFrame, targets: DataFrame, numeric_labels: list[str] | None = None) -> DataFrame:
    """Task per dataset by type and cardinality of its target; unknown target: classification."""
    numeric = (is_numeric_label("dtype") if numeric_labels is None
               else F.lower("dtype").isin(numeric_labels))
    chosen = p.select("dataset", F.col("name").alias("target_column"),
                      task_from_profile(numeric, F.col("unique_count")).alias("task_type"))
    return targets.select("dataset", "target_column").join(
        chosen, ["dataset", "target_column"], "left"
    ).withColumn("task_type", F.coalesce("task_type", F.lit("classification")))


def task_type(df: DataFrame, target: str, ratio: float = 0.05, max_classes: int = 20) -> DataFrame:
    """Task from the target's data: one row (n, unique_count, all_integers, task_type)."""
    t = df.schema[target].dataType
    c = quoted(target)
    numeric = is_numeric_type(t) or isinstance(t, T.BooleanType)
    x = c.cast("double")
    counts = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count("*").alias("n"))
    whole = F.bool_and(F.col("v").cast("double") == F.floor(F.col("v").cast("double"))) \
        if numeric else F.lit(None).cast("boolean")
    stats = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"),
        F.count("*").alias("unique_count"), whole.alias("all_integers"))
    share = F.try_divide(F.col("unique_count").cast("double"), F.col("n"))
    rule = (
        F.when((F.col("n") == 0) | F.lit(not numeric), "classification")
        .when(share > ratio, "regression")
        .when(~F.col("all_integers"), "regression")
        .when(F.col("unique_count") <= max_classes, "classification")
        .otherwise("regression")
    )
    return stats.select(F.lit(target).alias("target_column"), "n", "unique_count",
                        "all_integers", rule.alias("task_type"))


# --- T9, T10: time columns ----------------------------------------------------------------

def parse_time(c: Column, t: T.DataType) -> Column:
    """Timestamp of a cell; text that does not parse gives null."""
    if is_time_type(t):
        return c.cast("timestamp")
    if is_numeric_type(t):
        return F.timestamp_micros((c.cast("double") / 1000).cast("long"))  # epoch nanoseconds
    tries = [c.try_cast("timestamp")] + [F.try_to_timestamp(c, F.lit(f)) for f in TEXT_FORMATS]
    return F.coalesce(*tries)


def named_like_time(df: DataFrame, words: list[str]) -> list[T.StructField]:
    return [f for f in df.schema.fields if any(w in f.name.lower() for w in words)]


def time_parse_shares(df: DataFrame) -> list[tuple[str, float]]:
    """Share of rows that parse as a time, for every column named like one (T10)."""
    fields = named_like_time(df, TIME_NAMES_FEATURES)
    if not fields:
        return []
    row = df.agg(*[F.avg(parse_time(quoted(f.name), f.dataType).isNotNull().cast("double"))
                   for f in fields]).first()
    return [(f.name, row[i]) for i, f in enumerate(fields)]


def detect_time_column(df: DataFrame) -> str | None:
    """First column named like a time where more than half of the rows parse."""
    return next((n for n, share in time_parse_shares(df) if share is not None and share > 0.5), None)


def detect_time_profile(df: DataFrame, position: Column, strict: bool = False) -> str | None:
    """First column named like a time whose first 10 values parse into 1900-2100 (T9)."""
    for f in named_like_time(df, TIME_NAMES_PROFILE):
        if strict and is_numeric_type(f.dataType):
            continue
        c = quoted(f.name)
        head = df.where(c.isNotNull()).select(c.alias("v"), position.alias("p")).orderBy("p").limit(10)
        year = F.year(parse_time(F.col("v"), f.dataType))
        lo, hi = head.agg(F.min(year), F.max(year)).first()
        if lo is not None and lo >= 1900 and hi <= 2100:
            return f.name
    return None


def step_label(micros: Column) -> Column:
    day = 86_400 * 1_000_000
    return (
        F.when(micros.isNull(), "unknown")
        .when(micros == day, "daily").when(micros == 7 * day, "weekly")
        .when(micros == 30 * day, "monthly").when(micros == 365 * day, "yearly")
        .otherwise("irregular")
    )


def segment_summaries(df: DataFrame, position: Column, value: Column, bad: Column) -> DataFrame:
    """Rows dealt out by ranges of a position, each range reduced in its order: one row of kind ``range`` and one for each step.

    A range tells its first and last value, whether values rise or fall throughout, its gaps and its bad cells; two
    neighbouring ranges fold into one by the step between them. Steps count differences of neighbouring values.
    """
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last, steps = TaskContext.get().partitionId(), 0, None, Counter()
        first, rising, falling, gaps, bad_cells = None, True, True, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(1)
            gaps, bad_cells = gaps + column.null_count, bad_cells + (pc.sum(batch.column(2)).as_py() or 0)
            known = column.is_valid().to_numpy(zero_copy_only=False)
            values = column.fill_null(0).to_numpy()
            if seen:  # the last row of the batch before comes first
                known, values = np.concatenate([[last is not None], known]), np.concatenate([[last or 0], values])
            else:
                first = column[0].as_py()
            both = known[1:] & known[:-1]
            step = (values[1:] - values[:-1])[both]
            rising, falling = rising and bool((step >= 0).all()), falling and bool((step <= 0).all())
            steps.update(dict(zip(*(x.tolist() for x in np.unique(step, return_counts=True)))))
            last, seen = column[-1].as_py(), seen + batch.num_rows
            if len(steps) > HELD_STEPS:
                yield rows(part, steps=steps)
                steps = Counter()
        yield rows(part, [(first, last, rising, falling, gaps, bad_cells)] if seen else [], steps)

    def rows(part: int, ranges: list[tuple] = (), steps: dict = ()) -> pa.RecordBatch:
        found = [("range", part, *r, None, None) for r in ranges] + [("step", part, *[None] * 6, *x) for x in dict(steps).items()]
        columns = list(zip(*found)) if found else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    schema = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("rising", pa.bool_()),
                        ("falling", pa.bool_()), ("gaps", pa.int64()), ("bad", pa.int64()), ("step", pa.int64()), ("n", pa.int64())])
    ordered = df.select(position.alias("at"), value.alias("value"), bad.cast("long").alias("bad")).orderBy("at")
    return ordered.mapInArrow(
        reduce, "kind string, part int, first long, last long, rising boolean, falling boolean, gaps long, bad long, step long, n long")


def time_steps(df: DataFrame, column: str, position: Column) -> DataFrame:
    """One row: parse/monotonic flags and the most common step (smallest on a tie). One sorted pass at every size."""
    t = df.schema[column].dataType
    stamp = F.unix_micros(parse_time(quoted(column), t))
    bad = (quoted(column).isNotNull() & stamp.isNull()) if isinstance(t, T.StringType) else F.lit(False)
    # Summaries are folded twice, so they are stored; the ranges are one row for each sorted part.
    parts = cut_lineage(segment_summaries(df, position, stamp, bad))
    before = F.lag("last").over(Window.orderBy("part"))
    ranges = parts.where("kind = 'range'").withColumn("seam", F.col("first") - before)
    steps = parts.where("kind = 'step'").select("step", "n").unionByName(
        ranges.where("seam IS NOT NULL").select(F.col("seam").alias("step"), F.lit(1).cast("long").alias("n")))
    top = steps.groupBy("step").agg(F.sum("n").alias("n")).agg(F.min_by("step", F.struct(-F.col("n"), "step")).alias("step"))
    ok = lambda flag, seam: F.coalesce(F.bool_and(F.col(flag) & F.coalesce(seam, F.lit(True))), F.lit(True))
    order = ranges.agg(
        ((F.coalesce(F.sum("gaps"), F.lit(0)) == 0)
         & (ok("rising", F.col("seam") >= 0) | ok("falling", F.col("seam") <= 0))).alias("monotonic"),
        F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")).first()
    row = [(column, order["monotonic"], top.first()["step"], order["bad"])]
    return df.sparkSession.createDataFrame(
        row, "time_column string, is_monotonic boolean, modal_step_micros long, bad_cells long",
    ).withColumn("step_label", step_label(F.col("modal_step_micros")))


def time_frequency(steps: DataFrame) -> DataFrame:
    """Frequency label: bad cells, then order, then the modal step decide."""
    return steps.select(
        "time_column",
        F.when(F.col("bad_cells") > 0, "invalid_format")
        .when(~F.col("is_monotonic"), "non_sequential")
        .otherwise(F.col("step_label")).alias("frequency"),
    )
