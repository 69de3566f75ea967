"""Column profiling: one row of statistics per column of a table.

Passes over the data, each a map-side aggregate unless noted:

1. counts and moments of every column,
2. exact distinct counts of all columns together: the only shuffle, of fixed-width
   keys after map-side combine; small tables read the quartiles off it,
3. quartiles of large tables by narrowing, without a shuffle of rows,
4. outlier counts against the literal IQR bounds.

Only the finished statistics, a few numbers per column, reach the driver.
"""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.numeric import (
    as_double, is_fractional_type, is_nested_type, is_numeric_type, observed, quoted, value_text,
)
from tablesmith.operators.ranks import (
    Scan, agg_row, exact_quantiles, interpolate, quantile_ranks, scan_columns,
)
from tablesmith.session import SINGLE_TASK_ROWS, free_names

OUTLIER_FACTOR = 1.5
SKEW_LIMIT = 1.0
SAMPLES = 3
HEAD = 100  # rows in which the first samples are looked for at once

PROFILE_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("spark_type", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("missing_count", T.LongType()),
    T.StructField("unique_count", T.LongType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("raw_skewness", T.DoubleType()),
    T.StructField("q1", T.DoubleType()),
    T.StructField("q3", T.DoubleType()),
    T.StructField("outlier_count", T.LongType()),
    T.StructField("sample_values", T.ArrayType(T.StringType())),
])


def dtype_label(t: T.DataType, has_missing: bool) -> str:
    """Type label of the profile: integers with gaps count as floats, other types as objects."""
    if is_fractional_type(t):
        return "float64"
    if isinstance(t, T.IntegralType):
        return "float64" if has_missing else "int64"
    if isinstance(t, T.BooleanType):
        return "object" if has_missing else "bool"
    return "object"


# --- distinct values ------------------------------------------------------------

def _cells(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Unpivot to (ordinal, typed value) so that numbers are not turned into text."""
    long_type = (T.IntegralType, T.BooleanType)

    def cell(i: int, f: T.StructField) -> Column:
        c = observed(f.name, f.dataType)
        whole = c.cast("long") if isinstance(f.dataType, long_type) else F.lit(None).cast("long")
        real = c.cast("double") if is_fractional_type(f.dataType) else F.lit(None).cast("double")
        other = not isinstance(f.dataType, long_type) and not is_fractional_type(f.dataType)
        text = value_text(c, f.dataType) if other else F.lit(None).cast("string")
        return F.when(c.isNotNull(), F.struct(
            F.lit(i).alias("ordinal"), whole.alias("whole"), real.alias("real"), text.alias("text")))

    # exploded first and filtered after: the filter of an array would leave generated code
    cells = F.array(*[cell(i, f) for i, f in enumerate(fields)])
    return df.select(F.explode(cells).alias("c")).where("c is not null").select("c.*")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(ordinal, whole, real, text, n): rows per distinct non-null value."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    return _cells(df, fields).groupBy("ordinal", "whole", "real", "text").agg(F.count("*").alias("n"))


def group_value(f: T.StructField) -> Column:
    """The cell in a form that can be grouped, in its own type wherever possible."""
    c = observed(f.name, f.dataType)
    return F.to_json(c) if isinstance(f.dataType, (T.MapType, T.VariantType)) else c


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> dict[str, int]:
    """Exact distinct non-null values per column."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    got = scan_columns(df, {f.name: Scan(group_value(f)) for f in fields})
    return {c: s.distinct for c, s in got.items()}


def sample_values(df: DataFrame, columns: list[str], position: Column,
                  k: int = SAMPLES, head: int = HEAD) -> DataFrame:
    """First ``k`` distinct values of each text column in the order of a numeric row position: (ordinal, rank, value).

    The first ``head`` rows, a range of positions, answer most columns. For a column with fewer distinct values there,
    each further value is the one at the smallest position that holds none of those found: bounded minima that combine
    before they are shuffled, for all open columns together. No distinct text is grouped.
    """
    fields = [f for f in df.schema.fields if f.name in columns]
    at, = free_names(df, "position")
    rows = df.select(*[value_text(observed(f.name, f.dataType), f.dataType).alias(f"v{i}") for i, f in enumerate(fields)], position.alias(at))
    last = rows.select(at).where(F.col(at).isNotNull()).orderBy(at).limit(head).agg(F.max(at), F.count(at)).first()
    found: dict[int, list[str]] = {i: [] for i in range(len(fields))}
    if last[1]:
        cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.col(f"v{i}").alias("v"), F.col(at).alias("at")) for i in range(len(fields))])
        early = rows.where(F.col(at) <= F.lit(last[0])).select(F.inline(cells)).where("v is not null")
        order = Window.partitionBy("ordinal").orderBy("at", "v")
        first = early.groupBy("ordinal", "v").agg(F.min("at").alias("at")).withColumn("rank", F.row_number().over(order))
        for r in first.where(F.col("rank") <= k).orderBy("ordinal", "rank").collect():  # k values a column at most
            found[r["ordinal"]].append(r["v"])
    open_ = [i for i in found if len(found[i]) < k] if last[1] == head else []
    while open_:
        other = {i: F.col(f"v{i}").isNotNull() & ~F.sha2(f"v{i}", 256).isin(
            *[hashlib.sha256(v.encode()).hexdigest() for v in found[i]], "") for i in open_}
        where = agg_row(rows, {i: F.min(F.when(c, F.col(at))) for i, c in other.items()})
        open_ = [i for i in open_ if where[i] is not None]
        if open_:
            spots = rows.where(F.col(at).isin(*{where[i] for i in open_}))
            value = agg_row(spots, {i: F.min(F.when(other[i] & (F.col(at) == F.lit(where[i])), F.col(f"v{i}"))) for i in open_})
            for i in open_:
                found[i].append(value[i])
        open_ = [i for i in open_ if len(found[i]) < k]
    return df.sparkSession.createDataFrame(
        [(i, rank, v) for i, values in found.items() for rank, v in enumerate(values, 1)], "ordinal int, rank int, value string")


# --- one table --------------------------------------------------------------------

def _numeric_fields(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if is_numeric_type(f.dataType)]


def profile_rows(
    df: DataFrame,
    dataset: str,
    position: Column | None = None,
    distinct: str = "exact",
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> list[tuple]:
    """Statistics of one table as PROFILE_SCHEMA tuples (as many as it has columns)."""
    fields = df.schema.fields
    numeric = _numeric_fields(df)
    exprs: dict[str, Column] = {"rows": F.count(F.lit(1))}
    for i, f in enumerate(fields):
        c = observed(f.name, f.dataType)
        exprs[f"{i}.present"] = F.count(c)
        if distinct == "approx":
            exprs[f"{i}.distinct"] = F.approx_count_distinct(value_text(c, f.dataType))
        if is_numeric_type(f.dataType):
            x = as_double(f.name, f.dataType)
            exprs |= {f"{i}.min": F.min(x), f"{i}.max": F.max(x), f"{i}.mean": F.avg(x),
                      f"{i}.skew": F.skewness(x)}
    base = agg_row(df, exprs)
    n_rows = base["rows"]

    at = {f.name: i for i, f in enumerate(fields)}
    xs = {f.name: as_double(f.name, f.dataType) for f in numeric}
    sizes = {name: base[f"{at[name]}.present"] for name in xs}
    one_task = n_rows <= single_task_rows
    probs = [0.25, 0.75]
    scans = {f.name: Scan(group_value(f), quantile_ranks(sizes[f.name], probs) if one_task and f.name in xs else [])
             for f in fields if distinct == "exact" or f.name in xs}
    scanned = scan_columns(df, scans) if distinct == "exact" or one_task else {}
    if one_task:
        quart = {c: interpolate(sizes[c], probs, scanned[c].values) if sizes[c] else [None, None] for c in xs}
    else:
        quart = exact_quantiles(df, xs, probs, sizes, n_rows, single_task_rows) if xs else {}

    bounds = {}
    for name, (q1, q3) in quart.items():
        if q1 is not None:
            reach = OUTLIER_FACTOR * (q3 - q1)
            bounds[name] = F.count_if((xs[name] < F.lit(q1 - reach)) | (xs[name] > F.lit(q3 + reach)))
    outliers = agg_row(df, bounds) if bounds else {}

    unique = {i: scanned[f.name].distinct if distinct == "exact" else base[f"{i}.distinct"]
              for i, f in enumerate(fields)}
    samples: dict[int, list] = {}
    texts = [f.name for f in fields if not is_numeric_type(f.dataType)
             and not isinstance(f.dataType, T.BooleanType) and not is_nested_type(f.dataType)]
    if position is not None and texts:
        for r in sample_values(df, texts, position).orderBy("ordinal", "rank").collect():
            samples.setdefault(at[texts[r["ordinal"]]], []).append(r["value"])

    out = []
    for i, f in enumerate(fields):
        present = base[f"{i}.present"]
        missing = n_rows - present
        row = [dataset, i, f.name, dtype_label(f.dataType, missing > 0),
               f.dataType.simpleString(), n_rows, missing, unique.get(i, 0)]
        if is_numeric_type(f.dataType) and present:
            q1, q3 = quart[f.name]
            row += [base[f"{i}.min"], base[f"{i}.max"], base[f"{i}.mean"],
                    sample_skew(base[f"{i}.skew"], present, base[f"{i}.min"] == base[f"{i}.max"]),
                    q1, q3, outliers.get(f.name, 0)]
        else:
            row += [None] * 7
        row.append(samples.get(i))
        out.append(tuple(row))
    return out


def sample_skew(g1: float | None, n: int, constant: bool) -> float | None:
    """Bias-corrected skewness; 0 for a constant column, none below three rows."""
    if n < 3:
        return None
    if constant:
        return 0.0
    return None if g1 is None else g1 * (float(n) * (n - 1)) ** 0.5 / (n - 2)


def finish_profile(rows: DataFrame) -> DataFrame:
    """Rounded percentages and flags on top of the raw statistics."""
    reach = (F.col("q3") - F.col("q1")) * OUTLIER_FACTOR
    total = F.col("row_count")
    return rows.select(
        "dataset", "ordinal", "name", "dtype", "spark_type", "row_count", "missing_count",
        F.coalesce(F.round(F.try_divide(F.col("missing_count") * 100.0, total), 2), F.lit(0.0))
        .alias("missing_percentage"),
        "unique_count", "min", "max", "mean",
        F.round("raw_skewness", 4).alias("skewness"),
        F.coalesce(F.abs("raw_skewness") > SKEW_LIMIT, F.lit(False)).alias("is_skewed"),
        "q1", "q3", (F.col("q1") - reach).alias("lower_bound"), (F.col("q3") + reach).alias("upper_bound"),
        "outlier_count",
        F.round(F.try_divide(F.col("outlier_count") * 100.0, total), 2).alias("outlier_percentage"),
        "sample_values",
        (F.col("ordinal") == F.max("ordinal").over(Window.partitionBy("dataset"))).alias("is_last"),
    )


def profile(
    df: DataFrame,
    dataset: str = "dataset",
    position: Column | None = None,
    distinct: str = "exact",
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """Profile of one table: a DataFrame with one row per column."""
    rows = profile_rows(df, dataset, position, distinct, single_task_rows)
    return finish_profile(df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA))


def profile_many(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    positions: dict[str, Column] | None = None,
    parallel: int = 8,
    distinct: str = "exact",
) -> tuple[DataFrame, DataFrame]:
    """Profiles of many tables and a frame of failures, one bad table never stops the rest.

    A small driver pool submits the jobs; the work itself runs on the executors.
    """
    positions = positions or {}

    def one(item: tuple[str, DataFrame]):
        name, df = item
        try:
            return profile_rows(df, name, positions.get(name), distinct), None
        except Exception as e:  # recorded as a row, like any other per-table failure
            return [], (name, str(e))

    with ThreadPoolExecutor(parallel) as pool:
        done = list(pool.map(one, tables.items()))
    rows = [r for got, _ in done for r in got]
    failures = [f for _, f in done if f]
    return (
        finish_profile(spark.createDataFrame(rows, PROFILE_SCHEMA)),
        spark.createDataFrame(failures, "dataset string, error string"),
    )


def quick_profile(df: DataFrame) -> DataFrame:
    """Type, missing and distinct counts only."""
    fields = df.schema.fields
    nulls = agg_row(df, {str(i): F.count_if(observed(f.name, f.dataType).isNull())
                         for i, f in enumerate(fields)})
    unique = distinct_counts(df)
    return df.sparkSession.createDataFrame(
        [(i, f.name, dtype_label(f.dataType, nulls[str(i)] > 0), nulls[str(i)], unique[f.name])
         for i, f in enumerate(fields)],
        "ordinal int, name string, dtype string, missing_count long, unique_count long",
    )


# --- class shares ------------------------------------------------------------------

def target_distribution(df: DataFrame, target: str, top: int = 5) -> DataFrame:
    """Most frequent classes with their share of all rows; equal counts by value."""
    counts = df.groupBy(quoted(target).alias("value")).agg(F.count("*").alias("n"))
    total = df.count()
    return (
        counts.where(F.col("value").isNotNull())
        .orderBy(F.desc("n"), F.asc("value")).limit(top)
        .select("value", "n", F.round(F.col("n") * 100.0 / F.lit(total), 1).alias("pct"))
    )


def dataset_totals(profile_df: DataFrame) -> DataFrame:
    """Totals over the columns of each table and the ordered skew / outlier name lists."""
    def names(flag: Column) -> Column:
        kept = F.array_sort(F.collect_list(F.when(flag, F.struct("ordinal", "name"))))
        return F.transform(kept, lambda s: s["name"])

    cells = F.first("row_count") * F.count("*")
    return profile_df.groupBy("dataset").agg(
        F.first("row_count").alias("row_count"),
        F.count("*").alias("column_count"),
        F.sum("missing_count").alias("total_missing_values"),
        F.coalesce(F.try_divide(F.sum("missing_count") * 100.0, cells), F.lit(0.0))
        .alias("missing_share"),
        F.coalesce(F.sum("outlier_count"), F.lit(0).cast("long")).alias("total_outliers"),
        names(F.col("is_skewed")).alias("skewed_columns"),
        names(F.col("outlier_count") > 0).alias("columns_with_outliers"),
    )


def quality_score(totals: DataFrame) -> DataFrame:
    """100 minus penalties for missing cells, outliers and a missing target, floored at 0."""
    outlier_share = F.coalesce(
        F.try_divide(F.col("total_outliers") * 100.0, F.col("row_count")), F.lit(0.0))
    score = (
        F.lit(100.0)
        - F.least(F.lit(30.0), F.col("missing_share"))
        - F.least(F.lit(20.0), outlier_share / 2)
        - F.when(F.col("target_column").isNull(), 25.0).otherwise(0.0)
    )
    return totals.withColumn("quality_score", F.round(F.greatest(F.lit(0.0), score), 1)).withColumn(
        "missing_percentage", F.round("missing_share", 2))


