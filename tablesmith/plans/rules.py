"""Rule-based plan from profile rows (and, when given, from data facts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.names import id_rule
from tablesmith.operators.infer import GENERATOR_NUMERIC, priority_target, task_from_profile
from tablesmith.plans.contract import DEFAULT_SEED, DEFAULT_TEST_SIZE, ONE_HOT_LEVELS

CORRELATION_SCHEMA = "dataset string, ordinal int, col1 string, col2 string, correlation double"
LOW_SCHEMA = "dataset string, ordinal int, name string, correlation double"
BALANCE_SCHEMA = "dataset string, enabled boolean, reason string"


def ordered_names(flag: Column) -> Column:
    """Names of the flagged columns of a dataset in column order."""
    kept = F.array_sort(F.collect_list(F.when(flag, F.struct("ordinal", "name"))))
    return F.transform(kept, lambda s: s["name"])


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def rule_plans(
    p: DataFrame,
    targets: DataFrame | None = None,
    meta: DataFrame | None = None,
    registry: DataFrame | None = None,
    low: DataFrame | None = None,
    high: DataFrame | None = None,
    balance: DataFrame | None = None,
) -> DataFrame:
    """One plan row per dataset; a dataset without any target gives no row.

    ``low``, ``high`` and ``balance`` are the correlation and class-balance facts
    of the data; without them those parts of the plan stay empty. All inputs are
    catalog-sized: one row per column or per dataset.
    """
    low = low if low is not None else _empty(p, LOW_SCHEMA)
    high = high if high is not None else _empty(p, CORRELATION_SCHEMA)
    balance = balance if balance is not None else _empty(p, BALANCE_SCHEMA)
    targets = targets if targets is not None else priority_target(p, meta, registry)
    rows = p.join(targets.select("dataset", "target_column"), "dataset").where(
        F.col("target_column").isNotNull())

    is_target = F.col("name") == F.col("target_column")
    feature = ~is_target
    numeric = F.lower("dtype").isin(GENERATOR_NUMERIC)
    is_id = id_rule("name", "generator")
    used = feature & ~is_id
    gaps = F.col("missing_percentage") > 0
    few = F.col("unique_count") <= ONE_HOT_LEVELS
    plans = rows.groupBy("dataset", "target_column").agg(
        ordered_names(feature & is_id).alias("id_columns"),
        ordered_names(used & numeric).alias("numeric_columns"),
        ordered_names(used & ~numeric).alias("categorical_columns"),
        ordered_names(used & numeric & gaps).alias("impute_numeric"),
        ordered_names(used & ~numeric & gaps).alias("impute_categorical"),
        ordered_names(used & ~numeric & few).alias("one_hot_encode"),
        ordered_names(used & ~numeric & ~few).alias("label_encode"),
        ordered_names(used & numeric & F.col("is_skewed") & (F.col("min") >= 0)).alias("log_transform"),
        ordered_names(feature & F.col("is_skewed")).alias("skewed_columns"),
        ordered_names(feature & (F.col("outlier_count") > 0)).alias("columns_with_outliers"),
        F.max(F.when(is_target, task_from_profile(numeric, F.col("unique_count")))).alias("task_type"),
        F.max(F.when(is_target, F.col("unique_count"))).alias("target_levels"),
    )

    def by_ordinal(name: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("ordinal", name))), lambda s: s[name])

    lows = low.groupBy("dataset").agg(by_ordinal("name").alias("low_correlation_columns"))
    highs = high.groupBy("dataset").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "col1", "col2", "correlation")))
        .alias("pairs"))
    none = F.array().cast("array<string>")
    plans = plans.join(lows, "dataset", "left").join(highs, "dataset", "left").join(
        balance, "dataset", "left")
    second = F.filter(
        F.transform(F.coalesce("pairs", F.array().cast(
            "array<struct<ordinal:int,col1:string,col2:string,correlation:double>>")),
            lambda s: s["col2"]),
        lambda c: c != F.col("target_column"))
    drops = F.array_distinct(F.concat("id_columns", second))
    cls = F.col("task_type") == "classification"
    class_count = F.when(cls, F.col("target_levels"))
    return plans.select(
        "dataset", "target_column", "task_type", class_count.alias("class_count"),
        drops.alias("drop_columns"), "numeric_columns", "categorical_columns", "impute_numeric",
        "impute_categorical", "one_hot_encode", "label_encode",
        F.col("numeric_columns").alias("scale_columns"), "log_transform",
        F.struct(F.lit(True).alias("enabled"), F.lit("iqr").alias("method"),
                 F.lit(1.5).alias("multiplier"), F.col("columns_with_outliers")).alias("outlier_capping"),
        F.struct(F.lit(True).alias("enabled"), F.lit(0.05).alias("threshold"),
                 F.coalesce("low_correlation_columns", none).alias("columns")).alias("drop_low_correlation"),
        F.struct(F.lit(DEFAULT_TEST_SIZE).alias("test_size"), F.lit(DEFAULT_SEED).alias("random_state"),
                 cls.alias("stratify")).alias("split_strategy"),
        F.struct(F.coalesce("enabled", F.lit(False)).alias("enabled"),
                 F.coalesce("reason", F.lit("")).alias("reason"),
                 (class_count < 1000).alias("would_apply_if")).alias("smote"),
        F.struct(F.col("skewed_columns").alias("skewed_columns_by_skewness"),
                 F.col("pairs").alias("high_correlation_pairs"),
                 F.size("columns_with_outliers").cast("long").alias("outlier_columns_count"),
                 F.coalesce("low_correlation_columns", none).alias("low_correlation_columns"),
                 F.size("numeric_columns").cast("long").alias("total_numeric_columns"),
                 F.size("categorical_columns").cast("long").alias("total_categorical_columns"),
                 F.size(drops).cast("long").alias("columns_dropped")).alias("quality_metrics"),
    )


def rule_proposal() -> Column:
    """Rule plan fields renamed to the proposal layout of the contract."""
    return F.struct(
        "target_column", "task_type",
        F.struct(
            "drop_columns",
            F.struct(F.lit("median").alias("numeric_strategy"), F.col("impute_numeric").alias("numeric_columns"),
                     F.lit("most_frequent").alias("categorical_strategy"),
                     F.col("impute_categorical").alias("categorical_columns"),
                     F.lit(None).cast("string").alias("constant_value")).alias("imputation"),
            F.struct(F.col("one_hot_encode").alias("one_hot_columns"),
                     F.col("label_encode").alias("label_encoding_columns")).alias("encoding"),
            F.struct(F.lit("standard").alias("strategy"), F.col("scale_columns").alias("columns")).alias("scaling"),
            "log_transform",
        ).alias("preprocessing"),
        "split_strategy",
        F.struct(F.col("smote.enabled"), F.col("smote.reason")).alias("smote"),
        F.lit(True).alias("encoding_given"),
    )
