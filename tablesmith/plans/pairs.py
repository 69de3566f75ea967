"""Prompt/plan pairs assembled from the artifacts of each dataset version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.names import id_rule, strip_data_suffix
from tablesmith.functions.numeric import float_text
from tablesmith.operators.infer import (
    GENERATOR_NUMERIC, PAIR_NUMERIC, dispatch_target, is_numeric_label, task_type_schema,
)
from tablesmith.session import stored
from tablesmith.sources.artifacts import json_text

LABELS = ["full_structured", "stats_focused", "task_focused"]
PAIR_ONE_HOT_LEVELS = 10


# --- text forms ------------------------------------------------------------------------

def quoted_text(c: Column) -> Column:
    """A string as a quoted token in list style."""
    body = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    single = body.contains("'")
    plain = F.concat(F.lit("'"), body, F.lit("'"))
    return (F.when(single & ~body.contains('"'), F.concat(F.lit('"'), body, F.lit('"')))
            .when(single, F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
            .otherwise(plain))


def list_text(values: Column, n: int) -> Column:
    """First n values as ``['a', 'b']``; an absent list is ``[]``."""
    shown = F.transform(F.slice(F.coalesce(values, F.array().cast("array<string>")), 1, n), quoted_text)
    return F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))


def lines_of(line: Column, flag: Column | None = None, sep: str = "\n") -> Column:
    """Lines of a dataset joined in column order."""
    item = F.struct("ordinal", line.alias("t"))
    kept = F.collect_list(item if flag is None else F.when(flag, item))
    return F.array_join(F.transform(F.array_sort(kept), lambda s: s["t"]), sep)


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def or_none(c: Column) -> Column:
    return F.when(c == "", "none").otherwise(c)


# --- prompts -----------------------------------------------------------------------------

def plan_prompt(p: DataFrame) -> DataFrame:
    """(dataset, prompt): description handed to a plan-writing model."""
    numeric = is_numeric_label("dtype")
    show = lambda c: F.coalesce(float_text(F.col(c)), F.lit("unknown"))
    head = text("  - ", F.col("name"), ": ", F.col("dtype"), ", ", F.col("unique_count").cast("string"),
                " unique, ", float_text(F.col("missing_percentage")), "% missing, ")
    line = F.when(numeric, text(head, "mean=", show("mean"), ", min=", show("min"), ", max=", show("max"))
                  ).otherwise(text(head, "samples=", list_text(F.col("sample_values"), 3)))
    task = task_type_schema(p, dispatch_target(p)).select("dataset", "task_type")
    body = p.groupBy("dataset").agg(
        F.first("row_count").alias("rows"), F.count("*").alias("cols"),
        lines_of(F.col("name"), None, ", ").alias("names"), lines_of(line).alias("details"))
    return body.join(task, "dataset").select("dataset", text(
        "Generate preprocessing steps for a ", F.col("task_type"), " task.\n\nDataset: ", F.col("dataset"),
        "\nShape: ", F.col("rows").cast("string"), " rows x ", F.col("cols").cast("string"),
        " columns\n\nAll columns: ", F.col("names"), "\n\nColumn details:\n", F.col("details")).alias("prompt"))


def with_target(p: DataFrame, targets: DataFrame) -> DataFrame:
    t = targets.select("dataset", "target_column")
    return p.join(t, "dataset", "left").withColumn(
        "is_target", F.coalesce(F.col("name") == F.col("target_column"), F.lit(False)))


def pair_prompts(metadata: DataFrame, p: DataFrame, targets: DataFrame) -> DataFrame:
    """(dataset, prompt_v1, prompt_v2, prompt_v3).

    ``metadata`` holds dataset, original_filename, rows and columns_count. A dataset
    without a target shows ``None`` in its place.
    """
    q = with_target(p, targets)
    pct = F.col("missing_percentage")
    unique = F.col("unique_count").cast("string")
    gaps = F.when(pct > 0, text(", ", float_text(pct), "% missing")).otherwise("")
    tag = F.when(F.col("is_target"), " [TARGET]").otherwise("")
    start = text("  - ", F.col("name"), tag, ": ", F.col("dtype"), ", ")
    samples = F.when(F.size(F.coalesce("sample_values", F.array().cast("array<string>"))) > 0,
                     text(", samples=", list_text(F.col("sample_values"), 3))).otherwise("")
    line = F.when(F.col("min").isNotNull(), text(
        start, "min=", float_text(F.col("min")), ", max=", float_text(F.col("max")), ", mean=",
        float_text(F.round("mean", 2)), ", ", unique, " unique", gaps)
    ).otherwise(text(start, unique, " unique", gaps, samples))

    feature = ~F.col("is_target")
    stat_numeric = F.lower("dtype").isin(GENERATOR_NUMERIC)
    size = lambda flag: F.count_if(flag).cast("string")
    target_of = lambda c: F.max(F.when(F.col("is_target"), F.col(c)))
    body = q.groupBy("dataset").agg(
        F.max("target_column").alias("target"),
        lines_of(line).alias("details"),
        lines_of(F.col("name"), feature & stat_numeric, ", ").alias("numeric"),
        size(feature & stat_numeric).alias("n_numeric"),
        lines_of(F.col("name"), feature & ~stat_numeric, ", ").alias("categorical"),
        size(feature & ~stat_numeric).alias("n_categorical"),
        lines_of(text(F.col("name"), " (", float_text(pct), "%)"), feature & (pct > 0), ", ").alias("gaps"),
        lines_of(F.col("name"), feature, ", ").alias("features"),
        target_of("dtype").alias("t_dtype"), target_of("unique_count").alias("t_unique"),
        F.max_by("sample_values", F.when(F.col("is_target"), 1)).alias("t_samples"),
    ).join(metadata.select("dataset", "original_filename", "rows", "columns_count"), "dataset")
    target = F.coalesce("target", F.lit("None"))
    rows, cols = F.col("rows").cast("string"), F.col("columns_count").cast("string")
    file = F.col("original_filename")
    regression = F.lower("t_dtype").isin(PAIR_NUMERIC) & (F.col("t_unique") > 10)
    class_line = F.when(F.size("t_samples") > 0, text(
        "\nTarget class samples: ", list_text(F.col("t_samples"), 5))).otherwise("")
    v1 = text("Generate a comprehensive preprocessing plan for the following dataset.\n\nDataset: ", file,
              "\nRows: ", rows, " | Columns: ", cols, "\nTarget column: ", target, "\n\nColumn details:\n",
              F.col("details"))
    v2 = text("Create a machine learning preprocessing plan.\n\nFile: ", file, " | Rows: ", rows, " | Target: ",
              target, "\nNumeric columns (", F.col("n_numeric"), "): ", or_none(F.col("numeric")),
              "\nCategorical columns (", F.col("n_categorical"), "): ", or_none(F.col("categorical")),
              "\nColumns with missing values: ", or_none(F.col("gaps")))
    v3 = text("Generate preprocessing steps for a ",
              F.when(F.coalesce(regression, F.lit(False)), "regression").otherwise("classification"),
              " task.\n\nDataset: ", file, "\nShape: ", rows, " rows x ", cols, " columns\nPrediction target: '",
              target, "' (dtype=", F.coalesce("t_dtype", F.lit("unknown")), ", ",
              F.coalesce(F.col("t_unique").cast("string"), F.lit("?")), " unique values)", class_line,
              "\n\nAll feature columns: ", F.col("features"))
    return body.select("dataset", v1.alias("prompt_v1"), v2.alias("prompt_v2"), v3.alias("prompt_v3"))


# --- artifact match ---------------------------------------------------------------------------

SUMMARY_FILE = "validation_summary.json"
PIECES = 1_000_000  # substrings of a task, about 100 bytes each


def _pieces(name: Column, lengths: list[int]) -> Column:
    """Every substring of the given lengths."""
    def cut(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(name) - n + 1)
        return F.when(F.length(name) >= n, F.transform(starts, lambda i: F.substring(name, i, F.lit(n)))
                      ).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*[cut(n) for n in lengths])))


def _contained(wanted: DataFrame, key: str, files: DataFrame, name: Column) -> DataFrame:
    """(version_id, file_name): the first file name that contains the key.

    Containment as an equality join on the substrings that have the length of some
    key. A substring keeps its first file name before the join, so one that many names share gives each
    dataset one row; no document is carried. Names, and then substrings, are dealt to as many tasks as their number
    asks for, however few parts the input has; names that share a substring are combined where they lie. The result is stored.
    """
    lengths = sorted(r[0] for r in wanted.select(F.length(key)).distinct().collect() if r[0])
    if not lengths:
        return files.select(F.lit("").alias("version_id"), "file_name").limit(0)
    held = sum((F.greatest(F.length(name) - n + 1, F.lit(0)).cast("long") for n in lengths), F.lit(0))
    tasks = -(-(files.agg(F.sum(held)).first()[0] or 0) // PIECES) or 1
    deal = F.pmod(F.xxhash64("file_name"), F.lit(16 * tasks)).alias("deal")
    names = files.select("file_name", name.alias("name"), deal).repartition(tasks, "deal").distinct()
    first = F.min("file_name").alias("file_name")
    some = names.select("deal", "file_name", F.explode(_pieces(F.col("name"), lengths)).alias("piece")).groupBy("deal", "piece").agg(first)
    parts = some.repartition(tasks, "piece").groupBy("piece").agg(first)
    return stored(wanted.join(parts, F.col(key) == F.col("piece")).groupBy("version_id").agg(F.min("file_name").alias("file_name")))


def match_artifacts(metadata: DataFrame, files: DataFrame, fold: bool = False) -> DataFrame:
    """(version_id, file_name, json) of the artifact of each dataset version, if any.

    A file name holding the version id wins; else one holding the dataset name
    (separators removed on both sides with ``fold``); the first name decides. The summary of a validation run is no artifact.
    """
    files = files.where(~F.lower("file_name").endswith(SUMMARY_FILE))
    wanted = metadata.select("version_id", F.lower(
        F.regexp_replace("dataset", "[ _-]", "") if fold else F.translate("dataset", " ", "_")).alias("clean"))
    lowered = F.lower("file_name")
    named = F.regexp_replace(F.regexp_replace(lowered, r"\.[^.]*$", ""), "[ _-]", "") if fold else lowered
    by_version = _contained(wanted, "version_id", files, F.col("file_name"))
    rest = wanted.join(by_version, "version_id", "left_anti")
    by_name = _contained(rest, "clean", files, named)
    bodies = files.groupBy("file_name").agg(F.min("json").alias("json"))
    return by_version.unionByName(by_name).join(bodies, "file_name").select("version_id", "file_name", "json")


# --- comprehensive record ------------------------------------------------------------------------

def derived_preprocessing(q: DataFrame) -> DataFrame:
    """(dataset, preprocessing JSON) for datasets without a plan; one-hot up to 10 levels."""
    feature = ~F.col("is_target")
    is_id = id_rule("name", "pairs")
    used = feature & ~is_id
    numeric = F.lower("dtype").isin(PAIR_NUMERIC)
    gaps, few = F.col("missing_percentage") > 0, F.col("unique_count") <= PAIR_ONE_HOT_LEVELS

    def names(flag: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct("ordinal", "name")))),
                           lambda s: s["name"])

    return q.groupBy("dataset").agg(F.to_json(F.struct(
        names(feature & is_id).alias("drop_columns"),
        F.struct(F.lit("median").alias("numeric_strategy"), names(used & numeric & gaps).alias("numeric_columns"),
                 F.lit("most_frequent").alias("categorical_strategy"),
                 names(used & ~numeric & gaps).alias("categorical_columns")).alias("imputation"),
        F.struct(names(used & ~numeric & few).alias("one_hot_columns"),
                 names(used & ~numeric & ~few).alias("label_encoding_columns")).alias("encoding"),
        F.struct(F.lit("standard").alias("strategy"), names(used & numeric).alias("columns")).alias("scaling"),
    )).alias("derived"))


def column_summaries(q: DataFrame) -> DataFrame:
    """(dataset, columns JSON): one object per column, number and sample keys only where known."""
    common = ["name", "dtype", "missing_percentage", "unique_count", "is_target"]
    one = F.to_json(F.struct(*common, "min", "max", "mean", "sample_values"))
    return q.groupBy("dataset").agg(F.concat(F.lit("["), lines_of(one, None, ","), F.lit("]")).alias("columns_json"))


def _object(*fields: tuple[str, Column]) -> Column:
    """JSON object text from (name, JSON text) pairs."""
    parts = [F.concat(F.lit(f'"{n}":'), F.coalesce(v, F.lit("null"))) for n, v in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _s(c: Column) -> Column:
    return F.when(c.isNotNull(), json_text(c))


def _keep(json: Column, path: str, default: str) -> Column:
    """Sub-document of an artifact, or a default JSON text."""
    got = F.get_json_object(json, f"$.{path}")
    return F.coalesce(F.when(got.rlike(r"^\s*[\[{]"), got), F.lit(default))


def comprehensive_plans(metadata: DataFrame, p: DataFrame, meta: DataFrame, validation: DataFrame | None = None,
                        transformation: DataFrame | None = None, plans: DataFrame | None = None) -> DataFrame:
    """(dataset, version_id, output): every artifact of a dataset merged into one JSON text.

    ``validation``, ``transformation`` and ``plans`` are (version_id, json) frames.
    """
    def with_json(df: DataFrame, extra: DataFrame | None, name: str) -> DataFrame:
        if extra is None:
            return df.withColumn(name, F.lit(None).cast("string"))
        return df.join(extra.select("version_id", F.col("json").alias(name)), "version_id", "left")

    q = with_target(p, meta)
    facts = q.groupBy("dataset").agg(
        F.max(F.when(F.col("is_target"), F.lower("dtype").isin(PAIR_NUMERIC) & (F.col("unique_count") > 10))
              .cast("int")).alias("reg"))
    df = metadata.join(column_summaries(q), "dataset").join(derived_preprocessing(q), "dataset").join(
        facts, "dataset").join(meta.select(
            "dataset", "target_column", "target_detection_method", F.col("column_count").alias("m_columns"),
            F.col("row_count").alias("m_rows")), "dataset", "left")
    for extra, name in ((validation, "v"), (transformation, "t"), (plans, "pl")):
        df = with_json(df, extra, name)
    v, t, pl = F.col("v"), F.col("t"), F.col("pl")
    field = F.get_json_object
    task = F.when(pl.isNotNull(), F.coalesce(field(pl, "$.task_type"), F.lit("classification"))).otherwise(
        F.when(F.col("reg") == 1, "regression").otherwise("classification"))
    no = lambda c: F.when(c.isNull(), "false").otherwise("true")
    number = lambda c: F.col(c).cast("string")
    ingestion = _object(
        *[(n, _s(F.col(n))) for n in ("original_filename", "stored_filename", "stored_path", "version_id",
                                      "timestamp", "file_type")],
        ("rows", number("rows")), ("columns_count", number("columns_count")), ("columns", F.to_json("columns")))
    schema = _object(
        ("target_column", _s(F.col("target_column"))), ("target_detection_method", _s(F.col("target_detection_method"))),
        ("task_type", _s(task)), ("total_columns", number("m_columns")), ("row_count", number("m_rows")),
        ("columns", F.col("columns_json")))
    checked = _object(
        ("performed", no(v)), ("is_valid", field(v, "$.is_valid")), ("errors", _keep(v, "errors", "[]")),
        ("validation_status", F.when(v.isNull(), F.lit('"unknown"')).otherwise(_s(field(v, "$.validation_status")))))
    changed = _object(
        ("performed", no(t)),
        ("status", F.when(t.isNull(), F.lit('"unknown"')).otherwise(_s(field(t, "$.status")))),
        ("duplicates_removed", F.coalesce(field(t, "$.duplicates_removed"), F.lit("0"))),
        ("constant_columns_dropped", _keep(t, "constant_columns_dropped", "[]")),
        ("steps_applied", _keep(t, "steps", "[]")),
        ("original_shape", field(t, "$.original_shape")), ("final_shape", field(t, "$.final_shape")))
    has_plan = pl.isNotNull()
    split_default = F.concat(F.lit('{"test_size":0.2,"random_state":42,"stratify":'),
                             (task == "classification").cast("string"), F.lit("}"))
    smote_default = F.lit('{"enabled":false,"reason":"Cannot infer class imbalance from schema only"}')
    given = lambda path, default: F.when(has_plan, F.coalesce(
        field(pl, f"$.{path}"), default)).otherwise("{}")
    plan = _object(
        ("target_column", _s(F.col("target_column"))), ("task_type", _s(task)),
        ("input_summary", given("input_summary", F.lit("{}"))),
        ("preprocessing", F.when(has_plan, _keep(pl, "preprocessing", "{}")).otherwise(F.col("derived"))),
        ("split_strategy", given("split_strategy", split_default)), ("smote", given("smote", smote_default)))
    return df.select("dataset", "version_id", _object(
        ("ingestion", ingestion), ("schema", schema), ("validation", checked), ("transformation", changed),
        ("preprocessing_plan", plan), ("export_paths", given("export_paths", F.lit("{}")))).alias("output"))


# --- pairs ---------------------------------------------------------------------------------------

def dataset_label(filename: Column | str) -> Column:
    return strip_data_suffix(filename)


def build_pairs(prompts: DataFrame, outputs: DataFrame) -> DataFrame:
    """Three rows per dataset version with a profile: (id, dataset, version_id, variation, input, output)."""
    three = F.explode(F.array(*[
        F.struct(F.lit(label).alias("prompt_variation"), F.col(f"prompt_v{i + 1}").alias("input"))
        for i, label in enumerate(LABELS)]))
    return outputs.join(prompts, "dataset").select("dataset", "version_id", "output", three.alias("x")).select(
        F.concat_ws("_", "version_id", "x.prompt_variation").alias("id"), "dataset", "version_id",
        "x.prompt_variation", "x.input", "output")


def pair_coverage(metadata: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """(dataset, version_id, schema_found, validation_found, transformation_found, plan_found)."""
    out = metadata.select("dataset", "version_id")
    for kind in ("schema", "validation", "transformation", "plan"):
        hit = found[kind].where(F.col("json").isNotNull()).select(
            "version_id", F.lit(True).alias(f"{kind}_found"))
        out = out.join(hit, "version_id", "left").withColumn(
            f"{kind}_found", F.coalesce(f"{kind}_found", F.lit(False)))
    return out


def pair_summary(pairs: DataFrame) -> DataFrame:
    """(prompt_variation, pairs, datasets) per variation."""
    return pairs.groupBy("prompt_variation").agg(
        F.count("*").alias("pairs"), F.count_distinct("dataset").alias("datasets"))
