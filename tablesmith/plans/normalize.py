"""Bring any proposed plan into the contract, check it, and choose between proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.operators.infer import dispatch_scores, dispatch_target
from tablesmith.plans import contract as C
from tablesmith.plans.repair import parse_outputs
from tablesmith.plans.rules import rule_plans, rule_proposal
from tablesmith.session import cut_lineage


def dataset_facts(p: DataFrame) -> DataFrame:
    """One row per dataset: its columns in order with the facts the rules ask for."""
    scored = dispatch_scores(p)
    fact = F.struct(
        "ordinal", "name", "is_numeric", (F.col("is_id") | F.col("is_date")).alias("is_id_or_date"),
        (F.col("missing_percentage") > 0).alias("has_gaps"), "target_score", "unique_count")
    columns = scored.groupBy("dataset").agg(F.array_sort(F.collect_list(fact)).alias("cols"))
    best = dispatch_target(p).select("dataset", F.col("target_column").alias("best_target"))
    return columns.join(best, "dataset")


def _fact(name: Column) -> Column:
    """The fact struct of one column, null when it does not exist."""
    return F.get(F.filter("cols", lambda x: x["name"] == name), F.lit(0))


def _names(cond) -> Column:
    return F.transform(F.filter("cols", cond), lambda x: x["name"])


def _valid(names: Column, kind: str | None = None, drop: Column | None = None) -> Column:
    """Existing, non-target, right-typed, not dropped columns; first mention wins.

    NULL stays NULL: an absent list is not an empty one.
    """
    def keep(c: Column) -> Column:
        def same(x: Column) -> Column:
            ok = x["name"] == c
            if kind == "numeric":
                ok = ok & x["is_numeric"]
            elif kind == "categorical":
                ok = ok & ~x["is_numeric"]
            return ok

        ok = F.exists("cols", same) & (c != F.col("target"))
        return ok if drop is None else ok & ~F.array_contains(drop, c)

    return F.array_distinct(F.filter(names, keep))


def filter_columns(df: DataFrame, names: Column, target: Column, kind: str | None = None,
                   excluded: Column | None = None, out: str = "filtered") -> DataFrame:
    """Keep the listed names that exist in ``cols`` (see ``dataset_facts``), have the right
    type and are neither the target nor excluded; an absent list gives an empty one."""
    kept = F.coalesce(_valid(names, kind, excluded), F.array().cast("array<string>"))
    return df.withColumn("target", target).withColumn(out, kept).drop("target")


def _allowed(value: Column, allowed: list[str], default: str) -> Column:
    v = F.lower(value)
    return F.when(v.isin(allowed), v).otherwise(default)


def normalize(proposals: DataFrame) -> DataFrame:
    """(dataset, cols, best_target, proposal, source, parse_status) to contract columns."""
    raw, pre = F.col("proposal"), F.col("proposal.preprocessing")
    none = F.array().cast("array<string>")
    wanted = F.nullif(raw["target_column"], F.lit(""))
    known = F.when(F.exists("cols", lambda x: x["name"] == wanted), wanted)
    df = proposals.withColumn("target", F.coalesce(known, F.col("best_target")))
    df = df.withColumn("target_fact", _fact(F.col("target")))
    df = df.withColumn("task", F.when(
        F.col("target_fact.is_numeric") & (F.col("target_fact.unique_count") > 10), "regression",
    ).otherwise("classification"))

    not_target = lambda x: x["name"] != F.col("target")
    plain = lambda x: not_target(x) & ~x["is_id_or_date"]
    df = df.withColumn("drop_columns", F.coalesce(
        _valid(pre["drop_columns"]), _names(lambda x: not_target(x) & x["is_id_or_date"])))
    dropped = F.col("drop_columns")

    def default(cond) -> Column:
        return F.filter(_names(cond), lambda c: ~F.array_contains(dropped, c))

    imp, enc, sca = pre["imputation"], pre["encoding"], pre["scaling"]
    strategy = F.lower(imp["categorical_strategy"])
    strategy = F.when(strategy == "mode", "most_frequent").otherwise(strategy)
    scaling = _allowed(sca["strategy"], C.SCALING_STRATEGIES, "standard")
    given = F.coalesce(raw["encoding_given"], F.lit(False))
    one_hot = F.when(given, F.coalesce(_valid(enc["one_hot_columns"], "categorical", dropped), none)
                     ).otherwise(none)
    label = F.when(given, F.coalesce(_valid(enc["label_encoding_columns"], "categorical", dropped), none)
                   ).otherwise(default(lambda x: plain(x) & ~x["is_numeric"]))
    df = df.withColumn("one_hot_columns", one_hot)
    return df.select(
        *[c for c in ("dataset", "cols", "best_target", "source", "parse_status", "priority") if c in proposals.columns],
        F.col("task").alias("task_type"), F.col("target").alias("target_column"),
        "drop_columns",
        _allowed(imp["numeric_strategy"], C.NUMERIC_STRATEGIES, "median").alias("numeric_strategy"),
        F.coalesce(_valid(imp["numeric_columns"], "numeric", dropped),
                   default(lambda x: plain(x) & x["is_numeric"] & x["has_gaps"])).alias("numeric_columns"),
        F.when(strategy.isin(C.CATEGORICAL_STRATEGIES), strategy).otherwise("most_frequent")
        .alias("categorical_strategy"),
        F.coalesce(_valid(imp["categorical_columns"], "categorical", dropped),
                   default(lambda x: plain(x) & ~x["is_numeric"] & x["has_gaps"]))
        .alias("categorical_columns"),
        F.coalesce(imp["constant_value"], F.lit(C.DEFAULT_FILL)).alias("constant_value"),
        "one_hot_columns",
        F.array_except(label, F.col("one_hot_columns")).alias("label_encoding_columns"),
        scaling.alias("scaling_strategy"),
        F.when(scaling == "none", none).otherwise(F.coalesce(
            _valid(sca["columns"], "numeric", dropped),
            default(lambda x: plain(x) & x["is_numeric"]))).alias("scaling_columns"),
        F.coalesce(_valid(pre["log_transform"], "numeric", dropped), none).alias("log_transform"),
        F.coalesce(raw["split_strategy"]["test_size"], F.lit(C.DEFAULT_TEST_SIZE)).alias("test_size"),
        F.coalesce(raw["split_strategy"]["random_state"], F.lit(C.DEFAULT_SEED)).alias("random_state"),
        F.coalesce(raw["split_strategy"]["stratify"], F.col("task") == "classification").alias("stratify"),
        F.coalesce(raw["smote"]["enabled"], F.lit(False)).alias("smote_enabled"),
        F.coalesce(raw["smote"]["reason"], F.lit(C.DEFAULT_SMOTE_REASON)).alias("smote_reason"),
        F.col("target_fact.target_score").alias("target_score"),
        F.col("task").alias("task_type_inferred_from_schema"),
    )


def plan_struct() -> Column:
    """Normalized columns as the nested plan of the contract."""
    return F.struct(
        F.col("dataset").alias("dataset_name"), "task_type", "target_column",
        F.struct(
            "drop_columns",
            F.struct("numeric_strategy", "numeric_columns", "categorical_strategy",
                     "categorical_columns", "constant_value").alias("imputation"),
            F.struct("one_hot_columns", "label_encoding_columns").alias("encoding"),
            F.struct(F.col("scaling_strategy").alias("strategy"),
                     F.col("scaling_columns").alias("columns")).alias("scaling"),
            "log_transform",
        ).alias("preprocessing"),
        F.struct("test_size", "random_state", "stratify").alias("split_strategy"),
        F.struct(F.col("smote_enabled").alias("enabled"), F.col("smote_reason").alias("reason")).alias("smote"),
        F.struct("source", "parse_status", "target_score", "task_type_inferred_from_schema").alias("_debug"),
    )


# --- check ----------------------------------------------------------------------------

PROTECTED = ["drop_columns", "numeric_columns", "categorical_columns", "one_hot_columns",
             "label_encoding_columns", "scaling_columns"]


def plan_reasons(strict: Column) -> Column:
    """Why a plan is refused; an empty array means it is valid. ``strict`` also refuses weak parses."""
    target, fact, best = F.col("target_column"), _fact(F.col("target_column")), _fact(F.col("best_target"))
    expected = F.when(fact["is_numeric"] & (fact["unique_count"] > 10), "regression").otherwise("classification")
    exists = fact.isNotNull()
    best_score = F.coalesce(best["target_score"], fact["target_score"])
    reasons = [
        F.when(target.isNull() | (target == ""), "Missing target_column")
        .when(~exists, F.concat(F.lit("Target column does not exist in schema: "), target))
        .when(fact["is_id_or_date"], F.concat(F.lit("Target looks like ID/date column: "), target)),
        F.when(F.col("task_type").isNull() | ~F.col("task_type").isin(C.TASKS),
               F.concat(F.lit("Invalid task_type: "), F.coalesce("task_type", F.lit("None")))),
        F.when(exists & ~F.col("task_type").eqNullSafe(expected),
               F.concat(F.lit("Task type mismatch: got "), F.coalesce("task_type", F.lit("None")),
                        F.lit(", expected "), expected)),
        F.when(exists & best.isNotNull() & (best_score >= 80) & (fact["target_score"] < best_score - 60),
               F.concat(F.lit("Target '"), target, F.lit("' is much weaker than likely target '"),
                        F.col("best_target"), F.lit("'"))),
    ]
    reasons += [F.when(F.array_contains(c, target),
                       F.concat(F.lit("Target column appears inside preprocessing list: "), target))
                for c in PROTECTED]
    reasons.append(F.when(strict & F.col("parse_status").isin(C.WEAK_STATUSES),
                          F.concat(F.lit("Transformer output incomplete or weak: "), F.col("parse_status"))))
    return F.array_compact(F.array(*reasons))


def validate_plans(plans: DataFrame, strict: bool | Column = False) -> DataFrame:
    strict = F.lit(strict) if isinstance(strict, bool) else strict
    return plans.withColumn("reasons", plan_reasons(strict)).withColumn("is_valid", F.size("reasons") == 0)


# --- proposals ----------------------------------------------------------------------------

def model_proposals(facts: DataFrame, outputs: DataFrame) -> DataFrame:
    """Parsed model texts (dataset, raw_output) as proposals; nested fields win where given."""
    parsed = parse_outputs(facts.join(outputs.select("dataset", "raw_output"), "dataset", "left"))
    nested = F.from_json("parsed", C.MODEL_OUTPUT)
    m, n = F.col("m"), F.col("m.preprocessing_plan")
    inner = F.get_json_object("parsed", "$.preprocessing_plan.preprocessing")
    use_inner = inner.startswith("{")
    encoding = F.get_json_object(
        F.when(use_inner, inner).otherwise(F.get_json_object("parsed", "$.preprocessing")), "$.encoding")
    names = F.json_object_keys(encoding)
    given = F.array_contains(names, "one_hot_columns") | F.array_contains(names, "label_encoding_columns")
    first = lambda f: F.coalesce(F.nullif(m[f], F.lit("")), F.nullif(n[f], F.lit("")))
    return parsed.withColumn("m", nested).select(
        "dataset", "cols", "best_target", F.lit("transformer").alias("source"), "parse_status",
        F.struct(
            first("target_column").alias("target_column"), first("task_type").alias("task_type"),
            F.when(use_inner, n["preprocessing"]).otherwise(m["preprocessing"]).alias("preprocessing"),
            F.coalesce(n["split_strategy"], m["split_strategy"]).alias("split_strategy"),
            F.coalesce(n["smote"], m["smote"]).alias("smote"),
            F.coalesce(given, F.lit(False)).alias("encoding_given"),
        ).cast(C.PROPOSAL).alias("proposal"),
    )


def rule_proposals(facts: DataFrame, rules: DataFrame) -> DataFrame:
    return facts.join(rules.select("dataset", rule_proposal().alias("proposal")), "dataset").select(
        "dataset", "cols", "best_target", F.lit("plan_generator_fallback").alias("source"),
        F.lit("plan_generator_output").alias("parse_status"), F.col("proposal").cast(C.PROPOSAL))


def default_proposals(facts: DataFrame) -> DataFrame:
    return facts.select(
        "dataset", "cols", "best_target", F.lit("internal_safe_fallback").alias("source"),
        F.lit("internal_defaults").alias("parse_status"), F.lit(None).cast(C.PROPOSAL).alias("proposal"))


def default_plans(p: DataFrame) -> DataFrame:
    return normalize(default_proposals(dataset_facts(p)))


# --- cascade --------------------------------------------------------------------------------

DECISIONS = ["accepted_transformer_plan", "used_plan_generator_fallback", "used_internal_safe_fallback"]


def dispatch(
    p: DataFrame,
    outputs: DataFrame | None = None,
    rules: DataFrame | None = None,
) -> DataFrame:
    """Final plan per dataset: model plan if valid, else rule plan if valid, else defaults.

    All datasets go through in one job; the candidates are rows ranked by priority.
    """
    facts = cut_lineage(dataset_facts(p))  # three branches start from it
    outputs = outputs if outputs is not None else p.sparkSession.createDataFrame(
        [], "dataset string, raw_output string")
    rules = rules if rules is not None else rule_plans(p)
    proposals = (
        model_proposals(facts, outputs).withColumn("priority", F.lit(1))
        .unionByName(rule_proposals(facts, rules).withColumn("priority", F.lit(2)))
        .unionByName(default_proposals(facts).withColumn("priority", F.lit(3)))
    )
    ranked = validate_plans(normalize(proposals), F.col("priority") == 1).withColumn(
        "is_valid", F.col("is_valid") | (F.col("priority") == 3))  # the defaults are never refused
    fields = [c for c in ranked.columns if c != "dataset"]
    chosen = ranked.groupBy("dataset").agg(
        F.min_by(F.struct(*fields), F.when(F.col("is_valid"), F.col("priority"))).alias("plan"),
        F.max(F.when(F.col("priority") == 1, F.array_join("reasons", "; "))).alias("model_reasons"),
        F.max(F.when(F.col("priority") == 2, F.array_join("reasons", "; "))).alias("rule_reasons"),
    )
    level = F.col("plan.priority")
    why = (
        F.when(level == 2, F.col("model_reasons"))
        .when(level == 3, F.when(F.col("rule_reasons").isNull(),
                                 F.concat(F.lit("PlanGenerator fallback failed: No target column for '"),
                                          F.col("dataset"), F.lit("'")))
              .otherwise(F.concat(F.lit("PlanGenerator fallback invalid: "), F.col("rule_reasons"))))
    )
    # What the model said stays beside the plan, whichever proposal was taken.
    said = outputs.groupBy("dataset").agg(F.max("raw_output").alias("raw_output"))
    return chosen.join(said, "dataset", "left").select(
        "dataset", *[F.col(f"plan.{c}").alias(c) for c in fields if c not in ("priority", "is_valid", "reasons")], "raw_output",
        F.get(F.array(*map(F.lit, DECISIONS)), level - 1).alias("final_decision"),
        why.alias("fallback_reason"),
        F.when(level > 1, F.col("model_reasons")).alias("rejection_reasons"),
    )
