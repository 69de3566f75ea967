"""Plan, prompt, pair and model-output queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import (
    GAPS, TABLES, all_tables, columns_of, gappy, gappy_sql, plain, profile_sql, sql_id, table,
)
from checks.profiling import SCORED, T1, T3, T4
from tablesmith.facade import data_facts, dataset_meta
from tablesmith.operators.infer import profile_target
from tablesmith.operators.profile import profile, profile_many
from tablesmith.plans import normalize as nz
from tablesmith.plans import pairs as pr
from tablesmith.plans.repair import close_json, parse_outputs, rescue_fields
from tablesmith.plans.rules import rule_plans

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


RELATIONS = {t: gappy_sql(t) if t in GAPS else t for t in TABLES}
PROF = profile_sql(RELATIONS)


def profiles(spark, sf):
    tables = {t: gappy(spark, sf, t) if t in GAPS else df for t, df in all_tables(spark, sf).items()}
    return profile_many(spark, tables)[0]


def names_sql(cond: str) -> str:
    return f"coalesce(string_agg(name, ',' ORDER BY ordinal) FILTER (WHERE {cond}), '')"


# --- rule plans --------------------------------------------------------------------------------

GNUM = "dtype IN ('int64', 'float64')"
GID = sql_id("name", "generator")
RULE_LISTS = {
    "drop_columns": f"feat AND {GID}",
    "numeric_columns": f"feat AND NOT {GID} AND {GNUM}",
    "categorical_columns": f"feat AND NOT {GID} AND NOT {GNUM}",
    "impute_numeric": f"feat AND NOT {GID} AND {GNUM} AND pct > 0",
    "impute_categorical": f"feat AND NOT {GID} AND NOT {GNUM} AND pct > 0",
    "one_hot_encode": f"feat AND NOT {GID} AND NOT {GNUM} AND uniq <= 15",
    "label_encode": f"feat AND NOT {GID} AND NOT {GNUM} AND uniq > 15",
    "log_transform": f"feat AND NOT {GID} AND {GNUM} AND is_skewed AND mn >= 0",
    "outlier_columns": "feat AND outl > 0",
}
RULES = f"""rules AS (SELECT dataset, target_column, max(CASE WHEN NOT feat THEN CASE WHEN {GNUM} AND uniq > 10
    THEN 'regression' ELSE 'classification' END END) AS task_type, max(CASE WHEN NOT feat THEN uniq END) AS levels,
    {', '.join(f'{names_sql(c)} AS {n}' for n, c in RULE_LISTS.items())},
    count(*) FILTER (WHERE feat AND outl > 0) AS n_outl, count(*) FILTER (WHERE {RULE_LISTS['numeric_columns']}) AS n_num,
    count(*) FILTER (WHERE {RULE_LISTS['categorical_columns']}) AS n_cat,
    count(*) FILTER (WHERE {RULE_LISTS['drop_columns']}) AS n_drop, {names_sql('feat AND is_skewed')} AS skewed
    FROM (SELECT prof.*, t4.target_column, name <> t4.target_column AS feat FROM prof JOIN t4 USING (dataset))
    GROUP BY dataset, target_column)"""


def rules_of(spark, sf):
    p = profiles(spark, sf)
    return p, rule_plans(p, meta=profile_target(p))


@query("plan_rules", f"""WITH {PROF}, {T1}, {T4}, {RULES} SELECT dataset, target_column, task_type,
    CASE WHEN task_type = 'classification' THEN levels END::BIGINT AS class_count, {', '.join(RULE_LISTS)} FROM rules""")
def plan_rules(spark, sf):
    r = rules_of(spark, sf)[1]
    return plain(r.select("dataset", "target_column", "task_type", "class_count", *[
        F.col("outlier_capping.columns_with_outliers").alias(n) if n == "outlier_columns" else F.col(n)
        for n in RULE_LISTS]))


@query("plan_quality_metrics", f"""WITH {PROF}, {T1}, {T4}, {RULES} SELECT dataset, skewed AS skewed_columns,
    n_outl::BIGINT AS outlier_columns_count, n_num::BIGINT AS total_numeric_columns,
    n_cat::BIGINT AS total_categorical_columns, n_drop::BIGINT AS columns_dropped FROM rules""")
def quality_metrics(spark, sf):
    q = "quality_metrics."
    return plain(rules_of(spark, sf)[1].select(
        "dataset", F.col(q + "skewed_columns_by_skewness").alias("skewed_columns"), q + "outlier_columns_count",
        q + "total_numeric_columns", q + "total_categorical_columns", q + "columns_dropped"))


LINE_REL = f"(SELECT *, l_extendedprice * (1 - l_discount) AS l_revenue, l_tax * 2 AS l_copy FROM {gappy_sql('lineitem')})"
LINE_NUMERIC = [c for c, k in columns_of("lineitem") if k in ("int", "double")] + ["l_revenue", "l_copy"]


def corr_rows_sql(pairs: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS c1, '{b}' AS c2, corr({a}::DOUBLE, {b}::DOUBLE) AS r FROM {LINE_REL}" for a, b in pairs)


_all = [(a, b) for i, a in enumerate(LINE_NUMERIC) for b in LINE_NUMERIC[i + 1:] if b != "l_extendedprice"]
_low = [(c, "l_extendedprice") for c in LINE_NUMERIC if c != "l_extendedprice"]


@query("plan_rules_data", f"""SELECT 'lineitem' AS dataset, 'l_extendedprice' AS target_column,
    (SELECT string_agg(DISTINCT c2, ',' ORDER BY c2) FROM ({corr_rows_sql(_all)}) WHERE abs(r) > 0.9) AS sorted_drops,
    (SELECT string_agg(c1, ',' ORDER BY c1) FROM ({corr_rows_sql(_low)}) WHERE abs(r) < 0.05) AS low_columns,
    max(n)::DOUBLE / min(n) > 3 AS smote_enabled
    FROM (SELECT count(*) AS n FROM {LINE_REL} WHERE l_extendedprice IS NOT NULL GROUP BY l_extendedprice)""")
def plan_rules_data(spark, sf):
    """Rule plan with the correlation and balance facts of the data itself."""
    df = gappy(spark, sf, "lineitem").withColumns({
        "l_revenue": F.expr("l_extendedprice * (1 - l_discount)"), "l_copy": F.expr("l_tax * 2")})
    goal = spark.createDataFrame([("lineitem", "l_extendedprice")], "dataset string, target_column string")
    plan = rule_plans(profile(df, "lineitem"), goal, **data_facts(df, "lineitem", "l_extendedprice"))
    return plain(plan.select(
        "dataset", "target_column", F.array_sort("drop_columns").alias("sorted_drops"),
        F.array_sort("drop_low_correlation.columns").alias("low_columns"), F.col("smote.enabled").alias("smote_enabled")))


# --- proposals derived from the tables ----------------------------------------------------------------

def outputs_of(p):
    """A model text per dataset: last column as target, first column dropped, the text itself
    cut, wrapped or whole depending on the number of columns."""
    names = lambda flag: F.transform(F.array_sort(F.collect_list(
        F.when(flag, F.struct("ordinal", "name")))), lambda s: s["name"])
    body = p.groupBy("dataset").agg(
        F.count("*").alias("k"), F.to_json(F.struct(
            F.max_by("name", "ordinal").alias("target_column"), F.lit("regression").alias("task_type"),
            F.struct(
                F.array(F.min_by("name", "ordinal"), F.lit("no_such_column")).alias("drop_columns"),
                F.struct(names(F.col("unique_count") <= 5).alias("one_hot_columns")).alias("encoding"),
                F.struct(F.lit("minmax").alias("strategy"), names(F.lit(True)).alias("columns")).alias("scaling"),
            ).alias("preprocessing"))).alias("j"))
    cut = F.expr("left(j, length(j) - 1)")
    return body.select("dataset", F.when(F.col("k") == 2, cut).when(F.col("k") == 3, F.concat(F.lit("plan: "), "j", F.lit(" ok")))
                       .when(F.col("k") == 4, F.lit(None)).otherwise(F.col("j")).alias("raw_output"))


MODEL_STATUS = ("CASE k WHEN 2 THEN 'json_bracket_repair' WHEN 3 THEN 'json_regex_block' "
                "WHEN 4 THEN 'fallback_no_model_output' ELSE 'json_direct' END")
# facts of each proposal: target, the dropped column and the lists that survive the whitelist
NORM = f"""ctx AS (SELECT dataset, count(*) AS k, arg_max(name, ordinal) AS last_name, arg_min(name, ordinal) AS first_name
    FROM scored GROUP BY dataset), mdl AS (SELECT s.*, k, {MODEL_STATUS} AS status, best,
    CASE WHEN k = 4 THEN best ELSE last_name END AS tgt, CASE WHEN k <> 4 THEN first_name END AS dropped
    FROM scored s JOIN ctx USING (dataset) JOIN t3 USING (dataset)),
    feats AS (SELECT *, name <> tgt AS feat, CASE WHEN k = 4 THEN id_or_date AND name <> tgt
    ELSE name = dropped AND name <> tgt END AS gone FROM mdl),
    norm AS (SELECT dataset, any_value(k) AS k, any_value(status) AS status, any_value(best) AS best, any_value(tgt) AS target_column,
    max(CASE WHEN NOT feat THEN CASE WHEN is_num AND uniq > 10 THEN 'regression' ELSE 'classification' END END) AS task_type,
    max(CASE WHEN NOT feat THEN score END) AS target_score, bool_or(NOT feat AND id_or_date) AS target_bad,
    max(CASE WHEN name = best THEN score END) AS best_score,
    {names_sql('gone')} AS drop_columns,
    {names_sql('feat AND NOT id_or_date AND is_num AND pct > 0 AND NOT gone')} AS numeric_columns,
    {names_sql('feat AND NOT id_or_date AND NOT is_num AND pct > 0 AND NOT gone')} AS categorical_columns,
    {names_sql('k <> 4 AND feat AND NOT is_num AND uniq <= 5 AND NOT gone')} AS one_hot_columns,
    {names_sql('k = 4 AND feat AND NOT id_or_date AND NOT is_num AND NOT gone')} AS label_encoding_columns,
    {names_sql('feat AND is_num AND NOT gone AND (k <> 4 OR NOT id_or_date)')} AS scaling_columns
    FROM feats GROUP BY dataset)"""
NORM_OUT = ["dataset", "target_column", "task_type", "drop_columns", "numeric_columns", "categorical_columns",
            "one_hot_columns", "label_encoding_columns", "scaling_columns"]


def model_plans(spark, sf):
    p = profiles(spark, sf)
    facts = nz.dataset_facts(p)
    return p, nz.normalize(nz.model_proposals(facts, outputs_of(p)))


@query("normalize_plan", f"""WITH {PROF}, {SCORED}, {T3}, {NORM} SELECT {', '.join(NORM_OUT)},
    CASE WHEN k = 4 THEN 'standard' ELSE 'minmax' END AS scaling_strategy, status AS parse_status,
    target_score::BIGINT AS target_score, task_type = 'classification' AS stratify FROM norm""")
def normalize_plan(spark, sf):
    plans = model_plans(spark, sf)[1]
    return plain(plans.select(*NORM_OUT, "scaling_strategy", "parse_status", "target_score", "stratify"))


REASONS = """concat_ws('; ', CASE WHEN target_bad THEN 'Target looks like ID/date column: ' || target_column END,
    CASE WHEN best_score >= 80 AND target_score < best_score - 60 THEN 'Target ''' || target_column
    || ''' is much weaker than likely target ''' || best || '''' END,
    CASE WHEN status = 'fallback_no_model_output' THEN 'Transformer output incomplete or weak: ' || status END)"""


@query("validate_plan", f"""WITH {PROF}, {SCORED}, {T3}, {NORM} SELECT dataset, {REASONS} = '' AS is_valid,
    {REASONS} AS reasons FROM norm""")
def validate_plan(spark, sf):
    checked = nz.validate_plans(model_plans(spark, sf)[1], strict=True)
    return plain(checked.select("dataset", "is_valid", F.array_join("reasons", "; ").alias("reasons")))


@query("plan_default", f"""WITH {PROF}, {SCORED}, {T3}, f AS (SELECT *, name <> best AS feat FROM scored JOIN t3 USING (dataset))
    SELECT dataset, any_value(best) AS target_column, {names_sql('feat AND id_or_date')} AS drop_columns,
    {names_sql('feat AND NOT id_or_date AND is_num AND pct > 0')} AS numeric_columns,
    {names_sql('feat AND NOT id_or_date AND NOT is_num AND pct > 0')} AS categorical_columns, '' AS one_hot_columns,
    {names_sql('feat AND NOT id_or_date AND NOT is_num')} AS label_encoding_columns,
    {names_sql('feat AND NOT id_or_date AND is_num')} AS scaling_columns FROM f GROUP BY dataset""")
def plan_default(spark, sf):
    return plain(nz.default_plans(profiles(spark, sf)).select(*[c for c in NORM_OUT if c != "task_type"]))


@query("filter_columns", f"""WITH {PROF}, {SCORED}, {T3}, f AS (SELECT *, name <> best AS feat FROM scored JOIN t3 USING (dataset))
    SELECT dataset, {names_sql('feat AND is_num')} AS numeric_names, {names_sql('feat AND NOT is_num')} AS categorical_names
    FROM f GROUP BY dataset""")
def filter_columns(spark, sf):
    facts = nz.dataset_facts(profiles(spark, sf))
    names = F.transform("cols", lambda x: x["name"])
    wanted = F.concat(F.array(F.lit("no_such_column")), names, names)
    one = nz.filter_columns(facts, wanted, F.col("best_target"), "numeric", out="numeric_names")
    two = nz.filter_columns(one, wanted, F.col("best_target"), "categorical", out="categorical_names")
    return plain(two.select("dataset", "numeric_names", "categorical_names"))


CASCADE = f"""rt AS (SELECT t4.dataset, t4.target_column AS rtgt, s.score AS rscore, s.id_or_date AS rbad,
    CASE WHEN s.is_num AND s.uniq > 10 THEN 'regression' ELSE 'classification' END AS rtask
    FROM t4 JOIN scored s ON s.dataset = t4.dataset AND s.name = t4.target_column),
    bt AS (SELECT dataset, CASE WHEN is_num AND uniq > 10 THEN 'regression' ELSE 'classification' END AS btask
    FROM scored JOIN t3 USING (dataset) WHERE name = best),
    casc AS (SELECT norm.*, rt.*, btask, {REASONS} AS why, CASE WHEN {REASONS} = '' THEN 1
    WHEN NOT rbad AND NOT (best_score >= 80 AND rscore < best_score - 60) THEN 2 ELSE 3 END AS lvl
    FROM norm JOIN rt USING (dataset) JOIN bt USING (dataset))"""


@query("dispatch_plans", f"""WITH {PROF}, {T1}, {T4}, {SCORED}, {T3}, {NORM}, {CASCADE} SELECT dataset,
    CASE lvl WHEN 1 THEN 'accepted_transformer_plan' WHEN 2 THEN 'used_plan_generator_fallback'
    ELSE 'used_internal_safe_fallback' END AS final_decision,
    CASE lvl WHEN 1 THEN target_column WHEN 2 THEN rtgt ELSE best END AS target_column,
    CASE lvl WHEN 1 THEN task_type WHEN 2 THEN rtask ELSE btask END AS task_type,
    CASE lvl WHEN 1 THEN status WHEN 2 THEN 'plan_generator_output' ELSE 'internal_defaults' END AS parse_status,
    CASE WHEN lvl > 1 THEN why END AS rejection_reasons FROM casc""")
def dispatch_plans(spark, sf):
    p = profiles(spark, sf)
    final = nz.dispatch(p, outputs_of(p), rule_plans(p, meta=profile_target(p)))
    return plain(final.select("dataset", "final_decision", "target_column", "task_type", "parse_status",
                              "rejection_reasons"))


# --- model outputs ----------------------------------------------------------------------------------------

RAW = """(SELECT event_id, event_type, props, CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN left(props, length(props) - 1)
    WHEN 2 THEN 'Plan: ' || props || ' done' WHEN 3 THEN '"preprocessing_plan": ' || props || ', and more'
    WHEN 4 THEN '"target_column": "' || event_type || '", "task_type": "classification"'
    WHEN 5 THEN event_type END AS raw_output FROM events)"""
KEY = "regexp_extract(props, '([0-9]+)', 1)"


def raw_outputs(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("events")
    return spark.sql(f"SELECT * FROM {RAW}")


@query("parse_outputs", f"""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'json_direct' WHEN 1 THEN 'json_bracket_repair'
    WHEN 2 THEN 'json_regex_block' WHEN 3 THEN 'json_preprocessing_plan_block' WHEN 4 THEN 'regex_critical_fields'
    WHEN 5 THEN 'fallback_parse_failed' ELSE 'fallback_no_model_output' END AS parse_status,
    CASE WHEN event_id % 7 IN (0, 1, 2) THEN {KEY} END AS k, CASE WHEN event_id % 7 = 3 THEN {KEY} END AS nested_k,
    CASE WHEN event_id % 7 = 4 THEN event_type END AS target_column FROM {RAW}""")
def parsed_outputs(spark, sf):
    got = parse_outputs(raw_outputs(spark, sf))
    return plain(got.select("event_id", "parse_status", F.get_json_object("parsed", "$.k").alias("k"),
                            F.get_json_object("parsed", "$.preprocessing_plan.k").alias("nested_k"),
                            F.get_json_object("parsed", "$.target_column").alias("target_column")))


@query("json_close", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ELSE left(props, length(props) - 1) || '}' END
    AS closed FROM events""")
def json_closed(spark, sf):
    text = F.expr("CASE WHEN event_id % 2 = 0 THEN props ELSE left(props, length(props) - 1) END")
    return plain(table(spark, sf, "events").select("event_id", close_json(text).alias("closed")))


@query("json_rescue", f"""SELECT event_id, CASE WHEN event_id % 7 = 4 THEN event_type END AS target_column,
    CASE WHEN event_id % 7 = 4 THEN 'classification' END AS task_type FROM {RAW}""")
def json_rescued(spark, sf):
    target, task = rescue_fields(F.col("raw_output"))
    return plain(raw_outputs(spark, sf).select("event_id", target.alias("target_column"), task.alias("task_type")))


# --- prompts and pairs ---------------------------------------------------------------------------------------

KEYED = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
         "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey * 10 + l_linenumber", "events": "event_id",
         "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id",
         "conversations": "conv_id * 1000 + turn"}
KEYED_REL = {t: RELATIONS[t] for t in KEYED}
SAMPLES = "samples AS (" + " UNION ALL ".join(
    f"""SELECT '{t}' AS dataset, '{c}' AS name, string_agg('''' || replace(v, chr(10), '\\n') || '''', ', ' ORDER BY rk) AS shown FROM (
    SELECT {c}::VARCHAR AS v, row_number() OVER (ORDER BY min({k}), {c}::VARCHAR) AS rk FROM {RELATIONS[t]}
    WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rk <= 3"""
    for t, k in KEYED.items() for c, kind in columns_of(t) if kind in ("str", "ts")) + ")"
PSAMP = f"{profile_sql(KEYED_REL)}, {SAMPLES}, ps AS (SELECT prof.*, shown FROM prof LEFT JOIN samples USING (dataset, name))"


def keyed_profiles(spark, sf):
    tables = {t: gappy(spark, sf, t) if t in GAPS else table(spark, sf, t) for t in KEYED}
    p = profile_many(spark, tables, {t: F.expr(k) for t, k in KEYED.items()})[0]
    # sums run in another order on another engine: show the mean to 3 digits on both sides
    return p.withColumn("mean", F.round("mean", 3))


@query("prompt_plan", f"""WITH {PSAMP}, {SCORED}, {T3}, task AS (SELECT dataset, CASE WHEN is_num AND uniq > 10 THEN 'regression'
    ELSE 'classification' END AS task FROM scored JOIN t3 USING (dataset) WHERE name = best), body AS (
    SELECT dataset, any_value(n) AS n, count(*) AS k, string_agg(name, ', ' ORDER BY ordinal) AS names, string_agg(
    '  - ' || name || ': ' || dtype || ', ' || uniq || ' unique, ' || (pct::DOUBLE)::VARCHAR || '% missing, ' ||
    CASE WHEN dtype = 'object' THEN 'samples=[' || coalesce(shown, '') || ']' ELSE 'mean=' || round(mean, 3)::VARCHAR
    || ', min=' || mn::VARCHAR || ', max=' || mx::VARCHAR END, chr(10) ORDER BY ordinal) AS details FROM ps GROUP BY dataset)
    SELECT dataset, 'Generate preprocessing steps for a ' || task || ' task.' || chr(10) || chr(10) || 'Dataset: ' || dataset
    || chr(10) || 'Shape: ' || n || ' rows x ' || k || ' columns' || chr(10) || chr(10) || 'All columns: ' || names
    || chr(10) || chr(10) || 'Column details:' || chr(10) || details AS prompt FROM body JOIN task USING (dataset)""")
def prompt_plan(spark, sf):
    return plain(pr.plan_prompt(keyed_profiles(spark, sf)))


PROMPTS = f"""{PSAMP}, {T1}, pt AS (SELECT ps.*, target_column, coalesce(name = target_column, FALSE) AS is_t
    FROM ps JOIN t1 USING (dataset)), pb AS (SELECT dataset, any_value(n) AS n, count(*) AS k,
    coalesce(any_value(target_column), 'None') AS tgt, string_agg('  - ' || name || CASE WHEN is_t THEN ' [TARGET]' ELSE '' END
    || ': ' || dtype || ', ' || CASE WHEN mn IS NOT NULL THEN 'min=' || mn::VARCHAR || ', max=' || mx::VARCHAR || ', mean='
    || round(round(mean, 3)::DECIMAL(28, 3), 2)::DOUBLE::VARCHAR || ', ' || uniq || ' unique' || CASE WHEN pct > 0 THEN ', ' || (pct::DOUBLE)::VARCHAR
    || '% missing' ELSE '' END ELSE uniq || ' unique' || CASE WHEN pct > 0 THEN ', ' || (pct::DOUBLE)::VARCHAR || '% missing'
    ELSE '' END || coalesce(', samples=[' || shown || ']', '') END, chr(10) ORDER BY ordinal) AS details,
    string_agg(name, ', ' ORDER BY ordinal) FILTER (WHERE NOT is_t AND {GNUM}) AS nums,
    count(*) FILTER (WHERE NOT is_t AND {GNUM}) AS n_nums,
    string_agg(name, ', ' ORDER BY ordinal) FILTER (WHERE NOT is_t AND NOT {GNUM}) AS cats,
    count(*) FILTER (WHERE NOT is_t AND NOT {GNUM}) AS n_cats,
    string_agg(name || ' (' || (pct::DOUBLE)::VARCHAR || '%)', ', ' ORDER BY ordinal) FILTER (WHERE NOT is_t AND pct > 0) AS gaps,
    coalesce(string_agg(name, ', ' ORDER BY ordinal) FILTER (WHERE NOT is_t), '') AS feats,
    any_value(dtype) FILTER (WHERE is_t) AS t_dtype, any_value(uniq) FILTER (WHERE is_t) AS t_uniq,
    any_value(shown) FILTER (WHERE is_t) AS t_shown FROM pt GROUP BY dataset),
    prompts AS (SELECT dataset, 'Generate a comprehensive preprocessing plan for the following dataset.' || chr(10) || chr(10)
    || 'Dataset: ' || dataset || '.csv' || chr(10) || 'Rows: ' || n || ' | Columns: ' || k || chr(10) || 'Target column: '
    || tgt || chr(10) || chr(10) || 'Column details:' || chr(10) || details AS v1,
    'Create a machine learning preprocessing plan.' || chr(10) || chr(10) || 'File: ' || dataset || '.csv | Rows: ' || n
    || ' | Target: ' || tgt || chr(10) || 'Numeric columns (' || n_nums || '): ' || coalesce(nums, 'none') || chr(10)
    || 'Categorical columns (' || n_cats || '): ' || coalesce(cats, 'none') || chr(10) || 'Columns with missing values: '
    || coalesce(gaps, 'none') AS v2,
    'Generate preprocessing steps for a ' || CASE WHEN t_dtype IN ('int64', 'float64') AND t_uniq > 10 THEN 'regression'
    ELSE 'classification' END || ' task.' || chr(10) || chr(10) || 'Dataset: ' || dataset || '.csv' || chr(10) || 'Shape: '
    || n || ' rows x ' || k || ' columns' || chr(10) || 'Prediction target: ''' || tgt || ''' (dtype='
    || coalesce(t_dtype, 'unknown') || ', ' || coalesce(t_uniq::VARCHAR, '?') || ' unique values)'
    || coalesce(chr(10) || 'Target class samples: [' || t_shown || ']', '') || chr(10) || chr(10)
    || 'All feature columns: ' || feats AS v3 FROM pb)"""


def metadata_of(p):
    """Landing records of the given tables, as the landing step would write them."""
    return p.groupBy("dataset").agg(
        F.first("row_count").alias("rows"), F.count("*").alias("columns_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda s: s["name"]).alias("columns"),
    ).select("dataset", F.concat("dataset", F.lit(".csv")).alias("original_filename"),
             F.concat(F.lit("stored_"), "dataset").alias("stored_filename"),
             F.concat(F.lit("raw/"), "dataset").alias("stored_path"),
             F.substring(F.md5("dataset"), 1, 8).alias("version_id"), F.lit("20240101_000000").alias("timestamp"),
             F.lit(".csv").alias("file_type"), "rows", "columns_count", "columns")


def prompts_of(spark, sf):
    p = keyed_profiles(spark, sf)
    return p, pr.pair_prompts(metadata_of(p), p, profile_target(p))


for _v in (1, 2, 3):
    @query(f"prompt_v{_v}", f"WITH {PROMPTS} SELECT dataset, v{_v} AS prompt FROM prompts")
    def _prompt(spark, sf, v=_v):
        return plain(prompts_of(spark, sf)[1].select("dataset", F.col(f"prompt_v{v}").alias("prompt")))


def outputs_for(p):
    return pr.comprehensive_plans(metadata_of(p), p, dataset_meta(p))


ONE_HOT = f"dtype = 'object' AND uniq <= 10 AND NOT is_t AND NOT {sql_id('name', 'pairs')}"


@query("comprehensive_plan", f"""WITH {profile_sql(KEYED_REL)}, {T1}, f AS (SELECT prof.*, target_column,
    coalesce(name = target_column, FALSE) AS is_t FROM prof JOIN t1 USING (dataset)) SELECT dataset,
    substr(md5(dataset), 1, 8) AS version_id, any_value(target_column) AS target_column,
    CASE WHEN bool_or(is_t AND dtype <> 'object' AND uniq > 10) THEN 'regression' ELSE 'classification' END AS task_type,
    any_value(n)::VARCHAR AS row_count, count(*)::VARCHAR AS total_columns, min_by(name, ordinal) AS first_column,
    {names_sql(ONE_HOT)} AS one_hot, 'false' AS validated FROM f GROUP BY dataset""")
def comprehensive(spark, sf):
    out = outputs_for(keyed_profiles(spark, sf))
    get = lambda path: F.get_json_object("output", "$." + path)
    listed = F.array_join(F.from_json(get("preprocessing_plan.preprocessing.encoding.one_hot_columns"), "array<string>"), ",")
    return plain(out.select(
        "dataset", "version_id", get("schema.target_column").alias("target_column"),
        get("schema.task_type").alias("task_type"), get("schema.row_count").alias("row_count"),
        get("schema.total_columns").alias("total_columns"), get("schema.columns[0].name").alias("first_column"),
        listed.alias("one_hot"), get("validation.performed").alias("validated")))


def pairs_of(spark, sf):
    p, prompts = prompts_of(spark, sf)
    return pr.build_pairs(prompts, outputs_for(p))


VARIATIONS = "(VALUES ('full_structured', 1), ('stats_focused', 2), ('task_focused', 3)) x(label, i)"


@query("pairs", f"""WITH {PROMPTS} SELECT substr(md5(dataset), 1, 8) || '_' || label AS id, dataset,
    substr(md5(dataset), 1, 8) AS version_id, label AS prompt_variation, CASE i WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v3 END AS input,
    dataset AS output_for FROM prompts CROSS JOIN {VARIATIONS}""")
def pairs(spark, sf):
    name = F.regexp_replace(F.get_json_object("output", "$.ingestion.original_filename"), r"\.csv$", "")
    return plain(pairs_of(spark, sf).withColumn("output_for", name).drop("output"))


@query("pair_summary", f"""WITH {PROMPTS} SELECT label AS prompt_variation, count(*)::BIGINT AS pairs,
    count(DISTINCT dataset)::BIGINT AS datasets FROM prompts CROSS JOIN {VARIATIONS} GROUP BY label""")
def summary(spark, sf):
    return plain(pr.pair_summary(pairs_of(spark, sf)))


# --- artifact match ----------------------------------------------------------------------------------------------

ART_META = """(SELECT substr(md5({k}), 1, 8) AS version_id, 'Ds-' || lpad({k}, 7, '0') || ' set' AS dataset FROM customer)"""
ART_FILES = """(SELECT CASE c_custkey % 4 WHEN 0 THEN '20240101_000000_' || substr(md5({k}), 1, 8) || '_x_schema.json'
    WHEN 1 THEN 'ds_' || lpad({k}, 7, '0') || '_SET_schema.json' WHEN 2 THEN 'other_' || c_custkey || '_schema.json' ELSE 'rest_' || c_custkey || '.json' END AS file_name,
    CASE WHEN c_custkey % 8 <> 4 THEN '{{}}' END AS json FROM customer)"""
_kd, _ks = "c_custkey::VARCHAR", "cast(c_custkey as string)"
CLEAN = "lower(replace(replace(replace({c}, ' ', ''), '_', ''), '-', ''))"
MATCH = f"""m AS (SELECT * FROM {ART_META.format(k=_kd)}), f AS (SELECT * FROM {ART_FILES.format(k=_kd)}),
    byv AS (SELECT version_id, min(file_name) AS file_name FROM m JOIN f ON contains(file_name, version_id) GROUP BY 1),
    byn AS (SELECT version_id, min(file_name) AS file_name FROM (SELECT m.*, {CLEAN.format(c='dataset')} AS clean FROM m
    WHERE version_id NOT IN (SELECT version_id FROM byv)) r JOIN (SELECT file_name,
    {CLEAN.format(c="regexp_replace(file_name, '[.][^.]*$', '')")} AS cand FROM f) g ON contains(cand, clean) GROUP BY 1),
    hit AS (SELECT * FROM byv UNION ALL SELECT * FROM byn)"""


def artifacts(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    return (spark.sql(f"SELECT * FROM {ART_META.format(k=_ks)}"), spark.sql(f"SELECT * FROM {ART_FILES.format(k=_ks)}"))


@query("artifact_match", f"WITH {MATCH} SELECT version_id, hit.file_name, json FROM hit JOIN f USING (file_name)")
def artifact_match(spark, sf):
    return plain(pr.match_artifacts(*artifacts(spark, sf), fold=True))


@query("pair_coverage", f"""WITH {MATCH} SELECT dataset, m.version_id, json IS NOT NULL AS schema_found, FALSE AS validation_found,
    json IS NOT NULL AS transformation_found, FALSE AS plan_found FROM m LEFT JOIN hit USING (version_id)
    LEFT JOIN f USING (file_name)""")
def pair_coverage(spark, sf):
    meta, files = artifacts(spark, sf)
    hit = pr.match_artifacts(meta, files, fold=True)
    none = hit.where("false")
    return plain(pr.pair_coverage(meta, {"schema": hit, "validation": none, "transformation": hit, "plan": none}))

