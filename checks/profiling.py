"""Profile, inference and time queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import (
    PROFILE_OUT, all_tables, columns_of, gappy, gappy_sql, plain, profile_out, profile_sql, r6, sql_any, sql_date,
    sql_id, sql_in, sql_squash, table,
)
from tablesmith.facade import dataset_meta
from tablesmith.functions.names import clean_dataset_id, date_rule, id_rule, normalize_name, parse_filename, short_name
from tablesmith.operators import infer
from tablesmith.operators.features import time_features
from tablesmith.operators.profile import (
    profile, profile_many, quick_profile, sample_values, target_distribution,
)

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def all_profiles(spark, sf):
    return profile_many(spark, all_tables(spark, sf))[0]


# --- profile --------------------------------------------------------------------------------

@query("profile_lineitem", f"WITH {profile_sql({'lineitem': gappy_sql('lineitem')})} SELECT {PROFILE_OUT} FROM prof")
def profile_lineitem(spark, sf):
    return profile_out(profile(gappy(spark, sf, "lineitem"), "lineitem"))


@query("profile_customer", f"WITH {profile_sql({'customer': gappy_sql('customer')})} SELECT {PROFILE_OUT} FROM prof")
def profile_customer(spark, sf):
    return profile_out(profile(gappy(spark, sf, "customer"), "customer"))


@query("profile_narrowing", f"WITH {profile_sql({'orders': gappy_sql('orders')})} SELECT {PROFILE_OUT} FROM prof")
def profile_narrowing(spark, sf):
    """The same profile with quartiles from the multi-pass form used beyond one task's reach."""
    return profile_out(profile(gappy(spark, sf, "orders"), "orders", single_task_rows=500))


@query("profile_all", f"WITH {profile_sql()} SELECT {PROFILE_OUT} FROM prof")
def profile_all(spark, sf):
    return profile_out(all_profiles(spark, sf))


@query("profile_skew", f"""WITH {profile_sql({'events': 'events', 'documents': 'documents', 'labels': 'labels'})}
    SELECT dataset, name, (round(skew, 4) + 0.0) AS skewness, is_skewed FROM prof WHERE skew IS NOT NULL""")
def profile_skew(spark, sf):
    tables = {t: table(spark, sf, t) for t in ("events", "documents", "labels")}
    p = profile_many(spark, tables)[0]
    return plain(p.where("skewness is not null").select("dataset", "name", "skewness", "is_skewed"))


@query("profile_quick", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS name, {repr('object') if k in ('str', 'ts') else repr('float64') if k == 'double' else repr('int64')} "
    f"AS dtype, (count(*) - count({c}))::BIGINT AS missing_count, count(DISTINCT {c})::BIGINT AS unique_count "
    f"FROM {gappy_sql('customer')}" for c, k in columns_of("customer")))
def profile_quick(spark, sf):
    return plain(quick_profile(gappy(spark, sf, "customer")).drop("ordinal"))


@query("iqr_outliers", f"""WITH {profile_sql({'events': gappy_sql('events'), 'documents': 'documents', 'labels': 'labels'})}
    SELECT dataset, name, {r6('q1')} AS q1, {r6('q3')} AS q3, {r6('q1 - 1.5 * (q3 - q1)')} AS lower_bound,
    {r6('q3 + 1.5 * (q3 - q1)')} AS upper_bound, outl::BIGINT AS outlier_count,
    {r6('round(outl * 100.0 / n, 2)')} AS outlier_percentage FROM prof WHERE q1 IS NOT NULL""")
def iqr_outliers(spark, sf):
    p = profile_many(spark, {"events": gappy(spark, sf, "events"), "documents": table(spark, sf, "documents"),
                             "labels": table(spark, sf, "labels")})[0]
    return plain(p.where("q1 is not null").select(
        "dataset", "name", "q1", "q3", "lower_bound", "upper_bound", "outlier_count", "outlier_percentage"))


@query("sample_values", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS name, rank::BIGINT AS rank, value FROM (SELECT {c} AS value,
    row_number() OVER (ORDER BY min(p_partkey), {c}) AS rank FROM part WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 3"""
    for c in ("p_name", "p_brand", "p_type")))
def samples(spark, sf):
    names = ["p_name", "p_brand", "p_type"]
    got = sample_values(table(spark, sf, "part"), names, F.col("p_partkey"))
    label = F.get(F.array(*map(F.lit, names)), F.col("ordinal"))
    return plain(got.select(label.alias("name"), "rank", "value"))


@query("target_distribution", f"""SELECT o_orderpriority AS value, count(*)::BIGINT AS n,
    {r6('round(count(*) * 100.0 / (SELECT count(*) FROM orders), 1)')} AS pct
    FROM {gappy_sql('orders')} WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5""")
def distribution(spark, sf):
    return plain(target_distribution(gappy(spark, sf, "orders"), "o_orderpriority"))


# --- target detectors --------------------------------------------------------------------------

_lower = "lower(name)"
T1_SCORE = f"""(CASE WHEN {sql_in(_lower, infer.PROFILE_TARGETS)} THEN 100
    WHEN {sql_any(_lower, infer.PROFILE_TARGETS)} THEN 50 ELSE 0 END
    + CASE WHEN is_last THEN 30 ELSE 0 END + CASE WHEN uniq BETWEEN 2 AND 10 THEN 20 ELSE 0 END
    + CASE WHEN dtype = 'object' THEN 10 ELSE 0 END - CASE WHEN {sql_id('name', 'profile')} THEN 100 ELSE 0 END
    - CASE WHEN uniq > 100 THEN 30 ELSE 0 END)"""
T1_METHOD = f"""CASE WHEN {sql_in(_lower, infer.PROFILE_TARGETS)} THEN 'exact_keyword'
    WHEN {sql_any(_lower, infer.PROFILE_TARGETS)} THEN 'partial_keyword' WHEN is_last THEN 'last_column'
    WHEN uniq BETWEEN 2 AND 10 THEN 'low_cardinality' WHEN dtype = 'object' THEN 'non_numeric' ELSE 'unknown' END"""
T1 = f"""t1 AS (SELECT dataset, CASE WHEN score > 20 THEN name END AS target_column,
    CASE WHEN score > 20 THEN method ELSE 'none' END AS target_detection_method,
    CASE WHEN score > 20 THEN score ELSE 0 END AS target_confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, ordinal) AS rn FROM (
    SELECT *, {T1_SCORE} AS score, {T1_METHOD} AS method FROM prof)) WHERE rn = 1)"""


@query("target_profile", f"""WITH {profile_sql()}, {T1} SELECT dataset, target_column, target_detection_method,
    target_confidence::BIGINT AS target_confidence FROM t1""")
def target_profile(spark, sf):
    return plain(infer.profile_target(all_profiles(spark, sf)))


@query("quality_score", f"""WITH {profile_sql()}, {T1}, tot AS (SELECT dataset, any_value(n) AS n, count(*) AS k,
    sum(miss) AS miss, coalesce(sum(outl), 0) AS outl FROM prof GROUP BY dataset)
    SELECT dataset, n::BIGINT AS row_count, k::BIGINT AS column_count, miss::BIGINT AS total_missing_values,
    outl::BIGINT AS total_outliers, {r6('round(miss * 100.0 / (n * k), 2)')} AS missing_percentage,
    {r6('''round(greatest(0.0, 100.0 - least(30.0, miss * 100.0 / (n * k)) - least(20.0, outl * 100.0 / n / 2)
    - CASE WHEN target_column IS NULL THEN 25 ELSE 0 END), 1)''')} AS quality_score
    FROM tot JOIN t1 USING (dataset)""")
def quality(spark, sf):
    return plain(dataset_meta(all_profiles(spark, sf)).select(
        "dataset", "row_count", "column_count", "total_missing_values", "total_outliers", "missing_percentage",
        "quality_score"))


T2_SCORE = f"""CASE WHEN {sql_any('name', infer.FEATURE_BAD)} OR miss = n THEN -100 ELSE
    CASE WHEN {sql_any(_lower, infer.FEATURE_TARGETS)} THEN 50 ELSE 0 END + CASE WHEN is_last THEN 30 ELSE 0 END
    + CASE WHEN uniq BETWEEN 2 AND 10 THEN 20 ELSE 0 END - CASE WHEN uniq > 100 THEN 50 ELSE 0 END
    + CASE WHEN dtype = 'object' THEN 10 ELSE 0 END
    - CASE WHEN {sql_any('name', [' ', '$', '%', '@'])} THEN 20 ELSE 0 END END"""


@query("target_features", f"""WITH {profile_sql()} SELECT dataset, CASE WHEN score > 0 THEN name END AS target_column,
    score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, ordinal) AS rn
    FROM (SELECT *, {T2_SCORE} AS score FROM prof)) WHERE rn = 1""")
def target_features(spark, sf):
    return plain(infer.feature_target(all_profiles(spark, sf)))


NUM3 = "(contains(dtype, 'int') OR contains(dtype, 'float') OR contains(dtype, 'double'))"
_low = "lower(trim(name))"
SCORED = f"""scored AS (SELECT *, {NUM3} AS is_num, ({sql_id('name', 'dispatcher')} OR {sql_date('name')}) AS id_or_date,
    CASE WHEN {sql_id('name', 'dispatcher')} OR {sql_date('name')} THEN -500
    WHEN {sql_any(_low, infer.DISPATCH_TEXT)} THEN -120 ELSE
    CASE WHEN {sql_in(sql_squash('name'), infer.DISPATCH_EXACT)} THEN 120 ELSE 0 END
    + CASE WHEN {sql_any(_low, infer.DISPATCH_CONTAINS)} THEN 80 ELSE 0 END
    + CASE WHEN contains({_low}, 'chance') AND contains({_low}, 'admit') THEN 140 ELSE 0 END
    + CASE WHEN is_last THEN 35 ELSE 0 END + CASE WHEN NOT {NUM3} THEN 15 ELSE 0 END
    + CASE WHEN uniq BETWEEN 2 AND 10 THEN 20 ELSE 0 END + CASE WHEN {NUM3} AND uniq > 10 THEN 10 ELSE 0 END
    - CASE WHEN uniq > 1000 AND NOT {NUM3} THEN 80 ELSE 0 END END AS score FROM prof)"""
T3 = """t3 AS (SELECT dataset, coalesce(
    arg_max(name, score * 1000 - ordinal) FILTER (WHERE score > -100),
    arg_max(name, ordinal) FILTER (WHERE NOT id_or_date), arg_max(name, ordinal)) AS best FROM scored GROUP BY dataset)"""


@query("target_dispatch", f"""WITH {profile_sql()}, {SCORED}, {T3} SELECT dataset, best AS target_column,
    score::BIGINT AS target_score FROM t3 JOIN scored USING (dataset) WHERE name = best""")
def target_dispatch(spark, sf):
    p = infer.dispatch_scores(all_profiles(spark, sf))
    best = infer.dispatch_target(p)
    return plain(p.withColumnRenamed("name", "target_column").join(best, ["dataset", "target_column"]).select(
        "dataset", "target_column", "target_score"))


T4 = f"""t4 AS (SELECT p.dataset, coalesce(any_value(t1.target_column),
    arg_min(name, ordinal) FILTER (WHERE {sql_in(_low, infer.PRIORITY_TARGETS)}),
    arg_max(name, ordinal) FILTER (WHERE NOT {sql_id('name', 'generator')})) AS target_column
    FROM prof p JOIN t1 USING (dataset) GROUP BY p.dataset)"""


@query("target_priority", f"WITH {profile_sql()}, {T1}, {T4} SELECT dataset, target_column FROM t4")
def target_priority(spark, sf):
    p = all_profiles(spark, sf)
    return plain(infer.priority_target(p, infer.profile_target(p)))


@query("task_type_schema", f"""WITH {profile_sql()}, {SCORED}, {T3} SELECT dataset, best AS target_column,
    CASE WHEN is_num AND uniq > 10 THEN 'regression' ELSE 'classification' END AS task_type
    FROM t3 JOIN scored USING (dataset) WHERE name = best""")
def task_schema(spark, sf):
    p = all_profiles(spark, sf)
    return plain(infer.task_type_schema(p, infer.dispatch_target(p)))


TASK_CASES = [("lineitem", "l_linenumber", True), ("lineitem", "l_quantity", True), ("lineitem", "l_discount", True),
              ("lineitem", "l_orderkey", True), ("lineitem", "l_returnflag", False), ("orders", "o_totalprice", True)]


@query("task_type", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS target_column, n::BIGINT AS n, u::BIGINT AS unique_count, ints AS all_integers,
    CASE WHEN NOT {num} THEN 'classification' WHEN u::DOUBLE / n > 0.05 THEN 'regression' WHEN NOT ints THEN 'regression'
    WHEN u <= 20 THEN 'classification' ELSE 'regression' END AS task_type
    FROM (SELECT count({c}) AS n, count(DISTINCT {c}) AS u,
    {f"bool_and({c}::DOUBLE = floor({c}::DOUBLE))" if num else "NULL::BOOLEAN"} AS ints FROM {t})"""
    for t, c, num in TASK_CASES))
def task_types(spark, sf):
    out = None
    for t, c, _ in TASK_CASES:
        one = infer.task_type(table(spark, sf, t), c)
        out = one if out is None else out.unionByName(one)
    return plain(out)


# --- names -------------------------------------------------------------------------------------

NAMES_SQL = """(SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || '_id'
    WHEN p_partkey % 5 = 1 THEN 'Unnamed: ' || p_partkey WHEN p_partkey % 5 = 2 THEN ' Customer-ID ' || p_size
    WHEN p_partkey % 5 = 3 THEN p_brand || ' Created_At' ELSE p_type || '_' || p_name END AS name FROM part)"""


def names(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    return spark.sql(f"SELECT * FROM {NAMES_SQL}")


VARIANTS = ["profile", "dispatcher", "generator", "substring", "pairs"]


@query("id_columns", "SELECT p_partkey, name, " + ", ".join(
    f"{sql_id('name', v)} AS rule_{v}" for v in VARIANTS) + f" FROM {NAMES_SQL}")
def id_columns(spark, sf):
    return plain(names(spark, sf).select("p_partkey", "name", *[
        id_rule("name", v).alias(f"rule_{v}") for v in VARIANTS]))


@query("date_columns", f"SELECT p_partkey, name, {sql_date('name')} AS is_date FROM {NAMES_SQL}")
def date_columns(spark, sf):
    return plain(names(spark, sf).select("p_partkey", "name", date_rule("name").alias("is_date")))


@query("norm_names", f"SELECT p_partkey, {sql_squash('name')} AS normalized FROM {NAMES_SQL}")
def norm_names(spark, sf):
    return plain(names(spark, sf).select("p_partkey", normalize_name("name").alias("normalized")))


FILES_SQL = """(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'plain' || o_orderkey || '.csv' ELSE
    replace(substr({date}, 1, 10), '-', '') || '_173925_' || substr(md5({key}), 1, 8) || '_'
    || lower(replace(o_orderpriority, ' ', '_')) || '_' || o_orderstatus || '.csv' END AS path FROM orders)"""
FILES_DUCK = FILES_SQL.format(date="o_orderdate::VARCHAR", key="o_orderkey::VARCHAR")
FILES_SPARK = FILES_SQL.format(date="cast(o_orderdate as string)", key="cast(o_orderkey as string)")


def file_names(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql(f"SELECT * FROM {FILES_SPARK}")


STEM = "regexp_replace(path, '\\.[^.]*$', '')"


@query("parse_filename", f"""SELECT o_orderkey, CASE WHEN ok THEN p[1] END AS ts_date, CASE WHEN ok THEN p[2] END AS ts_time,
    CASE WHEN ok THEN p[3] END AS version, CASE WHEN ok THEN array_to_string(p[4:], '_') END AS name, stem AS base_name
    FROM (SELECT *, len(p) >= 4 AS ok FROM (SELECT *, string_split(stem, '_') AS p
    FROM (SELECT o_orderkey, {STEM} AS stem FROM {FILES_DUCK})))""")
def parsed_names(spark, sf):
    return plain(file_names(spark, sf).select("o_orderkey", parse_filename("path").alias("p")).select("o_orderkey", "p.*"))


_stamp = "regexp_matches({t}, '^([0-9]{{6}}|[0-9]{{8}}|[0-9a-fA-F]{{8,}})$')"


@query("short_name", f"""SELECT o_orderkey, replace(lower(CASE WHEN len(kept) > 0 THEN array_to_string(kept, '_') ELSE stem END),
    ' ', '_') AS short_name, replace(lower(array_to_string(kept, '_')), ' ', '_') AS dataset_id FROM (
    SELECT *, list_filter(string_split(stem, '_'), lambda x: NOT {_stamp.format(t='x')}) AS kept
    FROM (SELECT o_orderkey, {STEM} AS stem FROM {FILES_DUCK}))""")
def short_names(spark, sf):
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    return plain(file_names(spark, sf).select(
        "o_orderkey", short_name(stem).alias("short_name"), clean_dataset_id("path").alias("dataset_id")))


# --- time ------------------------------------------------------------------------------------------

@query("detect_time_column", """SELECT 'orders' AS dataset, 'o_orderdate' AS name, 1.0::DOUBLE AS parse_share,
    'o_orderdate' AS time_column WHERE (SELECT count(o_orderdate) FROM orders) > 0
    UNION ALL SELECT 'orders', 'o_datetext', (round(avg(CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE 1.0 END), 6))::DOUBLE,
    'o_orderdate' FROM orders
    UNION ALL SELECT 'lineitem', 'l_shipdate', (round(avg(CASE WHEN l_shipdate IS NULL THEN 0.0 ELSE 1.0 END), 6))::DOUBLE,
    'l_shipdate' FROM lineitem""")
def detect_time(spark, sf):
    orders = table(spark, sf, "orders").withColumn("o_datetext", F.expr(
        "CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END"))
    out = None
    for name, df in (("orders", orders), ("lineitem", table(spark, sf, "lineitem"))):
        shares = infer.time_parse_shares(df)
        chosen = next((n for n, s in shares if s and s > 0.5), None)
        one = spark.createDataFrame([(name, n, s, chosen) for n, s in shares],
                                    "dataset string, name string, parse_share double, time_column string")
        out = one if out is None else out.unionByName(one)
    return plain(out)


def steps_sql(t: str, c: str, key: str) -> str:
    return f"""SELECT '{c}' AS time_column, (SELECT coalesce(bool_and(d >= 0), TRUE) OR coalesce(bool_and(d <= 0), TRUE)
        FROM d WHERE d IS NOT NULL) AS is_monotonic, (SELECT d FROM d WHERE d IS NOT NULL GROUP BY d
        ORDER BY count(*) DESC, d LIMIT 1)::BIGINT AS modal_step_micros"""


def diff_cte(t: str, c: str, key: str) -> str:
    return f"d AS (SELECT epoch_us({c}) - lag(epoch_us({c})) OVER (ORDER BY {key}) AS d FROM {t})"


@query("ts_monotonic", f"WITH {diff_cte('events', 'ts', 'event_id')} {steps_sql('events', 'ts', 'event_id')}")
def ts_monotonic(spark, sf):
    steps = infer.time_steps(table(spark, sf, "events"), "ts", F.col("event_id"))
    return plain(steps.select("time_column", "is_monotonic", "modal_step_micros"))


DAILY = "(SELECT o_orderkey, make_timestamp(0) + to_days(o_orderkey::INTEGER) AS o_day FROM orders)"


@query("ts_frequency", f"""SELECT * FROM (WITH {diff_cte('orders', 'o_orderdate', 'o_orderkey')}, s AS (
    {steps_sql('orders', 'o_orderdate', 'o_orderkey')}) SELECT time_column, CASE WHEN NOT is_monotonic THEN 'non_sequential'
    WHEN modal_step_micros = 86400000000 THEN 'daily' ELSE 'irregular' END AS frequency FROM s)
    UNION ALL SELECT * FROM (WITH {diff_cte(DAILY, 'o_day', 'o_orderkey')}, s AS ({steps_sql('orders', 'o_day', 'o_orderkey')})
    SELECT time_column, CASE WHEN NOT is_monotonic THEN 'non_sequential'
    WHEN modal_step_micros = 86400000000 THEN 'daily' ELSE 'irregular' END AS frequency FROM s)""")
def ts_frequency(spark, sf):
    orders = table(spark, sf, "orders")
    daily = orders.select("o_orderkey", F.timestamp_seconds(F.col("o_orderkey") * 86400).alias("o_day"))
    one = infer.time_frequency(infer.time_steps(orders, "o_orderdate", F.col("o_orderkey")))
    return plain(one.unionByName(infer.time_frequency(
        infer.time_steps(daily, "o_day", F.col("o_orderkey")))))


def parts_sql(c: str, clock: bool) -> str:
    parts = {"year": f"year({c})", "month": f"month({c})", "day": f"day({c})", "weekday": f"isodow({c}) - 1",
             "quarter": f"quarter({c})", "is_weekend": f"CASE WHEN isodow({c}) >= 6 THEN 1 ELSE 0 END"}
    if clock:
        parts |= {"hour": f"hour({c})", "minute": f"minute({c})"}
    return ", ".join(f"({e})::BIGINT AS {c}_{p}" for p, e in parts.items())


@query("time_features", f"SELECT event_id, user_id, event_type, {r6('value')} AS value, props, {parts_sql('ts', True)} FROM events")
def event_parts(spark, sf):
    return plain(time_features(table(spark, sf, "events"), "ts", "event_id"))


@query("time_features_dates", f"""SELECT o_orderkey, o_custkey, o_orderstatus, {r6('o_totalprice')} AS o_totalprice,
    o_orderpriority, {parts_sql('o_orderdate', False)} FROM orders""")
def order_parts(spark, sf):
    return plain(time_features(table(spark, sf, "orders"), "o_orderdate", "o_orderkey"))

