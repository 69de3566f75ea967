"""Registry, event log, ingest and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import plain, r6, table, time_text
from checks.profiling import FILES_DUCK, FILES_SPARK
from tablesmith.operators import validate as va
from tablesmith.operators.profile import profile
from tablesmith.sources import registry as rg
from tablesmith.sources.events import filter_events
from tablesmith.streaming.landing import ingest_metadata

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def view(spark, sf, *names):
    for n in names:
        table(spark, sf, n).createOrReplaceTempView(n)


# the given tables in the roles of the registry: orders are runs, customers datasets, nations plans
DATASETS = ("SELECT c_custkey AS dataset_id, c_name AS original_filename, c_nationkey AS row_count, "
            "c_mktsegment AS task_type FROM customer")
PLANS = "SELECT n_nationkey AS plan_id, n_name AS plan_source FROM nation"
RUNS = ("SELECT o_orderkey AS run_id, o_custkey AS dataset_id, CAST(o_custkey % 40 AS INT) AS plan_id, "
        "o_orderstatus AS status, o_orderdate AS started_at FROM orders")
METRICS = "SELECT o_orderkey AS run_id, o_totalprice AS accuracy FROM orders"


@query("registry_datasets", f"""SELECT dataset_id::BIGINT AS dataset_id, original_filename, row_count::BIGINT AS row_count,
    task_type FROM ({DATASETS})""")
def registry_datasets(spark, sf):
    view(spark, sf, "customer")
    return plain(rg.list_datasets(spark.sql(DATASETS)))


@query("recent_runs", f"""SELECT run_id::BIGINT AS run_id, status, {time_text('started_at')} AS started_at, original_filename,
    plan_source FROM ({RUNS}) r JOIN ({DATASETS}) d USING (dataset_id) LEFT JOIN ({PLANS}) p ON p.plan_id = r.plan_id
    ORDER BY r.started_at DESC, run_id DESC LIMIT 50""")
def recent_runs(spark, sf):
    view(spark, sf, "orders", "customer", "nation")
    got = rg.recent_runs(spark.sql(RUNS), spark.sql(DATASETS), spark.sql(PLANS), 50)
    return plain(got.select("run_id", "status", "started_at", "original_filename", "plan_source"))


@query("recent_runs_metrics", f"""SELECT run_id::BIGINT AS run_id, {time_text('started_at')} AS started_at, original_filename,
    {r6('accuracy')} AS accuracy FROM ({RUNS}) r LEFT JOIN ({DATASETS}) d USING (dataset_id) LEFT JOIN ({METRICS}) m USING (run_id)
    ORDER BY r.started_at DESC, run_id DESC LIMIT 20""")
def recent_metrics(spark, sf):
    view(spark, sf, "orders", "customer")
    got = rg.recent_runs_with_metrics(spark.sql(RUNS), spark.sql(DATASETS), spark.sql(METRICS), 20)
    return plain(got.select("run_id", "started_at", "original_filename", "accuracy"))


OLD = ("SELECT c_name AS dataset_name, c_mktsegment AS target_column, c_nationkey AS row_count, c_custkey AS created_at, "
       "c_custkey AS updated_at FROM customer")
# every second supplier renews the customer of its number, the others are new
NEW = ("SELECT CASE WHEN s_suppkey % 2 = 0 THEN replace(s_name, 'Supplier', 'Customer') ELSE s_name END AS dataset_name, "
       "CASE WHEN s_suppkey % 4 = 0 THEN 'renewed' END AS target_column, s_nationkey + 100 AS row_count, "
       "s_suppkey + 1000000 AS created_at, s_suppkey + 1000000 AS updated_at FROM supplier")


@query("registry_upsert", f"""SELECT coalesce(o.dataset_name, n.dataset_name) AS dataset_name,
    coalesce(n.target_column, o.target_column) AS target_column, coalesce(n.row_count, o.row_count)::BIGINT AS row_count,
    coalesce(o.created_at, n.created_at)::BIGINT AS created_at, coalesce(n.updated_at, o.updated_at)::BIGINT AS updated_at
    FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.dataset_name = n.dataset_name""")
def registry_upsert(spark, sf):
    view(spark, sf, "customer", "supplier")
    return plain(rg.upsert_datasets(spark.sql(OLD), spark.sql(NEW)))


OLD_PLANS = ("SELECT o_orderkey AS plan_id, o_custkey AS dataset_id, o_orderpriority AS plan_json, o_orderkey AS created_at, "
             "o_orderkey AS updated_at FROM orders")
NEW_PLANS = ("SELECT event_id + 10000000 AS plan_id, user_id * 2 AS dataset_id, event_type AS plan_json, event_id + 5000000 AS created_at, "
             "event_id + 5000000 AS updated_at FROM events")
KNOWN = "SELECT c_custkey AS dataset_id FROM customer"


@query("registry_plan_upsert", f"""WITH u AS (SELECT * FROM ({OLD_PLANS}) UNION ALL SELECT * FROM ({NEW_PLANS})
    WHERE dataset_id IN ({KNOWN})) SELECT dataset_id::BIGINT AS dataset_id, min(created_at)::BIGINT AS created_at,
    arg_min(plan_id, created_at)::BIGINT AS plan_id, arg_max(plan_json, updated_at) AS plan_json,
    max(updated_at)::BIGINT AS updated_at FROM u GROUP BY dataset_id""")
def plan_upsert(spark, sf):
    view(spark, sf, "orders", "customer", "events")
    return plain(rg.upsert_plans(spark.sql(OLD_PLANS), spark.sql(NEW_PLANS), spark.sql(KNOWN)))


STATUS = ("CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END")
RUN_EVENTS = (f"SELECT user_id AS run_id, {STATUS} AS status, ts AS {{at}}, event_id AS rows_processed, "
              "repeat(props, 80) AS error_message FROM events")


@query("run_state", f"""SELECT run_id::BIGINT AS run_id, arg_max(status, moment) AS status, {time_text('min(moment)')} AS started_at,
    {time_text("max(CASE WHEN status IN ('completed', 'failed') THEN moment END)")} AS completed_at,
    arg_max(rows_processed, moment)::BIGINT AS rows_processed, substr(arg_max(error_message, moment), 1, 500) AS error_message,
    {r6("(epoch_us(max(CASE WHEN status IN ('completed', 'failed') THEN moment END)) - epoch_us(min(moment))) / 1e6")}
    AS execution_time_seconds FROM ({RUN_EVENTS.format(at='moment')}) GROUP BY run_id""")
def run_state(spark, sf):
    view(spark, sf, "events")
    return plain(rg.run_state(spark.sql(RUN_EVENTS.format(at='at'))))


@query("registry_lookup", f"""SELECT run_id::BIGINT AS run_id, dataset_id::BIGINT AS dataset_id, plan_id::BIGINT AS plan_id, status,
    {time_text('started_at')} AS started_at FROM ({RUNS}) WHERE dataset_id = 7 AND status = 'F'""")
def registry_lookup(spark, sf):
    view(spark, sf, "orders")
    return plain(rg.lookup(spark.sql(RUNS), dataset_id=7, status="F"))


LOG = f"SELECT user_id AS run_id, event_type AS step, {STATUS} AS status, event_id FROM events"


@query("event_filter", f"""SELECT run_id::BIGINT AS run_id, step, status, event_id::BIGINT AS event_id FROM ({LOG})
    WHERE step = 'click' AND status = 'running'""")
def event_filter(spark, sf):
    view(spark, sf, "events")
    return plain(filter_events(spark.sql(LOG), run_id=None, step="click", status="running"))


@query("ingest_metadata", """SELECT 'lineitem.csv' AS original_filename, '20240101_000000_0a1b2c3d_lineitem.csv' AS stored_filename,
    'raw/lineitem' AS stored_path, '0a1b2c3d' AS version_id, '20240101_000000' AS timestamp, '.csv' AS file_type,
    count(*)::BIGINT AS rows, 11::BIGINT AS columns_count, 'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,'
    || 'l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate' AS columns FROM lineitem""")
def metadata(spark, sf):
    df = table(spark, sf, "lineitem")
    return plain(ingest_metadata(df, "lineitem.csv", "20240101_000000_0a1b2c3d_lineitem.csv", "raw/lineitem", "0a1b2c3d",
                                 "20240101_000000", ".csv", df.count()))


# --- validation ----------------------------------------------------------------------------------------------

def altered(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("c_acctbal"),
        F.expr("CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END").alias("c_mktsegment"),
        F.col("c_custkey").alias("c_extra"))


ISSUES = """SELECT 'missing_column' AS kind, 'c_nationkey' AS name, 'Missing column: c_nationkey' AS message
    UNION ALL SELECT 'extra_column', 'c_extra', 'Extra column: c_extra'
    UNION ALL SELECT 'type_mismatch', 'c_acctbal', 'Type mismatch in c_acctbal'
    UNION ALL SELECT 'missing_mismatch', 'c_mktsegment', 'Missing mismatch in c_mktsegment' FROM
    (SELECT count(*) - count(c_mktsegment) AS e, count(*) FILTER (WHERE c_custkey % 9 = 0 OR c_mktsegment IS NULL) AS a
    FROM customer) WHERE e <> a
    UNION ALL SELECT 'target_missing', 'churn', 'Target column missing: churn'"""


@query("validate_profile", ISSUES)
def validate_profile(spark, sf):
    p = profile(table(spark, sf, "customer"), "customer")
    return plain(va.compare_profiles(p, va.actual_columns(altered(spark, sf)), "churn"))


@query("validation_report", """SELECT FALSE AS is_valid, 'Missing columns: c_nationkey,Extra columns: c_extra,'
    || 'Type mismatch in c_acctbal' || CASE WHEN count(*) FILTER (WHERE c_custkey % 9 = 0 AND c_mktsegment IS NOT NULL) > 0
    THEN ',Missing mismatch in c_mktsegment' ELSE '' END AS errors, '' AS warnings, 'customer' AS name, 'v1' AS version,
    'raw/customer.csv' AS raw_file_path, 'schema/customer.json' AS schema_path, 'invalid' AS validation_status FROM customer""")
def validation_report(spark, sf):
    p = profile(table(spark, sf, "customer"), "customer")
    return plain(va.validate(altered(spark, sf), p, "customer", "v1", None, "raw/customer.csv", "schema/customer.json"))


REPORTS = ("SELECT o_orderkey AS report_id, o_orderpriority AS name, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE "
           "{arr} END AS errors, CAST(NULL AS {lst}) AS warnings, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus = 'F' END AS is_valid, "
           "CASE WHEN o_orderkey % 5 = 0 THEN 'invalid' END AS validation_status FROM orders")
REPORTS_DUCK = REPORTS.format(arr="CASE WHEN o_orderstatus = 'O' THEN ['a', 'b'] ELSE []::VARCHAR[] END", lst="VARCHAR[]")
REPORTS_SPARK = REPORTS.format(arr="CASE WHEN o_orderstatus = 'O' THEN array('a', 'b') ELSE cast(array() as array<string>) END",
                               lst="ARRAY<STRING>")
FILLED = f"""filled AS (SELECT report_id, name, coalesce(errors, []::VARCHAR[]) AS errors,
    coalesce(is_valid, len(coalesce(errors, []::VARCHAR[])) = 0) AS is_valid, validation_status AS vs FROM ({REPORTS_DUCK})),
    rep AS (SELECT *, coalesce(vs, CASE WHEN is_valid THEN 'valid' ELSE 'invalid' END) AS validation_status FROM filled)"""


def reports(spark, sf):
    view(spark, sf, "orders")
    return va.normalize_reports(spark.sql(REPORTS_SPARK))


@query("report_normalize", f"""WITH {FILLED} SELECT report_id::BIGINT AS report_id, name, array_to_string(errors, ',') AS errors,
    '' AS warnings, is_valid, validation_status FROM rep""")
def report_normalize(spark, sf):
    return plain(reports(spark, sf).select("report_id", "name", "errors", "warnings", "is_valid", "validation_status"))


@query("validation_summary", f"""WITH {FILLED} SELECT validation_status, count(*)::BIGINT AS datasets,
    count(*) FILTER (WHERE is_valid)::BIGINT AS valid_datasets, sum(len(errors))::BIGINT AS errors_count,
    0::BIGINT AS warnings_count FROM rep GROUP BY validation_status""")
def validation_summary(spark, sf):
    return plain(va.validation_summary(reports(spark, sf)))


@query("unvalidated", f"""WITH fl AS (SELECT o_orderkey, path, o_orderkey % 7 = 0 AS bad,
    regexp_replace(path, '\\.csv$', '') AS base FROM {FILES_DUCK}), nm AS (SELECT *, substr(base, 26) AS name, substr(base, 17, 8) AS ver
    FROM fl) SELECT path AS raw_file, 'bad_name_format' AS problem, NULL::VARCHAR AS expected FROM nm WHERE bad
    UNION ALL SELECT path, 'missing_schema', base || '_schema.json' FROM nm WHERE NOT bad AND o_orderkey % 3 = 0
    UNION ALL SELECT path, 'not_validated', name || '_v' || ver || '_validation.json' FROM nm WHERE NOT bad AND o_orderkey % 5 = 0""")
def unvalidated(spark, sf):
    view(spark, sf, "orders")
    files = spark.sql(f"SELECT * FROM {FILES_SPARK}")
    schemas = files.where("o_orderkey % 3 <> 0").select(F.regexp_replace("path", r"\.csv$", "_schema.json").alias("path"))
    done = files.where("o_orderkey % 5 <> 0").select(F.regexp_replace(
        "path", r"^[0-9]+_[0-9]+_([0-9a-f]+)_(.*)\.csv$", "$2_v$1_validation.json").alias("path"))
    return plain(va.unvalidated(files, schemas, done))


HEADER_WORDS = ["small", "red", "widget", "ring", "ECONOMY", "missing"]


@query("parse_score", f"""SELECT p_partkey::BIGINT AS p_partkey, (CASE WHEN found = ['small;red'] THEN 0 * 10 - 6 * 3 - 1 - 100
    ELSE len(list_intersect(found, want)) * 10 - (6 - len(list_intersect(found, want))) * 3
    - (len(found) - len(list_intersect(found, want))) END)::BIGINT AS score FROM (SELECT p_partkey,
    CASE WHEN p_partkey % 10 = 0 THEN ['small;red'] ELSE list_distinct(string_split(p_name || ' ' || p_type, ' ')) END AS found,
    {HEADER_WORDS!r} AS want FROM part)""")
def parse_score(spark, sf):
    df = table(spark, sf, "part").withColumn("found", F.expr(
        "CASE WHEN p_partkey % 10 = 0 THEN array('small;red') ELSE split(concat(p_name, ' ', p_type), ' ') END"))
    want = F.array(*map(F.lit, HEADER_WORDS))
    return plain(df.select("p_partkey", va.parse_score(F.col("found"), want).alias("score")))
