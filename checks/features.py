"""Feature, split, correlation and plan-execution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import columns_of, gappy, gappy_sql, plain, r6, table, time_text
from tablesmith.operators import features as fe
from tablesmith.operators.correlate import class_imbalance, correlated_drops, high_correlation, low_correlation
from tablesmith.operators.split import rebalance, split_random, split_stratified, split_time
from tablesmith.plans import execute as ex
from tablesmith.sources.artifacts import head_sample
from tablesmith.sources.delimited import promote_header

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def select_sql(t: str, changed: dict[str, str] | None = None, skip: tuple = ()) -> str:
    """Column list of a given table in comparable form, with some columns recomputed."""
    changed = changed or {}
    out = []
    for c, k in columns_of(t):
        if c in skip:
            continue
        e = changed.get(c, c)
        if c in changed:
            out.append(f"{e} AS {c}")
        elif k == "double":
            out.append(f"{r6(e)} AS {c}")
        elif k == "int":
            out.append(f"{e}::BIGINT AS {c}")
        elif k == "ts":
            out.append(f"{time_text(e)} AS {c}")
        else:
            out.append(c)
    return ", ".join(out)


# --- drops, impute, infinities -----------------------------------------------------------------

@query("drop_ids", f"SELECT {select_sql('events', skip=('event_id', 'user_id'))} FROM events")
def drop_ids(spark, sf):
    return plain(fe.drop_id_columns(table(spark, sf, "events"))[0])


@query("drop_constants", f"SELECT {select_sql('orders')} FROM orders")
def drop_constants(spark, sf):
    df = table(spark, sf, "orders").withColumns({
        "flat": F.col("o_totalprice") * 0, "empty": F.when(F.col("o_orderkey") < 0, F.col("o_orderstatus")),
        "one": F.lit("x")})
    return plain(fe.drop_constant_columns(df)[0])


@query("impute_median", f"""SELECT {select_sql('orders', {'o_totalprice': r6('''coalesce(o_totalprice,
    (SELECT quantile_cont(o_totalprice, 0.5) FROM ''' + gappy_sql('orders') + '))')})} FROM {gappy_sql('orders')}""")
def impute_median(spark, sf):
    return plain(fe.impute(gappy(spark, sf, "orders"), ["o_totalprice"]))


@query("impute_unknown", f"""SELECT {select_sql('customer', {'c_mktsegment': "coalesce(c_mktsegment, 'unknown')"})}
    FROM {gappy_sql('customer')}""")
def impute_unknown(spark, sf):
    return plain(fe.impute(gappy(spark, sf, "customer"), ["c_mktsegment"]))


INF = """(SELECT * REPLACE (CASE WHEN event_id % 10 = 1 THEN 'inf'::DOUBLE WHEN event_id % 10 = 2 THEN '-inf'::DOUBLE
    WHEN event_id % 10 = 3 THEN NULL WHEN event_id % 10 = 4 THEN 'nan'::DOUBLE ELSE value END AS value) FROM events)"""


@query("replace_inf", f"""SELECT {select_sql('events', {'value': r6('''CASE WHEN value IS NULL OR isinf(value)
    OR isnan(value) THEN 0 ELSE value END''')})} FROM {INF}""")
def replace_inf(spark, sf):
    df = table(spark, sf, "events").withColumn("value", F.expr(
        "CASE WHEN event_id % 10 = 1 THEN double('inf') WHEN event_id % 10 = 2 THEN double('-inf') "
        "WHEN event_id % 10 = 3 THEN NULL WHEN event_id % 10 = 4 THEN double('nan') ELSE value END"))
    return plain(fe.replace_infinite(df))


# --- encode, scale ---------------------------------------------------------------------------------

def code_sql(c: str, rel: str, text: str | None = None) -> str:
    text = text or f"{c}::VARCHAR"
    return (f"(SELECT {text} AS t, dense_rank() OVER (ORDER BY {text}) - 1 AS code "
            f"FROM {rel} GROUP BY {text})")


@query("label_encode", f"""SELECT {select_sql('lineitem', {c: f'd_{c}.code::BIGINT' for c in
    ('l_returnflag', 'l_linestatus', 'l_quantity')})} FROM lineitem l
    JOIN {code_sql('l_returnflag', 'lineitem')} d_l_returnflag ON d_l_returnflag.t = l.l_returnflag::VARCHAR
    JOIN {code_sql('l_linestatus', 'lineitem')} d_l_linestatus ON d_l_linestatus.t = l.l_linestatus::VARCHAR
    JOIN {code_sql('l_quantity', 'lineitem')} d_l_quantity ON d_l_quantity.t = l.l_quantity::VARCHAR""")
def label_encode(spark, sf):
    return plain(fe.label_encode(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity"]))


@query("label_encode_many", f"""SELECT {select_sql('customer', {'c_name': 'd.code::BIGINT'})} FROM customer
    JOIN {code_sql('c_name', 'customer')} d ON d.t = c_name""")
def label_encode_many(spark, sf):
    """A text column with a level per row: the dictionary stays a table."""
    return plain(fe.label_encode(table(spark, sf, "customer"), ["c_name"]))


def std_sql(c: str, rel: str, x: str | None = None) -> str:
    x = x or f"coalesce({c}::DOUBLE, 0)"
    return (f"({x} - (SELECT avg({x}) FROM {rel})) / (SELECT CASE WHEN stddev_pop({x}) = 0 THEN 1 "
            f"ELSE stddev_pop({x}) END FROM {rel})")


@query("scale_standard", f"""SELECT {select_sql('lineitem', {c: r6(std_sql(c, gappy_sql('lineitem'))) for c in
    ('l_quantity', 'l_extendedprice', 'l_discount')})} FROM {gappy_sql('lineitem')}""")
def scale_standard(spark, sf):
    return plain(fe.scale(gappy(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


def minmax_sql(c: str, rel: str) -> str:
    x = f"coalesce({c}::DOUBLE, 0)"
    return (f"({x} - (SELECT min({x}) FROM {rel})) / (SELECT CASE WHEN max({x}) = min({x}) THEN 1 "
            f"ELSE max({x}) - min({x}) END FROM {rel})")


@query("scale_minmax", f"""SELECT {select_sql('orders', {c: r6(minmax_sql(c, gappy_sql('orders'))) for c in
    ('o_totalprice', 'o_custkey')})} FROM {gappy_sql('orders')}""")
def scale_minmax(spark, sf):
    return plain(fe.scale(gappy(spark, sf, "orders"), ["o_totalprice", "o_custkey"], strategy="minmax"))


# --- splits -------------------------------------------------------------------------------------------

@query("split_time", """SELECT o_orderkey::BIGINT AS o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey)
    <= floor((SELECT count(*) FROM orders) * 0.8) THEN 'train' ELSE 'test' END AS split FROM orders""")
def time_split(spark, sf):
    df = table(spark, sf, "orders")
    stamp = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return plain(split_time(df, stamp, F.col("o_orderkey")).select("o_orderkey", "split"))


HASH = "md5('42|' || {k}::VARCHAR)"


@query("split_random", f"""SELECT o_orderkey::BIGINT AS o_orderkey, CASE WHEN row_number() OVER
    (ORDER BY {HASH.format(k='o_orderkey')}) <= ceil((SELECT count(*) FROM orders) * 0.2) THEN 'test' ELSE 'train' END
    AS split FROM orders""")
def random_split(spark, sf):
    return plain(split_random(table(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey", "split"))


def stratified_sql(t: str, y: str, key: str) -> str:
    return f"""q AS (SELECT {y} AS y, c, c - base - CASE WHEN row_number() OVER (ORDER BY rem DESC, {y}::VARCHAR)
        <= ntrain - sum(base) OVER () THEN 1 ELSE 0 END AS n_test FROM (SELECT {y}, c, (c * ntrain) // n AS base,
        (c * ntrain) % n AS rem, ntrain FROM (SELECT {y}, count(*) AS c, (sum(count(*)) OVER ())::BIGINT AS n,
        ((sum(count(*)) OVER ()) - ceil((sum(count(*)) OVER ()) * 0.2))::BIGINT AS ntrain FROM {t} GROUP BY {y}))),
        st AS (SELECT {t}.*, CASE WHEN row_number() OVER (PARTITION BY {y} ORDER BY {HASH.format(k=key)}) <= q.n_test
        THEN 'test' ELSE 'train' END AS split FROM {t} JOIN q ON q.y = {t}.{y})"""


@query("split_stratified", f"""WITH {stratified_sql('labels', 'toxic', 'doc_id')}
    SELECT doc_id::BIGINT AS doc_id, toxic::BIGINT AS toxic, split FROM st""")
def stratified(spark, sf):
    return plain(split_stratified(table(spark, sf, "labels"), "toxic", ["doc_id"]).select("doc_id", "toxic", "split"))


@query("split_stratified_ranges", f"""WITH {stratified_sql('orders', 'o_orderpriority', 'o_orderkey')}
    SELECT o_orderkey::BIGINT AS o_orderkey, o_orderpriority, split FROM st""")
def stratified_ranges(spark, sf):
    """The same split with classes cut into hash ranges, as for classes beyond one task's reach."""
    df = table(spark, sf, "orders")
    return plain(split_stratified(df, "o_orderpriority", ["o_orderkey"], bucket_rows=200)
                 .select("o_orderkey", "o_orderpriority", "split"))


@query("rebalance", f"""WITH {stratified_sql('labels', 'toxic', 'doc_id')}, k AS (SELECT toxic,
    floor(max(count(*)) OVER () / count(*))::BIGINT AS times FROM st WHERE split = 'train' GROUP BY toxic)
    SELECT toxic::BIGINT AS toxic, split, (count(*) * CASE WHEN split = 'train' THEN times ELSE 1 END)::BIGINT AS n
    FROM st JOIN k USING (toxic) GROUP BY toxic, split, times""")
def balanced(spark, sf):
    done = split_stratified(table(spark, sf, "labels"), "toxic", ["doc_id"])
    return plain(rebalance(done, "toxic").groupBy("toxic", "split").agg(F.count("*").alias("n")))


SPLIT_SIZES = """SELECT k.split, (CASE WHEN k.split = 'test' THEN ceil(n * 0.2) ELSE n - ceil(n * 0.2) END)::BIGINT AS n
    FROM (SELECT count(*) AS n FROM {t}), (VALUES ('test'), ('train')) AS k(split)"""


@query("split_duplicates", SPLIT_SIZES.format(t="documents"))
def split_duplicates(spark, sf):
    """Rows without a key, most of them alike."""
    done = split_random(table(spark, sf, "documents").select("lang", "source"))
    return plain(done.groupBy("split").agg(F.count("*").alias("n")))


@query("split_null_target", f"""WITH g AS (SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS y, o_orderkey FROM orders),
    z AS (SELECT count(*) AS n, count(y) AS m FROM g), h AS (SELECT *, ceil(n * 0.2) AS t, ceil(m * 0.2) AS tm FROM z)
    SELECT y IS NULL AS gap, k.split, (CASE WHEN y IS NULL THEN CASE WHEN k.split = 'test' THEN any_value(t - tm) ELSE
    any_value(n - m - t + tm) END ELSE CASE WHEN k.split = 'test' THEN any_value(tm) ELSE any_value(m - tm) END END)::BIGINT AS n
    FROM (SELECT DISTINCT CASE WHEN y IS NOT NULL THEN 'x' END AS y FROM g), h, (VALUES ('test'), ('train')) AS k(split)
    GROUP BY y, k.split""")
def split_null_target(spark, sf):
    df = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("y"), "o_orderkey")
    done = split_stratified(df, "y", ["o_orderkey"])
    return plain(done.groupBy(F.col("y").isNull().alias("gap"), "split").agg(F.count("*").alias("n")))


@query("rebalance_names", """WITH c AS (SELECT toxic, count(*) AS n, floor(max(count(*)) OVER () / count(*))::BIGINT AS times FROM labels
    GROUP BY toxic) SELECT toxic::BIGINT AS toxic, (n * times)::BIGINT AS n, (n * times * 7)::BIGINT AS kept FROM c""")
def rebalance_names(spark, sf):
    """A table that has columns under the helper names."""
    df = table(spark, sf, "labels").withColumns({"copy": F.lit(7), "times": F.lit(1), "n": F.lit(1), "last": F.lit(0)})
    return plain(rebalance(df, "toxic").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("copy").alias("kept")))


# --- correlation, balance ---------------------------------------------------------------------------------

NUMERIC = [c for c, k in columns_of("lineitem") if k in ("int", "double")]
CORR_REL = f"(SELECT *, l_extendedprice * (1 - l_discount) AS l_revenue FROM {gappy_sql('lineitem')})"


def corr_sql(a: str, b: str) -> str:
    return f"CASE WHEN isnan(corr({a}::DOUBLE, {b}::DOUBLE)) THEN NULL ELSE corr({a}::DOUBLE, {b}::DOUBLE) END"


@query("low_corr", "SELECT name, (round(r, 6) + 0.0) AS correlation FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS name, {corr_sql(c, 'l_extendedprice')} AS r FROM {CORR_REL}"
    for c in NUMERIC + ["l_revenue"] if c != "l_extendedprice") + ") WHERE abs(r) < 0.05")
def low_corr(spark, sf):
    df = gappy(spark, sf, "lineitem").withColumn("l_revenue", F.expr("l_extendedprice * (1 - l_discount)"))
    return plain(low_correlation(df, "l_extendedprice").select("name", "correlation"))


_pairs = [(a, b) for i, a in enumerate(NUMERIC + ["l_revenue"]) for b in (NUMERIC + ["l_revenue"])[i + 1:]]


@query("high_corr", "SELECT col1, col2, (round(r, 3) + 0.0) AS correlation FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col1, '{b}' AS col2, {corr_sql(a, b)} AS r FROM {CORR_REL}" for a, b in _pairs)
    + ") WHERE abs(r) > 0.9")
def high_corr(spark, sf):
    df = gappy(spark, sf, "lineitem").withColumn("l_revenue", F.expr("l_extendedprice * (1 - l_discount)"))
    return plain(high_correlation(df).select("col1", "col2", "correlation"))


FAR = "CASE WHEN o_orderkey % 50 = 0 THEN 1e9 + o_orderkey ELSE 1e-3 * o_custkey END"
NEAR = "CASE WHEN o_orderkey % 50 <> 0 THEN 2e-3 * o_custkey + 5 END"


@query("high_corr_wide", f"""SELECT 'x' AS col1, 'y' AS col2, (round(corr(x, y), 3) + 0.0) AS correlation
    FROM (SELECT {FAR} AS x, {NEAR} AS y FROM orders) WHERE y IS NOT NULL""")
def high_corr_wide(spark, sf):
    """A pair that agrees on the rows it shares and lies far away on others, among 140 unrelated columns in two blocks."""
    df = table(spark, sf, "orders").select(
        F.expr(FAR.replace("1e-3", "1e-3D")).alias("x"), F.expr(NEAR).alias("y"),
        *[(F.pmod(F.xxhash64("o_orderkey", F.lit(i)), F.lit(1000))).cast("double").alias(f"z{i}") for i in range(140)])
    return plain(high_correlation(df).select("col1", "col2", "correlation"))


@query("correlated_drops", "SELECT DISTINCT col2 AS name FROM (" + " UNION ALL ".join(
    f"SELECT '{b}' AS col2, {corr_sql(a, b)} AS r FROM {CORR_REL}" for a, b in _pairs)
    + ") WHERE abs(r) > 0.9")
def corr_drops(spark, sf):
    df = gappy(spark, sf, "lineitem").withColumn("l_revenue", F.expr("l_extendedprice * (1 - l_discount)"))
    return plain(correlated_drops(high_correlation(df), "l_extendedprice").select("name"))


def balance_sql(t: str, y: str) -> str:
    return f"""SELECT '{y}' AS target_column, count(*)::BIGINT AS classes, {r6('round(max(n)::DOUBLE / min(n), 4)')} AS ratio,
        count(*) >= 2 AND max(n)::DOUBLE / min(n) > 3 AS enabled, CASE WHEN count(*) < 2 THEN 'Only ' || count(*)
        || ' class(es) found (need at least 2)' WHEN max(n)::DOUBLE / min(n) > 3 THEN
        printf('Class imbalance detected: majority/minority ratio = %.2f', max(n)::DOUBLE / min(n))
        ELSE printf('Class ratio = %.2f (below 3:1 threshold)', max(n)::DOUBLE / min(n)) END AS reason
        FROM (SELECT count(*) AS n FROM {t} WHERE {y} IS NOT NULL GROUP BY {y})"""


@query("class_imbalance", balance_sql("labels", "toxic") + " UNION ALL " + balance_sql("orders", "o_orderstatus"))
def imbalance(spark, sf):
    return plain(class_imbalance(table(spark, sf, "labels"), "toxic").unionByName(
        class_imbalance(table(spark, sf, "orders"), "o_orderstatus")))


# --- whole builds -----------------------------------------------------------------------------------------

def orders_build_sql() -> str:
    """Calendar parts, impute, encode, scale and chronological split of orders, spelled out."""
    rel = gappy_sql("orders")
    parts = {"year": "year(o_orderdate)", "month": "month(o_orderdate)", "day": "day(o_orderdate)",
             "weekday": "isodow(o_orderdate) - 1", "quarter": "quarter(o_orderdate)",
             "is_weekend": "CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END"}
    clean = (f"SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) "
             f"FROM {rel})) AS o_totalprice, coalesce(o_orderpriority, 'unknown') AS o_orderpriority, "
             + ", ".join(f"{e} AS o_orderdate_{p}" for p, e in parts.items()) + ", o_orderdate "
             f"FROM {rel}")
    encoded = ["o_orderpriority"] + [f"o_orderdate_{p}" for p in ("year", "weekday", "quarter", "is_weekend")]
    # month and day have more than ten levels and stay numbers
    numbers = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate_month", "o_orderdate_day"]
    codes = ", ".join(f"(dense_rank() OVER (ORDER BY {c}::VARCHAR) - 1)::DOUBLE AS {c}" for c in encoded)
    coded = (f"SELECT o_orderdate, o_orderkey AS k, o_orderstatus, {', '.join(c + '::DOUBLE AS ' + c for c in numbers)}, "
             f"{codes} FROM clean")
    scaled = ", ".join(r6(std_sql(c, "coded", c)) + f" AS {c}" for c in numbers + encoded)
    return (f"WITH clean AS ({clean}), coded AS ({coded}) SELECT o_orderstatus, {scaled}, "
            f"CASE WHEN row_number() OVER (ORDER BY o_orderdate, k) <= floor((SELECT count(*) FROM coded) * 0.8) "
            f"THEN 'train' ELSE 'test' END AS split FROM coded")


@query("feature_build", orders_build_sql())
def feature_build(spark, sf):
    return plain(fe.build_features(gappy(spark, sf, "orders"), ["o_orderkey"]).frame)


def lineitem_build_sql() -> str:
    rel = gappy_sql("lineitem")
    clean = (f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(l_quantity, (SELECT quantile_cont(l_quantity, "
             f"0.5) FROM {rel})) AS l_quantity, l_extendedprice, l_discount, l_tax, coalesce(l_returnflag, 'unknown') "
             f"AS l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate FROM {rel}")
    encoded = ["l_linenumber", "l_tax", "l_returnflag", "l_shipdate"]
    numbers = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]
    codes = ", ".join(f"(dense_rank() OVER (ORDER BY {c}::VARCHAR) - 1)::DOUBLE AS {c}" for c in encoded)
    coded = f"SELECT l_linestatus, {', '.join(c + '::DOUBLE AS ' + c for c in numbers)}, {codes} FROM clean"
    both = ", ".join(r6(std_sql(c, "coded", c)) + f" AS {c}" for c in numbers + encoded)
    return f"WITH clean AS ({clean}), coded AS ({coded}) SELECT l_linestatus, {both} FROM coded"


@query("feature_build_lineitem", lineitem_build_sql())
def feature_build_lineitem(spark, sf):
    plan = {"target_column": "l_linestatus", "task_type": "classification"}
    return plain(fe.build_features(gappy(spark, sf, "lineitem"), [], plan, detect_time=False, split=False).frame)


@query("head_sample", f"SELECT {select_sql('orders')} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def sample_head(spark, sf):
    return plain(head_sample(table(spark, sf, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 50))


@query("promote_header", """SELECT s_suppkey::VARCHAR AS "0", s_name AS "Supplier#000000000", s_nationkey::VARCHAR AS nationkey
    FROM supplier WHERE s_suppkey > 0""")
def header_promoted(spark, sf):
    df = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string"), "s_name", F.when(F.col("s_suppkey") == 0, " nationkey ").otherwise(
            F.col("s_nationkey").cast("string")).alias("s_nationkey"))
    return plain(promote_header(df, F.col("s_suppkey").cast("long")))


# --- plan execution --------------------------------------------------------------------------------------

MODE = ("(SELECT c_mktsegment FROM " + gappy_sql("customer") + " WHERE c_mktsegment IS NOT NULL GROUP BY 1 "
        "ORDER BY count(*) DESC, 1 LIMIT 1)")


@query("apply_impute", f"""SELECT {select_sql('customer', {
    'c_acctbal': r6('coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM ' + gappy_sql('customer') + '))'),
    'c_mktsegment': f'coalesce(c_mktsegment, {MODE})'})} FROM {gappy_sql('customer')}""")
def apply_impute(spark, sf):
    df = ex.impute_numeric(gappy(spark, sf, "customer"), ["c_acctbal"], "mean")
    return plain(ex.impute_categorical(df, ["c_mktsegment"], "most_frequent"))


@query("apply_impute_constant", f"""SELECT {select_sql('customer', {'c_mktsegment': "coalesce(c_mktsegment, 'Unknown')"})}
    FROM {gappy_sql('customer')}""")
def apply_constant(spark, sf):
    return plain(ex.impute_categorical(gappy(spark, sf, "customer"), ["c_mktsegment"], "constant"))


LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("one_hot", f"""SELECT {select_sql('orders', skip=('o_orderpriority',))}, {', '.join(
    f'''(CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END)::BIGINT AS "o_orderpriority_{v}"''' for v in LEVELS)}
    FROM {gappy_sql('orders')}""")
def one_hot(spark, sf):
    return plain(ex.one_hot(gappy(spark, sf, "orders"), ["o_orderpriority"]))


@query("log_transform", f"SELECT {select_sql('events', {'value': r6('ln(1 + value)')})} FROM {gappy_sql('events')}")
def log_values(spark, sf):
    return plain(ex.log_transform(gappy(spark, sf, "events"), ["value"]))


_q = "(SELECT quantile_cont(value, {p}) FROM " + gappy_sql("events") + ")"
_q1, _q3 = _q.format(p=0.25), _q.format(p=0.75)


@query("cap_outliers", f"""SELECT {select_sql('events', {'value': r6(f'''CASE WHEN value IS NULL THEN NULL ELSE
    least(greatest(value, {_q1} - 1.5 * ({_q3} - {_q1})), {_q3} + 1.5 * ({_q3} - {_q1})) END''')})}
    FROM {gappy_sql('events')}""")
def capped(spark, sf):
    return plain(ex.cap_outliers(gappy(spark, sf, "events"), ["value"]))


@query("dedup_rows", """SELECT text, min(doc_id)::BIGINT AS doc_id, arg_min(lang, doc_id) AS lang,
    arg_min(source, doc_id) AS source FROM documents GROUP BY text""")
def dedup(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return plain(ex.dedup_rows(df, ["text"], ["doc_id"]))


PLAN = {
    "target_column": "c_mktsegment", "task_type": "classification",
    "preprocessing": {
        "drop_columns": ["c_name"],
        "imputation": {"numeric_strategy": "median", "numeric_columns": ["c_acctbal"],
                       "categorical_strategy": "constant", "categorical_columns": [], "constant_value": "Unknown"},
        "encoding": {"one_hot_columns": [], "label_encoding_columns": []},
        "scaling": {"strategy": "minmax", "columns": ["c_acctbal", "c_custkey"]},
        "log_transform": ["c_custkey"],
    },
    "split_strategy": {"test_size": 0.25, "random_state": 7, "stratify": False},
}


def plan_sql() -> str:
    rel = gappy_sql("customer")
    clean = (f"SELECT c_custkey AS k, ln(1 + c_custkey::DOUBLE) AS c_custkey, c_nationkey, coalesce(c_acctbal, "
             f"(SELECT quantile_cont(c_acctbal, 0.5) FROM {rel})) AS c_acctbal, c_mktsegment FROM {rel}")
    h = "md5('7|{\"c_custkey\":' || k::VARCHAR || '}')"
    return (f"WITH clean AS ({clean}) SELECT {r6(minmax_sql('c_custkey', 'clean'))} AS c_custkey, c_nationkey::BIGINT "
            f"AS c_nationkey, {r6(minmax_sql('c_acctbal', 'clean'))} AS c_acctbal, c_mktsegment, CASE WHEN row_number() OVER "
            f"(ORDER BY {h}) <= ceil((SELECT count(*) FROM clean) * 0.25) THEN 'test' ELSE 'train' END AS split FROM clean")


@query("apply_plan_full", plan_sql())
def plan_applied(spark, sf):
    return plain(ex.apply_plan(gappy(spark, sf, "customer"), PLAN, keys=["c_custkey"]).frame)


EVERY_LIST = {
    "target_column": "c_nationkey", "task_type": "regression",
    "preprocessing": {
        "drop_columns": ["c_flag", "c_nationkey"],
        "imputation": {"numeric_strategy": "median", "numeric_columns": ["c_acctbal"],
                       "categorical_strategy": "constant", "categorical_columns": ["c_mktsegment"], "constant_value": "Unknown"},
        "encoding": {"one_hot_columns": ["c_mktsegment"], "label_encoding_columns": ["c_name"]},
        "scaling": {"strategy": "standard", "columns": ["c_acctbal", "c_name", "c_nationkey"]},
        "log_transform": ["c_weight"],
    },
    "split_strategy": {"test_size": 0.25, "random_state": 7, "stratify": False},
}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "Unknown"]


def every_list_sql() -> str:
    rel = gappy_sql("customer")
    standard = lambda c: r6(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1)")
    levels = ", ".join(f"(s = '{v}')::BIGINT AS \"c_mktsegment_{v}\"" for v in SEGMENTS)
    return f"""WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_name) - 1 AS name_code, c_nationkey,
            coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM {rel})) AS x, coalesce(c_mktsegment, 'Unknown') AS s FROM {rel}),
        q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM a WHERE x IS NOT NULL),
        b AS (SELECT a.*, least(greatest(x, q1 - 0.15 * (q3 - q1)), q3 + 0.15 * (q3 - q1)) AS y FROM a, q)
        SELECT {standard('name_code')} AS c_name, c_nationkey::BIGINT AS c_nationkey, {standard('y')} AS c_acctbal,
            {r6('ln(1 + c_custkey % 17)')} AS c_weight, {levels}, CASE WHEN row_number() OVER
            (ORDER BY md5('7|{{"c_custkey":' || c_custkey::VARCHAR || '}}')) <= ceil(count(*) OVER () * 0.25) THEN 'test' ELSE 'train' END AS split FROM b"""


@query("apply_plan_every_list", every_list_sql().replace("0.15", "1.5"))
def plan_every_list(spark, sf):
    """Dedup, drops (the target's own is ignored), low-correlation drop, both imputations, cap, log, label codes, one-hot, scale, split."""
    df = gappy(spark, sf, "customer").withColumns({"c_flag": F.lit(1), "c_weight": F.col("c_custkey") % 17})
    done = ex.apply_plan(df.unionByName(df), EVERY_LIST, keys=["c_custkey"], dedup=True, cap=["c_acctbal", "c_nationkey"], low_correlation=["c_custkey"])
    return plain(done.frame)
