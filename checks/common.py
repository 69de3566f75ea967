"""Shared pieces of the registered queries and of their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the given tables; used only to write SQL.
TABLES = {
    "region": "r_regionkey:int r_name:str",
    "nation": "n_nationkey:int n_name:str n_regionkey:int",
    "customer": "c_custkey:int c_name:str c_nationkey:int c_acctbal:double c_mktsegment:str",
    "supplier": "s_suppkey:int s_name:str s_nationkey:int s_acctbal:double",
    "part": "p_partkey:int p_name:str p_brand:str p_type:str p_size:int p_retailprice:double",
    "orders": "o_orderkey:int o_custkey:int o_orderstatus:str o_totalprice:double o_orderdate:ts o_orderpriority:str",
    "lineitem": "l_orderkey:int l_partkey:int l_suppkey:int l_linenumber:int l_quantity:double "
                "l_extendedprice:double l_discount:double l_tax:double l_returnflag:str l_linestatus:str l_shipdate:ts",
    "events": "event_id:int ts:ts user_id:int event_type:str value:double props:str",
    "documents": "doc_id:int text:str lang:str source:str n_chars:int",
    "embeddings": "vec_id:int embedding:list label:int",
    "pages": "page_id:int url:str html:str",
    "benchmark": "item_id:int text:str",
    "labels": "doc_id:int quality:int toxic:int",
    "conversations": "conv_id:int turn:int role:str text:str",
}
SPARK_TYPES = {"int": "bigint", "double": "double", "str": "string", "ts": "timestamp", "list": "array"}


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in TABLES[table].split()]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def all_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf, t) for t in TABLES}


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: 64-bit integers, rounded doubles, lists as text, times as text."""
    out = []
    for f in df.schema.fields:
        c = F.col("`" + f.name + "`")
        if isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FractionalType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def r6(expr: str) -> str:
    return f"(round(({expr})::DOUBLE, 6) + 0.0)"


def time_text(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


# --- nulls put into the given tables, the same way on both sides ---------------------------

GAPS = {
    "lineitem": {"l_quantity": "l_linenumber = 7", "l_returnflag": "l_linenumber = 6"},
    "orders": {"o_totalprice": "o_orderkey % 11 = 0", "o_orderpriority": "o_orderkey % 13 = 0"},
    "customer": {"c_acctbal": "c_custkey % 7 = 0", "c_mktsegment": "c_custkey % 9 = 0"},
    "events": {"value": "event_id % 10 = 3"},
}


def gappy(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = table(spark, sf, name)
    return df.select(*[
        F.expr(f"CASE WHEN {GAPS[name][c]} THEN NULL ELSE {c} END").alias(c) if c in GAPS[name] else F.col(c)
        for c in df.columns])


def gappy_sql(name: str) -> str:
    cols = [f"CASE WHEN {GAPS[name][c]} THEN NULL ELSE {c} END AS {c}" if c in GAPS[name] else c
            for c, _ in columns_of(name)]
    return f"(SELECT {', '.join(cols)} FROM {name})"


# --- profile in SQL ---------------------------------------------------------------------------

def profile_column_sql(dataset: str, relation: str, ordinal: int, name: str, kind: str) -> str:
    head = (f"'{dataset}' AS dataset, {ordinal} AS ordinal, '{name}' AS name, count(*) AS n, "
            f"count(*) - count({name}) AS miss, count(DISTINCT {name}) AS uniq")
    if kind not in ("int", "double"):
        return (f"SELECT s.*, 'object' AS dtype, NULL::DOUBLE AS mn, NULL::DOUBLE AS mx, NULL::DOUBLE AS mean, "
                f"NULL::DOUBLE AS skew, NULL::DOUBLE AS q1, NULL::DOUBLE AS q3, NULL::BIGINT AS outl "
                f"FROM (SELECT {head} FROM {relation} t) s")
    x = f"{name}::DOUBLE"
    skew = (f"CASE WHEN count({name}) < 3 THEN NULL WHEN min({name}) = max({name}) THEN 0.0 "
            f"ELSE skewness({x}) END")
    base = (f"SELECT {head}, min({x}) AS mn, max({x}) AS mx, avg({x}) AS mean, {skew} AS skew, "
            f"quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {relation} t")
    dtype = "'float64'" if kind == "double" else "CASE WHEN s.miss > 0 THEN 'float64' ELSE 'int64' END"
    return (f"SELECT s.dataset, s.ordinal, s.name, s.n, s.miss, s.uniq, {dtype} AS dtype, s.mn, s.mx, s.mean, "
            f"s.skew, s.q1, s.q3, (SELECT count(*) FROM {relation} u WHERE u.{name} < s.q1 - 1.5 * (s.q3 - s.q1) "
            f"OR u.{name} > s.q3 + 1.5 * (s.q3 - s.q1)) AS outl FROM ({base}) s")


def profile_sql(relations: dict[str, str] | None = None) -> str:
    """CTE list ``raw, prof`` over the given tables (all of them by default)."""
    relations = relations or {t: t for t in TABLES}
    parts = []
    for t, rel in relations.items():
        for i, (c, k) in enumerate(columns_of(t)):
            parts.append(profile_column_sql(t, rel, i, c, k))
    union = "\nUNION ALL\n".join(f"SELECT dataset, ordinal, name, n, miss, uniq, dtype, mn, mx, mean, skew, q1, q3, outl "
                                 f"FROM ({p})" for p in parts)
    return (f"raw AS ({union}), prof AS (SELECT *, ordinal = max(ordinal) OVER (PARTITION BY dataset) AS is_last, "
            f"round(miss * 100.0 / n, 2) AS pct, coalesce(abs(skew) > 1, FALSE) AS is_skewed FROM raw)")


PROFILE_OUT = (
    "dataset, ordinal::BIGINT AS ordinal, name, dtype, n::BIGINT AS row_count, miss::BIGINT AS missing_count, "
    f"{r6('pct')} AS missing_percentage, uniq::BIGINT AS unique_count, {r6('mn')} AS min, {r6('mx')} AS max, "
    "(round(mean, 3) + 0.0) AS mean, (round(skew, 4) + 0.0) AS skewness, outl::BIGINT AS outlier_count"
)


def profile_out(p: DataFrame) -> DataFrame:
    return plain(p.select(
        "dataset", "ordinal", "name", "dtype", "row_count", "missing_count", "missing_percentage", "unique_count",
        "min", "max", F.round("mean", 3).alias("mean"), "skewness", "outlier_count"))


# --- name rules in SQL ---------------------------------------------------------------------------

def sql_squash(c: str, chars: str = "_- ") -> str:
    return f"lower(translate(trim({c}), '{chars}', ''))"


def sql_any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def sql_in(c: str, words: list[str]) -> str:
    return f"{c} IN (" + ", ".join(f"'{w}'" for w in words) + ")"


def sql_id(c: str, variant: str) -> str:
    if variant == "substring":
        return sql_any(c, ["id", "Id", "ID", "customerID", "EmployeeNumber", "index", "IMBD title ID", "PassengerId"])
    if variant == "profile":
        n = sql_squash(c)
        return f"(suffix({n}, 'id') OR contains({n}, 'passengerid'))"
    if variant == "dispatcher":
        n = sql_squash(c)
        words = sql_any(n, ["passengerid", "customerid", "employeeid", "employeenumber"])
        return f"(suffix({n}, 'id') OR starts_with({n}, 'unnamed') OR {words})"
    if variant == "generator":
        n = sql_squash(c, "_ ")
        return f"(suffix({n}, 'id') OR {sql_any(n, ['passengerid', 'unnamed'])})"
    return f"suffix({sql_squash(c, '_-')}, 'id')"


def sql_date(c: str) -> str:
    return sql_any(f"lower(trim({c}))", ["date", "time", "timestamp", "created_at", "updated_at"])
