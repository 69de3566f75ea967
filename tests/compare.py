"""Run registered queries against their SQL twins on DuckDB."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


def connect(sf: str):
    con = duckdb.connect()
    for f in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return f"{type(v).__name__}:{v!r}"


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf: str) -> tuple[bool, str]:
    from __spark_entry__ import oracle_sql, queries

    t = time.time()
    df = queries()[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    sql = oracle_sql().get(name)
    if sql is None:
        return len(got) > 0, f"rows only: {len(got)} rows in {took:.1f}s"
    rel = con.execute(sql)
    want_columns = [d[0] for d in rel.description]
    want = rows_of(want_columns, rel.fetchall())
    if sorted(df.columns) != sorted(want_columns):
        return False, f"columns {sorted(df.columns)} != {sorted(want_columns)}"
    if got == want:
        return True, f"{len(got)} rows in {took:.1f}s"
    a, b = set(got), set(want)
    diff = [r for r in got if r not in b][:2], [r for r in want if r not in a][:2]
    return False, f"{len(got)} vs {len(want)} rows; spark only {diff[0]}; sql only {diff[1]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from __spark_entry__ import queries

    sf = sys.argv[1]
    names = sys.argv[2:] or list(queries())
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, name, sf)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(("ok  " if ok else "FAIL"), name, note, flush=True)
    print("failed:", bad)
