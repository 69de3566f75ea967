"""Rank, lookup, split, feature and profile operators against pandas and brute force."""

import functools
import os
import subprocess
import sys
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import ROOT
from tablesmith.functions.names import clean_dataset_id, parse_filename, short_name
from tablesmith.functions.numeric import float_text, safe_corr
from tablesmith.operators import features as fe
from tablesmith.operators import ranks
from tablesmith.operators.correlate import block_correlations, block_moments, merge_moments, pair_correlations
from tablesmith.operators.infer import detect_time_column, detect_time_profile, profile_target, time_frequency, time_steps
from tablesmith.operators.lookup import attach, broadcast_share
from tablesmith.operators.profile import distinct_counts, profile, profile_many, sample_values
from tablesmith.operators.ranks import exact_quantiles, global_row_number, order_statistics, rank_cut, with_previous
from tablesmith.operators.split import rebalance, split_random, split_stratified, split_time
from tablesmith.session import with_row_id

quick = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


@quick
@given(st.lists(st.integers(-5, 5) | st.integers(-10**6, 10**6), min_size=30, max_size=200))
def test_order_statistics_is_exact_with_ties(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x long")
    n = len(values)
    ranks = [0, n // 4, n // 2, n - 1]
    got = order_statistics(df, {"x": F.col("x")}, {"x": ranks}, {"x": n}, finish_rows=5)["x"]
    assert got == {r: sorted(values)[r] for r in ranks}


def test_hot_value_holding_most_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(7.0)).otherwise(F.col("id").cast("double")).alias("x"))
    got = exact_quantiles(df, {"x": F.col("x")}, [0.1, 0.5, 0.9], {"x": 3000}, 3000, single_task_rows=20)["x"]
    assert got == pytest.approx(df.toPandas().x.quantile([0.1, 0.5, 0.9]).tolist())


def test_rank_cut_inside_ties(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 1000).alias("t"))
    cut = rank_cut(df, F.col("k"), F.col("t"), 499, 1000, finish_rows=10)
    want = df.toPandas().sort_values(["k", "t"]).head(500)
    got = df.where(cut).toPandas().sort_values(["k", "t"])
    assert got.values.tolist() == want.values.tolist()


def test_global_order_over_ranges(spark):
    df = spark.range(2000).select(((F.col("id") * 7919) % 2000).alias("k"), F.col("id").alias("v"))
    pos = global_row_number(df, F.col("k"), "p")
    assert pos.where("p <> k").count() == 0
    text = df.select(F.lpad(F.col("k").cast("string"), 5, "0").alias("s"))
    assert global_row_number(text, F.col("s"), "p").where("p <> cast(s as long)").count() == 0
    prev = with_previous(df, F.col("k"), F.col("k"))
    assert prev.where("previous is null").count() == 1 and prev.where("value - previous <> 1").count() == 0


def test_attach_gives_the_same_rows_on_every_path(spark):
    # key 0 holds two thirds of the rows
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).cast("string").alias("k"), "id")
    df = df.unionByName(spark.sql("select cast(null as string) k, 5000L id"))
    dim = df.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("v"))
    small = attach(df, F.col("k"), dim, "k", ["v"])
    large = attach(df, F.col("k"), dim, "k", ["v"], broadcast_rows=0)
    key = lambda d: sorted(map(tuple, d.select("id", "k", "v").collect()))
    assert key(small) == key(large) and len(key(large)) == 3001


@quick
@given(st.integers(5, 300))
def test_split_sizes(spark, n):
    df = spark.range(n)
    assert split_random(df, ["id"]).where("split = 'test'").count() == int(np.ceil(n * 0.2))
    timed = split_time(df, F.col("id") % 4, F.col("id")).where("split = 'train'").count()
    assert timed == int(n * 0.8)


def test_stratified_falls_back_when_a_class_is_too_small(spark):
    df = spark.range(50).select("id", F.when(F.col("id") == 0, "rare").otherwise("common").alias("y"))
    assert split_stratified(df, "y", ["id"]).where("split = 'test'").count() == 10
    even = spark.range(100).select("id", (F.col("id") % 4).alias("y"))
    out = split_stratified(even, "y", ["id"], bucket_rows=5).where("split = 'test'").groupBy("y").count()
    assert {r[1] for r in out.collect()} == {5}


def test_rebalance_without_split_column(spark):
    df = spark.range(40).select("id", (F.col("id") < 8).alias("y"))
    got = {r[0]: r[1] for r in rebalance(df, "y").groupBy("y").count().collect()}
    assert got == {False: 32, True: 32}


def test_profile_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=400), "b": rng.integers(0, 9, 400), "c": list("wxyz") * 100})
    pdf.loc[::7, "a"] = np.nan
    p = {r["name"]: r for r in profile(spark.createDataFrame(pdf), "t", F.monotonically_increasing_id()).collect()}
    for c in "ab":
        assert p[c]["skewness"] == pytest.approx(pdf[c].skew(), abs=1e-4)
        assert p[c]["q1"] == pytest.approx(pdf[c].quantile(0.25))
        assert p[c]["unique_count"] == pdf[c].nunique()
        q1, q3 = pdf[c].quantile([0.25, 0.75])
        far = (pdf[c] < q1 - 1.5 * (q3 - q1)) | (pdf[c] > q3 + 1.5 * (q3 - q1))
        assert p[c]["outlier_count"] == far.sum()
    assert p["a"]["missing_count"] == pdf.a.isna().sum()
    assert p["c"]["sample_values"] == ["w", "x", "y"] and p["c"]["dtype"] == "object"


def test_constant_null_and_approx_columns(spark):
    df = spark.range(10).select(F.lit(1.0).alias("one"), F.lit(None).cast("double").alias("none"), "id")
    p = {r["name"]: r for r in profile(df).collect()}
    assert p["one"]["skewness"] == 0.0 and p["none"]["unique_count"] == 0 and p["none"]["min"] is None
    rough = {r["name"]: r["unique_count"] for r in profile(df, distinct="approx").collect()}
    assert rough["id"] == 10


def test_one_bad_table_does_not_stop_the_others(spark):
    bad = spark.range(3).select(F.raise_error(F.lit("boom")).cast("int").alias("x"))
    p, failed = profile_many(spark, {"ok": spark.range(5).toDF("a"), "bad": bad})
    assert [r["dataset"] for r in p.collect()] == ["ok"] and failed.first()["dataset"] == "bad"


def test_y_counts_as_part_of_a_name(spark):
    df = spark.createDataFrame([(1, 2.0), (3, 4.0)], "y_axis long, other double")
    best = profile_target(profile(df)).first()
    assert (best["target_column"], best["target_detection_method"]) == ("y_axis", "partial_keyword")


def test_correlations_match_pandas_with_gaps_and_constants(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(300, 3)), columns=list("abc"))
    pdf["d"] = pdf.a * 2 + 1e6
    pdf["k"] = 3.0
    pdf.loc[::5, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    want = pdf.corr()
    for got in (block_correlations(df, list("abcdk")), block_correlations(df.repartition(7), list("abcdk"), width=2, fan=2), pair_correlations(df, [("a", "b"), ("a", "d"), ("a", "k")])):
        for r in got.collect():
            w = want.loc[r["col1"], r["col2"]]
            assert r["correlation"] is None if np.isnan(w) else r["correlation"] == pytest.approx(w, abs=1e-9)
    assert df.agg(safe_corr(F.col("a"), F.col("k"))).first()[0] is None


def test_narrowing_shares_sketches_and_counts_in_short_aggregates(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({f"c{i}": rng.integers(0, 50 + 400 * i, 3000).astype(float) for i in range(6)})
    sizes, seen, run = {c: len(pdf) for c in pdf}, [], ranks.agg_row
    monkeypatch.setattr(ranks, "agg_row", lambda df, exprs, chunk=4 * ranks.AGG_CHUNK: seen.append((len(exprs), chunk)) or run(df, exprs, chunk))
    got = exact_quantiles(spark.createDataFrame(pdf), {c: F.col(c) for c in pdf}, [0.25, 0.75], sizes, len(pdf), 100)
    assert all(got[c] == pytest.approx(list(np.quantile(pdf[c], [0.25, 0.75]))) for c in pdf)
    assert seen[0][0] == len(sizes) and all(min(seen[i]) <= 16 for i in (0, 1))  # a sketch a column, then short counts


def test_wide_correlations_with_gaps_are_products_of_matrices():
    """A gap in one column costs a block of 128 columns no sum for each pair, and pairs far from their columns' means keep their digits."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(10_000, 128))
    x[rng.random(x.shape) < 0.01] = np.nan
    start = time.process_time()
    block_moments(x, x)
    assert time.process_time() - start < 1.5
    y = rng.normal(size=(200, 5))
    y[rng.random(y.shape) < 0.2] = np.nan
    y[::9, 3] = np.nan  # column 4 lies far away where column 3 has none, column 2 is constant where it has some
    y[:, 2] = np.where(np.isnan(y[:, 3]), y[:, 2], 5.0)
    y[:, 4] = np.where(np.isnan(y[:, 3]), 1e9 + y[:, 4], y[:, 3] * 1e-3)
    y[:, 0] = np.where(np.isnan(y[:, 1]), y[:, 0], np.nan)  # no rows in common
    for parts in ([y], [y[:70], y[70:]]):
        total = functools.reduce(merge_moments, [block_moments(p, p) for p in parts])
        for i in range(5):
            for j in range(5):
                both = ~np.isnan(y[:, i]) & ~np.isnan(y[:, j])
                a, b = y[both, i], y[both, j]
                da, db = (a - a.mean(), b - b.mean()) if both.any() else (a, b)
                want = [len(a), a.mean() if len(a) else 0, b.mean() if len(a) else 0, (da * da).sum(), (db * db).sum(), (da * db).sum()]
                assert [m[i, j] for m in total] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_wide_correlations_from_another_folder(tmp_path):
    """Workers that cannot import the package: the functions travel by value."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import numpy as np, pandas as pd
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate())
from tablesmith.facade import prepare
from tablesmith.operators.correlate import block_correlations, high_correlation
x = np.random.default_rng(1).normal(size=(400, 300))
x[:, 299] = x[:, 3] * 2
x[::7, 5] = np.nan
df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{{i}}" for i in range(300)]))
assert [tuple(r)[1:3] for r in high_correlation(df).collect()] == [("c3", "c299")]
got = {{(r.col1, r.col2): r.correlation for r in block_correlations(df, df.columns).collect()}}
want = pd.DataFrame(x).corr().to_numpy()
assert len(got) == 300 * 299 // 2 and all(abs(got[f"c{{i}}", f"c{{j}}"] - want[i, j]) < 1e-9 for i in range(300) for j in range(i + 1, 300))
with open("in.csv", "w") as f:
    f.write("PassengerId,Age,Fare,Survived\\n" + "\\n".join(f"{{i}},{{20 + i % 40}},{{i * 1.5}},{{i % 2}}" for i in range(60)))
prepare(spark, "in.csv", {str(tmp_path / "warehouse")!r})
print("fine")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env, timeout=600)
    assert "fine" in done.stdout, done.stderr[-3000:]


def test_float_text_is_python_text(spark):
    values = [0.0, 1.5, -2.0, 1e7, 12345678.5, 1e15, 1e16, 1.5e20, 0.001, 0.0005, 0.0001, 1e-5, 1.25e-7, 1 / 3]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(float_text(F.col("x"))).collect()
    assert [r[0] for r in got] == [str(v) for v in values]


def test_file_names(spark):
    names = ["a/20260331_173925_1acb0a5a_automobile_dataset.csv", "plain.csv", "20260331_173925_1acb0a5a_X y_cleaned.csv"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    parsed = [r[0] for r in df.select(parse_filename("p")).collect()]
    assert (parsed[0]["version"], parsed[0]["name"]) == ("1acb0a5a", "automobile_dataset")
    assert parsed[1]["version"] is None and parsed[1]["base_name"] == "plain"
    assert df.select(clean_dataset_id("p")).collect()[2][0] == "x_y"
    short = spark.createDataFrame([("20260331_a_deadbeef_B c",), ("12345678_123456",)], "n string")
    assert [r[0] for r in short.select(short_name("n")).collect()] == ["a_b_c", "12345678_123456"]


def test_label_codes_sort_as_text(spark):
    df = spark.createDataFrame([(9, 1.5), (10, 10.0), (9, 2.0)], "n int, x double")
    got = fe.label_encode(df, ["n", "x"]).collect()
    assert [r["n"] for r in got] == [1, 0, 1] and [r["x"] for r in got] == [0, 1, 2]


def test_levels_around_the_limits(spark):
    df = spark.range(1000).select(*[(F.col("id") % k).alias(f"l{k}") for k in (1, 10, 11, 100, 101)], "id")
    got = fe.few_levels(df, df.columns)
    assert {c: len(v) for c, v in got.items()} == {"l1": 1, "l10": 10, "l11": 11, "l100": 100}


def test_build_drops_imputes_encodes_scales(spark):
    pdf = pd.DataFrame({
        "width": np.arange(60.0), "flat": 1, "amount": np.arange(60) * 1.5, "color": ["r", "g", None] * 20,
        "big": [f"t{i:03d}" for i in range(60)], "churn": [0, 1] * 30})
    pdf.loc[3, "amount"] = np.nan
    pdf.loc[4, "amount"] = np.inf
    df = spark.createDataFrame(pdf).withColumn("ok", F.col("churn") == 1)
    b = fe.build_features(df, ["big"], detect_time=False)
    assert b.target == "churn" and b.task_type == "classification"
    assert b.dropped_ids == ["width"] and b.dropped_constants == ["flat"]
    assert set(b.encoded) == {"color", "big", "ok"}
    out = b.frame.toPandas()
    assert out.groupby("split").size().to_dict() == {"test": 12, "train": 48}
    for c in ("amount", "color", "big", "ok"):
        assert out[c].mean() == pytest.approx(0, abs=1e-9) and out[c].std(ddof=0) == pytest.approx(1)
    assert not out.isna().any().any()
    flat = fe.build_features(df, ["big"], {"target_column": "churn", "preprocessing_plan": {
        "preprocessing": {"scaling": {"strategy": "minmax"}}}}, detect_time=False, split=False)
    m = flat.frame.toPandas()
    assert flat.scaling == "minmax" and (m.amount.min(), m.amount.max(), m.color.max()) == (0, 1, 1)


def test_drops_never_take_everything(spark):
    df = spark.createDataFrame([(1, 1)], "id int, paid int")
    assert fe.drop_id_columns(df)[0].columns == ["id", "paid"]
    assert fe.drop_constant_columns(df)[0].columns == ["id", "paid"]
    assert fe.drop_constant_columns(df, "id")[0].columns == ["id"]


def test_time_columns(spark):
    df = spark.createDataFrame([(i, f"2024-01-{i:02d}" if i % 3 else "?", 2011) for i in range(1, 20)],
                               "n int, order_date string, year int")
    assert detect_time_column(df) == "order_date"
    assert detect_time_profile(df, F.col("n")) == "order_date"
    assert detect_time_profile(df.drop("order_date"), F.col("n")) == "year"  # numbers read as epoch values
    assert detect_time_profile(df.drop("order_date"), F.col("n"), strict=True) is None
    assert time_frequency(time_steps(df, "order_date", F.col("n"))).first()["frequency"] == "invalid_format"
    weekly = spark.range(30).select("id", F.timestamp_seconds(F.col("id") * 7 * 86400).alias("t"))
    assert time_frequency(time_steps(weekly, "t", F.col("id"))).first()["frequency"] == "weekly"
    back = time_frequency(time_steps(weekly, "t", -F.col("id"))).first()["frequency"]
    assert back == "irregular"  # falling order, steps of minus a week


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 6)), max_size=40), st.sampled_from(["as is", "up", "down"]), st.integers(1, 5))
def test_step_and_order_fold_over_ranges(spark, values, order, parts):
    if order != "as is":
        values = sorted((v for v in values if v is not None), reverse=order == "down")
    rows = [(i, None if v is None else f"2024-01-{v + 1:02d}") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, t string").repartition(parts, "i")
    got = time_steps(df, "t", F.col("i")).first()
    steps = [b - a for a, b in zip(values, values[1:]) if a is not None and b is not None]
    day = 86_400_000_000
    top = min(set(steps), key=lambda x: (-steps.count(x), x), default=None)
    assert got["modal_step_micros"] == (None if top is None else top * day)
    assert got["is_monotonic"] == (None not in values and (all(x >= 0 for x in steps) or all(x <= 0 for x in steps)))


def test_first_samples_far_from_the_head(spark):
    df = spark.range(2000).select(
        "id", F.when(F.col("id") < 1500, "a").when(F.col("id") < 1800, None).otherwise(F.concat(F.lit("v"), F.col("id") % 3)).alias("late"),
        F.when(F.col("id") % 7 == 0, "x" * 5000).alias("two"), F.lit(None).cast("string").alias("none"),
        F.concat(F.lit("u"), 3000 - F.col("id")).alias("many")).repartition(5)
    got = sample_values(df, ["late", "two", "none", "many"], F.col("id")).collect()
    assert [(r["ordinal"], r["rank"], r["value"]) for r in got] == [
        (0, 1, "a"), (0, 2, "v0"), (0, 3, "v1"), (1, 1, "x" * 5000), (3, 1, "u3000"), (3, 2, "u2999"), (3, 3, "u2998")]
    assert sample_values(df.limit(0), ["late"], F.col("id")).count() == 0


def test_distinct_counts_of_many_kinds(spark):
    df = spark.range(500).select(
        F.col("id"), (F.col("id") % 7).cast("double").alias("d"), F.repeat(F.concat(F.lit("t"), F.col("id") % 11), 900).alias("long"),
        F.array(F.when(F.col("id") % 2 == 0, F.col("id") % 3)).alias("list"), F.create_map(F.lit("k"), F.col("id") % 5).alias("map"),
        (F.col("id") % 13).cast("decimal(30,2)").alias("dec"), F.when(F.col("id") % 2 == 0, float("nan")).otherwise(1.0).alias("nan"),
        (F.col("id") % 2 == 0).alias("flag"), F.timestamp_seconds(F.col("id") % 17).alias("time"), F.lit(None).cast("string").alias("none"))
    assert distinct_counts(df) == {"id": 500, "d": 7, "long": 11, "list": 4, "map": 5, "dec": 13, "nan": 1, "flag": 2, "time": 17, "none": 0}


def test_keys_that_share_a_digest_are_counted_by_value(spark, monkeypatch):
    monkeypatch.setattr(ranks, "_cell", lambda i, s, kind: F.when(s.value.isNotNull(), F.struct(
        F.lit(i).alias("i"), F.length(s.value).cast("long").alias("whole"), F.lit(None).cast("double").alias("real"), F.xxhash64(s.value).alias("second"))))
    df = spark.createDataFrame([("a",), ("b",), ("cc",), ("cc",), (None,)], "s string")
    assert distinct_counts(df) == {"s": 3}


def test_row_numbers_where_tasks_write_several_files(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "30")
    try:
        df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.lit("x").alias("t"))
        assert with_row_id(df, "row").select("row").distinct().count() == 1000
        assert global_row_number(df, F.col("k"), "p").where("p <> k").count() == 0
        assert with_previous(df, F.col("k"), F.col("k")).where("value - previous = 1").count() == 999
        assert split_random(df.drop("k"), [], 0.2).where("split = 'test'").count() == 200
        assert fe.label_encode(df, ["k"]).select("k").distinct().count() == 1000
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_many_wide_columns_are_encoded_by_the_same_jobs(spark):
    df = spark.range(400).select(*[F.concat(F.lit("v"), (F.col("id") * k) % 311).alias(f"c{k}") for k in range(1, 7)],
                                 F.repeat(F.concat(F.lit("l"), F.col("id") % 150), 400).alias("long"))
    pdf = df.toPandas()
    want = pdf.apply(lambda x: x.map({v: i for i, v in enumerate(sorted(x.unique(), key=str.encode))}))
    got = fe.label_encode(df, df.columns).toPandas()
    assert got.sort_values(list(got)).values.tolist() == want.sort_values(list(want)).values.tolist()
    codes = fe.fit_codes(df, df.columns, {})
    for c, (mean, scale) in fe.code_scaler(codes, "standard").items():
        assert (mean, scale) == pytest.approx((want[c].mean(), want[c].std(ddof=0)))

    def jobs(columns):
        tracker, group = spark.sparkContext.statusTracker(), f"wide-{len(columns)}"
        spark.sparkContext.setJobGroup(group, group)
        fe.fit_codes(df, columns, {})
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(df.columns) == jobs(df.columns[:2])


def test_broadcast_lookups_share_one_budget():
    sizes = {"a": (10, 100, 10), "b": (20, 200, 20), "c": (10, 10**6, 10)}
    assert broadcast_share(sizes, 100, 10**4) == {"a", "b"} and broadcast_share(sizes, 25, 10**9) == {"a"}


def test_files_written_in_time_order(spark, tmp_path):
    df = spark.range(1000).select("id", F.timestamp_seconds((F.col("id") * 7919) % 1000 * 3600).alias("t"))
    back = fe.write_in_time_order(df, "t", str(tmp_path / "out"), "id", files=4)
    spans = back.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min("t_order"), F.max("t_order")).orderBy("f").collect()
    assert len(spans) == 4 and all(a[2] <= b[1] for a, b in zip(spans, spans[1:])) and back.count() == 1000
    assert "Sort" not in fe.time_features(df, "t")._jdf.queryExecution().toString()


def test_chronological_build_orders_equal_times_by_the_key(spark):
    df = spark.range(100).select(
        F.col("id").alias("row"), F.timestamp_seconds((F.col("id") % 2) * 86400).alias("date"),
        (F.col("id") * 31 % 97).alias("amount"), (F.col("id") % 3).alias("label"))
    b = fe.build_features(df, ["row"], {"target_column": "row", "task_type": "regression"})
    test = sorted(r["row"] for r in b.frame.where("split = 'test'").collect())
    assert b.time_column == "date" and test == list(range(61, 100, 2))


def test_text_dates_and_boolean_gaps(spark):
    from tablesmith.operators.features import impute
    from tablesmith.operators.infer import parse_time

    texts = ["5/3/2024", "13/05/2024", "05/13/2024 10:11", "5 January 2024", "2024-02-01", "no date"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [str(r[0]) for r in df.select(parse_time(F.col("t"), df.schema["t"].dataType)).collect()]
    assert got == ["2024-05-03 00:00:00", "2024-05-13 00:00:00", "2024-05-13 10:11:00", "2024-01-05 00:00:00", "2024-02-01 00:00:00", "None"]
    flags = impute(spark.createDataFrame([(True,), (None,), (False,)], "b boolean")).collect()
    assert [r[0] for r in flags] == ["True", "unknown", "False"]


def test_splits_of_any_rows_and_names(spark):
    names = {n: F.lit(1) for n in ("n", "q", "last", "times", "_h", "_k", "_lk", "at", "mine", "row_id")}
    df = spark.range(400).select("id", (F.col("id") % 4).alias("y")).withColumns(names)
    done = split_stratified(df, "y", ["id"])
    assert done.columns == [*df.columns, "split"]
    assert {r[0]: r[1] for r in done.where("split = 'test'").groupBy("y").count().collect()} == {i: 20 for i in range(4)}
    alike = df.withColumn("id", F.lit(1))
    assert split_random(alike, ["id"]).where("split = 'test'").count() == 80
    assert split_stratified(alike, "y", ["id"]).where("split = 'test'").count() == 80
    gaps = df.withColumn("y", F.when(F.col("id") < 200, F.col("y")))
    assert split_stratified(gaps, "y").where("split = 'test'").groupBy(F.col("y").isNull()).count().select("count").distinct().collect() == [(40,)]


def test_both_quantile_paths_agree(spark):
    """The narrowing search gives what one sorted task gives, on the values that doubles hold badly."""
    df = spark.range(500).select(
        (F.lit(2**53) + F.col("id") * 3).alias("big"), (F.col("id") / 7).cast("decimal(20,6)").alias("dec"),
        F.when(F.col("id") < 20, float("-inf")).when(F.col("id") > 480, float("inf")).otherwise(F.col("id") * 1.5).alias("inf"),
        F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0).alias("zero"))
    columns = {c: F.col(c).cast("double") for c in df.columns}
    sizes = {c: 500 for c in columns}
    one = exact_quantiles(df, columns, [0.1, 0.25, 0.5, 0.9], sizes, 500)
    many = exact_quantiles(df, columns, [0.1, 0.25, 0.5, 0.9], sizes, 500, single_task_rows=10)
    assert one == many
