"""Train/test splits as a ``split`` column, computed from cut points.

Rows are never ranked as a whole: the cut is a literal (or a small per-class
table), so the split is a filter expression on the row itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.functions.numeric import quoted, value_text
from tablesmith.operators.lookup import attach, lookup_size
from tablesmith.operators.ranks import global_row_number, rank_cut
from tablesmith.session import SINGLE_TASK_ROWS, cut_lineage, free_names, with_row_id

TEST_SIZE = 0.2
SEED = 42
HASH_BITS = 60


def hash_order(keys: list[str], seed: int = SEED) -> Column:
    """Reproducible pseudo-random 60-bit order of rows by their key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[quoted(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def tie_order(keys: list[str]) -> Column:
    return F.xxhash64(*[quoted(k) for k in keys])


def label_split(is_test: Column) -> Column:
    return F.when(is_test, "test").otherwise("train").alias("split")


def split_time(df: DataFrame, time: Column, tie: Column, test_size: float = TEST_SIZE,
               n_rows: int | None = None, finish_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """Chronological split: the first floor((1-test)*n) rows by (time, tie) are train.

    Rows without a time sort last.
    """
    n = df.count() if n_rows is None else n_rows
    n_train = int(n * (1 - test_size))
    late = F.lit((1 << 63) - 1)
    key = F.coalesce(time, late)
    before = rank_cut(df, key, tie, n_train - 1, n, finish_rows)
    return df.withColumn("split", label_split(~before))


def split_random(df: DataFrame, keys: list[str] | None = None, test_size: float = TEST_SIZE, seed: int = SEED,
                 n_rows: int | None = None, finish_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """ceil(test*n) rows, lowest in hash order, are test.

    Without keys, or where several rows share the key at the cut, rows get numbers of their own.
    """
    n = df.count() if n_rows is None else n_rows
    want = math.ceil(n * test_size)
    if keys:
        cut = rank_cut(df, hash_order(keys, seed), tie_order(keys), want - 1, n, finish_rows)
        if df.agg(F.count_if(cut)).first()[0] == want:
            return df.withColumn("split", label_split(cut))
    row, = free_names(df, "row_id")
    rows, order = with_row_id(df, row), [*(keys or []), row]
    cut = rank_cut(rows, hash_order(order, seed), tie_order(order), want - 1, n, finish_rows)
    return rows.withColumn("split", label_split(cut)).drop(row)


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(value, text, n) per non-null class, stored so that later steps do not count again."""
    c = quoted(target)
    return cut_lineage(
        df.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count("*").alias("n"))
        .select("value", value_text(F.col("value"), df.schema[target].dataType).alias("text"), "n")
    )


def class_quotas(df: DataFrame, target: str, test_size: float = TEST_SIZE) -> tuple[DataFrame, dict]:
    """(value, n, n_test) per class with train sizes by largest remainder, plus totals."""
    counts = class_counts(df, target)
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.min("n").alias("least")).first()
    n, k = total["n"] or 0, total["k"]
    n_test = math.ceil(n * test_size)
    n_train = n - n_test
    facts = {"n": n, "classes": k, "least": total["least"] or 0, "n_test": n_test, "n_train": n_train}
    wide = "decimal(19,0)"
    product = F.col("n").cast(wide) * F.lit(n_train).cast(wide)
    rest = F.pmod(product, F.lit(n).cast(wide))
    parts = counts.withColumn("base", ((product - rest) / F.lit(n).cast(wide)).cast("long")).withColumn(
        "order_key", F.concat(F.lpad((F.lit(n).cast(wide) - rest).cast("string"), 20, "0"), F.col("text")))
    spare = n_train - (parts.agg(F.sum("base")).first()[0] or 0)
    ranked = global_row_number(parts, F.col("order_key"), "at")
    train = F.col("base") + F.when(F.col("at") < spare, 1).otherwise(0)
    return ranked.select("value", "n", (F.col("n") - train).alias("n_test")), facts


def split_stratified(df: DataFrame, target: str, keys: list[str] | None = None, test_size: float = TEST_SIZE,
                     seed: int = SEED, bucket_rows: int = 200_000) -> DataFrame:
    """Per-class split in hash order; falls back to a random split.

    The fall-back applies when a class has one row or either side is smaller than
    the number of classes. Rows without a target are split among themselves, so that ceil(test*n) of all rows are test.
    Classes larger than ``bucket_rows`` are counted per hash range first, so only the one range that
    holds the cut is ever sorted. Rows get numbers of their own where keys are missing or shared.
    """
    n = df.count()
    quotas, facts = class_quotas(df, target, test_size)
    want = math.ceil(n * test_size)
    if facts["least"] < 2 or min(facts["n_test"], facts["n_train"]) < facts["classes"]:
        return split_random(df, keys, test_size, seed, n)
    if keys:
        done = _split_classes(df, target, keys, quotas, facts, n, want, seed, bucket_rows)
        if done.where("split = 'test'").count() == want:
            return done
    row, = free_names(df, "row_id")
    return _split_classes(with_row_id(df, row), target, [*(keys or []), row], quotas, facts, n, want, seed, bucket_rows).drop(row)


def _split_classes(df: DataFrame, target: str, keys: list[str], quotas: DataFrame, facts: dict, n: int, want: int,
                   seed: int, bucket_rows: int) -> DataFrame:
    size = lookup_size(quotas, "value")
    at, mine, last = free_names(df, "at", "mine", "last")
    place = F.struct(hash_order(keys, seed).alias("h"), tie_order(keys).alias("t"))
    tagged = attach(df.withColumn(at, place), quoted(target), quotas.withColumn(mine, F.struct("n", "n_test")),
                    "value", [mine], size)
    buckets = F.ceil(F.col("share.n") / bucket_rows).cast("double")
    bucket = F.floor(F.col("at.h").cast("double") / float(1 << HASH_BITS) * buckets).cast("int")
    narrow = tagged.select(quoted(target).alias("value"), F.col(at).alias("at"), F.col(mine).alias("share")).where(
        "value IS NOT NULL").withColumn("b", bucket)
    per_bucket = narrow.groupBy("value", "b").agg(F.count("*").alias("rows"), F.first("share.n_test").alias("n_test"))
    upto = F.sum("rows").over(Window.partitionBy("value").orderBy("b"))
    cut_bucket = (
        per_bucket.withColumn("upto", upto)
        .where((F.col("upto") >= F.col("n_test")) & (F.col("upto") - F.col("rows") < F.col("n_test")))
        .select("value", F.struct(F.col("b"), (F.col("n_test") - F.col("upto") + F.col("rows")).alias("need")).alias("cut"),
                F.lit(1).alias("n"))
    )
    in_cut = attach(narrow.select("value", "at", "b"), F.col("value"), cut_bucket, "value", ["cut"], size).where(
        F.col("b") == F.col("cut.b"))
    order = Window.partitionBy("value").orderBy("at")
    cuts = (
        in_cut.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == F.col("cut.need"))
        .select("value", F.col("at").alias(last), F.lit(1).alias("n"))
    )
    out = attach(tagged.drop(mine), quoted(target), cuts, "value", [last], size)
    is_test = F.coalesce(F.col(at) <= F.col(last), F.lit(False))
    if n > facts["n"]:
        gaps = df.where(quoted(target).isNull())
        cut = rank_cut(gaps, hash_order(keys, seed), tie_order(keys), want - facts["n_test"] - 1, n - facts["n"])
        is_test = F.when(quoted(target).isNull(), cut).otherwise(is_test)
    return out.select(*[quoted(c) for c in df.columns if c != "split"], label_split(is_test))


def rebalance(df: DataFrame, target: str, only_split: str | None = "train", copy: str = "copy") -> DataFrame:
    """Repeat rows of the smaller classes floor(majority / class size) times and number the repeats in ``copy``.

    Works on the train part only when the frame carries a ``split`` column. A column that the frame has
    under the name of ``copy`` stays; the number then gets an underscore.
    """
    train = df if only_split is None or "split" not in df.columns else df.where(F.col("split") == only_split)
    counts = class_counts(train, target)
    most = counts.agg(F.max("n").alias("m")).first()["m"] or 0
    copy, times_name = free_names(df, copy, "times")
    factors = counts.withColumn(times_name, F.floor(F.lit(most) / F.col("n")).cast("int"))
    joined = attach(df, quoted(target), factors, "value", [times_name])
    times = F.coalesce(times_name, F.lit(1))
    if train is not df:
        times = F.when(F.col("split") == only_split, times).otherwise(1)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), times))).drop(times_name)
