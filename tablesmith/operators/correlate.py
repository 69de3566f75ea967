"""Correlation and class-balance checks that feed the plan."""

from __future__ import annotations

import functools
import io

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.numeric import as_double, numeric_columns, quoted
from tablesmith.operators.ranks import AGG_CHUNK, agg_row

LOW_CORRELATION = 0.05
HIGH_CORRELATION = 0.9
IMBALANCE_RATIO = 3
MOMENTS = ["n", "mx", "my", "sxx", "syy", "sxy"]
BLOCK_COLUMNS = 128  # columns of a block: a matrix of 128 KB
FAN = 16
LOST_DIGITS = 100  # squares about a column's mean to those about the pair's: with more, two digits are lost
FEW_PAIRS = AGG_CHUNK


def _xs(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    return {c: as_double(c, df.schema[c].dataType) for c in columns}


def pair_correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(ordinal, col1, col2, correlation) of chosen pairs by plain sums: means first, then sums centred on them.

    A pair without gaps takes the means and spreads of its columns. A pair with gaps has its own, over the rows that
    have both values. A few numbers for each pair reach the driver.
    """
    xs = _xs(df, sorted({c for p in pairs for c in p}))
    first = agg_row(df, {"rows": F.count(F.lit(1))} | {f"n.{c}": F.count(x) for c, x in xs.items()}
                    | {f"m.{c}": F.avg(x) for c, x in xs.items()})
    dense = {c for c in xs if first[f"n.{c}"] == first["rows"]}
    gapped = {p: (F.when(xs[p[1]].isNotNull(), xs[p[0]]), F.when(xs[p[0]].isNotNull(), xs[p[1]]))
              for p in pairs if not dense.issuperset(p)}
    own = agg_row(df, {(k, p): e for p, (x, y) in gapped.items()
                       for k, e in (("n", F.count(x + y)), ("x", F.avg(x)), ("y", F.avg(y)))}) if gapped else {}
    centred = {c: x - F.lit(first[f"m.{c}"]) for c, x in xs.items()}
    sums = {("xx", c): F.sum(d * d) for c, d in centred.items() if c in dense}
    for p in dict.fromkeys(pairs):
        dx, dy = centred[p[0]], centred[p[1]]
        if p in gapped:
            dx, dy = (v - F.lit(own[k, p]) for k, v in zip("xy", gapped[p]))
            sums |= {("xx", p): F.sum(dx * dx), ("yy", p): F.sum(dy * dy)}
        sums["xy", p] = F.sum(dx * dy)
    got = agg_row(df, sums)

    def coefficient(p: tuple[str, str]) -> float | None:
        n = own["n", p] if p in gapped else first["rows"]
        mx, my = (own["x", p], own["y", p]) if p in gapped else (first[f"m.{c}"] for c in p)
        sxx, syy = (got["xx", p], got["yy", p]) if p in gapped else (got["xx", c] for c in p)
        if not n:
            return None
        r = float(_coefficients(tuple(np.full((1, 1), v) for v in (n, mx, my, sxx, syy, got["xy", p])))[0, 0])
        return None if np.isnan(r) else r

    return df.sparkSession.createDataFrame(
        [(i, a, b, coefficient((a, b))) for i, (a, b) in enumerate(pairs)], "ordinal long, col1 string, col2 string, correlation double")


# Wide tables: co-moments of blocks of columns

def block_moments(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Moments of every column of ``x`` with every column of ``y`` over the rows that have both.

    Without gaps the counts, means and spreads are those of the columns and stay vectors; with gaps they
    are matrices, products of the values and of the marks of presence. A pair whose common rows lie far from the means of its
    columns would lose digits in them: it is summed by itself, centred on these rows.
    """
    have_x, have_y = ~np.isnan(x), ~np.isnan(y)
    if have_x.all() and have_y.all():
        mx, my = x.mean(axis=0), y.mean(axis=0)
        dx, dy = x - mx, y - my
        return (np.full((1, 1), float(len(x))), mx[:, None], my[None, :], (dx * dx).sum(axis=0)[:, None],
                (dy * dy).sum(axis=0)[None, :], dx.T @ dy)
    (cx, dx), (cy, dy) = centred(x, have_x), centred(y, have_y)
    hx, hy = have_x.astype(float), have_y.astype(float)
    n, sx, sy = hx.T @ hy, dx.T @ hy, hx.T @ dy
    sxx, syy, sxy = (dx * dx).T @ hy, hx.T @ (dy * dy), dx.T @ dy
    mx, my = sx / np.maximum(n, 1), sy / np.maximum(n, 1)
    vxx, vyy, vxy = sxx - sx * mx, syy - sy * my, sxy - sx * my
    far = (n > 0) & ((sxx > LOST_DIGITS * vxx) | (syy > LOST_DIGITS * vyy))
    out = (n, np.where(n > 0, cx[:, None] + mx, 0.0), np.where(n > 0, cy[None, :] + my, 0.0), vxx, vyy, vxy)
    for i in np.flatnonzero(far.any(axis=1)):
        for m, value in zip(out, _pair_by_pair(x[:, i], y[:, far[i]], have_x[:, i], have_y[:, far[i]])):
            m[i, far[i]] = value
    return out


def centred(x: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of the columns over the values they have, and the distances from them, 0 for gaps."""
    mean = np.where(have, x, 0.0).sum(axis=0) / np.maximum(have.sum(axis=0), 1)
    return mean, np.where(have, x - mean, 0.0)


def _pair_by_pair(x: np.ndarray, y: np.ndarray, have_x: np.ndarray, have_y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Moments of one column with some others, each over the rows that both have."""
    both, a = have_y[have_x], x[have_x][:, None]
    b = np.where(both, y[have_x], 0.0)
    n = both.sum(axis=0)
    mx, my = (a * both).sum(axis=0) / np.maximum(n, 1), b.sum(axis=0) / np.maximum(n, 1)
    da, db = (a - mx) * both, (b - my) * both
    return n, mx, my, (da * da).sum(axis=0), (db * db).sum(axis=0), (da * db).sum(axis=0)


def merge_moments(a: tuple, b: tuple) -> tuple[np.ndarray, ...]:
    """Moments of two groups of rows together."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    weight = a[0] * share
    return (n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight,
            a[5] + b[5] + dx * dy * weight)


def pack_moments(m: tuple) -> bytes:
    out = io.BytesIO()
    np.savez(out, **dict(zip(MOMENTS, m)))
    return out.getvalue()


def unpack_moments(data: bytes) -> tuple[np.ndarray, ...]:
    with np.load(io.BytesIO(data)) as m:
        return tuple(m[name] for name in MOMENTS)


def _coefficients(m: tuple) -> np.ndarray:
    n, mx, my, sxx, syy, sxy = m
    # What rounding alone leaves of a constant column is no spread.
    flat = (sxx <= 1e-28 * n * mx * mx) | (syy <= 1e-28 * n * my * my) | (n < 1)
    spread = np.sqrt(sxx) * np.sqrt(syy)
    return np.divide(sxy, spread, out=np.full(sxy.shape, np.nan), where=~np.broadcast_to(flat, sxy.shape) & (spread > 0))


def block_correlations(df: DataFrame, columns: list[str], width: int = BLOCK_COLUMNS, fan: int = FAN) -> DataFrame:
    """(ordinal, col1, col2, correlation) of all pairs of a table of any width, in one scan.

    Accumulating tasks, no more than the cluster has cores twice over however many parts the input has, reduce their rows to one
    matrix for each pair of column blocks; matrices are added up along a tree of ``fan`` children a node, a block pair a task.
    """
    xs = _xs(df, columns)
    k = len(columns)
    starts = list(range(0, k, width))

    def accumulate(batches):
        task, total = TaskContext.get().partitionId(), {}
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan)
            for a in starts:
                for b in starts:
                    if a <= b and len(x):
                        part = block_moments(x[:, a: a + width], x[:, b: b + width])
                        total[a, b] = merge_moments(total[a, b], part) if (a, b) in total else part
        yield pd.DataFrame([(a, b, task, pack_moments(m)) for (a, b), m in total.items()], columns=["i", "j", "node", "m"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = functools.reduce(merge_moments, map(unpack_moments, group.sort_values("node")["m"]))
        return pd.DataFrame([[*group[["i", "j"]].iloc[0], group["node"].iloc[0] // fan, pack_moments(total)]], columns=["i", "j", "node", "m"])

    def finish(batches):
        for batch in batches:
            for i, j, m in zip(batch["i"], batch["j"], batch["m"]):
                r = _coefficients(unpack_moments(m))
                at = np.argwhere((np.arange(r.shape[0]) + i)[:, None] < (np.arange(r.shape[1]) + j)[None, :])
                r = r[at[:, 0], at[:, 1]]
                yield pd.DataFrame({"i": at[:, 0] + i, "j": at[:, 1] + j, "r": pd.Series(r, dtype=object).where(~np.isnan(r), None)})

    schema = "i long, j long, node long, m binary"
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    rows = df.select(*[xs[c].alias(f"x{i}") for i, c in enumerate(columns)]).coalesce(tasks)
    parts = rows.mapInPandas(accumulate, schema)
    while tasks > 1:
        parts = parts.groupBy("i", "j", F.expr(f"node div {fan}").alias("above")).applyInPandas(merge, schema)
        tasks = -(-tasks // fan)
    names = F.array(*[F.lit(c) for c in columns])
    return parts.select("i", "j", "m").mapInPandas(finish, "i long, j long, r double").select(
        (F.col("i") * k + F.col("j")).alias("ordinal"), F.get(names, F.col("i").cast("int")).alias("col1"),
        F.get(names, F.col("j").cast("int")).alias("col2"), F.col("r").alias("correlation"))


def all_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs in column order. Both ways centre each pair on the rows that have both values.

    The schema alone decides: up to ``FEW_PAIRS`` pairs are plain aggregates, more columns go through blocks.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    return pair_correlations(df, pairs) if len(pairs) <= FEW_PAIRS else block_correlations(df, columns)


def low_correlation(df: DataFrame, target: str, threshold: float = LOW_CORRELATION) -> DataFrame:
    """Numeric columns whose |r| with a numeric target is below the threshold."""
    others = [c for c in numeric_columns(df) if c != target]
    numeric_target = isinstance(df.schema[target].dataType, T.NumericType)
    if not others or not numeric_target:
        return df.sparkSession.createDataFrame([], "ordinal int, name string, correlation double")
    r = pair_correlations(df, [(c, target) for c in others])
    return r.where(F.abs("correlation") < threshold).select(
        "ordinal", F.col("col1").alias("name"), "correlation")


def high_correlation(df: DataFrame, threshold: float = HIGH_CORRELATION,
                     columns: list[str] | None = None) -> DataFrame:
    """Pairs with |r| above the threshold in column order; the second is the one to drop."""
    names = columns or numeric_columns(df)
    if len(names) < 2:
        return df.sparkSession.createDataFrame(
            [], "ordinal int, col1 string, col2 string, correlation double")
    r = all_correlations(df, names)
    return r.where(F.abs("correlation") > threshold).withColumn(
        "correlation", F.round("correlation", 3))


def correlated_drops(pairs: DataFrame, target: str | None = None) -> DataFrame:
    """Second columns of the found pairs, first appearance first, never the target."""
    keep = pairs if target is None else pairs.where(F.col("col2") != target)
    return keep.groupBy(F.col("col2").alias("name")).agg(F.min("ordinal").alias("ordinal"))


def class_imbalance(df: DataFrame, target: str, ratio: float = IMBALANCE_RATIO) -> DataFrame:
    """One row: enabled flag, class count, ratio and the reason text."""
    counts = df.where(quoted(target).isNotNull()).groupBy(quoted(target).alias("v")).agg(
        F.count("*").alias("n"))
    got = counts.agg(F.count("*").alias("classes"), F.max("n").alias("most"), F.min("n").alias("least"))
    r = F.try_divide(F.col("most").cast("double"), F.col("least"))
    text = F.format_string("%.2f", r)
    few = F.col("classes") < 2
    return got.select(
        F.lit(target).alias("target_column"), "classes", F.round(r, 4).alias("ratio"),
        (~few & (r > ratio)).alias("enabled"),
        F.when(few, F.concat(F.lit("Only "), F.col("classes"), F.lit(" class(es) found (need at least 2)")))
        .when(r > ratio, F.concat(F.lit("Class imbalance detected: majority/minority ratio = "), text))
        .otherwise(F.concat(F.lit("Class ratio = "), text, F.lit(" (below 3:1 threshold)")))
        .alias("reason"),
    )
