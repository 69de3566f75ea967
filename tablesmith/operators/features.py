"""Feature operators: drop, impute, encode, scale, calendar parts, and the fixed build.

Statistics are fitted in narrow passes and then written into the projection as
literals, so applying them is one scan without joins. Only dictionaries of
columns with many text levels stay distributed tables and are joined.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.names import is_drop_id
from tablesmith.functions.numeric import (
    as_double, is_nested_type, is_numeric_type, is_time_type, observed, quoted, value_text, zero_if_infinite,
)
from tablesmith.operators.infer import (
    FEATURE_BAD, FEATURE_TARGETS, detect_time_column, parse_time,
)
from tablesmith.operators.lookup import KEY_BYTES, attach, broadcast_share
from tablesmith.operators.profile import value_counts
from tablesmith.operators.ranks import agg_row, exact_quantiles, literal_lookup
from tablesmith.operators.split import split_random, split_stratified, split_time, tie_order
from tablesmith.session import BROADCAST_ROWS, free_names, stored_rows, with_row_id

ENCODE_LEVELS = 10     # numeric columns with at most this many levels are encoded
TRACKED_LEVELS = 100   # largest level count any rule asks about
HLL_RSD = 0.05        # 512 registers: a finer sketch would add thousands of buffer columns


# --- level counting -----------------------------------------------------------------

def level_sketches(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Sketch of the distinct count of each column, to be evaluated with other aggregates."""
    return {
        f.name: F.approx_count_distinct(
            value_text(quoted(f.name), f.dataType) if is_nested_type(f.dataType)
            else observed(f.name, f.dataType), HLL_RSD)
        for f in df.schema.fields if f.name in columns
    }


def few_levels(df: DataFrame, columns: list[str], limit: int = TRACKED_LEVELS,
               sketch: dict[str, int] | None = None) -> dict[str, list]:
    """Exact (value, n) lists of the columns with at most ``limit`` distinct values.

    A sketch screens out the wide columns first. With d distinct values at most d
    registers are set, so the sketch cannot exceed ``2 * limit`` while d <= limit;
    every screened-out column truly has more levels. The rest is counted exactly.
    """
    if not columns:
        return {}
    sketch = sketch or agg_row(df, level_sketches(df, columns))
    narrow = [f.name for f in df.schema.fields if f.name in columns and sketch[f.name] <= 2 * limit]
    out: dict[str, list] = {c: [] for c in narrow}
    if not narrow:
        return out
    for r in value_counts(df, narrow).collect():  # at most 2 * limit rows per column, by the sketch
        v = next((r[k] for k in ("whole", "real", "text") if r[k] is not None), None)
        out[narrow[r["ordinal"]]].append((v, r["n"]))
    return {c: v for c, v in out.items() if len(v) <= limit}


# --- drops -----------------------------------------------------------------------------

def drop_id_columns(df: DataFrame, protect: str | None = None) -> tuple[DataFrame, list[str]]:
    """Drop columns by the substring ID rule; never the target, never every column."""
    ids = [c for c in df.columns if c != protect and is_drop_id(c)]
    return (df, []) if len(ids) == len(df.columns) else (df.drop(*map(quoted, ids)), ids)


def drop_constant_columns(df: DataFrame, protect: str | None = None,
                          levels: dict[str, list] | None = None) -> tuple[DataFrame, list[str]]:
    """Drop columns with at most one distinct value; never the target, never every column."""
    if levels is None:
        row = agg_row(df, {c: e for f in df.schema.fields for c, e in _same_value(f).items()})
        flat = [c for c in df.columns if c != protect and row[c]]
    else:
        flat = [c for c in df.columns if c != protect and len(levels.get(c, [0, 0])) <= 1]
    return (df, []) if len(flat) == len(df.columns) else (df.drop(*map(quoted, flat)), flat)


def _same_value(f: T.StructField) -> dict[str, Column]:
    c = observed(f.name, f.dataType)
    c = F.to_json(c) if isinstance(f.dataType, (T.MapType, T.StructType)) else c
    return {f.name: F.coalesce(F.min(c) == F.max(c), F.lit(True))}


# --- impute / infinities ----------------------------------------------------------------

def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Same columns in the same order, some of them recomputed."""
    return df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


def column_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians; 0 for a column without any value."""
    xs = {c: as_double(c, df.schema[c].dataType) for c in columns}
    counts = agg_row(df, {"rows": F.count(F.lit(1))} | {f"c.{c}": F.count(x) for c, x in xs.items()})
    sizes = {c: counts[f"c.{c}"] for c in columns}
    got = exact_quantiles(df, xs, [0.5], sizes, counts["rows"])
    return {c: 0.0 if got[c][0] is None else got[c][0] for c in columns}


def fill_numeric(df: DataFrame, c: str, value: float) -> Column:
    """Fill gaps; integers stay integers when the fill value is whole."""
    t = df.schema[c].dataType
    if isinstance(t, T.IntegralType) and float(value).is_integer():
        return F.coalesce(quoted(c), F.lit(int(value)).cast(t))
    return F.coalesce(as_double(c, t), F.lit(float(value)))


def missing_counts(df: DataFrame) -> dict[str, int]:
    return agg_row(df, {f.name: F.count_if(observed(f.name, f.dataType).isNull())
                        for f in df.schema.fields})


def impute(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Median for numbers, ``'unknown'`` for text, only where something is missing."""
    gaps = {c for c, n in missing_counts(df).items() if n and (columns is None or c in columns)}
    numeric = [f.name for f in df.schema.fields if f.name in gaps and is_numeric_type(f.dataType)]
    medians = column_medians(df, numeric) if numeric else {}
    new = {c: fill_numeric(df, c, m) for c, m in medians.items()}
    for f in df.schema.fields:
        # with gaps, a column that is no number holds objects: its values become text beside the filler
        if f.name in gaps and (isinstance(f.dataType, (T.StringType, T.BooleanType))):
            new[f.name] = F.coalesce(value_text(quoted(f.name), f.dataType), F.lit("unknown"))
    return replace_columns(df, new)


def replace_infinite(df: DataFrame) -> DataFrame:
    """Infinite and missing numbers become 0; whole-number columns only have gaps to fill."""
    new = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.IntegralType):
            new[f.name] = F.coalesce(quoted(f.name), F.lit(0).cast(f.dataType))
        elif is_numeric_type(f.dataType):
            new[f.name] = zero_if_infinite(quoted(f.name).cast("double"))
    return replace_columns(df, new)


# --- calendar parts -----------------------------------------------------------------------

def has_clock(df: DataFrame, column: str) -> bool:
    """Whether the hours of a time column differ."""
    t = parse_time(quoted(column), df.schema[column].dataType)
    low, high = df.agg(F.min(F.hour(t)), F.max(F.hour(t))).first()
    return low != high


def time_parts(df: DataFrame, column: str, with_clock: bool | None = None) -> DataFrame:
    """Replace a time column by its calendar parts (hour/minute only if hours differ)."""
    t = parse_time(quoted(column), df.schema[column].dataType)
    if with_clock is None:
        with_clock = has_clock(df, column)
    parts = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t),
             "weekday": F.weekday(t), "quarter": F.quarter(t),
             "is_weekend": F.coalesce((F.weekday(t) >= 5).cast("int"), F.lit(0))}
    if with_clock:
        parts |= {"hour": F.hour(t), "minute": F.minute(t)}
    kept = [quoted(c) for c in df.columns if c != column]
    return df.select(*kept, *[e.alias(f"{column}_{p}") for p, e in parts.items()])


def time_features(df: DataFrame, column: str, tie: str | None = None, ordered: bool = False) -> DataFrame:
    """Calendar parts of a time column. Order in time is a property of the written table (:func:`write_in_time_order`).

    ``ordered`` sorts the frame itself (unknown times last) for a consumer that reads it directly.
    """
    rows = df.orderBy(*_in_time(column, tie)) if ordered else df
    return time_parts(rows, column)


def _in_time(column: str, tie: str | None) -> list[Column]:
    return [quoted(column).asc_nulls_last()] + ([quoted(tie)] if tie else [])


def write_in_time_order(df: DataFrame, column: str, path: str, tie: str | None = None, files: int | None = None) -> DataFrame:
    """Write calendar parts so that files hold ascending ranges of time, sorted inside, and read them back.

    Rows are dealt out by ranges once, at the write; the footers' bounds of each file then let readers of a time span skip the others.
    """
    dealt = df.repartitionByRange(files, *_in_time(column, tie)) if files else df.repartitionByRange(*_in_time(column, tie))
    with_clock = has_clock(df, column)
    stamp, = free_names(df, f"{column}_order")
    rows = dealt.withColumn(stamp, F.unix_micros(parse_time(quoted(column), df.schema[column].dataType)))
    time_parts(rows.sortWithinPartitions(*_in_time(column, tie)), column, with_clock).write.parquet(path)
    return df.sparkSession.read.parquet(path)


# --- label encoding --------------------------------------------------------------------------

@dataclass
class Codes:
    """Codes of one column: a literal map for few levels, a table for many."""
    levels: dict | None = None                    # value -> code
    counts: dict | None = None                    # value -> rows
    table: DataFrame | None = None                # (text, n, code)
    size: tuple[int, int, int] | None = None
    moments: tuple[float, float, float] | None = None  # mean and deviation of the codes over the rows, highest code


def dictionaries(df: DataFrame, columns: list[str]) -> dict[str, Codes]:
    """Codes of many columns together: their sorted distinct texts numbered from 0, each column apart.

    One aggregate counts (column, text), one sort by both deals ranges to tasks, whatever the number of columns, and the numbered table is
    stored once. Sizes and the moments of the codes of all columns come from that table in two small aggregates.
    """
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), value_text(quoted(c), df.schema[c].dataType).alias("text"))
                      for i, c in enumerate(columns)])
    counts = df.select(F.inline(cells)).where("text IS NOT NULL").groupBy("ordinal", "text").agg(F.count("*").alias("n"))
    rows = stored_rows(counts.orderBy("ordinal", "text"), "part", "place", "before").withColumn("at", F.col("before") + F.col("place"))
    key = F.least(F.octet_length("text") + 1, F.lit(KEY_BYTES))
    weight = F.col("n").cast("double")
    first = {r["ordinal"]: r for r in rows.groupBy("ordinal").agg(
        F.min("at").alias("low"), F.count("*").alias("keys"), F.sum(key).alias("bytes"), F.sum("n").alias("rows"),
        (F.sum(F.col("at") * weight) / F.sum(weight)).alias("mean")).collect()}  # one row a column
    low = {i: F.lit(r["low"]).cast("long") for i, r in first.items()}
    mean = {i: F.lit(r["mean"] - r["low"]) for i, r in first.items()}
    coded = rows.drop("part", "place", "before")
    if first:
        coded = coded.withColumn("code", F.col("at") - literal_lookup(F.col("ordinal"), low))
        away = F.col("code") - literal_lookup(F.col("ordinal"), mean)
        spread = dict(coded.groupBy("ordinal").agg(F.sum(away * away * weight)).collect())
    out = {}
    for i, c in enumerate(columns):
        r = first.get(i)
        table = coded.where(F.col("ordinal") == i).select("text", "n", F.col("code") if first else F.col("n").alias("code"))
        out[c] = Codes(table=table, size=(r["keys"], r["bytes"], r["rows"]) if r else (0, 0, 0),
                       moments=(r["mean"] - r["low"], (spread[i] / r["rows"]) ** 0.5, r["keys"] - 1) if r else (0.0, 0.0, 0))
    return out


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each column by the rank of its text form among the sorted distinct texts."""
    codes = fit_codes(df, columns, few_levels(df, columns))
    return apply_codes(df, codes, {})


def fit_codes(df: DataFrame, columns: list[str], levels: dict[str, list]) -> dict[str, Codes]:
    wide = dictionaries(df, [c for c in columns if c not in levels])
    out = {}
    for c in columns:
        if c in wide:
            out[c] = wide[c]
            continue
        order = sorted((v for v, _ in levels[c]), key=lambda v: level_text(v).encode("utf-8"))
        out[c] = Codes(levels={v: i for i, v in enumerate(order)}, counts=dict(levels[c]))
    return out


def level_text(v) -> str:
    """Text a level is sorted by; numbers sort as text on purpose ("10" before "9")."""
    return v if isinstance(v, str) else repr(v)


def literal_map(key: Column, mapping: dict, kind: str) -> Column:
    keys = list(mapping)
    found = F.map_from_arrays(F.array(*map(F.lit, keys)),
                              F.array(*[F.lit(mapping[k]).cast(kind) for k in keys]))
    return F.try_element_at(found, key)


def level_key(c: str, t: T.DataType) -> Column:
    """The cell in the form its level list is keyed by (whole, real or text)."""
    if isinstance(t, T.IntegralType):
        return quoted(c).cast("long")
    if isinstance(t, T.BooleanType):
        return quoted(c).cast("long")
    return as_double(c, t) if is_numeric_type(t) else value_text(quoted(c), t)


def apply_codes(df: DataFrame, codes: dict[str, Codes],
                scaled: dict[str, tuple[float, float]]) -> DataFrame:
    """Codes, or (code - shift) / scale where a scaler is given, in place of the columns."""
    new: dict[str, Column] = {}
    out = df
    small = broadcast_share({c: code.size for c, code in codes.items() if code.levels is None})
    for i, (c, code) in enumerate(codes.items()):
        t = df.schema[c].dataType
        shift, scale = scaled.get(c, (None, None))
        if code.levels is not None:
            values = {k: v if shift is None else (v - shift) / scale for k, v in code.levels.items()}
            new[c] = literal_map(level_key(c, t), values, "long" if shift is None else "double")
        else:
            value = F.col("code") if shift is None else (F.col("code") - F.lit(shift)) / F.lit(scale)
            joined = code.table.withColumn(f"_code{i}", value)
            out = attach(out, value_text(quoted(c), t), joined, "text", [f"_code{i}"], code.size,
                         BROADCAST_ROWS if c in small else -1)
            new[c] = F.col(f"_code{i}")
    return out.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


# --- scaling ------------------------------------------------------------------------------------

def scaler_aggs(x: Column, strategy: str) -> tuple[Column, Column]:
    """(shift, scale) aggregates; a constant column keeps scale 1."""
    if strategy == "minmax":
        return F.min(x), F.max(x) - F.min(x)
    return F.avg(x), F.stddev_pop(x)


def fit_scaler(df: DataFrame, columns: dict[str, Column], strategy: str) -> dict[str, tuple[float, float]]:
    exprs = {}
    for c, x in columns.items():
        shift, scale = scaler_aggs(x, strategy)
        exprs |= {f"a.{c}": shift, f"b.{c}": scale}
    got = agg_row(df, exprs) if exprs else {}
    return {c: (got[f"a.{c}"] or 0.0, got[f"b.{c}"] or 1.0) for c in columns}


def code_scaler(codes: dict[str, Codes], strategy: str) -> dict[str, tuple[float, float]]:
    """Scaler of encoded columns from the dictionaries alone: no second pass over the data."""
    out = {}
    for c, code in codes.items():
        if code.levels is not None:
            n = sum(code.counts.values()) or 1
            mean = sum(code.levels[t] * k for t, k in code.counts.items()) / n
            var = sum((code.levels[t] - mean) ** 2 * k for t, k in code.counts.items()) / n
            top = max(len(code.levels) - 1, 0)
        else:
            mean, deviation, top = code.moments
            var = deviation ** 2
        out[c] = (0.0, float(top) or 1.0) if strategy == "minmax" else (float(mean), var ** 0.5 or 1.0)
    return out


def scale(df: DataFrame, columns: list[str] | None = None, target: str | None = None,
          strategy: str = "standard") -> DataFrame:
    """Standard (population deviation) or min-max scaling; gaps count as 0."""
    names = [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name != target
             and (columns is None or f.name in columns)]
    xs = {c: F.coalesce(as_double(c, df.schema[c].dataType), F.lit(0.0)) for c in names}
    fitted = fit_scaler(df, xs, strategy)
    return replace_columns(df, {c: (xs[c] - F.lit(a)) / F.lit(b) for c, (a, b) in fitted.items()})


# --- the fixed build ---------------------------------------------------------------------------------

@dataclass
class Build:
    """Result of ``build_features`` with what was decided on the way."""
    frame: DataFrame
    target: str | None
    task_type: str
    time_column: str | None
    scaling: str
    dropped_ids: list[str] = field(default_factory=list)
    dropped_constants: list[str] = field(default_factory=list)
    encoded: list[str] = field(default_factory=list)
    has_split: bool = False


def plan_scaling(plan: dict | None) -> str:
    """Scaling strategy of a plan, nested or flat layout."""
    for layer in ((plan or {}).get("preprocessing_plan", {}), plan or {}):
        strategy = layer.get("preprocessing", {}).get("scaling", {}).get("strategy")
        if strategy:
            return strategy
    return "standard"


def detect_target(df: DataFrame, levels: dict[str, list], gaps: dict[str, int], n_rows: int) -> str | None:
    """Feature-stage target rule on the level counts at hand (same points as the profile form)."""
    best, best_score = None, 0
    for i, f in enumerate(df.schema.fields):
        c, low = f.name, f.name.lower()
        if any(b in c for b in FEATURE_BAD) or gaps[c] == n_rows:
            continue
        known = len(levels[c]) if c in levels else TRACKED_LEVELS + 1
        score = 50 * any(w in low for w in FEATURE_TARGETS) + 30 * (i == len(df.columns) - 1)
        score += 20 * (2 <= known <= 10) - 50 * (known > TRACKED_LEVELS)
        score += 10 * (not is_numeric_type(f.dataType) and not isinstance(f.dataType, T.BooleanType))
        score -= 20 * any(ch in c for ch in " $%@")
        if score > best_score:
            best, best_score = c, score
    return best


def detect_task(df: DataFrame, target: str | None) -> str:
    from tablesmith.operators.infer import task_type

    return "classification" if target is None else task_type(df, target).first()["task_type"]


def build_features(
    df: DataFrame,
    keys: list[str],
    plan: dict | None = None,
    detect_time: bool = True,
    split: bool = True,
) -> Build:
    """Calendar parts, drops, impute, encode, scale and split in one applied scan.

    ``keys`` identify a row (from landing); they order ties and seed the split and
    are kept out of the features unless the data itself holds them.
    """
    if not keys:  # rows get stored numbers of their own, which leave with the key
        row, = free_names(df, "row_id")
        built = build_features(with_row_id(df, row), [row], plan, detect_time, split)
        built.frame = built.frame.drop(row)
        return built
    time_column = detect_time_column(df) if detect_time else None
    work = df
    if time_column:
        stamp = F.unix_micros(parse_time(quoted(time_column), df.schema[time_column].dataType))
        work = time_parts(df.withColumn("_time", stamp), time_column)
    hidden = [F.struct(*[quoted(k) for k in keys]).alias("_key")]
    data_columns = [c for c in work.columns if c != "_time"]
    work = work.select(*map(quoted, data_columns), *hidden,
                       *([F.col("_time")] if time_column else []))

    data = work.select(*map(quoted, data_columns))
    first = agg_row(data, {"rows": F.count(F.lit(1))}
                    | {f"gap.{f.name}": F.count_if(observed(f.name, f.dataType).isNull())
                       for f in data.schema.fields}
                    | {f"levels.{c}": e for c, e in level_sketches(data, data_columns).items()})
    n_all = first["rows"]
    gaps = {c: first[f"gap.{c}"] for c in data_columns}
    levels = few_levels(data, data_columns, sketch={c: first[f"levels.{c}"] for c in data_columns})

    target = (plan or {}).get("target_column")
    task = (plan or {}).get("task_type", "classification")
    if target not in data_columns:
        target = detect_target(data, levels, gaps, n_all)
        task = detect_task(data, target)

    data, ids = drop_id_columns(data, target)
    data, constants = drop_constant_columns(data, target, levels)
    kept = data.columns
    carried = [c for c in ("_key", "_time") if c in work.columns]
    rows = work.select(*map(quoted, kept), *carried)

    # impute and clean as expressions on the source columns
    types = {f.name: f.dataType for f in data.schema.fields}
    numeric = [c for c in kept if is_numeric_type(types[c])]
    medians = column_medians(data, [c for c in numeric if gaps[c]])
    clean: dict[str, Column] = {}
    for c in kept:
        if c in medians:
            clean[c] = fill_numeric(data, c, medians[c])
        elif c in numeric:
            continue
        elif gaps[c] or is_time_type(types[c]):
            clean[c] = F.coalesce(value_text(quoted(c), types[c]), F.lit("unknown"))
    rows = replace_columns(rows, clean)
    rows = replace_columns(rows, {
        c: zero_if_infinite(quoted(c)) for c in numeric
        if isinstance(rows.schema[c].dataType, (T.DoubleType, T.FloatType))})
    after = {c: clean_levels(levels[c], gaps[c], types[c], rows.schema[c].dataType, medians.get(c))
             for c in kept if c in levels}
    types = {f.name: f.dataType for f in rows.schema.fields}

    features = [c for c in kept if c != target]
    encoded = [c for c in features if not is_numeric_type(types[c])
               or (c in after and len(after[c]) <= ENCODE_LEVELS)]
    codes = fit_codes(rows, encoded, after)
    strategy = plan_scaling(plan)
    plain = {c: quoted(c).cast("double") for c in features if c not in codes}
    if strategy == "none":
        fitted, code_fit = {}, {}
    else:
        fitted, code_fit = fit_scaler(rows, plain, strategy), code_scaler(codes, strategy)

    # split on the untouched key and time, then apply everything
    has_split = bool(split and target)
    if has_split:
        rows = _add_split(rows, target, task, time_column is not None, n_all)
    tail = ["split"] if has_split else []
    out = apply_codes(rows, codes, code_fit)
    final = [
        ((plain[c] - F.lit(fitted[c][0])) / F.lit(fitted[c][1])).alias(c) if c in fitted else quoted(c)
        for c in kept
    ]
    if not kept:
        final = [F.lit(0).alias("placeholder")]
    frame = out.select(F.col("_key.*"), *final, *tail) if _free_keys(keys, kept) else out.select(
        *final, *tail)
    return Build(frame, target, task, time_column, strategy, ids, constants, encoded, has_split)


def clean_levels(levels: list, gaps: int, before: T.DataType, after: T.DataType,
                 median: float | None) -> list:
    """Level list of a column once its gaps are filled and infinities are zero."""
    merged: dict = {}
    fractional = is_numeric_type(after) and not isinstance(after, T.IntegralType)
    for v, n in levels:
        if isinstance(before, T.BooleanType) and isinstance(after, T.StringType):
            v = "True" if v else "False"
        if fractional:
            v = float(v) if math.isfinite(v) else 0.0
        merged[v] = merged.get(v, 0) + n
    if gaps:
        if is_numeric_type(after):
            fill = float(median) if fractional else int(median)
            fill = fill if math.isfinite(fill) else 0.0
        else:
            fill = "unknown"
        merged[fill] = merged.get(fill, 0) + gaps
    return list(merged.items())


def _free_keys(keys: list[str], kept: list[str]) -> bool:
    """Keys are shown beside the features when none of them is a feature itself."""
    return bool(keys) and not set(keys) & set(kept)


def _add_split(rows: DataFrame, target: str, task: str, chronological: bool, n: int) -> DataFrame:
    if chronological:
        key = rows.schema["_key"].dataType
        whole = len(key) == 1 and isinstance(key[0].dataType, T.IntegralType)
        # equal times go by the row key itself where it is one whole number
        tie = F.col("_key").getField(key[0].name).cast("long") if whole else tie_order(["_key"])
        return split_time(rows, F.col("_time"), tie, n_rows=n)
    flat = rows.withColumn("_row", F.to_json("_key"))
    done = (split_stratified(flat, target, ["_row"]) if task == "classification"
            else split_random(flat, ["_row"], n_rows=n))
    return done.drop("_row")
