"""Execute a plan: dedup, drop, impute, cap, log, encode, scale, split.

Each stage fits its statistics in one narrow pass and applies them as literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.numeric import (
    as_double, is_numeric_type, observed, quoted, value_text,
)
from tablesmith.operators.features import (
    column_medians, dictionaries, fill_numeric, label_encode, replace_columns, scale,
)
from tablesmith.operators.profile import OUTLIER_FACTOR
from tablesmith.operators.lookup import attach, broadcast_share
from tablesmith.operators.ranks import agg_row, exact_quantiles, literal_lookup
from tablesmith.operators.split import split_random, split_stratified
from tablesmith.plans.contract import DEFAULT_FILL, DEFAULT_SEED, DEFAULT_TEST_SIZE
from tablesmith.session import BROADCAST_ROWS, cut_lineage, free_names, with_row_id

MODE_CELLS, MODE_COUNTED = 1024, 64  # hash cells of a column, and how many of them are counted by value


def _present(df: DataFrame, columns: list[str] | None) -> list[str]:
    return [c for c in columns or [] if c in df.columns]


def _typed_cells(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Non-null cells as (ordinal, one column for each data type), and the name of each column's own."""
    values = {c: observed(c, df.schema[c].dataType) for c in columns}
    kinds = {f.name: f.dataType for f in df.select(*[v.alias(c) for c, v in values.items()]).schema.fields}
    names = {kind: f"v{i}" for i, kind in enumerate(dict.fromkeys(kinds.values()))}
    cells = [F.when(v.isNotNull(), F.struct(F.lit(i).alias("ordinal"), *[
        (v if kind == kinds[c] else F.lit(None).cast(kind)).alias(name) for kind, name in names.items()]))
        for i, (c, v) in enumerate(values.items())]
    return df.select(F.explode(F.array(*cells)).alias("c")).where("c is not null").select("c.*"), {c: names[kinds[c]] for c in columns}


def _leading(cells: DataFrame, names: dict[str, str]) -> dict[int, tuple[object, int]]:
    """Most frequent value of each ordinal, the smallest on a tie, and its count."""
    kinds = list(dict.fromkeys(names.values()))
    counts = cells.groupBy("ordinal", *kinds).agg(F.count("*").alias("n"))
    best = counts.groupBy("ordinal").agg(F.max("n").alias("n"), *[
        F.min_by(v, F.when(F.col(v).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(v).alias("v")))).alias(v) for v in kinds])
    own = list(names.values())
    return {r["ordinal"]: (r[own[r["ordinal"]]], r["n"]) for r in best.collect()}  # one row a column


def column_modes(df: DataFrame, columns: list[str], cells: int = MODE_CELLS, counted: int = MODE_COUNTED) -> dict[str, object]:
    """Most frequent value per column, the smallest on a tie: two jobs for any number of columns.

    The first counts rows in ``cells`` hash cells a column, a table of bounded size. No value is more frequent than its cell, so the second
    counts only the values in the ``counted`` fullest cells: a value there with more rows than the fullest cell left out is the mode.
    Columns where none has (all values about as rare as a cell is full) are counted in full, together.
    """
    out = dict.fromkeys(columns)
    if not columns:
        return out
    rows, names = _typed_cells(df, columns)
    rows = rows.withColumn("cell", F.pmod(F.xxhash64(*dict.fromkeys(names.values())), F.lit(cells)).cast("int"))
    full = rows.groupBy("ordinal", "cell").agg(F.count("*").alias("n")).groupBy("ordinal").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("n", "cell")), False), 1, counted + 1).alias("top")).collect()
    if not full:
        return out
    top = {r["ordinal"]: [x["cell"] for x in r["top"][:counted]] for r in full}
    rest = {r["ordinal"]: r["top"][counted]["n"] if len(r["top"]) > counted else 0 for r in full}
    held = literal_lookup(F.col("ordinal"), {i: F.array(*map(F.lit, v)) for i, v in top.items()})
    found = _leading(rows.where(F.array_contains(held, F.col("cell"))), names)
    unproven = [columns[i] for i, (_, n) in found.items() if n <= rest[i]]
    out.update({columns[i]: v for i, (v, _) in found.items()})
    if unproven:
        again, own = _typed_cells(df, unproven)
        out.update({unproven[i]: v for i, (v, _) in _leading(again, own).items()})
    return out


def impute_numeric(df: DataFrame, columns: list[str], strategy: str = "median") -> DataFrame:
    columns = [c for c in _present(df, columns) if is_numeric_type(df.schema[c].dataType)]
    if not columns:
        return df
    if strategy == "mean":
        got = agg_row(df, {c: F.avg(as_double(c, df.schema[c].dataType)) for c in columns})
        values = {c: got[c] or 0.0 for c in columns}
    else:
        values = column_medians(df, columns)
    return replace_columns(df, {c: fill_numeric(df, c, v) for c, v in values.items()})


def impute_categorical(df: DataFrame, columns: list[str], strategy: str = "most_frequent",
                       constant: str = DEFAULT_FILL) -> DataFrame:
    columns = _present(df, columns)
    if strategy == "constant":
        return replace_columns(df, {
            c: F.coalesce(value_text(quoted(c), df.schema[c].dataType), F.lit(constant)) for c in columns})
    modes = column_modes(df, columns)
    return replace_columns(df, {
        c: F.coalesce(quoted(c), F.lit(m).cast(df.schema[c].dataType)) for c, m in modes.items()
        if m is not None})


def iqr_bounds(df: DataFrame, columns: list[str], factor: float = OUTLIER_FACTOR) -> dict[str, tuple]:
    xs = {c: as_double(c, df.schema[c].dataType) for c in columns}
    got = agg_row(df, {"rows": F.count(F.lit(1))} | {f"c.{c}": F.count(x) for c, x in xs.items()})
    quart = exact_quantiles(df, xs, [0.25, 0.75], {c: got[f"c.{c}"] for c in columns}, got["rows"])
    return {c: (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
            for c, (q1, q3) in quart.items() if q1 is not None}


def cap_outliers(df: DataFrame, columns: list[str], factor: float = OUTLIER_FACTOR) -> DataFrame:
    """Clamp values to the IQR fences; gaps stay gaps."""
    bounds = iqr_bounds(df, _present(df, columns), factor)
    new = {}
    for c, (lo, hi) in bounds.items():
        x = as_double(c, df.schema[c].dataType)
        new[c] = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
    return replace_columns(df, new)


def log_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    """``log1p`` of non-negative columns."""
    return replace_columns(df, {c: F.log1p(as_double(c, df.schema[c].dataType))
                                for c in _present(df, columns)})


def one_hot(df: DataFrame, columns: list[str], form: str = "columns") -> DataFrame:
    """One 0/1 column per level, named ``{column}_{level}``, in place of each column.

    ``form="index"`` gives the same vector in sparse form whatever the number of levels: ``{column}_index``, the place of the level
    among the sorted levels (null where all would be 0), and ``{column}_size``, the number of levels. The plan chooses the form; the data never does.
    """
    columns = _present(df, columns)
    if form == "index":
        codes = dictionaries(df, columns)
        rows, index = df, dict(zip(columns, free_names(df, *[f"{c}_index" for c in columns])))
        small = broadcast_share({c: code.size for c, code in codes.items()})
        for c, code in codes.items():
            table = code.table.withColumnRenamed("code", index[c])
            rows = attach(rows, value_text(quoted(c), df.schema[c].dataType), table, "text", [index[c]], code.size,
                          BROADCAST_ROWS if c in small else -1)
        return rows.select(*[x for c in df.columns for x in (
            [quoted(c)] if c not in columns else
            [quoted(index[c]).alias(f"{c}_index"), F.lit(codes[c].size[0]).cast("long").alias(f"{c}_size")])])
    texts = {c: value_text(quoted(c), df.schema[c].dataType) for c in columns}
    found: dict[str, list] = {c: [] for c in columns}
    if columns:
        cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), t.alias("text")) for i, t in enumerate(texts.values())])
        for r in df.select(F.inline(cells)).where("text IS NOT NULL").distinct().collect():  # one row for each column of the result
            found[columns[r["ordinal"]]].append(r["text"])
    out = []
    for c in df.columns:
        levels = sorted(found.get(c, []), key=lambda x: x.encode("utf-8"))
        out += [F.coalesce((texts[c] == F.lit(n)).cast("int"), F.lit(0)).alias(f"{c}_{n}") for n in levels] if c in columns else [quoted(c)]
    return df.select(*out)


def dedup_rows(df: DataFrame, columns: list[str] | None = None,
               keep: list[str] | None = None) -> DataFrame:
    """One row per distinct combination; with ``keep`` the first by that order.

    Copies are reduced before the shuffle (``min_by`` combines on the map side), so
    a group of copies that holds much of the table does not meet in one task.
    """
    columns = columns or df.columns
    if not keep:
        return df.dropDuplicates(columns)
    rest = [c for c in df.columns if c not in columns]
    order = F.struct(*[quoted(k) for k in keep])
    first = df.groupBy(*map(quoted, columns)).agg(
        F.min_by(F.struct(*map(quoted, rest)), order).alias("_rest")) if rest else \
        df.select(*map(quoted, columns)).distinct()
    picked = [F.col("_rest")[c].alias(c) if c in rest else quoted(c) for c in df.columns]
    return first.select(*picked)


@dataclass
class Applied:
    frame: DataFrame
    steps: list[str] = field(default_factory=list)
    constant_columns_dropped: list[str] = field(default_factory=list)
    duplicates_removed: int | None = None


def contract_plan(row) -> dict:
    """The nested plan of the contract from a flat row of ``dispatch``, or from a row that is nested already."""
    plan = row.asDict(recursive=True) if hasattr(row, "asDict") else dict(row)
    if "preprocessing" in plan:
        return plan
    part = lambda *names: {n: plan.get(n) for n in names}
    return {
        "dataset_name": plan.get("dataset"), "task_type": plan["task_type"], "target_column": plan["target_column"],
        "preprocessing": {
            "drop_columns": plan["drop_columns"],
            "imputation": part("numeric_strategy", "numeric_columns", "categorical_strategy", "categorical_columns", "constant_value"),
            "encoding": part("one_hot_columns", "label_encoding_columns"),
            "scaling": {"strategy": plan["scaling_strategy"], "columns": plan["scaling_columns"]},
            "log_transform": plan["log_transform"],
        },
        "split_strategy": part("test_size", "random_state", "stratify"),
        "smote": {"enabled": plan.get("smote_enabled"), "reason": plan.get("smote_reason")},
    }


def apply_plan(
    df: DataFrame,
    plan,
    keys: list[str] | None = None,
    dedup: bool = False,
    cap: list[str] | None = None,
    low_correlation: list[str] | None = None,
    with_split: bool = True,
) -> Applied:
    """Apply a normalized plan to a table: the contract's nested layout, or a row that ``dispatch`` gave.

    ``cap`` and ``low_correlation`` are the optional extras of a rule plan. ``keys``
    identify a row for the split; without them rows get stored numbers of their own. What is left after dedup is
    stored too, so the later fits do not repeat it.
    """
    plan = contract_plan(plan)
    target = plan["target_column"]
    pre = plan["preprocessing"]
    imp, enc, sca = pre["imputation"], pre["encoding"], pre["scaling"]
    done = Applied(df)

    def step(name: str, frame: DataFrame) -> None:
        done.frame = frame
        done.steps.append(name)

    if dedup:
        before = df.count()
        step("dedup", cut_lineage(dedup_rows(df)))
        done.duplicates_removed = before - done.frame.count()
    drops = [c for c in _present(df, (pre["drop_columns"] or []) + (low_correlation or []))
             if c != target]
    row, = free_names(done.frame, "_row")
    work = done.frame
    if with_split and keys:
        work = work.withColumn(row, F.to_json(F.struct(*[quoted(k) for k in keys])))
    elif with_split:
        work = with_row_id(work, row)
    if drops:
        step("drop", work.drop(*map(quoted, drops)))
        work = done.frame
    if imp["numeric_columns"]:
        step("impute_numeric", impute_numeric(work, imp["numeric_columns"], imp["numeric_strategy"]))
        work = done.frame
    if imp["categorical_columns"]:
        step("impute_categorical", impute_categorical(
            work, imp["categorical_columns"], imp["categorical_strategy"], imp["constant_value"]))
        work = done.frame
    if cap:
        step("cap_outliers", cap_outliers(work, [c for c in cap if c != target]))
        work = done.frame
    if pre["log_transform"]:
        step("log_transform", log_transform(work, pre["log_transform"]))
        work = done.frame
    if enc["label_encoding_columns"]:
        step("label_encode", label_encode(work, _present(work, enc["label_encoding_columns"])))
        work = done.frame
    if enc["one_hot_columns"]:
        step("one_hot", one_hot(work, enc["one_hot_columns"], enc.get("one_hot_form") or "columns"))
        work = done.frame
    if sca["strategy"] != "none" and sca["columns"]:
        step("scale", scale(work, _present(work, sca["columns"]), target, sca["strategy"]))
        work = done.frame
    if with_split and target in work.columns:
        s = plan.get("split_strategy") or {}
        size = s.get("test_size") or DEFAULT_TEST_SIZE
        seed = s.get("random_state") if s.get("random_state") is not None else DEFAULT_SEED
        split = (split_stratified(work, target, [row], size, seed) if s.get("stratify")
                 else split_random(work, [row], size, seed))
        step("split", split)
        work = done.frame
    done.frame = work.drop(row)
    return done


