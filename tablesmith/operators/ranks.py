"""Exact order statistics and global ranks that never sort a whole column in one task.

``order_statistics`` finds the k-th smallest values by narrowing: an approximate
percentile proposes two pivots, one aggregate counts how many rows lie below, on
and between them, and the region that holds rank k becomes the next region. Each
round is a scan with a map-side aggregate, no shuffle of rows; pivots only steer,
the counts decide, so the answer is exact. Once a region is small its distinct
values are counted and ranked.

``global_row_number`` gives every row its position in a total order: the rows are
written once in key order, and a position is the file's start plus the place in it, so a
recomputed task sees the same numbers. The number of files follows the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.session import SINGLE_TASK_ROWS, free_names, stored_rows

AGG_CHUNK = 40  # expressions of one kind per aggregate, keeps generated code small
COUNT_CHUNK = 16  # conditional counts per aggregate: code of more is too long to be compiled
PIVOT_ACCURACY = 10_000
SLACK = 2.0 / PIVOT_ACCURACY  # pivots sit this far (in rank share) around the wanted ranks


def chunks(items: list, size: int = AGG_CHUNK) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def agg_row(df: DataFrame, exprs: dict[str, Column], chunk: int = 4 * AGG_CHUNK) -> dict:
    """Evaluate named aggregates and return the single result row as a dict."""
    out: dict = {}
    for part in chunks(list(exprs.items()), chunk):
        aliased = [e.alias(f"a{i}") for i, (_, e) in enumerate(part)]
        row = df.agg(*aliased).first()
        out.update({name: row[i] for i, (name, _) in enumerate(part)})
    return out


@dataclass
class _Region:
    """An open value interval of one column and the wanted ranks that fall into it."""
    column: str
    ranks: list[int]
    size: int
    below: int = 0
    low: object = None  # exclusive bounds, None = open
    high: object = None

    def test(self, x: Column) -> Column:
        cond = x.isNotNull()
        if self.low is not None:
            cond = cond & (x > F.lit(self.low))
        if self.high is not None:
            cond = cond & (x < F.lit(self.high))
        return cond

    def split(self, lo, hi, counts: dict[str, int], found: dict[int, object]) -> list["_Region"]:
        """Ranks on a pivot are answered; the others go to the part that holds them."""
        edges = [
            (counts["lt"], (self.low, lo)), (counts["lo"], lo), (counts["mid"], (lo, hi)),
            (counts["hi"], hi), (None, (hi, self.high)),
        ]
        parts, start = [], self.below
        left = list(self.ranks)
        for n, what in edges:
            n = self.below + self.size - start if n is None else n
            mine = [r for r in left if r < start + n]
            left = left[len(mine):]
            if mine and isinstance(what, tuple):
                parts.append(_Region(self.column, mine, n, start, *what))
            found.update({} if isinstance(what, tuple) else {r: what for r in mine})
            start += n
        return parts


def order_statistics(
    df: DataFrame,
    columns: dict[str, Column],
    ranks: dict[str, list[int]],
    sizes: dict[str, int],
    finish_rows: int = SINGLE_TASK_ROWS,
) -> dict[str, dict[int, object]]:
    """Values at 0-based ``ranks`` of numeric columns with ``sizes`` non-null rows each."""
    found: dict[str, dict[int, object]] = {name: {} for name in ranks}
    done, open_ = [], []
    for name, wanted in ranks.items():
        inside = sorted({r for r in wanted if 0 <= r < sizes[name]})
        for group in _neighbours(inside, sizes[name]):
            open_.append(_Region(name, group, sizes[name]))
    while open_:
        done += [r for r in open_ if r.size <= finish_rows]
        wide = [r for r in open_ if r.size > finish_rows]
        open_ = [part for some in chunks(wide) for part in _narrow_once(df, columns, some, found)]
    _finish(df, columns, done, found)
    return found


def _neighbours(ranks: list[int], size: int) -> list[list[int]]:
    """Ranks close enough to share a pair of pivots."""
    groups: list[list[int]] = []
    for r in ranks:
        if groups and r - groups[-1][0] <= size * SLACK:
            groups[-1].append(r)
        else:
            groups.append([r])
    return groups


def _narrow_once(df: DataFrame, columns: dict[str, Column], regions: list[_Region],
                 found: dict[str, dict[int, object]]) -> list[_Region]:
    points: dict[tuple, list[float]] = {}
    spots = []
    for r in regions:  # regions of the same interval, as all of a column are at first, share a sketch
        first, last = ((k - r.below + 0.5) / r.size for k in (r.ranks[0], r.ranks[-1]))
        mine = points.setdefault((r.column, r.low, r.high), [])
        spots.append(((r.column, r.low, r.high), len(mine)))
        mine += [max(0.0, first - SLACK), min(1.0, last + SLACK)]
    tests = {(r.column, r.low, r.high): r.test(columns[r.column]) for r in regions}
    sketched = agg_row(df, {k: F.percentile_approx(F.when(tests[k], columns[k[0]]), ps, PIVOT_ACCURACY) for k, ps in points.items()})
    pivots = [sketched[k][at : at + 2] for k, at in spots]
    counts = {}
    for i, r in enumerate(regions):
        x, inside = columns[r.column], r.test(columns[r.column])
        lo, hi = pivots[i]
        counts[f"{i}.lt"] = F.count_if(inside & (x < F.lit(lo)))
        counts[f"{i}.lo"] = F.count_if(inside & (x == F.lit(lo)))
        counts[f"{i}.mid"] = F.count_if(inside & (x > F.lit(lo)) & (x < F.lit(hi)))
        counts[f"{i}.hi"] = F.count_if(inside & (x == F.lit(hi)) & F.lit(hi > lo))
    got = agg_row(df, counts, COUNT_CHUNK)
    out = []
    for i, r in enumerate(regions):
        lo, hi = pivots[i]
        out += r.split(lo, hi, {k: got[f"{i}.{k}"] for k in ("lt", "lo", "mid", "hi")}, found[r.column])
    return out


def _finish(df: DataFrame, columns: dict[str, Column], regions: list[_Region],
            found: dict[str, dict[int, object]]) -> None:
    """Rank the distinct values left in each (small) region."""
    if not regions:
        return
    scans = {
        str(i): Scan(F.when(r.test(columns[r.column]), columns[r.column]), [k - r.below for k in r.ranks])
        for i, r in enumerate(regions)
    }
    got = scan_columns(df, scans)
    for i, r in enumerate(regions):
        found[r.column].update({k: got[str(i)].values[k - r.below] for k in r.ranks})


@dataclass
class Scan:
    """What to learn about one column: its distinct count and the values at some ranks."""
    value: Column
    ranks: list[int] = field(default_factory=list)


@dataclass
class Scanned:
    distinct: int
    values: dict[int, object]


def scan_columns(df: DataFrame, scans: dict[str, Scan]) -> dict[str, Scanned]:
    """Distinct counts, and values at ranks, of many columns in one pass.

    Cells are grouped by column and a key of fixed width: numbers by themselves, everything else by a 64-bit digest with a
    second digest beside it, so no text is shuffled. Where one key has two second digests, two values share it,
    and that column is counted by its values. Ranks order the distinct values of their column in one task,
    so callers pass them only for columns (or regions) of bounded size.
    """
    out: dict[str, Scanned] = {}
    for part in chunks(list(scans.items())):
        kinds = df.select(*[s.value.alias(f"v{i}") for i, (_, s) in enumerate(part)]).schema.fields
        cells = F.array(*[_cell(i, s, kinds[i].dataType) for i, (_, s) in enumerate(part)])
        freq = df.select(F.explode(cells).alias("c")).where("c is not null").select("c.*").groupBy("i", "whole", "real").agg(
            F.count("*").alias("n"), (F.min("second") != F.max("second")).alias("shared"))
        wanted = {i: s.ranks for i, (_, s) in enumerate(part) if s.ranks}
        stats = [F.count("*").alias("d"), F.count_if("shared").alias("shared")]
        if wanted:
            freq = freq.withColumn("upto", F.when(
                F.col("i").isin(*wanted), F.sum("n").over(Window.partitionBy("i").orderBy("real", "whole"))))
            ranks = literal_lookup(F.col("i"), {i: F.array(*[F.lit(r).cast("long") for r in rs]) for i, rs in wanted.items()})
            for j in range(max(map(len, wanted.values()))):
                rank = F.get(ranks, F.lit(j))
                at = (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
                stats += [F.max(F.when(at, F.struct("real", "whole"))).alias(f"r{j}")]
        for r in freq.groupBy("i").agg(*stats).collect():  # one row per column
            name, scan = part[r["i"]]
            values = [r[f"r{j}"] for j in range(len(scan.ranks))]
            distinct = r["d"] if not r["shared"] else df.select(scan.value.alias("v")).where("v is not null").distinct().count()
            out[name] = Scanned(distinct, {k: v["whole"] if v["real"] is None else v["real"] for k, v in zip(scan.ranks, values)})
        for name, _ in part:
            out.setdefault(name, Scanned(0, {}))
    return out


def _cell(i: int, scan: Scan, kind: T.DataType) -> Column:
    """(i, whole, real, second) of a cell, null where the cell is."""
    v, none = scan.value, F.lit(None).cast("long")
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        whole, real, second = v.cast("long"), none.cast("double"), none
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        whole, real, second = none, v.cast("double"), none
    else:
        v = F.to_json(v) if isinstance(kind, (T.ArrayType, T.StructType)) else v
        real = scan.value.cast("double") if isinstance(kind, T.DecimalType) else none.cast("double")
        whole, second = F.xxhash64(v), F.xxhash64(F.lit("second"), v)
    return F.when(scan.value.isNotNull(), F.struct(
        F.lit(i).alias("i"), whole.alias("whole"), real.alias("real"), second.alias("second")))


def literal_lookup(key: Column, values: dict) -> Column:
    """The value of a literal map at a key, null if it has none."""
    return F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values())), key)


def quantile_ranks(size: int, probs: list[float]) -> list[int]:
    """Ranks whose values the interpolated quantiles need."""
    spots = [(size - 1) * p for p in probs]
    return sorted({r for h in spots for r in (math.floor(h), math.ceil(h))}) if size else []


def interpolate(size: int, probs: list[float], values: dict[int, object]) -> list:
    """Linear interpolation between the two ranks around each quantile."""
    out = []
    for p in probs:
        h = (size - 1) * p
        a, b = (float(values[r]) for r in (math.floor(h), math.ceil(h)))
        out.append(a if a == b else a + (b - a) * (h - math.floor(h)))
    return out


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probs: list[float],
    sizes: dict[str, int],
    n_rows: int,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> dict[str, list]:
    """Linearly interpolated quantiles of each column, exact at any size."""
    live = {c: x for c, x in columns.items() if sizes[c] > 0}
    out: dict[str, list] = {c: [None] * len(probs) for c in columns}
    ranks = {c: quantile_ranks(sizes[c], probs) for c in live}
    if n_rows <= single_task_rows:
        got = scan_columns(df, {c: Scan(x, ranks[c]) for c, x in live.items()})
        found = {c: s.values for c, s in got.items()}
    else:
        found = order_statistics(df, live, ranks, sizes, single_task_rows)
    out.update({c: interpolate(sizes[c], probs, found[c]) for c in live})
    return out


def rank_cut(
    df: DataFrame, key: Column, tie: Column, rank: int, n_rows: int,
    finish_rows: int = SINGLE_TASK_ROWS,
) -> Column:
    """Predicate true for rows whose 0-based position by (key, tie) is <= ``rank``.

    Both are numeric, ``key`` has no nulls and ``tie`` is unique among equal keys.
    Only the cut point is searched for; no row is shuffled.
    """
    if rank < 0:
        return F.lit(False)
    if rank >= n_rows - 1:
        return F.lit(True)
    at = order_statistics(df, {"k": key}, {"k": [rank]}, {"k": n_rows}, finish_rows)["k"][rank]
    got = agg_row(df, {"lt": F.count_if(key < F.lit(at)), "eq": F.count_if(key == F.lit(at))})
    if rank - got["lt"] >= got["eq"] - 1:
        return key <= F.lit(at)
    tied = df.where(key == F.lit(at))
    k = rank - got["lt"]
    last = order_statistics(tied, {"t": tie}, {"t": [k]}, {"t": got["eq"]}, finish_rows)["t"][k]
    return (key < F.lit(at)) | ((key == F.lit(at)) & (tie <= F.lit(last)))


# --- total order over rows -----------------------------------------------------

def sorted_rows(df: DataFrame, key: Column, part: str, place: str, before: str | None = None) -> DataFrame:
    """Rows written once in the order of a unique key: the file a row lies in, and its place there.

    The sort deals key ranges to tasks, so no task holds the whole column, and a retried reader sees the same places.
    """
    at, = free_names(df, "sort_key")
    return stored_rows(df.withColumn(at, key).orderBy(at), part, place, before).drop(at)


def global_row_number(df: DataFrame, key: Column, out: str = "row_number") -> DataFrame:
    """Add the 0-based position by a unique ``key`` (number, text, date); one way at every size."""
    part, place, before = free_names(df, "part", "place", "before")
    rows = sorted_rows(df, key, part, place, before)
    return rows.withColumn(out, F.col(place) + F.col(before)).drop(part, place, before)


def with_previous(df: DataFrame, key: Column, value: Column, out: str = "previous") -> DataFrame:
    """Add the value of the preceding row in the order of a unique numeric ``key``.

    The last row of each sorted file is carried over to the next, so no file
    waits for another and none holds the whole column.
    """
    rows = sorted_rows(df.select(key.alias("_key"), value.alias("value")), F.col("_key"), "part", "place")
    ends = rows.groupBy("part").agg(F.max_by(F.struct("value"), "place").alias("end"))  # one row for each written file
    carried = ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("carried"))
    lagged = F.lag("value").over(Window.partitionBy("part").orderBy("place"))
    first = F.col("place") == 0
    return rows.withColumn("lagged", lagged).join(carried, "part").select(
        "value", F.when(first, F.col("carried.value")).otherwise(F.col("lagged")).alias(out),
        (~(first & F.col("carried").isNull())).alias("has_previous"))
