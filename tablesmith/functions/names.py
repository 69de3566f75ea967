"""Column-name and file-name rules as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
DROP_ID_SUBSTRINGS = [
    "id", "Id", "ID", "customerID", "EmployeeNumber",
    "index", "IMBD title ID", "PassengerId",
]
DATE_WORDS = ["date", "time", "timestamp", "created_at", "updated_at"]
# --------------------------------------------------------------------------


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(c: Column, words: list[str]) -> Column:
    """True where the text contains at least one of the words."""
    return any_of([c.contains(w) for w in words])


def squash(c: Column | str, chars: str = "_- ") -> Column:
    """Lower-case the trimmed name and delete separator characters."""
    return F.lower(F.translate(F.trim(col_of(c)), chars, ""))


def normalize_name(c: Column | str) -> Column:
    return squash(c)


def id_rule(c: Column | str, variant: str) -> Column:
    """ID-column predicate. Variants differ on purpose, see the README table."""
    c = col_of(c)
    if variant == "substring":
        return contains_any(c, DROP_ID_SUBSTRINGS)
    if variant == "profile":
        n = squash(c)
        return n.endswith("id") | n.contains("passengerid")
    if variant == "dispatcher":
        n = squash(c)
        return (
            n.endswith("id")
            | n.startswith("unnamed")
            | contains_any(n, ["passengerid", "customerid", "employeeid", "employeenumber"])
        )
    if variant == "generator":
        n = squash(c, "_ ")
        return n.endswith("id") | contains_any(n, ["passengerid", "unnamed"])
    if variant == "pairs":
        return squash(c, "_-").endswith("id")
    raise ValueError(f"unknown ID rule: {variant}")


def date_rule(c: Column | str, dtype: Column | None = None) -> Column:
    """Name or type says the column holds dates."""
    named = contains_any(F.lower(F.trim(col_of(c))), DATE_WORDS)
    return named if dtype is None else named | F.lower(dtype).contains("datetime")


def is_drop_id(name: str) -> bool:
    """The substring rule for a literal column name (used to pick columns to drop)."""
    return any(p in name for p in DROP_ID_SUBSTRINGS)


# --- file names -------------------------------------------------------------

def base_name(path: Column | str) -> Column:
    return F.regexp_extract(posix_path(path), r"([^/]*)$", 1)


def stem(path: Column | str) -> Column:
    """Last path segment without its final suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def posix_path(path: Column | str) -> Column:
    return F.translate(col_of(path), "\\", "/")


def parse_filename(path: Column | str) -> Column:
    """``{date}_{time}_{version}_{name}.ext`` to a struct; other shapes give nulls."""
    base = stem(path)
    parts = F.split(base, "_", 4)
    whole = F.size(parts) == 4

    def part(i: int) -> Column:
        return F.when(whole, F.get(parts, F.lit(i)))

    return F.struct(
        part(0).alias("ts_date"), part(1).alias("ts_time"),
        part(2).alias("version"), part(3).alias("name"), base.alias("base_name"),
    )


def is_stamp_token(token: Column) -> Column:
    """Date (8 digits), time (6 digits) or a run of at least 8 hex characters."""
    return token.rlike(r"^([0-9]{6}|[0-9]{8}|[0-9a-fA-F]{8,})$")


def short_name(name: Column | str) -> Column:
    """Drop every stamp token; keep the name whole if nothing else remains."""
    name = col_of(name)
    kept = F.filter(F.split(name, "_"), lambda t: ~is_stamp_token(t))
    joined = F.when(F.size(kept) > 0, F.array_join(kept, "_")).otherwise(name)
    return F.translate(F.lower(joined), " ", "_")


def clean_dataset_id(path: Column | str) -> Column:
    """Drop only the leading stamp tokens of a curated file name."""
    base = F.replace(stem(path), F.lit("_cleaned"), F.lit(""))
    tail = F.regexp_replace(base, r"^(([0-9]{6}|[0-9]{8}|[0-9a-fA-F]{8,})(_|$))+", "")
    only_stamps = base.rlike(r"^(([0-9]{6}|[0-9]{8}|[0-9a-fA-F]{8,})(_|$))+$") & (tail == "")
    return F.translate(F.lower(F.when(only_stamps, base).otherwise(tail)), " ", "_")


def strip_data_suffix(name: Column | str) -> Column:
    """Remove ``.csv``/``.xlsx`` anywhere in the name, as the dataset label does."""
    return F.regexp_replace(col_of(name), r"\.csv|\.xlsx", "")
