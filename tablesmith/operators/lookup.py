"""Join rows to a lookup with unique keys, whatever its size and however skewed the rows.

* small lookup (rows and bytes both measured): broadcast;
* large lookup: the heavy keys, at most ``1 / HEAVY_SHARE`` of them by counting,
  are broadcast; all other rows meet the rest of the lookup in a shuffle join.
  Rows already answered get a spread-out empty key, so a key that fills a third
  of the table never lands in one task. The data is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.session import BROADCAST_BYTES, BROADCAST_ROWS, free_names

HEAVY_SHARE = 1e-3
KEY_BYTES = 65   # of a text key in a join: a mark and 64 characters
ROW_BYTES = 32   # of a broadcast row besides its key


def key_form(key: Column) -> Column:
    """A text key in at most ``KEY_BYTES`` bytes: a long text by its SHA-256, marked so that no short text equals it."""
    text = key.cast("string")
    return F.when(F.octet_length(text) < KEY_BYTES - 1, F.concat(F.lit("t"), text)).otherwise(F.concat(F.lit("h"), F.sha2(text, 256)))


def lookup_size(lookup: DataFrame, key: str) -> tuple[int, int, int]:
    """(keys, bytes of the keys as they are joined, rows they stand for)."""
    row = lookup.agg(
        F.count("*"), F.sum(F.least(F.octet_length(F.col(key).cast("string")) + 1, F.lit(KEY_BYTES))), F.sum("n")).first()
    return row[0], row[1] or 0, row[2] or 0


def broadcast_share(sizes: dict, broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> set:
    """Names of the lookups that may be broadcast together: the smallest first, until rows or bytes run out."""
    out, rows, size = set(), 0, 0
    for name, (n_keys, n_bytes, _) in sorted(sizes.items(), key=lambda x: x[1][1]):
        rows, size = rows + n_keys, size + n_bytes + ROW_BYTES * n_keys
        if rows > broadcast_rows or size > broadcast_bytes:
            break
        out.add(name)
    return out


def attach(
    df: DataFrame,
    key: Column,
    lookup: DataFrame,
    lookup_key: str,
    values: list[str],
    size: tuple[int, int, int] | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left-join ``values`` of ``lookup`` (unique ``lookup_key``, row count ``n``) onto ``df``.

    Text keys are joined in a form of bounded width, so the broadcast heavy keys are bounded too: 1,000 keys of ``KEY_BYTES``.
    """
    n_keys, n_bytes, n_rows = size or lookup_size(lookup, lookup_key)
    k, lk, hk, hot_name, salt, lsalt, k2, n = free_names(
        df, *(f"_{x}_{'_'.join(values)}" for x in ("k", "lk", "hk", "hot", "salt", "lsalt", "k2", "n")))
    form = key_form if isinstance(lookup.schema[lookup_key].dataType, T.StringType) else lambda c: c
    slim = lookup.select(form(F.col(lookup_key)).alias(lk), F.col("n").alias(n), *[F.col(v) for v in values])
    rows = df.withColumn(k, form(key))
    if n_keys <= broadcast_rows and n_bytes + ROW_BYTES * n_keys <= broadcast_bytes:
        hit = rows.join(F.broadcast(slim.drop(n)), F.col(k) == F.col(lk), "left")
        return hit.drop(k, lk)

    floor = max(2, int(n_rows * HEAVY_SHARE))
    heavy = slim.where(F.col(n) >= floor).select(
        F.col(lk).alias(hk), *[F.col(v).alias(f"{hk}_{v}") for v in values], F.lit(True).alias(hot_name))
    light = slim.where(F.col(n) < floor).drop(n).withColumn(lsalt, F.lit(0))
    first = rows.join(F.broadcast(heavy), F.col(k) == F.col(hk), "left").drop(hk)
    hot = F.coalesce(F.col(hot_name), F.lit(False)) | F.col(k).isNull()
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(1 << 20)).cast("int")
    first = (
        first.withColumn(salt, F.when(hot, spread).otherwise(F.lit(0)))
        .withColumn(k2, F.when(~hot, F.col(k)))
    )
    second = first.join(light, (F.col(k2) == F.col(lk)) & (F.col(salt) == F.col(lsalt)), "left")
    merged = [F.coalesce(F.col(f"{hk}_{v}"), F.col(v)).alias(v) for v in values]
    return second.select(*[F.col(f"`{c}`") for c in df.columns], *merged)
