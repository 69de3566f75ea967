"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in the order of their key, the number is permuted by a keyed
Feistel network on the smallest even power of two that holds all rows, walked
until it falls below the row count, and dealt round-robin: shard is the place
modulo the shard count, slot the quotient. Shard and slot of a row follow from
its number alone (:func:`place`), and :func:`row_at` inverts them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.shared import col, fresh, numbered, workspace

ROUNDS = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, half: int, seed: int, back: bool = False) -> np.ndarray:
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = x >> bits, x & mask
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        key = _mix(np.full(1, (seed * ROUNDS + k + 1) & (2**64 - 1), np.uint64) * _ODD)
        if back:
            left, right = right ^ (_mix(left ^ key) & mask), left
        else:
            left, right = right, left ^ (_mix(right ^ key) & mask)
    return (left << bits) | right


def permute(rows: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1, or its inverse. Walking ends: the row's own cycle leads back below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    x = _network(np.asarray(rows).astype(np.uint64), half, seed, back)
    out = x >= np.uint64(max(n, 1))
    while out.any():
        x[out] = _network(x[out], half, seed, back)
        out = x >= np.uint64(n)
    return x.astype(np.int64)


def place(rows: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of global row numbers."""
    at = permute(rows, n, seed)
    return at % shards, at // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    """The global row number that sits in a slot of a shard."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), n, seed, back=True)


def shard(rows: DataFrame, key: list[str], shards: int, seed: int = 0, path: str | None = None) -> DataFrame:
    """Adds ``row``, ``shard`` and ``slot`` (and an underscore each where the name is taken).

    Counts of the shards differ by at most one and slots are gapless from 0.
    Give a narrow frame: it is sorted by ``key`` and stored once. Rows equal in
    ``key`` are numbered in any way, so put enough columns there to make the
    shuffle reproducible. Nulls sort first; an empty frame gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    row, place_col, shard_col, slot_col = fresh(rows, "row", "place", "shard", "slot")
    data, n = numbered(rows, key, path or workspace(rows.sparkSession, "shards"), row)

    @F.pandas_udf("long")
    def permuted(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    at = data.withColumn(place_col, permuted(col(row)))
    return at.select(
        *[col(c) for c in rows.columns], col(row),
        (col(place_col) % shards).cast("int").alias(shard_col),
        F.expr(f"`{place_col}` div {shards}").alias(slot_col),
    )


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 20) -> DataFrame:
    """Documents dealt to shards; a null text has no bytes and the checksum of none.

    Columns besides ``doc_id`` and ``text`` are not read. Repeated rows each get a slot of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard(narrow, ["doc_id", "text_crc32", "size"], shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row",
    )
