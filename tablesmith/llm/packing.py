"""Packing of token pieces into sequences by length patterns and non-negative least squares.

Only the histogram of piece lengths, at most one count for each length up to
the capacity, comes to the driver. Patterns of two and three lengths that fill
a sequence exactly are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded to whole numbers that the histogram can
serve; repeats of one or two hot lengths, which need not fill exactly, are tried too. What is
left goes, longest first, into the tightest open space, and the plan with the fewest sequences is taken. The plan
is a table of patterns with repeat counts, so its size follows the capacity and not the
corpus. Pieces find their place from their length and their rank in it.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.shared import store, worker_cache, workspace

CAPACITY = 2048
#: The smallest part of a three-part pattern is a multiple of this.
GRID = 32
FIT_ROUNDS = 400
#: Lengths with most tokens whose repeats are tried as patterns.
HOT = 8
#: Entries that a worker keeps of encoded chunks.
KEEP = 1_000_000
LONG_CHUNK = 64
#: A blank next to other white space belongs to a run that must not be split there; the rarer kinds of white space go the long way too.
_RUNS = ("  ", "\n ", " \n", *"\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0")


class _Chunks(dict):
    """Packed ids of chunks, made when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self.encode(chunk)).tobytes()
        if len(chunk) <= LONG_CHUNK and len(self) < KEEP:
            self[chunk] = ids
        return ids


class ByteCoder:
    """Byte-level BPE ids of texts; the same ids as the tokenizer file gives.

    A blank before a word belongs to that word, so texts whose white space stands alone are split at blanks
    and chunks are encoded once, by the rank file. All other texts go to the tokenizer whole.
    """

    def __init__(self, file: str, ranks: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.chunks = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.chunks = _Chunks(fast.encode_ordinary)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, text: str) -> bool:
        """Whether the text may be split at blanks: Latin-1 alone, no runs of white space with a blank, no special token."""
        if any(r in text for r in _RUNS) or any(x in text for x in self.special):
            return False
        try:
            return text.isascii() or bool(text.encode("latin-1"))
        except UnicodeEncodeError:
            return False

    def encode(self, text: str) -> bytes:
        if self.chunks is None or not self.plain(text):
            return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, text.replace(" ", "\0 ").split("\0") if "\0" not in text else
                            re.split("(?= )", text)))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, after a first one that takes the rest."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, file: str, ranks: str | None = None, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the task and rank among its pieces of that length."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, task = worker_cache(), TaskContext.get().partitionId()
        if ("bytes", file) not in cache:
            cache["bytes", file] = ByteCoder(file, ranks)
        coder, seen = cache["bytes", file], [0] * (capacity + 1)
        tail = int(end).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = coder.encode(text) + tail
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start: 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))
    return narrow.mapInArrow(
        encode, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def patterns(capacity: int, grid: int = GRID) -> np.ndarray:
    """Exact fillings of two or three lengths, longest first; a missing third part is 0."""
    out = [(capacity - b, b, 0) for b in range(1, capacity // 2 + 1)]
    for c in range(grid, capacity // 3 + 1, grid):
        out += [(capacity - c - b, b, c) for b in range(c, (capacity - c) // 2 + 1)]
    return np.array(out, np.int64).reshape(-1, 3)


def fit(counts: np.ndarray, table: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used by the patterns nearest to ``counts``: accelerated projected gradient."""
    size = len(counts)

    def used(x):
        y = np.zeros(size)
        for j in range(table.shape[1]):
            y += np.bincount(table[:, j], x, size)
        y[0] = 0.0
        return y

    def back(r):
        r = r.copy()
        r[0] = 0.0
        return sum(r[table[:, j]] for j in range(table.shape[1]))

    target = counts.astype(float)
    target[0] = 0.0
    v = np.ones(len(table))
    for _ in range(20):  # the largest eigenvalue gives the step
        v = back(used(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(table))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y + back(target - used(y)) / top)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def take(left: np.ndarray, parts: tuple[int, ...], most: int | None = None) -> int:
    """How often the pattern can be repeated from what is ``left``, ``most`` at most; these pieces are taken away."""
    n = min(int(left[p]) // parts.count(p) for p in parts)
    n = n if most is None else min(n, most)
    for p in parts:
        left[p] -= n
    return n


def close(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns for all that is left: longest first, as many as fit into the open sequences with the least space that suffices, then into new ones."""
    left = left.copy()
    spaces: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            room = min((s for s in spaces if s >= length), default=None)
            if room is None:
                room, parts = capacity, ()
                fits = min(room // length, n)
                many = n // fits
            else:
                parts, many = spaces[room].pop()
                if not spaces[room]:
                    del spaces[room]
                fits = min(room // length, n)
            taken = min(many, n // fits)
            if taken < many:
                spaces.setdefault(room, []).append((parts, many - taken))
            spaces.setdefault(room - fits * length, []).append((parts + (length,) * fits, taken))
            n -= taken * fits
    return [x for entries in spaces.values() for x in entries]


def fitted(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Exact fillings as often as the fit says; takes their pieces from ``left``."""
    out: list[tuple[tuple[int, ...], int]] = []
    table = patterns(capacity)
    if left.any() and len(table):
        times = np.rint(fit(left, table)).astype(np.int64)
        for k in np.argsort(-times, kind="stable"):
            if not times[k]:
                break
            parts = tuple(int(p) for p in table[k] if p)
            n = take(left, parts, int(times[k]))
            if n > 0:
                out.append((parts, n))
    return out


def repeated(left: np.ndarray, capacity: int, hot: int = HOT) -> list[tuple[tuple[int, ...], int]]:
    """Fillings by repeats of one or two of the lengths with most tokens, fullest first; takes their pieces from ``left``."""
    tokens = left * np.arange(len(left))
    top = [int(k) for k in np.argsort(-tokens, kind="stable")[:hot] if left[k]]
    found = {(a,) * i + (b,) * ((capacity - i * a) // b) for a in top for b in top if a != b for i in range(1, capacity // a + 1)}
    found |= {(a,) * (capacity // a) for a in top}
    found = {tuple(sorted(x, reverse=True)) for x in found}
    return [(x, n) for x in sorted(found, key=lambda x: (-sum(x), len(x), x)) if (n := take(left, x))]


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that use every length exactly as often as ``counts`` says. Driver work bounded by the capacity.

    Broad histograms fill well with the fitted patterns, hot lengths with repeats of themselves; the shortest plan is taken.
    """
    plans = []
    for steps in ((fitted,), (), (repeated,), (repeated, fitted)):
        left = counts.astype(np.int64).copy()
        full = int(left[capacity])
        left[capacity] = 0
        out = [((capacity,), full)] if full else []
        for step in steps:
            out += step(left, capacity)
        plans.append(out + close(left, capacity))
    return min(plans, key=lambda x: sum(n for _, n in x))


def places(planned: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ranks within lengths: sorted keys (length, first rank), the sequence of that rank, the offset there."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for parts, n in planned:
        at = 0
        for length in parts:
            first = rank.get(length, 0)
            rows.append(((length << 40) + first, sequence, at))
            rank[length] = first + n
            at += length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored rows with ``length``, ``task`` and ``nth`` (rank in task and length).

    Equal lengths may fill most of the table: ranks come from counts for each task and length, so no task holds a whole length.
    """
    spark = parts.sparkSession
    per_task = parts.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = per_task.select(
        "task", "length", F.expr("sum(n) OVER (PARTITION BY length ORDER BY task) - n").alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("length").count().collect():  # one row for each length at most
        counts[r["length"]] = r["count"]
    keys, sequences, offsets = places(plan(counts, capacity))
    shared = spark.sparkContext.broadcast((keys, sequences, offsets))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def seat(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, sequences, offsets = shared.value
        key = (length.to_numpy(np.int64) << 40) + rank.to_numpy(np.int64)
        k = np.searchsorted(keys, key, "right") - 1
        return pd.DataFrame({"sequence_id": sequences[k] + key - keys[k], "offset": offsets[k]})

    ranked = parts.join(before, ["task", "length"])
    return ranked.withColumn("seat", seat("length", F.col("nth") + F.col("before"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.col("seat.sequence_id").alias("sequence_id"), F.col("seat.offset").alias("offset"))


def pack_documents(docs: DataFrame, file: str, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """All documents cut into pieces and packed.

    A null text counts as empty and gives a piece of the end mark alone. Only texts
    over the capacity are cut. Repeated rows are packed each; further columns are
    not read; an empty table gives no rows.
    """
    path = workspace(docs.sparkSession, "pieces")
    return pack(store(pieces(docs, file, ranks, capacity), path), capacity)
