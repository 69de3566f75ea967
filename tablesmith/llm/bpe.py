"""BPE encoding and decoding of whole texts by tree concatenation.

A text longer than a leaf is cut into leaves that are encoded apart, in
parallel tasks. Neighbours are then joined level by level: a window that covers
the cut is encoded anew and grown on both sides until it shares a token with
the left part before the cut and one with the right part after it; the left
tokens up to the first, the window's tokens between and the right tokens from the
second on are the encoding of the whole. A token sequence in which all neighbours encode
to themselves is the encoding of its text, and every neighbouring pair of the
result lies inside one of the three.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.shared import col, fresh, store, worker_cache, workspace

#: Characters of a leaf.
LEAF = 65_536
#: Entries that a worker keeps of encoded chunks.
KEEP = 1_000_000
#: A chunk longer than this is encoded without being kept.
LONG_CHUNK = 64
_ODD_BLANK = re.compile("[\x1c-\x1fɐ-\U0010ffff]")


class _Chunks(dict):
    """Encoded forms of white-space separated chunks, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk):
        made = self.make(chunk)
        if len(chunk) <= LONG_CHUNK and len(self) < KEEP:
            self[chunk] = made
        return made


class Coder:
    """One tokenizer file, with caches. ``separated``: white space parts tokens and leaves none."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.margin = max([1, *map(len, self.special)])
        ids = lambda x: self.tok.encode(x, add_special_tokens=False).ids
        shown = lambda x: self.tok.decode(ids(x), skip_special_tokens=False)
        self.separated = ids("a \nB") == ids("a") + ids("b") and shown("a b") == f"{shown('a')} {shown('b')}"
        self.chunks = _Chunks(self._chunk)

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        ids = self.tok.encode(chunk, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes(), self.tok.decode(ids, skip_special_tokens=False)

    def plain(self, text: str) -> bool:
        """Whether chunks between white space can be encoded one by one, in lower case made here.

        Below U+0250 every text is in composed form already and lower-casing looks at single characters.
        """
        return self.separated and not _ODD_BLANK.search(text) and not any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.plain(text):
            return b"".join([x for x, _ in map(self.chunks.__getitem__, text.lower().split())])
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def both(self, text: str) -> tuple[bytes, str]:
        """Ids and the decoded text."""
        if self.plain(text):
            parts = list(map(self.chunks.__getitem__, text.lower().split()))
            return b"".join([x for x, _ in parts]), " ".join([y for _, y in parts if y])
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes(), self.tok.decode(ids, skip_special_tokens=False)

    def spans(self, text: str, at: int = 0) -> list[tuple[int, int, int]]:
        """Tokens as (id, start, end) in characters of the text, moved by ``at``."""
        e = self.tok.encode(text, add_special_tokens=False)
        return [(i, s + at, t + at) for i, (s, t) in zip(e.ids, e.offsets)]


def coder(file: str) -> Coder:
    """The worker's coder of a file."""
    cache = worker_cache()
    if ("coder", file) not in cache:
        cache["coder", file] = Coder(file)
    return cache["coder", file]


def cut_points(text: str, leaf: int) -> list[int]:
    """Starts of the leaves. A cut moves back to a blank if one is near, and never splits a composed character."""
    out = [0]
    while len(text) - out[-1] > leaf:
        at = out[-1] + leaf
        near = text.rfind(" ", at - leaf // 8, at)
        if near > out[-1]:
            at = near
        else:
            while at > out[-1] + leaf // 2 and (unicodedata.combining(text[at]) or not text[at].isascii()):
                at -= 1
        out.append(at)
    return out


def _steady(text: str, token: tuple[int, int, int], special: list[str]) -> bool:
    """A token inside a run of letters, or right after white space: what stands left of it cannot change how it is split off."""
    _, s, t = token
    return t > s and (text[s:t].isalpha() or (s > 0 and text[s - 1].isspace()))


def join(c: Coder, text: str, left: list, right: list, cut: int, least: int = 64) -> list:
    """Tokens of ``text`` from those of its part before ``cut`` and of its part after it.

    ``left`` and ``right`` hold (id, start, end). The window grows by doubling; once it is the whole text, it is the answer.
    """
    size = least
    while True:
        lo, hi = max(0, cut - size - c.margin), min(len(text), cut + size + c.margin)
        first = next((k for k, x in enumerate(left) if x[1] >= lo), len(left)) if lo else 0
        lo = left[first][1] if lo and first < len(left) else 0
        last = len(right) - next((k for k, x in enumerate(reversed(right)) if x[2] <= hi), len(right)) if hi < len(text) else len(right)
        hi = right[last - 1][2] if hi < len(text) and last else len(text)
        if lo == 0 and hi == len(text):
            return c.spans(text)
        window = c.spans(text[lo:hi], lo)
        # A token at a cut end of the window may owe its form to that end.
        inner = window[1 if lo else 0: len(window) - 1 if hi < len(text) else len(window)]
        have = set(inner)
        if lo == 0:
            a = inner[0] if inner else None
        else:
            a = next((x for x in left[first:] if x in have and x[2] <= cut - c.margin and _steady(text, x, c.special)), None)
        if hi == len(text):
            b = inner[-1] if inner else None
        else:
            b = next((x for x in reversed(right[:last]) if x in have and x[1] >= cut + c.margin and _steady(text, x, c.special)), None)
        if a is not None and b is not None:
            i, j = window.index(a), len(window) - 1 - window[::-1].index(b)
            head = left[: left.index(a, first)] if lo else []
            tail = right[len(right) - right[::-1].index(b):] if hi < len(text) else []
            if i <= j:
                return head + window[i: j + 1] + tail
        size *= 2


def tree(c: Coder, text: str, parts: list[list], starts: list[int]) -> list:
    """Joins neighbouring parts pair by pair until one is left. ``parts``: tokens of each leaf in places of the whole text."""
    ends = [*starts[1:], len(text)]
    while len(parts) > 1:
        new, new_starts, new_ends = [], [], []
        for k in range(0, len(parts), 2):
            if k + 1 == len(parts):
                new.append(parts[k])
                new_starts.append(starts[k])
                new_ends.append(ends[k])
                continue
            s, cut, e = starts[k], starts[k + 1], ends[k + 1]
            move = lambda xs, by: [(i, a + by, b + by) for i, a, b in xs]
            joined = join(c, text[s:e], move(parts[k], -s), move(parts[k + 1], -s), cut - s)
            new.append(move(joined, s))
            new_starts.append(s)
            new_ends.append(e)
        parts, starts, ends = new, new_starts, new_ends
    return parts[0] if parts else []


def encode_tree(c: Coder, text: str, leaf: int = LEAF) -> list[int]:
    """The whole method on one text, in one process."""
    starts = cut_points(text, leaf)
    parts = [c.spans(text[a:b], a) for a, b in zip(starts, [*starts[1:], len(text)])]
    return [x[0] for x in tree(c, text, parts, starts)]


def _digest(ids: bytes, decoded: str) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encode(docs: DataFrame, file: str, text: str = "text", leaf: int = LEAF) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` for every whole text.

    Texts of one leaf are done where they are read. Of longer ones the leaves go
    to tasks of their own, each with its tokens' places; the joins of one text
    run in one task, which holds no more than that one row's text and tokens.
    A null text counts as empty: no tokens, digests of nothing. Further columns
    are passed on; clashing names get an underscore.
    """
    rest = [col(c) for c in docs.columns]
    body, row, starts, k, piece, tokens, out = fresh(docs, "body", "row", "starts", "k", "piece", "tokens", "out")
    names = fresh(docs, "n_tokens", "ids_sha256", "decoded_sha256")
    docs = docs.withColumn(body, F.coalesce(col(text), F.lit("")))

    @F.pandas_udf("struct<n:long,i:string,d:string>")
    def short(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = coder(file)
        for batch in texts:
            yield pd.DataFrame([_digest(*c.both(x)) for x in batch], columns=["n", "i", "d"])

    @F.pandas_udf("array<int>")
    def cuts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: cut_points(x, leaf))

    @F.pandas_udf("binary")
    def encode_leaf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = coder(file)
        for batch in texts:
            yield batch.map(lambda x: np.asarray(c.spans(x), "<i4").tobytes())

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        c = coder(file)
        group = group.sort_values(k)
        begins = np.concatenate([[0], group[piece].str.len().cumsum()[:-1]]).astype(int).tolist()
        parts = []
        for packed, a in zip(group[tokens], begins):
            parts.append(list(map(tuple, (np.frombuffer(packed, "<i4").reshape(-1, 3) + np.array([0, a, a], "<i4")).tolist())))
        ids = [x[0] for x in tree(c, "".join(group[piece]), parts, begins)]
        made = _digest(np.asarray(ids, "<u4").tobytes(), c.tok.decode(ids, skip_special_tokens=False))
        return pd.DataFrame([[group[row].iloc[0], *made]], columns=[row, "n", "i", "d"])

    one = docs.where(F.length(body) <= leaf).withColumn(out, short(col(body)))
    one = one.select(*rest, *[col(out)[f].alias(n) for f, n in zip("nid", names)])
    # Long texts: the leaves leave the task that read the text, so that one text keeps many cores busy.
    # They are stored with their numbers, which two reads must agree on.
    many = store(docs.where(F.length(body) > leaf).withColumn(row, F.monotonically_increasing_id()), workspace(docs.sparkSession, "long-texts"))
    leaves = many.select(row, body, cuts(col(body)).alias(starts)).select(
        row, F.posexplode(F.transform(col(starts), lambda s, i: F.substring(
            col(body), s + 1, F.coalesce(F.get(col(starts), i + 1), F.length(col(body))) - s))).alias(k, piece))
    leaves = leaves.repartition(col(row), col(k)).withColumn(tokens, encode_leaf(col(piece)))
    done = leaves.groupBy(row).applyInPandas(joined, f"`{row}` long, n long, i string, d string")
    many = many.drop(body).join(done, row).select(*rest, *[F.col(f).alias(n) for f, n in zip("nid", names)])
    return one.unionByName(many)


def encode_documents(docs: DataFrame, file: str) -> DataFrame:
    """Token counts and digests of ids and decoded text for every document."""
    return encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), file).drop("text")
