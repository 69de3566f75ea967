"""Alignment of two tokenizers' tokens with corpus-wide counts of id pairs, held under minimal perfect hashes.

Both tokenizers encode the same bytes; places where tokens of both end cut a text into groups, and tokens whose byte
ranges overlap are linked. A first pass gathers, task by task, in how many documents each pair of ids is linked. The
distinct pairs get a minimal perfect hash: dealt to buckets by a hash, and in each bucket every small cell of keys is displaced
by the first seed that puts its keys on free places. The tasks' counts become dense vectors indexed by the hash, and the vectors are
added up along a tree. Keys are kept beside the counts, so a pair that was never counted is found out. A second pass
aligns the documents again and looks its pairs up.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.packing import ByteCoder
from tablesmith.llm.shared import store, worker_cache, workspace

#: Distinct pairs of a bucket and of a cell, on average.
BUCKET, CELL = 2048, 4
#: Vectors that are added in one step of the tree.
FAN = 16
#: A table of counts up to this size is broadcast; beyond it documents ask for their counts by bucket.
TABLE_BYTES = 64 * 1024 * 1024
#: Bytes of the table for each pair: key, count, and a seed for every ``CELL`` pairs.
PAIR_BYTES = 17
#: Distinct pairs that a task counts before it hands them on.
HELD = 500_000
#: Chunks and their characters that a worker keeps aligned, and characters of text that are aligned at a time.
KEEP, KEEP_CHARS, PART = 500_000, 32_000_000, 6_000_000
#: Chunks that B encodes in one call.
TOGETHER = 50
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: White space that may make a blank not stand alone; in texts beyond Latin-1 the slow way looks.
_RUNS = ("  ", "\n ", " \n", *"\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0")
_SINGLE = re.compile(r"(?<=[^\s᠎])(?= [^\s᠎])")
#: Chunks in Latin-1 whose white space both ways of encoding A see alike.
_LATIN = re.compile("[\n -~\xa1-\xff]*\\Z")


# Alignment

def _byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in shown]
    return {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(rest)}


class Aligner:
    """Tokenizers A (byte-level, of a blank and the text) and B (pieces, of the text; it adds the blank).

    A single blank between two words begins a token of A, and of B if none of its pieces holds a blank after
    another character. Both sides then cut there, so texts are aligned chunk by chunk between such blanks, and many chunks
    at once. ``ranks``: A's vocabulary as ranks, a faster way for chunks in Latin-1.
    """

    def __init__(self, file_a: str, file_b: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=file_b)
        self.fast = ByteCoder(file_a, ranks).chunks.encode if ranks else None
        alphabet = _byte_alphabet()
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        plain = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [special.get(i) or bytes(alphabet[c] for c in plain.get(i, "")) for i in range(max(plain) + 1)]
        piece, n = self.b.id_to_piece, self.b.vocab_size()
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(n)]
        self.split = not any(re.search("[^▁]▁", piece(i)) for i in range(n))
        self.len_a, self.len_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        # Ids as text with what may follow: within a group, after its A side, after a group, after a chunk.
        ids_a, ids_b = [str(i) for i in range(len(self.bytes_a))], [str(i) for i in range(n)]
        self.shown = np.array([x + end for ids, ends in ((ids_a, ",|"), (ids_b, ",;\n")) for end in ends for x in ids], object)

    def plain(self, text: str) -> bool:
        """Whether all blanks of a text stand alone between two words."""
        if not self.split or any(x in text for x in _RUNS) or text[0].isspace() or text[-1].isspace():
            return False
        try:
            return text.isascii() or bool(text.encode("latin-1"))
        except UnicodeEncodeError:
            return False

    def cut(self, text: str) -> list[str]:
        """The chunks of any text, each without the blank before it."""
        return [x[1:] for x in _SINGLE.split(" " + text)] if self.split else [text]

    def pieces(self, text: str, size: int = PART) -> Iterator[str]:
        """A text cut at single blanks, about ``size`` characters at a time; the blanks between are left out."""
        at = 0
        while self.split and len(text) - at > size:
            end = at + size
            while (end := text.find(" ", end)) > 0 and not _SINGLE.match(text, end):
                end += 1
            if end < 0:
                break
            yield text[at:end]
            at = end + 1
        yield text[at:] if at else text

    def ids(self, chunks: list[str], latin: bool) -> tuple[np.ndarray, np.ndarray]:
        body = " " + " ".join(chunks)
        a = self.fast(body) if latin and self.fast else self.a.encode(body, add_special_tokens=False).ids
        b = self.b.encode([" ".join(chunks[k: k + TOGETHER]) for k in range(0, len(chunks), TOGETHER)], num_threads=1)
        return np.asarray(a, np.int64), np.fromiter(chain.from_iterable(b), np.int64)


class Batch(NamedTuple):
    """Aligned chunks: tokens, groups and links of each, all links in chunk order, and the groups as text."""
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    keys: np.ndarray  # id of A << 32 | id of B
    groups: list[str]


def align(tool: Aligner, chunks: list[str], latin: bool = False, shown: bool = True) -> Batch | None:
    """All chunks at once; none if one side's bytes are not those of the chunks, or the sides do not cut between them."""
    a, b = tool.ids(chunks, latin)
    whole = (" " + " ".join(chunks)).encode()
    end_a, end_b = np.cumsum(tool.len_a[a]), np.cumsum(tool.len_b[b])
    # Byte-level tokens give back any bytes, so their number says it; pieces are held against the text itself.
    if end_a[-1] != len(whole) or end_b[-1] != len(whole) or b"".join(map(tool.bytes_b.__getitem__, b.tolist())) != whole:
        return None
    n = len(chunks)
    ends = np.cumsum(pc.binary_length(pa.array(chunks, pa.large_string())).to_numpy() + 1)
    begin_a, begin_b = end_a - tool.len_a[a], end_b - tool.len_b[b]
    at = np.minimum(np.searchsorted(end_b, end_a), len(b) - 1)
    both = end_a[end_b[at] == end_a]
    last_groups = np.searchsorted(both, ends)
    if (both[np.minimum(last_groups, len(both) - 1)] != ends).any():
        return None
    chunk_a, chunk_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
    first = np.searchsorted(end_b, begin_a, "right")
    held = np.searchsorted(begin_b, end_a) - first
    side_a = np.repeat(np.arange(len(a)), held)
    side_b = np.arange(len(side_a)) - np.repeat(np.cumsum(held) - held, held) + np.repeat(first, held)
    texts = []
    if shown:
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        closes_a, closes_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        closes_chunk = np.zeros(len(both), bool)
        closes_chunk[last_groups] = True
        row_a = a + len(tool.bytes_a) * closes_a
        row_b = b + 2 * len(tool.bytes_a) + len(tool.bytes_b) * np.where(closes_b, 1 + closes_chunk[group_b], 0)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        texts = "".join(tool.shown[np.concatenate([row_a, row_b])[order]].tolist()).split("\n")[:-1]
    n_links = np.add.reduceat(held, np.searchsorted(chunk_a, np.arange(n)))
    return Batch(np.bincount(chunk_a, minlength=n), np.bincount(chunk_b, minlength=n), np.diff(last_groups, prepend=-1), n_links,
                 a[side_a] << 32 | b[side_b], texts)


class Lexicon:
    """Chunks that were met, aligned once. Kept up to a number of chunks and characters, then begun anew."""

    NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def __init__(self, tool: Aligner, rate=None, shown: bool = True):
        """``rate``: from keys of links their counts and whether they are best; without it the pairs themselves are kept."""
        self.tool, self.rate, self.shown, self.pairs = tool, rate, shown, {}
        self.clear()

    def clear(self, pairs: bool = False) -> None:
        if pairs:
            self.pairs = {}
        self.index, self.groups, self.chars = {}, [], 0
        self.rows = np.zeros((1024, len(self.NAMES)), np.int64)
        self.good, self.begin = np.zeros(1024, bool), np.zeros(1024, np.int64)
        self.links, self.n_kept = np.zeros(1024, np.int32), 0

    def _room(self, chunks: int, links: int) -> None:
        def grown(x, n):
            return x if len(x) >= n else np.concatenate([x, np.zeros((max(n, 2 * len(x)) - len(x), *x.shape[1:]), x.dtype)])

        n = len(self.index) + chunks
        self.rows, self.good, self.begin = grown(self.rows, n), grown(self.good, n), grown(self.begin, n)
        self.links = grown(self.links, self.n_kept + links)

    def _add(self, chunks: list[str], latin: bool) -> None:
        made = align(self.tool, chunks, latin, self.shown) if self.tool.split or len(chunks) == 1 else None
        if made is None and len(chunks) > 1:
            half = len(chunks) // 2
            self._add(chunks[:half], latin)
            self._add(chunks[half:], latin)
            return
        at, n = len(self.index), len(chunks)
        if made is None:
            self._room(1, 0)
            self.groups.append("")
        else:
            self._room(n, 0 if self.rate else len(made.keys))
            begin = np.cumsum(made.n_links) - made.n_links
            for k, x in enumerate(made[:4]):
                self.rows[at: at + n, k] = x
            if self.rate:
                counts, best = self.rate(made.keys)
                self.rows[at: at + n, 4] = np.add.reduceat(best.astype(np.int64), begin)
                self.rows[at: at + n, 5] = np.add.reduceat(counts, begin)
            else:
                keys, where = np.unique(made.keys, return_inverse=True)
                numbers = np.array([self.pairs.setdefault(x, len(self.pairs)) for x in keys.tolist()], np.int32)
                self.begin[at: at + n] = self.n_kept + begin
                self.links[self.n_kept: self.n_kept + len(where)] = numbers[where]
                self.n_kept += len(where)
            self.good[at: at + n] = True
            self.groups += made.groups
        self.index.update(zip(chunks, range(at, at + n)))
        self.chars += sum(map(len, chunks))

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """Rows of distinct chunks here."""
        out = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        at = np.flatnonzero(out < 0).tolist()
        new = [chunks[k] for k in at]
        latin = new if _LATIN.match(" ".join(new)) else [x for x in new if _LATIN.match(x)]
        for some, flag in ((latin, True), ([] if latin is new else [x for x in new if not _LATIN.match(x)], False)):
            for k in range(0, len(some), 20_000):
                self._add(some[k: k + 20_000], flag)
        out[at] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        return out

    def pairs_of(self, docs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (document, pair number) of chunks in documents, and the links of each."""
        chunk, times = np.unique(docs << 32 | rows, return_counts=True)
        doc, row = chunk >> 32, chunk & 0xFFFFFFFF
        held = self.rows[row, 3]
        of = np.repeat(np.arange(len(row)), held)
        at = np.arange(len(of)) - np.repeat(np.cumsum(held) - held, held) + np.repeat(self.begin[row], held)
        return summed(doc[of] << 32 | self.links[at], times[of])


def summed(keys: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (document << 32 | pair) taken apart, with the sums of their links."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    total = np.add.reduceat(links[order], first) if len(first) else links[:0]
    return keys[first] >> 32, keys[first] & 0xFFFFFFFF, total


def read_texts(lexicon: Lexicon, texts: list, part: int = PART) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, bool]]:
    """Texts in steps of about ``part`` characters: (documents of the step, first chunk of each, rows of all chunks, whether a text goes on).

    A text longer than that comes in several steps of its own. Null and empty texts do not come.
    """
    tool = lexicon.tool

    def step(docs: list[int], some: list[str], more: bool):
        if len(lexicon.index) > KEEP or lexicon.chars > KEEP_CHARS:
            lexicon.clear()
        plain = [k for k, x in enumerate(some) if tool.plain(x)]
        rest = sorted(set(range(len(some))).difference(plain))
        lists = [pc.split_pattern(pa.array([some[k] for k in plain], pa.string()), " "),
                 pa.array([tool.cut(some[k]) for k in rest], pa.list_(pa.string()))]
        coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        rows = lexicon.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sizes = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
        return [docs[k] for k in plain + rest], np.cumsum(sizes) - sizes, rows, more

    docs, some, size = [], [], 0
    for d, text in enumerate(texts):
        if not text:
            continue
        if docs and size + len(text) > part:
            yield step(docs, some, False)
            docs, some, size = [], [], 0
        if len(text) > part:
            held = None
            for x in tool.pieces(text, part):
                if held is not None:
                    yield step([d], [held], True)
                held = x
            yield step([d], [held], False)
            continue
        docs.append(d)
        some.append(text)
        size += len(text)
    if docs:
        yield step(docs, some, False)


def measured(lexicon: Lexicon, texts: list, pairs: bool = False, part: int = PART) -> tuple[np.ndarray, list[str], list]:
    """Sums of each text, the digests, and with ``pairs`` the (pair numbers, links) of each; zeros and empty where a text has no tokens."""
    sums, good = np.zeros((len(texts), len(Lexicon.NAMES)), np.int64), np.zeros(len(texts), bool)
    digests, found, going = [""] * len(texts), [None] * len(texts), None
    for docs, begins, rows, more in read_texts(lexicon, texts, part):
        sums[docs] += np.add.reduceat(lexicon.rows[rows], begins, axis=0)
        fine = np.logical_and.reduceat(lexicon.good[rows], begins)
        ends = [*begins[1:].tolist(), len(rows)]
        parts = list(map(lexicon.groups.__getitem__, rows.tolist())) if lexicon.shown else []
        of, number, links = lexicon.pairs_of(np.repeat(np.arange(len(docs)), np.diff([*begins, len(rows)])), rows) if pairs else (None,) * 3
        for k, (d, lo, hi) in enumerate(zip(docs, begins.tolist(), ends)):
            sha, before, own = going or (hashlib.sha256(), True, None)
            if lexicon.shown:
                sha.update((";" if going else "").encode() + ";".join(parts[lo:hi]).encode())
            if pairs:
                mine = slice(*np.searchsorted(of, [k, k + 1]))
                new = number[mine], links[mine]
                own = new if own is None else summed(np.concatenate([own[0], new[0]]), np.concatenate([own[1], new[1]]))[1:]
            going = (sha, before and bool(fine[k]), own) if more else None
            if not more:
                good[d] = before and fine[k]
                digests[d], found[d] = sha.hexdigest() if good[d] else "", own if good[d] else None
    sums[~good] = 0
    return sums, digests, found


def lexicon(file_a: str, file_b: str, ranks: str | None, kind: str, rate=None, shown: bool = True) -> Lexicon:
    """The worker's lexicon; one of another kind gives way to it."""
    cache = worker_cache()
    if ("aligner", file_a, file_b) not in cache:
        cache["aligner", file_a, file_b] = Aligner(file_a, file_b, ranks)
    if cache.get("lexicon", (None,))[0] != kind:
        cache["lexicon"] = kind, Lexicon(cache["aligner", file_a, file_b], rate, shown)
    return cache["lexicon"][1]


# Minimal perfect hashes

def mix(keys: np.ndarray, salt) -> np.ndarray:
    """A 64-bit hash of each key under a salt."""
    x = keys.astype(np.uint64) ^ (np.atleast_1d(salt).astype(np.uint64) + np.uint64(1)) * _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys, 1 << 40) % np.uint64(buckets)).astype(np.int64)


def cells(n):
    """Cells of a bucket of ``n`` keys."""
    return np.maximum(1, -(-np.asarray(n) // CELL))


def build(keys: np.ndarray, tries: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of the cells and the keys in the order of their places: place = hash under the cell's seed, modulo the number of keys."""
    n, r = len(keys), int(cells(len(keys)))
    cell = (mix(keys, 1 << 41) % np.uint64(r)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    sizes = np.bincount(cell, minlength=r)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    seeds, taken, out = np.zeros(r, np.uint32), np.zeros(n, bool), np.zeros(n, np.uint64)
    for c in np.argsort(-sizes, kind="stable"):
        own = keys[order[begins[c]: begins[c + 1]]]
        first = 0
        while len(own):
            at = (mix(own[None, :], np.arange(first, first + tries)[:, None]) % np.uint64(n)).astype(np.int64)
            spread = np.sort(at, axis=1)
            good = np.flatnonzero(~taken[at].any(axis=1) & (spread[:, 1:] != spread[:, :-1]).all(axis=1))
            if len(good):
                seeds[c] = first + good[0]
                taken[at[good[0]]] = True
                out[at[good[0]]] = own
                break
            first += tries
    return seeds, out


class Table:
    """Functions of some buckets, with the keys and counts at their places."""

    def __init__(self, buckets: int, rows: list[tuple[int, bytes, bytes, bytes]]):
        """``rows``: bucket, seeds, keys and counts; buckets that are not given hold no keys."""
        rows = sorted(rows, key=lambda x: x[0])
        size, r = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b, seeds, keys, _ in rows:
            size[b], r[b] = len(keys) // 8, len(seeds) // 4
        self.buckets, self.size, self.r = buckets, size, r
        self.begin, self.seed_begin = np.cumsum(size) - size, np.cumsum(r) - r
        self.seeds = np.frombuffer(b"".join(x[1] for x in rows), "<u4")
        self.keys = np.frombuffer(b"".join(x[2] for x in rows), "<u8")
        self.counts = np.frombuffer(b"".join(x[3] for x in rows), "<i8")

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; raises if one was never hashed."""
        keys = keys.astype(np.uint64)
        b = bucket_of(keys, self.buckets)
        if len(keys) and not self.size[b].all():
            raise KeyError("a pair that the first pass did not meet")
        cell = self.seed_begin[b] + (mix(keys, 1 << 41) % np.maximum(self.r[b], 1).astype(np.uint64)).astype(np.int64)
        at = self.begin[b] + (mix(keys, self.seeds[cell]) % np.maximum(self.size[b], 1).astype(np.uint64)).astype(np.int64)
        if (self.keys[at] != keys).any():
            raise KeyError("a pair that the first pass did not meet")
        return at

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        return self.counts[self.places(keys)]


# The passes

def count_pairs(docs: DataFrame, file_a: str, file_b: str, ranks: str | None = None, held: int = HELD) -> DataFrame:
    """First pass: (task, key, docs), how many documents of a task's input link a pair. A key may come more than once for a task."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = lexicon(file_a, file_b, ranks, "pairs", shown=False), TaskContext.get().partitionId()
        seen = np.zeros(0, np.int64)

        def handed() -> pa.RecordBatch:
            keys, counts = np.fromiter(words.pairs, np.int64, len(words.pairs)), np.resize(seen, len(words.pairs))
            counts[len(seen):] = 0
            keys, counts = keys[counts > 0], counts[counts > 0]
            return pa.RecordBatch.from_arrays([pa.array([task] * len(keys), pa.int32()), pa.array(keys), pa.array(counts)], names=["task", "key", "docs"])

        for batch in batches:
            _, _, found = measured(words, batch.column(0).to_pylist(), pairs=True)
            every = [x[0] for x in found if x is not None]
            if every:
                new = np.bincount(np.concatenate(every), minlength=len(words.pairs))
                new[: len(seen)] += seen
                seen = new
            if len(words.pairs) >= held:
                yield handed()
                seen = np.zeros(0, np.int64)
                words.clear(pairs=True)
        yield handed()

    return docs.select("text").mapInArrow(gather, "task int, key long, docs long")


def _buckets(rows: DataFrame, buckets: int) -> DataFrame:
    @F.pandas_udf("long")
    def dealt(keys: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(keys.to_numpy(), buckets))

    return rows.withColumn("bucket", dealt("key"))


def hash_pairs(partial: DataFrame, buckets: int) -> DataFrame:
    """A function for each bucket of distinct keys: (bucket, seeds, keys)."""

    def place(group: pd.DataFrame) -> pd.DataFrame:
        seeds, keys = build(group["key"].to_numpy().astype(np.uint64))
        return pd.DataFrame([[group["bucket"].iloc[0], seeds.astype("<u4").tobytes(), keys.astype("<u8").tobytes()]], columns=["bucket", "seeds", "keys"])

    return _buckets(partial.select("key").distinct(), buckets).groupBy("bucket").applyInPandas(place, "bucket long, seeds binary, keys binary")


def sum_vectors(partial: DataFrame, functions: DataFrame, buckets: int, folder: str, fan: int = FAN) -> DataFrame:
    """Counts of each bucket as one dense vector in the order of its places, (bucket, counts), added along a tree of ``fan`` children a node."""
    tasks = (partial.agg(F.max("task")).first()[0] or 0) + 1
    leaves = -(-tasks // fan)

    def leaf(group: pd.DataFrame, function: pd.DataFrame) -> pd.DataFrame:
        if group.empty:
            return pd.DataFrame({"bucket": [], "leaf": [], "counts": []})
        b = int(group["bucket"].iloc[0])
        keys = function["keys"].iloc[0]
        table = Table(buckets, [(b, function["seeds"].iloc[0], keys, b"")])
        counts = np.zeros(len(keys) // 8, np.int64)
        np.add.at(counts, table.places(group["key"].to_numpy()), group["docs"].to_numpy())
        return pd.DataFrame([[b, int(group["leaf"].iloc[0]), counts.astype("<i8").tobytes()]], columns=["bucket", "leaf", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8") for x in group["counts"])
        return pd.DataFrame([[group["bucket"].iloc[0], int(group["leaf"].iloc[0]) // fan, total.astype("<i8").tobytes()]], columns=["bucket", "leaf", "counts"])

    schema = "bucket long, leaf long, counts binary"
    # A node of the lowest level adds the rows of ``fan`` tasks, so the same function is sent to each of them.
    sent = functions.select("*", F.expr(f"explode(sequence(0L, {leaves - 1}L))").alias("leaf"))
    rows = _buckets(partial, buckets).withColumn("leaf", F.expr(f"task div {fan}"))
    vectors = rows.groupBy("bucket", "leaf").cogroup(sent.groupBy("bucket", "leaf")).applyInPandas(leaf, schema)
    while leaves > 1:
        leaves = -(-leaves // fan)
        at = vectors.withColumn("node", F.expr(f"leaf div {fan}"))
        vectors = at.groupBy("bucket", "node").applyInPandas(add, schema)
    return store(vectors.select("bucket", "counts"), f"{folder}/counts")


def highest(table: DataFrame) -> DataFrame:
    """The highest count of each id of A, (a, high); no more rows than A has ids."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, counts in zip(batch["keys"], batch["counts"]):
                pairs = pd.DataFrame({"a": (np.frombuffer(keys, "<u8") >> np.uint64(32)).astype(np.int64), "high": np.frombuffer(counts, "<i8")})
                yield pairs.groupby("a", as_index=False)["high"].max()

    return table.select("keys", "counts").mapInPandas(best, "a long, high long").groupBy("a").agg(F.max("high").alias("high"))


NAMES = [*Lexicon.NAMES, "groups_sha256"]
RESULT = ", ".join(f"{x} long" for x in Lexicon.NAMES) + ", groups_sha256 string"


def best_of(keys: np.ndarray, counts: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its A id."""
    return counts == high[keys >> 32]


def align_documents(docs: DataFrame, file_a: str, file_b: str, ranks: str | None = None, key: str = "doc_id", table_bytes: int = TABLE_BYTES,
                    bucket: int = BUCKET) -> DataFrame:
    """One row a document: counts of tokens, groups and links, how many links are the best of their A id, the sum of their counts, a digest.

    A text that is null or empty, or that one side's tokens do not give back byte for byte, has no tokens: zeros and an empty digest. Repeated
    rows each count as a document. Columns besides ``key`` and ``text`` are not read; an empty table gives no rows.
    Up to ``table_bytes`` the table of counts is sent to every worker; a larger one stays in its buckets and each batch of documents asks
    the buckets once for every pair it holds.
    """
    spark, folder = docs.sparkSession, workspace(docs.sparkSession, "pairs")
    docs = docs.select(F.col(key), "text")
    partial = store(count_pairs(docs, file_a, file_b, ranks), f"{folder}/partial")
    distinct = partial.select("key").distinct().count()
    buckets = max(1, distinct // bucket)
    functions = store(hash_pairs(partial, buckets), f"{folder}/functions")
    table = functions.join(sum_vectors(partial, functions, buckets, folder), "bucket")
    table = store(table, f"{folder}/table")
    high = np.zeros(1, np.int64)
    for r in highest(table).collect():  # one number for each id of A at most
        if r["a"] >= len(high):
            high = np.concatenate([high, np.zeros(2 * r["a"] + 1 - len(high), np.int64)])
        high[r["a"]] = r["high"]
    shared_high = spark.sparkContext.broadcast(high)
    if distinct * PAIR_BYTES <= table_bytes:
        rows = [(r["bucket"], bytes(r["seeds"]), bytes(r["keys"]), bytes(r["counts"])) for r in table.collect()]
        return _near(docs, key, (file_a, file_b, ranks), folder, spark.sparkContext.broadcast((buckets, rows)), shared_high)
    return _far(docs, key, (file_a, file_b, ranks), table, buckets, shared_high, folder)


def _near(docs: DataFrame, key: str, files: tuple, run: str, shared, shared_high) -> DataFrame:
    """Second pass with the whole table in every worker."""
    kind = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, high = Table(*shared.value), shared_high.value

        def rate(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            counts = table.lookup(keys)
            return counts, best_of(keys, counts, high)

        words = lexicon(*files, run, rate)
        for batch in batches:
            sums, digests, _ = measured(words, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums.T), pa.array(digests, pa.string())], names=[key, *NAMES])

    return docs.mapInArrow(score, f"`{key}` {kind}, {RESULT}")


def _far(docs: DataFrame, key: str, files: tuple, table: DataFrame, buckets: int, shared_high, folder: str) -> DataFrame:
    """Second pass with the table in its buckets: batches of documents ask for the counts of their distinct pairs."""
    kind = docs.schema[key].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = lexicon(*files, folder), TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            sums, digests, found = measured(words, batch.column(1).to_pylist(), pairs=True)
            numbers = np.fromiter(words.pairs, np.int64, len(words.pairs))
            found = [(numbers[x[0]], x[1]) if x else (numbers[:0], numbers[:0]) for x in found]
            wanted = np.unique(np.concatenate([x for x, _ in found]))
            at = bucket_of(wanted, buckets)
            order = np.argsort(at, kind="stable")
            asked = np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(wanted) else []
            n, m, lists = batch.num_rows, len(asked), pa.list_(pa.int64())
            none = [None] * m
            yield pa.RecordBatch.from_arrays([
                pa.array([task << 32 | k] * (n + m), pa.int64()), pa.array([None] * n + [int(at[x[0]]) for x in asked], pa.int64()),
                pa.concat_arrays([batch.column(0), pa.nulls(m, batch.schema.field(0).type)]),
                *[pa.array(c.tolist() + none, pa.int64()) for c in sums.T[:4]], pa.array(digests + none, pa.string()),
                pa.array([x for x, _ in found] + [wanted[x] for x in asked], lists), pa.array([x for _, x in found] + none, lists)],
                names=["unit", "bucket", key, *NAMES[:4], "groups_sha256", "pairs", "links"])
            if len(words.pairs) >= HELD:
                words.clear(pairs=True)

    counted = ", ".join(f"{x} long" for x in NAMES[:4])
    asked = store(docs.mapInArrow(
        ask, f"unit long, bucket long, `{key}` {kind}, {counted}, groups_sha256 string, pairs array<long>, links array<long>"), f"{folder}/asked")

    def answer(wanted: pd.DataFrame, function: pd.DataFrame) -> pd.DataFrame:
        if wanted.empty:
            return pd.DataFrame({"unit": [], "pairs": [], "counts": []})
        t = Table(buckets, [tuple(function[c].iloc[0] for c in ("bucket", "seeds", "keys", "counts"))])
        return pd.DataFrame({"unit": wanted["unit"], "pairs": wanted["pairs"], "counts": [t.lookup(np.asarray(x)) for x in wanted["pairs"]]})

    given = asked.where("bucket IS NOT NULL").select("unit", "bucket", "pairs").groupBy("bucket").cogroup(
        table.groupBy("bucket")).applyInPandas(answer, "unit long, pairs array<long>, counts array<long>")

    def finish(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        keys, known = (np.concatenate([np.zeros(0, np.int64), *counts[c]]) for c in ("pairs", "counts"))
        order = np.argsort(keys)
        keys, known, made = keys[order], known[order], []
        for pairs, links in zip(rows["pairs"], rows["links"]):
            own = known[np.searchsorted(keys, pairs)] if len(pairs) else known[:0]
            made.append((int(links[best_of(pairs, own, shared_high.value)].sum()), int((links * own).sum())) if len(pairs) else (0, 0))
        return rows.assign(n_best=[x for x, _ in made], count_sum=[x for _, x in made])[[key, *NAMES]].astype({key: "object"})

    rows = asked.where("bucket IS NULL").drop("bucket")
    return rows.groupBy("unit").cogroup(given.groupBy("unit")).applyInPandas(finish, f"`{key}` {kind}, {RESULT}")
