"""Repeated passages by collinear chaining of shared word seeds.

Winnowed k-mers of words are the seeds. A seed that occurs in several texts links each
occurrence to its first one, so a passage of n copies gives n links and
not n squared. The links of a text to one source are chained in order, with gap costs, through a
Fenwick tree; each chain is aligned word by word between its seeds and beyond both ends, which
also finds passages with words changed, lost or added. Stretches of a text that one source covers are joined, and those of at least
``least`` words are its repeated passages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.minhash import _lists, shingles
from tablesmith.llm.quality import let, words_of
from tablesmith.llm.shared import BATCH, col, erase, fresh, store, workspace

#: Words of a seed; one seed at least in every run of ``WINDOW`` neighbouring k-mers.
#: Twelve equal words in a row share a seed for certain, so passages with every tenth word changed hardly ever lack one.
SEED, WINDOW = 5, 8
#: Words of the shortest passage.
LEAST = 50
#: Worth of a seed in a chain, and the cost of each word of gap on either side.
WORTH, GAP = 8.0, 0.125
#: Words beyond a chain's ends that alignment may reach; the drop from the best score that ends it.
REACH, DROP = 64, 8
#: Share of equal words that an aligned stretch needs, and gaps between covered stretches that count as covered.
IDENTITY, BRIDGE = 0.8, 2
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def winnow(words: np.ndarray, seed: int = SEED, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the smallest k-mer of every window; none in texts of fewer than ``seed`` words."""
    if len(words) < seed:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = shingles(words, seed)
    if len(h) <= window:
        at = np.array([int(h.argmin())])
    else:
        views = np.lib.stride_tricks.sliding_window_view(h, window)
        at = np.unique(np.arange(len(views)) + views.argmin(axis=1))
    return at, h[at]


def coded(docs: DataFrame) -> DataFrame:
    """doc_id, tid (hash of the word sequence), n (words) and w (32-bit hashes of the words): the one time that a text is split."""
    made = let(words_of(F.col("text")), lambda ws: F.struct(
        F.xxhash64(F.unhex(F.md5(F.array_join(ws, " ")))).alias("tid"), F.size(ws).alias("n"), F.transform(ws, lambda x: F.hash(x)).alias("w")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), made.alias("m")).select("doc_id", "m.tid", "m.n", "m.w")


def seeds(texts: DataFrame) -> DataFrame:
    """h, tid and pos of every seed of coded texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = _lists(batch.column(1))
            for s in range(0, batch.num_rows, 512):
                t = min(s + 512, batch.num_rows)
                found = [winnow(values[offsets[i]: offsets[i + 1]]) for i in range(s, t)]
                take = pa.array(np.repeat(np.arange(s, t), [len(p) for p, _ in found]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([h for _, h in found]).astype(np.int64)), batch.column(0).take(take),
                    pa.array(np.concatenate([p for p, _ in found]).astype(np.int32))], names=["h", "tid", "pos"])

    return texts.select("tid", "w").mapInArrow(find, "h long, tid long, pos int")


def chain(anchors: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Collinear chains of (place, source place) matches, best first; each match is in one chain.

    A chain scores ``WORTH`` a match less ``GAP`` for each word between matches on either side. The best
    forerunner of a match is a prefix maximum over source places, kept in a Fenwick tree.
    """
    order = sorted(set(anchors))
    places = {s: i + 1 for i, s in enumerate(sorted({s for _, s in order}))}
    tree: list = [None] * (len(places) + 1)
    score, back = [0.0] * len(order), [-1] * len(order)
    waiting: list[int] = []

    def enter(i):
        k, value = places[order[i][1]], (score[i] + GAP * sum(order[i]), i)
        while k < len(tree):
            if tree[k] is None or value > tree[k]:
                tree[k] = value
            k += k & -k

    for i, (p, s) in enumerate(order):
        if waiting and order[waiting[0]][0] < p:  # matches at one place never follow each other
            for j in waiting:
                enter(j)
            waiting = []
        k, best = places[s] - 1, None
        while k > 0:
            if tree[k] is not None and (best is None or tree[k] > best):
                best = tree[k]
            k -= k & -k
        score[i] = WORTH
        if best is not None and best[0] - GAP * (p + s) > 0:
            score[i], back[i] = WORTH + best[0] - GAP * (p + s), best[1]
        waiting.append(i)
    out, used = [], [False] * len(order)
    for i in sorted(range(len(order)), key=lambda i: -score[i]):
        run = []
        while i >= 0 and not used[i]:
            used[i] = True
            run.append(order[i])
            i = back[i]
        if run:
            out.append(run[::-1])
    return out


def _extend(a: np.ndarray, at_a: np.ndarray, n_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, n_b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Words, and equal words among them, that many pairs of sequences go on together: the best score before it drops too far.

    ``at_a`` and ``at_b`` are the first places to compare in the flat arrays, ``n_a`` and ``n_b`` the words that are left there, ``step`` the way to go.
    """
    k = np.arange(REACH)
    valid = k < np.minimum(n_a, n_b)[:, None]
    spot = lambda x, at: x[np.where(valid, at[:, None] + step * k, 0)]
    equal = (spot(a, at_a) == spot(b, at_b)) & valid
    total = np.cumsum(np.where(equal, 1, -2), axis=1)
    best = np.maximum.accumulate(np.maximum(total, 0), axis=1)
    going = valid & (np.cumsum((best - total > DROP) & valid, axis=1) == 0)
    total = np.where(going, total, 0)
    n = np.where(total.max(axis=1, initial=0) > 0, total.argmax(axis=1) + 1, 0)
    same = np.cumsum(equal, axis=1)
    return n, np.where(n > 0, same[np.arange(len(n)), np.maximum(n - 1, 0)], 0)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words of the longest common subsequence, row by row."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return int(row[-1])


def stretches(run: list[tuple[int, int]], words: np.ndarray, source: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Stretches (start, end, source start, source end, equal words) between the seeds of a chain. Parted where too few words between seeds agree."""
    parts, (p0, s0) = [], run[0]
    p1, s1, same = p0 + SEED, s0 + SEED, SEED
    for p, s in run[1:]:
        if p - s == p1 - s1 and p <= p1:
            same, p1, s1 = same + p + SEED - p1, p + SEED, s + SEED
            continue
        gap_a, gap_b = words[p1: max(p, p1)], source[s1: max(s, s1)]
        equal = int((gap_a == gap_b).sum()) if len(gap_a) == len(gap_b) else _common(gap_a, gap_b)
        longest = max(len(gap_a), len(gap_b))
        if longest > 4 and equal < 0.5 * longest:
            parts.append((p0, p1, s0, s1, same))
            p0, s0, same = p, s, SEED
        else:
            same += equal + SEED - max(0, p1 - p)
        p1, s1 = p + SEED, s + SEED
    parts.append((p0, p1, s0, s1, same))
    return parts


def align(runs: list[list[tuple[int, int]]], words: tuple[np.ndarray, np.ndarray], source: tuple[np.ndarray, np.ndarray],
          slice_rows: int = 8192) -> np.ndarray:
    """Rows (run, start, end, source start, source end) that chains cover, each reaching on beyond its ends as far as words agree.

    ``words`` and ``source`` are offsets and values of the lists of all runs, so the reaching is done for many stretches at once.
    """
    (off_a, a), (off_b, b) = words, source
    parts = np.array([(i, *x) for i, run in enumerate(runs) for x in stretches(
        run, a[off_a[i]: off_a[i + 1]], b[off_b[i]: off_b[i + 1]])], np.int64).reshape(-1, 6)
    out = []
    for k in range(0, len(parts), slice_rows):
        i, p0, p1, s0, s1, same = parts[k: k + slice_rows].T
        n, m = _extend(a, off_a[i] + p1, off_a[i + 1] - off_a[i] - p1, b, off_b[i] + s1, off_b[i + 1] - off_b[i] - s1, 1)
        back, more = _extend(a, off_a[i] + p0 - 1, p0, b, off_b[i] + s0 - 1, s0, -1)
        found = np.stack([i, p0 - back, p1 + n, s0 - back, s1 + n], axis=1)
        out.append(found[same + m + more >= IDENTITY * (found[:, 2] - found[:, 1])])
    return np.concatenate(out) if out else np.zeros((0, 5), np.int64)


def cover(parts: list[tuple], least: int = LEAST, bridge: int = BRIDGE) -> list[tuple]:
    """(start, end, source) of what sources cover by at least ``least`` words each, joined where they meet.

    Stretches of one source are joined first, so short repeats of several texts side by side are no passage. A joined
    passage has the source of its longest part, ties to the smallest.
    """
    rank = lambda source: (source is None, source or 0)
    long: list = []
    for start, end, source in sorted(parts, key=lambda x: (rank(x[2]), x[0], x[1])):
        if long and long[-1][2] == source and start <= long[-1][1] + bridge:
            long[-1][1] = max(long[-1][1], end)
        else:
            long.append([start, end, source])
    out: list = []
    for start, end, source in sorted((x for x in long if x[1] - x[0] >= least), key=lambda x: (x[0], x[1], rank(x[2]))):
        if out and start <= out[-1][1] + bridge:
            if end - start > out[-1][3]:
                out[-1][2], out[-1][3] = source, end - start
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end, source, end - start])
    return [tuple(x[:3]) for x in out]


def passages(docs: DataFrame, least: int = LEAST, path: str | None = None) -> DataFrame:
    """One row per repeated passage: doc_id, tid, start and end (words, end exclusive) and source_id, where it stood earlier.

    A passage is repeated if it stands in another text with a smaller doc_id (nulls last,
    then by the text's hash). Rows alike in words are one text: only the one with the smallest doc_id counts, its copies are repeated
    whole. Passages shared by very many texts give one link each. Texts under ``least`` words, empty and null ones
    have none; rows alike in doc_id and words give their passages once. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    path = path or workspace(spark, "chains")
    texts = store(coded(docs), f"{path}/texts")
    lengths = store(texts.select("doc_id", "tid", "n"), f"{path}/lengths")
    firsts = texts.groupBy("tid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("f"))
    firsts = store(firsts.select("tid", F.col("f.id").alias("first_id")), f"{path}/firsts")
    found = store(seeds(texts), f"{path}/seeds", BATCH)
    shared = found.groupBy("h").agg(F.min("tid").alias("least"), F.max("tid").alias("most")).where("least != most").select("h")
    # Stored first: a join of two plain shuffles is one whose hot keys Spark can split.
    shared = store(shared, f"{path}/shared")
    # Copies of a text have the same seeds, which are one here.
    hits = store(found.join(shared, "h", "left_semi").distinct(), f"{path}/hits")
    erase(spark, f"{path}/seeds")
    first_hits = store(hits.join(firsts, "tid"), f"{path}/first-hits")
    erase(spark, f"{path}/hits")
    order = F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), F.col("tid").alias("tid"))
    start = first_hits.groupBy("h").agg(F.min(F.struct(order.alias("o"), F.col("pos").alias("pos"))).alias("f"))
    start = start.select("h", F.col("f.o.id").alias("src_id"), F.col("f.o.tid").alias("src"), F.col("f.pos").alias("src_pos"))
    start = store(start, f"{path}/start")
    links = first_hits.join(start, "h").where("tid != src")
    per_text = links.groupBy("tid").agg(F.collect_list(F.struct("src", "src_id", "pos", "src_pos")).alias("links"))

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for tid, found in zip(batch["tid"], batch["links"]):
                by_source: dict = {}
                for x in found:
                    by_source.setdefault((x["src"], x["src_id"]), []).append((x["pos"], x["src_pos"]))
                for (src, src_id), anchors in by_source.items():
                    for run in chain(anchors):
                        rows.append((tid, src, src_id, [p for p, _ in run], [s for _, s in run]))
            yield pd.DataFrame(rows, columns=["tid", "src", "src_id", "p", "s"]).astype({"src_id": "Int64"})

    runs = store(per_text.mapInPandas(chained, "tid long, src long, src_id long, p array<int>, s array<int>"), f"{path}/runs")
    # Words of the texts that take part, once each; a run then carries only the slices around it.
    need = runs.select("tid").union(runs.select(F.col("src").alias("tid"))).distinct().join(firsts, "tid")
    words = texts.join(need.withColumnRenamed("tid", "of"), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tid") == F.col("of"))).groupBy(
        "tid").agg(F.first("w").alias("w"))
    words = store(words, f"{path}/words")
    for done in ("texts", "first-hits", "start", "shared"):  # nothing after this reads them
        erase(spark, f"{path}/{done}")

    def sliced(array: str, places: str, name: str):
        lo = F.greatest(F.get(places, F.lit(0)) - REACH, F.lit(0))
        n = F.get(places, F.size(places) - 1) + SEED + REACH - lo
        return F.slice(array, lo + 1, n).alias(name), lo.alias(f"{name}_at")

    near = runs.join(words, "tid").select("tid", "src", "src_id", "p", "s", *sliced("w", "p", "a"))
    near = near.join(words.select(F.col("tid").alias("src"), F.col("w").alias("w")), "src").select(
        "tid", "src_id", "p", "s", "a", "a_at", *sliced("w", "s", "b"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            lists = {n: _lists(c[n]) for n in ("p", "s", "a", "b")}
            at_a, at_b = c["a_at"].to_numpy().astype(np.int64), c["b_at"].to_numpy().astype(np.int64)
            shift = lambda n, at: (lists[n][1] - np.repeat(at, np.diff(lists[n][0]))).tolist()
            anchors, cuts = list(zip(shift("p", at_a), shift("s", at_b))), lists["p"][0].tolist()
            got = align([anchors[x:y] for x, y in zip(cuts, cuts[1:])], lists["a"], lists["b"])
            take = pa.array(got[:, 0])
            yield pa.RecordBatch.from_arrays([
                c["tid"].take(take), c["src_id"].take(take), pa.array((got[:, 1] + at_a[got[:, 0]]).astype(np.int32)),
                pa.array((got[:, 2] + at_a[got[:, 0]]).astype(np.int32))], names=["tid", "src_id", "start", "end"])

    parts = near.mapInArrow(aligned, "tid long, src_id long, start int, end int")
    gathered = parts.groupBy("tid").agg(F.collect_list(F.struct("start", "end", "src_id")).alias("parts"))

    @F.pandas_udf("array<struct<start:int,end:int,source_id:long>>")
    def covered(parts: pd.Series) -> pd.Series:
        return parts.map(lambda xs: [
            {"start": a, "end": b, "source_id": s} for a, b, s in cover([(x["start"], x["end"], x["src_id"]) for x in xs], least)])

    own = gathered.join(firsts, "tid").select(F.col("first_id").alias("doc_id"), "tid", F.explode(covered("parts")).alias("x")).select(
        "doc_id", "tid", "x.start", "x.end", "x.source_id")
    copies = lengths.distinct().join(firsts, "tid").where((F.col("n") >= least) & ~F.col("doc_id").eqNullSafe(F.col("first_id"))).select(
        "doc_id", "tid", F.lit(0).alias("start"), F.col("n").alias("end"), F.col("first_id").alias("source_id"))
    return own.unionByName(copies)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of some spans, and without the white space after each."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at: starts[a]])
        at = starts[min(b, len(starts) - 1)]
    return "".join(out) + text[at:]


def remove_passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents with every passage that stands in an earlier text taken out; all rows stay, n_chars follows the text."""
    path = workspace(docs.sparkSession, "passages")
    found = store(passages(docs, least, path), f"{path}/passages")
    for done in ("words", "runs", "firsts", "lengths"):  # before the texts are moved
        erase(docs.sparkSession, f"{path}/{done}")
    found = found.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    tid, spans, left = fresh(docs, "tid", "spans", "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else without(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(text, spans)])

    keyed = docs.withColumn(tid, F.xxhash64(F.unhex(F.md5(F.array_join(words_of(F.col("text")), " ")))))
    cuts = found.select(F.col("doc_id").alias("cut_id"), F.col("tid").alias("cut_tid"), F.col("spans").alias("cut_spans"))
    joined = keyed.join(cuts, keyed["doc_id"].eqNullSafe(cuts["cut_id"]) & (keyed[tid] == cuts["cut_tid"]), "left").withColumn(
        left, F.when(F.col("cut_spans").isNull(), F.col("text")).otherwise(cut(F.coalesce("text", F.lit("")), "cut_spans")))
    made = {"text": col(left), "n_chars": F.when(F.col("cut_spans").isNull(), col("n_chars") if "n_chars" in docs.columns else F.lit(None)).otherwise(
        F.char_length(col(left)))}
    return joined.select(*[(made[c].cast(docs.schema[c].dataType).alias(c) if c in made else col(c)) for c in docs.columns])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (words) and source_id of every passage that repeats across documents."""
    return passages(docs).drop("tid")
