"""Near-duplicate classes by DartMinHash signatures.

A document is a weighted set of word shingles. Hashed darts fall on each element's
region of weight and rank: for each power-of-two cell of weight and rank their number is
Poisson with the cell's area, so an element costs what its weight is worth in darts
and not a pass over all coordinates. A dart hits one of ``k``
coordinates; the earliest dart of each coordinate is the signature. Two documents agree in a coordinate with
the probability of their weighted Jaccard similarity. Bands of coordinates
propose candidates and shingle sets verify them exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.quality import let, words_of
from tablesmith.llm.shared import BATCH, col, erase, fresh, store, workspace

SHINGLE = 5
SIMILARITY = 0.8
#: 32 bands of 4 coordinates miss a pair of similarity 0.8 with a probability of 5e-8.
BANDS, ROWS = 32, 4
#: Bits of the filter that keeps texts without a shared bucket out of a shuffle: fixed, so it can go to every task.
FILTER_BITS = 1 << 23
#: Members of one bucket that one task compares; larger buckets are compared chunk by chunk.
CHUNK = 2048
#: Rank side of the smallest cell; elements and texts handled at once. A text throws some ``k ln k + 2 k`` darts however short it is.
UNIT, ELEMENTS, TEXTS = 1 / 16, 200_000, 512
FULL = np.uint64(2**64 - 1)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson_table(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts."""
    top = int(mean + 12 * math.sqrt(mean) + 16)
    logs = np.array([-mean + i * math.log(mean) - math.lgamma(i + 1) for i in range(top)])
    return np.cumsum(np.exp(logs))


_TABLES: dict[int, np.ndarray] = {}


def _darts(elements, weight, doc, theta, k, out):
    """Throws all darts of some elements under the documents' rank limits into ``out`` (documents x k)."""
    for v in range(64):
        low_w, wide = 2.0**v - 1, 2.0**v
        deep = weight > low_w
        if not deep.any():
            return
        e, w, d = (elements, weight, doc) if deep.all() else (elements[deep], weight[deep], doc[deep])
        for r in range(64):
            low = (2.0**r - 1) * UNIT
            live = theta[d] > low
            if not live.any():
                break
            if not live.all():
                e, w, d = e[live], w[live], d[live]
            if v + r not in _TABLES:
                _TABLES[v + r] = poisson_table(2.0**(v + r) * UNIT)
            h = mix(e ^ np.uint64(((v * 64 + r + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            n = np.searchsorted(_TABLES[v + r], (h >> np.uint64(11)) * 2.0**-53, "right")
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            at = np.repeat(hit, n[hit])
            j = np.arange(len(at)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
            dart = mix(h[at] + (j.astype(np.uint64) + np.uint64(1)) * _C[1])
            rank = low + (dart >> np.uint64(24)) * 2.0**-40 * (2.0**r * UNIT)
            keep = rank < theta[d[at]]
            if (w < low_w + wide).any():
                keep &= low_w + (mix(dart ^ _C[2]) >> np.uint64(11)) * 2.0**-53 * wide < w[at]
            at, dart, rank = at[keep], dart[keep], rank[keep]
            spot = mix(dart ^ _C[3])
            packed = (np.minimum(rank * 2.0**24, 2.0**40 - 1).astype(np.uint64) << np.uint64(24)) | (spot >> np.uint64(40))
            np.minimum.at(out.reshape(-1), d[at] * k + (spot % np.uint64(k)).astype(np.int64), packed)


def signatures(elements: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Earliest dart of each coordinate for every document; ``FULL`` throughout where a document has no weight.

    ``doc`` is sorted. Rank limits are set for ``k ln k + 2 k`` darts a document and doubled where a coordinate stayed empty.
    An element given twice adds nothing.
    """
    out = np.full((n_docs, k), FULL)
    total = np.bincount(doc, weight, n_docs)
    theta = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300)
    open_ = total > 0
    while open_.any():
        chosen = np.flatnonzero(open_[doc]) if not open_.all() else np.arange(len(doc))
        for s in range(0, len(chosen), ELEMENTS):
            part = chosen[s: s + ELEMENTS]
            _darts(elements[part], weight[part], doc[part], theta, k, out)
        open_ = open_ & (out == FULL).any(axis=1)
        theta = np.where(open_, 2 * theta, theta)
    return out


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all windows of ``size`` word hashes; of all words together if there are fewer, none for none."""
    w = words.astype(np.uint64)
    if len(w) == 0:
        return w
    size_here = min(size, len(w))
    out = np.full(len(w) - size_here + 1, np.uint64(size_here))
    for j in range(size_here):
        out = mix(out ^ (w[j: len(w) - size_here + 1 + j] * _C[0])) + _C[4]
    return out


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, ``node`` (digest of the word sequence) and ``w`` (hashes of the words)."""
    words = words_of(F.col("text"))
    made = let(words, lambda ws: F.struct(
        F.unhex(F.md5(F.array_join(ws, " "))).alias("node"), F.transform(ws, lambda x: F.xxhash64(x)).alias("w")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), made.alias("m")).select("doc_id", "m.node", "m.w")


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of an Arrow list column."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.values.to_numpy()[offsets[0]: offsets[-1]]


def sketches(docs: DataFrame, k: int = BANDS * ROWS) -> DataFrame:
    """doc_id, node and the band keys (null without words)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = _lists(batch.column(2))
            start = 0
            while start < batch.num_rows:  # as many documents as make up one load of elements, or of darts
                stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + ELEMENTS, "right")) - 1)
                stop = min(stop, start + TEXTS, batch.num_rows)
                sets = [shingles(values[offsets[i]: offsets[i + 1]]) for i in range(start, stop)]
                sizes = np.array([len(s) for s in sets])
                flat = np.concatenate(sets) if sizes.sum() else np.zeros(0, np.uint64)
                sig = signatures(flat, np.ones(len(flat)), np.repeat(np.arange(len(sets)), sizes), len(sets), k)
                keys = np.zeros((len(sets), BANDS), np.uint64)
                for b in range(BANDS):
                    for j in range(ROWS):
                        keys[:, b] = mix(keys[:, b] ^ (sig[:, b * ROWS + j] * _C[0])) + np.uint64(b + 1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start),
                    pa.array([x.astype(np.int64).tolist() if n else None for x, n in zip(keys, sizes)], pa.list_(pa.int64())),
                ], names=["doc_id", "node", "keys"])
                start = stop

    return hashed(docs).mapInArrow(sketch, "doc_id long, node binary, keys array<long>")


def components(edges: DataFrame, path: str) -> DataFrame:
    """node, label: the smallest node of each connected component. Labels spread and jump until none changes.

    ``edges`` has columns a and b. Each round is stored, and a node with very many links is
    combined before it is shuffled.
    """
    both = store(edges.select("a", "b").union(edges.select("b", "a")), f"{path}/both")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("label")), f"{path}/labels-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnsRenamed({"node": "b", "label": "near"}), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("near").alias("near"))
        spread = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        # A jump: the label's own label.
        far = labels.withColumnsRenamed({"node": "next", "label": "far"})
        new = store(spread.join(far, "next", "left").select(
            "node", F.least("next", F.coalesce("far", "next")).alias("label"),
            (F.col("label") != F.least("next", F.coalesce("far", "next"))).alias("moved")), f"{path}/labels-{step}")
        done = new.where("moved").isEmpty()
        erase(both.sparkSession, f"{path}/labels-{step - 1}")
        labels = new.drop("moved")
        if done:
            return labels


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose shingle sets reach the similarity. A hot node's set is joined, never grouped."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return both.where(F.col("i") >= similarity * (F.col("n") - F.col("i")) - 1e-9).select("a", "b")


def _links_inside(similarity: float):
    """Verified links that join components within one bucket, or between two chunks of a large one.

    Every member outside the largest component is compared with all others at once, by counting over an
    inverted index of the shingles. Only links that join two parts come out.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        node, label = group["node"].tolist(), pd.factorize(group["label"])[0]
        side = (group["chunk"] == group["lo"]).to_numpy()
        apart = bool((group["lo"] != group["hi"]).iloc[0])
        sizes = group["s"].map(len).to_numpy()
        owner = np.repeat(np.arange(len(node)), sizes)
        flat = np.concatenate(group["s"].tolist())
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        root = list(range(label.max() + 1))

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        rows = []
        for i in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
            s = group["s"].iloc[i]
            lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(node))
            near = shared >= similarity * (sizes + len(s) - shared) - 1e-9
            if apart:
                near &= side != side[i]
            for j in np.flatnonzero(near & (label != label[i])).tolist():
                x, y = top(label[i]), top(label[j])
                if x != y:
                    root[x] = y
                    rows.append((min(node[i], node[j]), max(node[i], node[j])))
        return pd.DataFrame(rows, columns=["a", "b"])

    return run


def _bucket_links(members: DataFrame, sets: DataFrame, labels: DataFrame, similarity: float, path: str) -> DataFrame:
    """Verified links across components in the buckets that hold more than one."""
    known = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    buckets = known.groupBy("key").agg(
        F.count("*").alias("n"), F.min("label").alias("first"), F.max("label").alias("last"), F.expr("count_if(node != least AND star = least)").alias("tested"),
        # Buckets with the same members say the same; one of them is enough.
        F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"))
    # Two members of which one was compared with the other have nothing left to say.
    open_ = buckets.where("first != last AND NOT (n = 2 AND tested = 1)").groupBy("n", "h1", "h2").agg(F.min("key").alias("key"))
    open_ = open_.select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    rows = store(known.join(open_, "key").select(
        "key", "node", "label", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk")), path)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "key", "node", "label", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    rows = rows.join(sets, "node")
    return rows.groupBy("key", "lo", "hi").applyInPandas(_links_inside(similarity), "a binary, b binary").distinct()


def _sets(docs: DataFrame, involved: DataFrame) -> DataFrame:
    """node and its sorted shingle hashes, for the nodes that share a bucket.

    A bit filter of fixed size keeps most other texts out of the shuffle; the join then decides exactly.
    """
    at = lambda node: F.pmod(F.xxhash64(node), F.lit(FILTER_BITS))
    words_ = involved.select(at(F.col("node")).alias("bit")).groupBy((F.col("bit") % (FILTER_BITS // 64)).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(bit div {FILTER_BITS // 64} as int))")).alias("bits"))
    every = docs.sparkSession.range(FILTER_BITS // 64).select(F.col("id").cast("int").alias("word")).join(words_, "word", "left")
    table = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).cast("long").alias("bits")))),
                                  lambda x: x["bits"]).alias("table"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = _lists(batch.column(1))
            for s in range(0, batch.num_rows, 256):
                t = min(s + 256, batch.num_rows)
                sets = [np.unique((shingles(values[offsets[i]: offsets[i + 1]]) >> np.uint64(16)).astype(np.int64)) for i in range(s, t)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(s, t - s),
                    pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), np.concatenate(sets))], names=["node", "s"])

    texts = docs.select(F.unhex(F.md5(F.array_join(words_of(F.col("text")), " "))).alias("node"), "text").withColumn("table", table.scalar())
    bit = at(F.col("node"))
    texts = texts.where(F.getbit(F.get("table", (bit % (FILTER_BITS // 64)).cast("int")), F.floor(bit / (FILTER_BITS // 64)).cast("int")) == 1)
    # Copies are reduced to one text where they are read, so they do not meet in one task.
    texts = texts.groupBy("node").agg(F.first("text").alias("text")).join(involved, "node", "left_semi")
    hashes = texts.select("node", let(words_of(F.col("text")), lambda ws: F.transform(ws, lambda x: F.xxhash64(x))).alias("w"))
    return hashes.mapInArrow(sets_of, "node binary, s array<long>")


def classes(docs: DataFrame, similarity: float = SIMILARITY, path: str | None = None) -> DataFrame:
    """doc_id, node and class_id for every row: the smallest doc_id among all that a chain of near copies joins.

    Exact copies in words fall together first, so only different word sequences are
    compared. Each is compared with the smallest member of most of its band buckets at once; in the buckets that still hold several
    components, every pair across them is then verified, and only links that join two components leave the task. Texts without words, null
    included, are one class; fewer than five words are one shingle. Rows with a null doc_id get a
    class too (its id is null if all have none). Only doc_id and text are read.
    """
    spark = docs.sparkSession
    path = path or workspace(spark, "minhash")
    sketched = store(sketches(docs), f"{path}/sketches", BATCH)
    bands = sketched.where("keys IS NOT NULL").groupBy("node").agg(F.first("keys").alias("keys"))
    bands = store(bands, f"{path}/nodes").select("node", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1").drop("n")
    # Stored first: a join of two plain shuffles is one whose hot keys Spark can split.
    shared = store(shared, f"{path}/shared")
    members = store(bands.join(shared, "key"), f"{path}/pairs")
    erase(spark, f"{path}/nodes")
    # Each node is first compared with one smallest member only: that of most of its buckets.
    stars = members.groupBy("node", "least").agg(F.count("*").alias("n")).groupBy("node").agg(
        F.min(F.struct((F.col("node") == F.col("least")).alias("own"), (-F.col("n")).alias("n"), F.col("least").alias("star"))).alias("x"))
    stars = store(stars.select("node", "x.star"), f"{path}/stars")
    members = members.join(stars, "node")
    sets = store(_sets(docs, stars.select("node")), f"{path}/sets", BATCH)
    edges = store(_verified(stars.where("node != star").select(F.col("star").alias("a"), F.col("node").alias("b")), sets, similarity),
                  f"{path}/edges")
    labels = components(edges, f"{path}/components-0")
    more = store(_bucket_links(members, sets, labels, similarity, f"{path}/open"), f"{path}/more")
    if not more.isEmpty():
        labels = components(edges.union(more), f"{path}/components-1")
    for part in ("sets", "pairs", "stars", "open"):
        erase(spark, f"{path}/{part}")
    rows = sketched.select("doc_id", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = store(rows.groupBy(F.col("label").alias("l")).agg(F.min("doc_id").alias("class_id")), f"{path}/least")
    return rows.join(least, F.col("label") == F.col("l")).select("doc_id", "node", "class_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and whether the row stays: the one with the smallest doc_id of its class."""
    return classes(docs).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("stays"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents with one of each class left, with the columns they came with: the row with the smallest doc_id."""
    path = workspace(docs.sparkSession, "dedup")
    stay = store(classes(docs, path=path).where("doc_id <=> class_id").groupBy("doc_id", "class_id").agg(
        F.min("node").alias("node"), F.count("*").alias("n")), f"{path}/stay")
    for part in ("sketches", "shared", "edges", "more", "least", "components-0", "components-1"):  # only the rows that stay are read from here on
        erase(docs.sparkSession, f"{path}/{part}")
    node, = fresh(docs, "node")
    with_node = docs.withColumn(node, F.unhex(F.md5(F.array_join(words_of(F.col("text")), " "))))
    keys = stay.select(F.col("doc_id").alias("stay_id"), F.col("node").alias("stay_node"), F.col("n").alias("stay_n"))
    kept = with_node.join(keys, with_node["doc_id"].eqNullSafe(keys["stay_id"]) & (col(node) == keys["stay_node"]))
    names = [col(c) for c in docs.columns]
    if stay.where("n > 1").isEmpty():
        return kept.select(*names)
    tied = kept.where("stay_n > 1").groupBy("stay_id", "stay_node").agg(
        *[F.first(col(c)).alias(c) for c in docs.columns]).select(*names)
    return kept.where("stay_n = 1").select(*names).unionByName(tied)
