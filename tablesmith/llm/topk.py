"""Exact top-k search by inner product over norm buckets.

Vectors are grouped by length into buckets. A first pass over the bucket of the longest
vectors gives each query a score to beat. A bucket whose largest length cannot
reach it is never paired with the query. In the others the score to beat, divided by both lengths, is a local
cosine threshold: a low one prunes by length alone, a high one also by the range
that each of the query's largest coordinates leaves to the other vector. What remains is
verified by its full product. Queries and buckets meet in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.shared import store, workspace

#: Length buckets, at most; a bucket holds at least this many rows on average, and a block no more than about the third.
BUCKETS, BUCKET_ROWS, BLOCK_ROWS = 32, 256, 16_384
QUERY_ROWS = 4096
#: From this local cosine threshold on, coordinates prune too.
COORDINATES_FROM = 0.3
FOCUS = 4
#: Bounds are compared with this relative slack, so that rounding never prunes a result.
SLACK = 1e-9


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id, floor(256 x) of each component, length and dimension; rows that take no part are left out.

    These are rows with a null id, a null vector, or a null or non-finite component. A row given several times is kept each time.
    Components beyond the range of long are held at its ends.
    """
    e = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(256 * x)).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.withColumn("norm", norm).withColumn("dim", F.size("v"))


def products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products; doubles hold them unless lengths are huge."""
    if len(p) and np.abs(p).max(initial=0).astype(float) * np.abs(q).max(initial=0).astype(float) * p.shape[1] < 2**53:
        return (p.astype(float) @ q.astype(float)).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in p]
    return np.array([min(max(x, -2**63), 2**63 - 1) for x in exact], np.int64)


def search(p: np.ndarray, ids: np.ndarray, norms: np.ndarray, unit: np.ndarray, q: np.ndarray, own: int, k: int, floor: float):
    """Best ``k`` of one bucket for one query: (ids, scores). ``p`` is sorted by length, longest first."""
    length = float(np.sqrt((q.astype(float) ** 2).sum()))
    chosen = np.arange(len(p))
    if floor > 0 and length > 0:
        local = floor / (length * norms[0]) * (1 - SLACK) if norms[0] > 0 else 2.0
        if local > 1:
            return ids[:0], ids[:0]
        # Shorter vectors than this cannot reach the score.
        chosen = chosen[: np.searchsorted(-norms, -(floor / length * (1 - SLACK)), "right")]
        if local >= COORDINATES_FROM:
            focus = np.argsort(-np.abs(q))[:FOCUS]
            at = np.arccos(np.clip(q[focus] / length, -1, 1))
            turn = np.arccos(min(1.0, local))
            low, high = np.cos(np.minimum(np.pi, at + turn)) - SLACK, np.cos(np.maximum(0.0, at - turn)) + SLACK
            near = unit[chosen][:, focus]
            chosen = chosen[((near >= low) & (near <= high)).all(axis=1)]
    elif floor > 0:
        return ids[:0], ids[:0]
    chosen = chosen[ids[chosen] != own]
    scores = products(p[chosen], q)
    order = np.lexsort((ids[chosen], -scores.astype(object) if scores.size and scores.min() == -2**63 else -scores))[:k]
    return ids[chosen][order], scores[order]


def _bucket_search(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            rows = rows.sort_values("norm", ascending=False, kind="stable")
            p = np.array(rows["v"].tolist(), np.int64).reshape(len(rows), -1)
            ids, norms = rows["vec_id"].to_numpy(np.int64), rows["norm"].to_numpy(float)
            unit = p / np.where(norms > 0, norms, 1.0)[:, None]
            for row, own, v, beat in zip(queries["query_row"], queries["query_id"], queries["q"], queries["beat"]):
                q = np.array(v, np.int64)
                found, scores = search(p, ids, norms, unit, q, int(own), k, -np.inf if beat is None or np.isnan(beat) else float(beat))
                out += [(row, own, i, s) for i, s in zip(found.tolist(), scores.tolist())]
        return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"])

    return run


def _meet(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Each block of queries with the blocks of rows that some of its queries need; only these rows are copied to it."""
    place, keys = ["dim", "bucket", "block"], ["query_block", "dim", "bucket", "block"]
    needed = queries.select(*keys).distinct()
    rows = rows.join(needed, place).select(*[F.col(c).alias(f"row_{c}") for c in keys], "vec_id", "v", "norm")
    return queries.groupBy(*keys).cogroup(rows.groupBy(*[f"row_{c}" for c in keys])).applyInPandas(
        _bucket_search(k), "query_row long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest products, ties to the smaller id.

    ``is_query`` is a condition on vec_id. Only vectors of the query's dimension
    are compared, never rows with the query's own id. Every row is a candidate, also one given several times; rows of
    one query id are ranked together. Fewer than ``k`` candidates give fewer rows, an empty table none.
    """
    spark = vectors.sparkSession
    path = workspace(spark, "topk")
    data = store(quantized(vectors).withColumn("row", F.monotonically_increasing_id()), f"{path}/vectors")
    n, nq = data.count(), data.where(is_query).count()
    buckets = max(1, min(BUCKETS, n // BUCKET_ROWS))
    edges = data.select(F.percentile_approx("norm", [i / buckets for i in range(1, buckets)] or [0.5], 10_000)).first()[0] or []
    edges = sorted(set(edges), reverse=True) if buckets > 1 else []
    bucket = F.lit(0)
    for e in edges:  # the longest vectors are in bucket 0
        bucket = bucket + (F.col("norm") < F.lit(e)).cast("int")
    data = data.withColumn("bucket", bucket)
    query_blocks = max(1, -(-nq // QUERY_ROWS))
    # A row per bucket and dimension: how many blocks share it, and its largest length.
    shape = data.groupBy("dim", "bucket").agg(
        F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"), F.max("norm").alias("longest"))
    shape = store(shape, f"{path}/shape")
    # Dealt by the row's own number, so copies of one vector are spread over the blocks.
    rows = data.join(shape.drop("longest"), ["dim", "bucket"]).withColumn(
        "block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("blocks")
    queries = data.where(is_query).select(
        F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("norm").alias("query_norm"), "dim",
        F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int").alias("query_block"))
    first = shape.groupBy("dim").agg(F.min("bucket").alias("bucket"))
    start = queries.join(first, "dim").withColumn("block", F.lit(0)).withColumn("beat", F.lit(None).cast("double"))
    opened = store(_meet(start, rows.where("block = 0"), k), f"{path}/first")
    beat = opened.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("beat"))
    blocks = shape.join(first.withColumnRenamed("bucket", "top"), "dim").select(
        "dim", "bucket", "longest", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "top",
    ).where("NOT (bucket = top AND block = 0)").drop("top")
    left = store(queries.join(beat, "query_row", "left").join(blocks, "dim").where(
        F.col("beat").isNull() | (F.col("query_norm") * F.col("longest") * (1 + SLACK) >= F.col("beat"))).drop("longest"), f"{path}/left")
    ranked = opened.unionByName(_meet(left, rows, k)).withColumn(
        "rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
