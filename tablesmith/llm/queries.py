"""One registered query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.alignment import align_documents
from tablesmith.llm.bpe import encode_documents
from tablesmith.llm.chains import repeated_passages
from tablesmith.llm.frames import token_files
from tablesmith.llm.manifest import document_manifest
from tablesmith.llm.minhash import near_duplicates
from tablesmith.llm.packing import pack_documents
from tablesmith.llm.private import report
from tablesmith.llm.quality import measure
from tablesmith.llm.sharding import shard_documents
from tablesmith.llm.topk import top_k
from tablesmith.llm.warc import round_trip
from tablesmith.llm.wrappers import main_text


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return shard_documents(_table(spark, sf, "documents"), 40)


def op2_topk(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(_table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    return round_trip(_table(spark, sf, "pages"))


def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return measure(docs, _table(spark, sf, "labels")).drop("text")


def op5_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_table(spark, sf, "documents"))


def op6_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return encode_documents(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_substring(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_passages(_table(spark, sf, "documents"))


def op8_html(spark: SparkSession, sf: str) -> DataFrame:
    return main_text(_table(spark, sf, "pages"))


def op9_pii(spark: SparkSession, sf: str) -> DataFrame:
    return report(_table(spark, sf, "documents"))


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(
        _table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_frames(spark: SparkSession, sf: str) -> DataFrame:
    return token_files(
        _table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op12_alignment(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return align_documents(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op13_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return document_manifest(_table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_topk, op3_warc, op4_quality, op5_minhash, op6_bpe, op7_substring, op8_html, op9_pii, op10_packing,
    op11_frames, op12_alignment, op13_manifest)}
ORACLES = {
    "op2_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
}
