"""Cleaning of a document corpus in five stages, each written as Parquet and read again by the next.

quality rules (rejected documents go) -> near duplicates (one of each class stays) -> repeated
passages (all but the first copy are taken out) -> personal data (replaced by kind) -> packing into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablesmith.llm.chains import remove_passages
from tablesmith.llm.minhash import deduplicate
from tablesmith.llm.packing import pack_documents
from tablesmith.llm.private import redact
from tablesmith.llm.quality import keep
from tablesmith.llm.shared import erase, store, workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood threshold, the labels of ``sf_dir`` being the trusted target."""
    return keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies."""
    return deduplicate(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that stand in an earlier one."""
    return remove_passages(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("private", private), ("packing", packing)]

#: SQL cannot express these stages; a brute-force version tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. A stage's table is deleted when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = workspace(spark, f"pipeline-{name}")
        docs = store(stage(spark, docs, sf_dir), path)
        if before:
            erase(spark, before)
        before = path
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
