"""Read any supported table, resolve curated or raw copies, decode workbooks."""

from __future__ import annotations

import io
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.sources.delimited import ReadInfo, clean_tokens, file_type, infer_types, read_delimited


def workbook_rows(batches):
    """First sheet of every workbook in a batch as (path, row, cells)."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            sheet = pd.read_excel(io.BytesIO(content), dtype=object)
            header = [str(c) for c in sheet.columns]
            cells = [[None if pd.isna(v) else str(v) for v in row] for row in sheet.itertuples(index=False)]
            yield pd.DataFrame({"path": path, "row": range(len(cells)),
                                "header": [header] * len(cells), "cells": cells})


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of one workbook; needs an Excel reader on the executors.

    Workbooks are decoded one per task; a workbook is small by format.
    """
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("reading .xlsx/.xls needs the openpyxl package") from e
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(workbook_rows, "path string, row long, header array<string>, cells array<string>")
    head = rows.select("header").first()
    if head is None:
        raise ValueError(f"no rows in {path}")
    named = rows.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(head[0])])
    return infer_types(clean_tokens(named))


def read_table(spark: SparkSession, path: str, strategy: str = "sniff",
               expected: list[str] | None = None) -> tuple[DataFrame, ReadInfo]:
    """Dispatch by suffix."""
    if file_type(path) == ".csv":
        return read_delimited(spark, path, strategy, expected)
    df = read_excel(spark, path)
    return df, ReadInfo("binary", "none", "", None, len(df.columns))


def resolve_source(spark: SparkSession, curated_path: str, raw_path: str) -> DataFrame | None:
    """Curated copy if it has at least two columns, else the raw file, else nothing."""
    for path, needed in ((curated_path, 2), (raw_path, 0)):
        try:
            df, _ = read_delimited(spark, path, "encoding_only" if needed else "first_multicolumn")
        except Exception as e:  # unreadable or absent: try the next copy
            if not needed and "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        if len(df.columns) >= needed:
            return df
    return None


def list_files(spark: SparkSession, *globs: str) -> DataFrame:
    """(path) of the files matching the globs, in name order; contents are not read."""
    found = None
    for g in globs:
        try:
            part = spark.read.format("binaryFile").load(g).select("path")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "path string")
    return found.distinct().orderBy("path")
