"""Delimited files: decide encoding and separator from evidence, then scan once.

Only the header line reaches the driver. Encoding validity is a distributed scan
of the bytes; separators are judged on the header; the data is parsed one time.
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions.numeric import quoted
from tablesmith.operators.ranks import agg_row
from tablesmith.operators.validate import parse_score

# --- fixed values ------------------------------------------------------------------
ENCODINGS = {
    "sniff": ["utf-8", "utf-8-sig", "cp1252", "latin1"],
    "schema_match": ["utf-8", "utf-8-sig", "latin1", "cp1252"],
    "default": ["utf-8", "latin-1", "cp1252", "iso-8859-1", "mac_roman"],
}
SEPARATORS = {",": "comma", ";": "semicolon", "\t": "tab", "|": "pipe", " ": "space"}
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
FILE_TYPES = [".csv", ".xlsx", ".xls"]
# the CSV source reads UTF and Latin-1 only; the other one-byte sets are mapped from Latin-1 below
JVM_CHARSETS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1",
                "cp1252": "ISO-8859-1", "iso-8859-1": "ISO-8859-1", "mac_roman": "ISO-8859-1"}
STRATEGIES = ["sniff", "first_line", "schema_match", "first_multicolumn", "encoding_only"]
# -----------------------------------------------------------------------------------

CORRUPT = "_corrupt_record"


@dataclass
class ReadInfo:
    encoding: str
    separator: str
    separator_value: str
    schema_match_score: int | None = None
    columns_read: int = 0
    rows_read: int | None = None
    on_bad_lines: str = "skip"


def file_type(path: str) -> str:
    """Suffix of a supported file; anything else is an error."""
    m = re.search(r"\.[^./\\]+$", path)
    suffix = m.group().lower() if m else ""
    if suffix not in FILE_TYPES:
        raise ValueError("Unsupported file type. Only CSV and Excel are allowed.")
    return suffix


def text_facts(spark: SparkSession, path: str | list[str]) -> dict:
    """Lines that are no UTF-8, those with bytes cp1252 lacks, and those that leave a quote open: one scan."""
    lines = spark.read.text(path)
    bad = ~F.is_valid_utf8(F.col("value"))
    undefined = F.hex(F.col("value").cast("binary")).rlike("^(..)*(81|8D|8F|90|9D)")
    open_quote = F.regexp_count(F.col("value"), F.lit('"')) % 2 == 1
    return lines.agg(F.count_if(bad).alias("bad"), F.count_if(bad & undefined).alias("undefined"),
                     F.count_if(open_quote).alias("open")).first().asDict()


def detect_encoding(facts: dict, ladder: list[str]) -> str:
    """First encoding of the ladder that can decode every byte."""
    for encoding in ladder:
        if encoding.startswith("utf-8"):
            if facts["bad"] == 0:
                return encoding
        elif encoding == "cp1252":
            if facts["undefined"] == 0:
                return encoding
        else:
            return encoding
    return ladder[-1]


def headers(spark: SparkSession, path: str, encoding: str) -> dict[str, list[str]]:
    """Files by their first line, in the order of their names; a file's first block is read by one task, in order."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    firsts = lines.where("block = 0").groupBy("file").agg(F.first("line").alias("line"))
    groups = firsts.groupBy("line").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    if not groups:
        raise ValueError(f"empty file: {path}")
    show = lambda b: bytes(b).decode(encoding, errors="replace").lstrip("\ufeff").rstrip("\r\n")
    return {show(g["line"]): g["files"] for g in sorted(groups, key=lambda g: g["files"][0])}


def has_data(spark: SparkSession, path: str | list[str]) -> bool:
    return len(spark.read.text(path).limit(2).collect()) > 1


def header_names(line: str, sep: str) -> list[str]:
    """Column names of a header line; blanks get a position name, repeats a suffix, also those that differ in case only."""
    cells = next(csv.reader([line], delimiter=sep), [])
    names, taken = [], set()
    for i, cell in enumerate(cells):
        name = cell if cell else f"Unnamed: {i}"
        n = 0
        while (f"{name}.{n}" if n else name).lower() in taken:
            n += 1
        names.append(f"{name}.{n}" if n else name)
        taken.add(names[-1].lower())
    return names


def sniff_separator(line: str) -> str:
    """Guess from one line; a letter or digit is never a separator."""
    try:
        found = csv.Sniffer().sniff(line).delimiter
    except csv.Error:
        return ","
    return "," if found.isalnum() else found


def choose_separator(spark: SparkSession, line: str, strategy: str, expected: list[str] | None,
                     data: bool) -> tuple[str, int | None]:
    """Separator for a header line by the strategy's rule, and the score if it has one."""
    if strategy == "sniff":
        return sniff_separator(line), None
    if strategy == "first_line":
        sep = ";" if line.count(";") > line.count(",") else ","
        return (sep if len(header_names(line, sep)) > 1 else ";"), None
    if strategy == "encoding_only":
        return ",", None
    if strategy == "first_multicolumn":
        wide = [s for s in SEPARATORS if len(header_names(line, s)) > 1]
        return (wide[0] if wide and data else ","), None
    return best_separators(spark, [(line, list(expected or []), data)])[0]


def best_separators(spark: SparkSession, requests: list[tuple[str, list[str], bool]]) -> list[tuple[str, int]]:
    """Separator and score for each (header line, expected names, has data): the first candidate of the best score, all in one job."""
    rows = [(k, i, s, header_names(line, s), expected, int(data)) for k, (line, expected, data) in enumerate(requests)
            for i, s in enumerate([",", ";", "\t", "|", sniff_separator(line)])]
    scored = spark.createDataFrame(rows, "k int, i int, sep string, found array<string>, expected array<string>, n int").withColumn(
        "score", parse_score(F.col("found"), F.col("expected"), F.col("n")))
    best = scored.groupBy("k").agg(F.min_by(F.struct("sep", "score"), F.struct(-F.col("score"), F.col("i"))).alias("b")).collect()
    return [(r["b"]["sep"], r["b"]["score"]) for r in sorted(best, key=lambda r: r["k"])]


def field_count(line: Column, sep: str) -> Column:
    """Number of fields of a raw line; separators inside quotes do not count."""
    bare = F.regexp_replace(line, r'"(?:[^"]|"")*"', "q")
    return F.regexp_count(bare, F.lit(re.escape(sep) if sep != "\t" else "\t")) + 1


def byte_map(encoding: str) -> tuple[str, str]:
    """Characters that differ between Latin-1 and another one-byte encoding, as a translation."""
    pairs = [(bytes([b]).decode("latin-1"), bytes([b]).decode(encoding, errors="replace")) for b in range(128, 256)]
    pairs = [(a, c) for a, c in pairs if a != c and c != "\ufffd"]
    return "".join(a for a, _ in pairs), "".join(c for _, c in pairs)


def scan_text(spark: SparkSession, path: str | list[str], names: list[str], sep: str, encoding: str,
              multi_line: bool = False) -> DataFrame:
    """All cells as text; rows with too many fields are dropped, short rows padded with nulls."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    raw = (
        spark.read.schema(schema)
        .options(header=True, sep=sep, encoding=JVM_CHARSETS[encoding], mode="PERMISSIVE", quote='"',
                 escape='"', columnNameOfCorruptRecord=CORRUPT, multiLine=multi_line,
                 columnPruning=False, enforceSchema=True)
        .csv(path)
    )
    too_long = F.col(CORRUPT).isNotNull() & (field_count(F.col(CORRUPT), sep) > len(names))
    # a query may not read the corrupt-record column alone: the filter names a data column too
    some_cell = F.coalesce(F.length(quoted(names[0])), F.lit(0)) >= 0
    rows = raw.where(some_cell & ~too_long).drop(CORRUPT)
    if encoding in ("cp1252", "mac_roman"):
        latin, wanted = byte_map(encoding)
        rows = rows.select(*[F.translate(quoted(n), latin, wanted).alias(n) for n in names])
    return rows


def clean_tokens(df: DataFrame) -> DataFrame:
    """Missing-value tokens become nulls in every text column."""
    return df.select(*[
        F.when(~quoted(c).isin(NA_TOKENS), quoted(c)).alias(c) if t == "string" else quoted(c)
        for c, t in df.dtypes])


def type_counts(v: Column) -> dict[str, Column]:
    """Present values of a text column, and those that read as whole number, number and truth value."""
    return {
        "n": F.count(v),
        "int": F.count_if(v.isNotNull() & v.rlike(r"^\s*[+-]?[0-9]+\s*$") & v.try_cast("bigint").isNotNull()),
        "float": F.count_if(v.isNotNull() & ~v.rlike(r"[dDfF]\s*$") & v.try_cast("double").isNotNull()),
        "bool": F.count_if(F.lower(v).isin("true", "false")),
    }


def type_of_counts(n: Column, whole: Column, real: Column, truth: Column) -> Column:
    """Type of a column by its counts: the first that every present value has; a column without values is a float column."""
    return (F.when(n == 0, "double").when(whole == n, "bigint").when(real == n, "double").when(truth == n, "boolean").otherwise("string"))


def infer_types(df: DataFrame) -> DataFrame:
    """Integer, float or boolean where every present value parses; text otherwise. One pass."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df
    got = agg_row(df, {(i, k): e for i, c in enumerate(texts) for k, e in type_counts(quoted(c)).items()})
    new = {}
    for i, c in enumerate(texts):
        n = got[i, "n"]
        kind = "double" if not n else next((t for t, k in (("bigint", "int"), ("double", "float"), ("boolean", "bool")) if got[i, k] == n), None)
        if kind:
            new[c] = F.lower(quoted(c)) == "true" if kind == "boolean" else quoted(c).try_cast(kind)
    return df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


def read_delimited(
    spark: SparkSession,
    path: str,
    strategy: str = "sniff",
    expected: list[str] | None = None,
    encoding: str | None = None,
    multi_line: bool = False,
    typed: bool = True,
) -> tuple[DataFrame, ReadInfo]:
    """Read one delimited dataset. ``expected`` column names steer ``schema_match``.

    Files of a folder are read by their own headers and put together by name. Where a quoted cell holds a line
    break (a line leaves a quote open), records are read across lines, also without ``multi_line``.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    facts = text_facts(spark, path)
    encoding = encoding or detect_encoding(facts, ENCODINGS.get(strategy, ENCODINGS["default"]))
    multi_line = multi_line or facts["open"] > 0
    groups = headers(spark, path, encoding)
    parts, info = [], None
    for line, files in groups.items():
        where = path if len(groups) == 1 else files
        sep, score = choose_separator(spark, line, strategy, expected, has_data(spark, where))
        names = header_names(line, sep)
        parts.append(clean_tokens(scan_text(spark, where, names, sep, encoding, multi_line)))
        info = info or ReadInfo(encoding, SEPARATORS.get(sep, "auto"), sep, score, len(names))
    df = parts[0]
    for other in parts[1:]:
        df = df.unionByName(other, allowMissingColumns=True)
    info.columns_read = len(df.columns)
    return (infer_types(df) if typed else df), info


def promote_header(df: DataFrame, position: Column) -> DataFrame:
    """First row (by position) becomes the header, unless all its cells are whole numbers."""
    cells = [quoted(c).cast("string").alias(c) for c in df.columns]
    first = df.select(position.alias("_p"), *cells).orderBy("_p").limit(1).collect()
    if not first:
        return df
    p, values = first[0][0], list(first[0])[1:]
    if all(v is not None and v.isnumeric() for v in values):
        return df
    names = ["nan" if v is None else v.strip() for v in values]
    return df.where(position != F.lit(p)).toDF(*names)
