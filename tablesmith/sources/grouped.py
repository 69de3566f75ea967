"""Many small delimited files in a few jobs: one scan for their facts, one for each way of parsing, results by file.

Files differ in header, width and types, so a scan reads cells by place and the file's own header names them afterwards.
The number of jobs follows the separators and character sets in use, never the number of files.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.numeric import quoted
from tablesmith.sources.delimited import (
    CORRUPT, ENCODINGS, JVM_CHARSETS, NA_TOKENS, best_separators, byte_map, choose_separator, detect_encoding, field_count, header_names, type_counts,
    type_of_counts,
)


@dataclass
class Layout:
    """How one file is read."""
    encoding: str
    separator: str
    names: list[str]
    multi_line: bool
    path: str  # in full, as Spark reads it
    key: str   # and as a scan names it


@dataclass
class Group:
    layouts: dict[str, Layout] = field(default_factory=dict)
    problems: dict[str, str] = field(default_factory=dict)


def existing(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, str]]:
    """By given path of the files that are there: the full path, and the form in which a scan names it."""
    out = {}
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(at):
            full = fs.makeQualified(at)
            out[p] = full.toString(), same_file(full.toUri().toString())
    return out


def layouts(spark: SparkSession, paths: list[str], strategy: str = "schema_match",
            expected: dict[str, list[str]] | None = None) -> Group:
    """Encoding, separator and header of every file from one scan of their lines; ``expected`` names steer ``schema_match`` by path.

    One row of facts for each file reaches the driver. A missing or empty file is a problem of its own.
    """
    there, out = existing(spark, paths), Group()
    out.problems = {p: "file not found" for p in paths if p not in there}
    if not there:
        return out
    value = F.col("value")
    bad = ~F.is_valid_utf8(value)
    undefined = F.hex(value.cast("binary")).rlike("^(..)*(81|8D|8F|90|9D)")
    facts = spark.read.text([full for full, _ in there.values()]).select("value", "_metadata.file_path", "_metadata.file_block_start").groupBy("file_path").agg(
        F.count_if(bad).alias("bad"), F.count_if(bad & undefined).alias("undefined"),
        F.count_if(F.regexp_count(value, F.lit('"')) % 2 == 1).alias("open"), F.count("*").alias("lines"),
        # only the task that reads a file's first block sees its first line
        F.first(F.when(F.col("file_block_start") == 0, value.cast("binary")), ignorenulls=True).alias("head"))
    got = {same_file(r["file_path"]): r for r in facts.collect()}
    found = {}
    for p, (full, key) in there.items():
        r = got.get(key)
        if r is None or r["head"] is None:
            out.problems[p] = "No columns to parse from file"
            continue
        encoding = detect_encoding(r.asDict(), ENCODINGS.get(strategy, ENCODINGS["default"]))
        line = bytes(r["head"]).decode(encoding, errors="replace").lstrip("\ufeff").rstrip("\r\n")
        found[p] = encoding, line, r["lines"] > 1, r["open"] > 0
    if strategy == "schema_match":
        seps = [s for s, _ in best_separators(spark, [(line, (expected or {}).get(p) or [], data) for p, (_, line, data, _) in found.items()])] if found else []
    else:
        seps = [choose_separator(spark, line, strategy, None, data)[0] for _, line, data, _ in found.values()]
    for (p, (encoding, line, _, multi)), sep in zip(found.items(), seps):
        out.layouts[p] = Layout(encoding, sep, header_names(line, sep), multi, *there[p])
    return out


def same_file(uri: str) -> str:
    """A file's name without the ways to write its scheme."""
    return "/" + uri.split(":", 1)[-1].lstrip("/") if ":" in uri else uri


def group_cells(spark: SparkSession, group: Group) -> DataFrame:
    """(file, ordinal, name, value): every cell of every file as text, missing-value tokens as null; rows with too many fields left out."""
    ways: dict[tuple, list[str]] = {}
    for p, x in group.layouts.items():
        ways.setdefault((x.separator, x.encoding, x.multi_line), []).append(p)
    shape = "file string, ordinal int, name string, value string"
    out = spark.createDataFrame([], shape)
    for (sep, encoding, multi), files in ways.items():
        width = max(len(group.layouts[p].names) for p in files)
        named = spark.createDataFrame(
            [(x.key, p, x.names) for p in files for x in [group.layouts[p]]], "at string, file string, names array<string>")
        places = [f"c{i}" for i in range(width)]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*places, CORRUPT]])
        raw = spark.read.schema(schema).options(
            header=True, sep=sep, encoding=JVM_CHARSETS[encoding], mode="PERMISSIVE", quote='"', escape='"',
            columnNameOfCorruptRecord=CORRUPT, multiLine=multi, columnPruning=False, enforceSchema=True).csv([group.layouts[p].path for p in files])
        at = F.concat(F.lit("/"), F.regexp_replace(F.col("_metadata.file_path"), "^[^:/]*:?/+", ""))
        rows = raw.select(*places, CORRUPT, at.alias("at"))
        n = F.size("names")
        fields = F.when(F.col(CORRUPT).isNull(), F.lit(width)).otherwise(F.least(field_count(F.col(CORRUPT), sep), F.lit(width + 1)))
        # one row for each file on the other side
        rows = rows.join(named, "at").where((fields <= n) | (F.coalesce(F.length("c0"), F.lit(0)) < 0))
        latin, wanted = byte_map(encoding) if encoding in ("cp1252", "mac_roman") else ("", "")
        value = lambda c: F.translate(quoted(c), latin, wanted) if latin else quoted(c)
        cells = F.slice(F.array(*[F.struct(F.lit(i).alias("ordinal"), value(c).alias("value")) for i, c in enumerate(places)]), F.lit(1), n)
        long = rows.select("file", "names", F.inline(cells))
        out = out.unionByName(long.select("file", "ordinal", F.get("names", F.col("ordinal")).alias("name"),
                                          F.when(~F.col("value").isin(NA_TOKENS), F.col("value")).alias("value")))
    return out


def group_columns(cells: DataFrame) -> DataFrame:
    """(file, ordinal, name, spark_type, row_count, missing_count): what a typed read of each file would give, from one aggregate."""
    counts = type_counts(F.col("value"))
    return cells.groupBy("file", "ordinal", "name").agg(
        F.count("*").alias("row_count"), *[e.alias(k) for k, e in counts.items()]).select(
        "file", "ordinal", "name", type_of_counts(*[F.col(k) for k in counts]).alias("spark_type"), "row_count",
        (F.col("row_count") - F.col("n")).alias("missing_count"))
