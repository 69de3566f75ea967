"""WARC archives: an index of every record first, then byte-range reads of the selected records.

Writing gives one gzip member per record and an index row with its file, offset,
length, URL and payload digest. Reading takes any selection of index rows, sorts
them by place, merges neighbouring byte ranges into larger reads and parses each record.
Archives lie in a folder that all executors share and are opened by its URI.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.shared import col, store, workspace

#: Payloads of fewer bytes are never written as revisits.
LEAST_BYTES = 0
#: Ranges closer than this are read as one; a read grows no longer than the second unless one record does.
GAP, READ = 64 * 1024, 4 * 1024 * 1024
#: Bytes of one archive that one task reads.
SPAN = 16 * 1024 * 1024
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:x-page:"
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"


def _open(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to, copy: int = 0) -> bytes:
    """One record; a revisit if ``payload`` is None. Line breaks in a URL are percent-encoded."""
    name = f"<{RECORD}{'' if page_id is None else page_id}{f'.{copy}' if copy else ''}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if payload is None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{RECORD}{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers, payload size, digest and payload of one record; raises if a response does not match its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda x: int(x) if x else None
    page = fields["WARC-Record-ID"].strip("<>").removeprefix(RECORD).split(".")[0]
    refers = fields.get("WARC-Refers-To", "").strip("<>").removeprefix(RECORD)
    return {"page_id": number(page), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": number(refers), "payload": payload if kind == "response" else None}


def _first_holders(pages: DataFrame, least: int) -> DataFrame:
    """For payloads that occur more than once: digest, the smallest page_id (nulls last) and how often it occurs itself."""
    narrow = pages.select("page_id", "url", F.sha1(F.col("payload")).alias("sha"), F.octet_length("payload").alias("size"))
    per_page = narrow.where(F.col("size") >= least).groupBy("sha", "page_id").agg(F.count("*").alias("n"), F.min("url").alias("url"))
    return per_page.groupBy("sha").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("n").alias("n"),
                       F.col("url").alias("url"))).alias("first"),
        F.sum("n").alias("all"),
    ).where("all > 1").select("sha", F.col("first.id").alias("first_id"), F.col("first.n").alias("first_n"), F.col("first.url").alias("first_url"))


def write(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Writes all pages as archives in ``folder`` and returns the stored index.

    Of records with equal payloads of at least ``least`` bytes that with the smallest page_id is the
    response. A null html counts as empty. Repeated rows get a record each: of rows alike in page_id and
    html one with the first URL is the response. File names carry the task attempt, so a retried task leaves at
    worst a file that no index row names. Columns besides page_id, url and html are not read.
    """
    spark = pages.sparkSession
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    firsts = store(_first_holders(pages, least), f"{folder}/firsts")
    # Its written size decides between broadcast and a shuffle whose large keys Spark splits.
    rows = pages.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload")).join(firsts, "sha", "left").withColumn("copy", F.lit(0))
    holder = F.col("page_id").eqNullSafe(F.col("first_id"))
    tied = F.coalesce(F.col("first_n") > 1, F.lit(False)) & holder
    later = F.col("first_n").isNotNull() & ~holder
    plain = rows.where(~tied).withColumn("revisit", later)
    if firsts.where("first_n > 1").isEmpty():
        every = plain
    else:  # rows alike in page_id and html: counted before they meet, then dealt out again
        alike = rows.where(tied).groupBy("sha", "page_id", "url").agg(
            *[F.first(c).alias(c) for c in ("payload", "size", "first_id", "first_url")], F.count("*").alias("n"))
        copies = alike.select("*", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("copy")).drop("n")
        copies = copies.withColumn("revisit", (F.col("copy") > 0) | ~F.col("url").eqNullSafe(F.col("first_url")))
        every = plain.unionByName(copies, allowMissingColumns=True)
    every = every.select(
        "page_id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "sha",
        "size", F.when(F.col("revisit"), F.col("first_id")).alias("refers_to"), "copy")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/archives/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        try:
            for batch in batches:
                index = []
                for page_id, url, payload, sha, size, refers_to, copy in zip(*[c.to_pylist() for c in batch.columns]):
                    if out is None:
                        fs, path = _open(name)
                        fs.create_dir(path.rpartition("/")[0])
                        out = fs.open_output_stream(path, compression=None)
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    z = zlib.compressobj(5, zlib.DEFLATED, 31)
                    data = z.compress(record(page_id, url, payload, size, digest, refers_to, copy)) + z.flush()
                    out.write(data)
                    index.append((name, at, len(data), page_id, url, digest, "response" if payload is not None else "revisit"))
                    at += len(data)
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                names = ["file", "offset", "length", "page_id", "url", "payload_digest", "record_type"]
                columns = list(zip(*index)) if index else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        finally:
            if out is not None:
                out.close()

    return store(every.mapInArrow(put, INDEX), f"{folder}/index")


def merged(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) ranges joined into reads: (start, end, the ranges inside)."""
    out: list = []
    for offset, length in sorted(ranges):
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], offset + length)
            out[-1][2].append((offset, length))
        else:
            out.append([offset, offset + length, [(offset, length)]])
    return [tuple(x) for x in out]


def read(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the given index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).

    A task takes one span of one archive, whatever the record sizes; an index row given twice gives its record twice.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads

    def fetch(group: pd.DataFrame) -> pd.DataFrame:
        fs, path = _open(group["file"].iloc[0])
        rows = []
        with fs.open_input_file(path) as f:
            for start, end, inside in merged(list(zip(group["offset"].tolist(), group["length"].tolist()))):
                f.seek(start)
                data = f.read(end - start)
                for offset, length in inside:
                    rows.append(parse(zlib.decompress(data[offset - start: offset - start + length], 31)))
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    spans = index.select("file", "offset", "length", F.expr(f"offset div {SPAN}").alias("span"))
    # As many tasks as spans: index rows are far smaller than what they point to.
    spans = spans.repartition(max(1, spans.select("file", "span").distinct().count()), "file", "span")
    return spans.groupBy("file", "span").applyInPandas(
        fetch, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
        + ", payload binary" * payloads)


def round_trip(pages: DataFrame) -> DataFrame:
    """Every page written and read back."""
    return read(write(pages, workspace(pages.sparkSession, "warc"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", col("url"))
