"""Token ids of documents in files of independent zstandard frames with a trailing seek table.

A file is a skippable frame with the id width, frames of at most ``FRAME`` ids each, and a
skippable frame with the seek table: compressed size, plain size and checksum (low half of
xxh64 of the plain bytes) of every frame, in the layout of the public seekable format. Any zstandard
reader decompresses the whole file; a reader of some documents reads the table from the end of the file and
then only the frames that hold them. Documents lie in ascending order, back to back, so a frame holds
many short ones and a long one spans frames. An index row names the file, first id and id count of each document.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.packing import ByteCoder
from tablesmith.llm.shared import col, fresh, store, worker_cache, workspace

#: Ids of a frame, and of the part of a file that one reading task takes.
FRAME, SPAN = 65_536, 4_194_304
#: Bytes of text that one file holds, about.
FILE_BYTES = 128 * 1024 * 1024
LEVEL = 3
# Fixed values of the frame formats.
SKIPPABLE, SEEK_TABLE, FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
INDEX = "doc_id long, part int, file string, first long, n_tokens long"


def _open(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64(data).intdigest() & 0xFFFFFFFF


def head(width: int) -> bytes:
    """The leading frame: bytes of an id."""
    return struct.pack("<IIB", SKIPPABLE, 1, width)


def seek_table(entries: list[tuple[int, int, int]]) -> bytes:
    """The trailing frame of (compressed size, plain size, checksum) rows."""
    body = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), CHECKSUMS, FOOTER)
    return struct.pack("<II", SEEK_TABLE, len(body)) + body


class FrameWriter:
    """Writes ids to a stream, frame by frame; at most one frame is held."""

    def __init__(self, out, width: int, frame: int = FRAME, level: int = LEVEL):
        import zstandard

        self.out, self.width, self.size = out, width, frame * width
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True).compress
        self.held, self.entries = bytearray(), []
        out.write(head(width))

    def add(self, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit integers."""
        self.held += ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        at = 0
        while len(self.held) - at >= self.size:
            self._frame(bytes(self.held[at: at + self.size]))
            at += self.size
        del self.held[:at]

    def _frame(self, plain: bytes) -> None:
        packed = self.pack(plain)
        self.out.write(packed)
        self.entries.append((len(packed), len(plain), checksum(plain)))

    def close(self) -> None:
        if self.held:
            self._frame(bytes(self.held))
        self.out.write(seek_table(self.entries))
        self.out.close()


class FrameReader:
    """Reads ids of any range of a file; only the frames that hold it are read, checked and decompressed."""

    def __init__(self, f, size: int):
        import zstandard

        f.seek(0)
        magic, length, self.width = struct.unpack("<IIB", f.read(9))
        f.seek(size - 9)
        n, flags, footer = struct.unpack("<IBI", f.read(9))
        if magic != SKIPPABLE or length != 1 or footer != FOOTER or flags != CHECKSUMS:
            raise ValueError("not a file of id frames")
        f.seek(size - 9 - 12 * n)
        table = np.frombuffer(f.read(12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.f, self.unpack, self.sums = f, zstandard.ZstdDecompressor().decompress, table[:, 2]
        self.places = 9 + np.concatenate([[0], np.cumsum(table[:, 0])])
        self.ends = np.cumsum(table[:, 1])
        self.at, self.plain = -1, b""

    def _frame(self, k: int) -> bytes:
        if k != self.at:
            self.f.seek(int(self.places[k]))
            plain = self.unpack(self.f.read(int(self.places[k + 1] - self.places[k])))
            if checksum(plain) != self.sums[k]:
                raise ValueError(f"damaged frame {k}")
            self.at, self.plain = k, plain
        return self.plain

    def ids(self, first: int, n: int) -> bytes:
        """Ids ``first`` to ``first + n`` of the file as little-endian unsigned 32-bit integers."""
        lo, hi, out = first * self.width, (first + n) * self.width, []
        if n and hi > (self.ends[-1] if len(self.ends) else 0):
            raise ValueError("range beyond the end of the file")
        k = int(np.searchsorted(self.ends, lo, "right"))
        while lo < hi:
            begin = int(self.ends[k - 1]) if k else 0
            part = self._frame(k)[lo - begin: hi - begin]
            out.append(part)
            lo, k = lo + len(part), k + 1
        data = b"".join(out)
        return data if self.width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def write(docs: DataFrame, folder: str, file: str, ranks: str | None = None, end: int = 2, frame: int = FRAME,
          file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes every whole text, appends ``end``, writes the ids in ascending ``doc_id`` order and returns the stored index.

    Null ids come first; rows with one id follow the hash of their text. A null text counts as empty and leaves the end id
    alone. Rows are dealt out by ranges of (id, hash, row), so no group of equal rows meets in one file; give a stored table, whose
    rows keep their places when a task is run again. A file is named after its task attempt: a retried task leaves
    at worst a file that no index row names. Columns besides ``doc_id`` and ``text`` are not read; an empty table gives no files.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    keys = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.select("doc_id", "text", keys[1].alias("hash"), keys[2].alias("place"))
    order = ["doc_id", "hash", "place"]
    rows = rows.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part = worker_cache(), TaskContext.get().partitionId()
        if ("bytes", file) not in cache:
            cache["bytes", file] = ByteCoder(file, ranks)
        coder, tail = cache["bytes", file], int(end).to_bytes(4, "little")
        width = 2 if max(coder.tok.get_vocab_size(), end + 1) <= 1 << 16 else 4
        name = f"{folder}/ids/part-{part:05d}-{uuid.uuid4().hex}.ids.zst"
        out, at = None, 0
        for batch in batches:
            first, count = [], []
            for body in batch.column(1):
                if out is None:
                    fs, path = _open(name)
                    fs.create_dir(path.rpartition("/")[0])
                    out = FrameWriter(fs.open_output_stream(path, compression=None), width, frame)
                ids = coder.encode(body.as_py()) + tail
                out.add(ids)
                first.append(at)
                count.append(len(ids) // 4)
                at += count[-1]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * n, pa.int32()), pa.array([name] * n), pa.array(first, pa.int64()), pa.array(count, pa.int64())],
                names=["doc_id", "part", "file", "first", "n_tokens"])
        if out is not None:
            out.close()

    return store(rows.mapInArrow(put, INDEX), f"{folder}/index")


def starts(index: DataFrame) -> DataFrame:
    """One row for each file: its name and the ids in all files before it."""
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    # One row for each written file, so this running sum stays small in one task.
    return files.select("file", F.expr("sum(n) OVER (ORDER BY part, file) - n").alias("before"))


def read(index: DataFrame, ids: bool = False, span: int = SPAN) -> DataFrame:
    """Documents of the given index rows, read from the files: doc_id, file, first, n_tokens, ids_crc32 (and ids, 32-bit little-endian).

    A task takes the documents that begin in one span of one file; an index row given twice gives its document twice.
    """
    names = ["doc_id", "file", "first", "n_tokens", "ids_crc32"] + ["ids"] * ids

    def fetch(group: pd.DataFrame) -> pd.DataFrame:
        fs, path = _open(group["file"].iloc[0])
        group = group.sort_values("first")
        with fs.open_input_file(path) as f:
            reader = FrameReader(f, f.size())
            data = [reader.ids(a, n) for a, n in zip(group["first"].tolist(), group["n_tokens"].tolist())]
        group = group.assign(ids_crc32=[zlib.crc32(x) for x in data], n_tokens=[len(x) // 4 for x in data])
        return (group.assign(ids=data) if ids else group)[names].astype({"doc_id": "Int64"})

    part, = fresh(index, "span")
    rows = index.select("doc_id", "file", "first", "n_tokens", F.expr(f"first div {span}").alias(part))
    rows = rows.repartition(max(1, rows.select("file", part).distinct().count()), "file", part)
    return rows.groupBy("file", col(part)).applyInPandas(
        fetch, "doc_id long, file string, first long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def token_files(docs: DataFrame, file: str, ranks: str | None = None) -> DataFrame:
    """Every document written and read back: its place among all ids, id count and checksum."""
    index = write(docs, workspace(docs.sparkSession, "ids"), file, ranks)
    return read(index).join(starts(index), "file").select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
