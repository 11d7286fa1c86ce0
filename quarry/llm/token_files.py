"""Token-id files of independent zstandard frames with a trailing seek table.

A file is valid zstandard and follows the public seekable format: frames that
each hold whole documents, one frame with the document index, and a skippable
frame with, for each frame, its compressed and plain size and the low 32 bits
of its XXH64 sum.  A reader gets the table from the end of the file, then
fetches and checks only the frames that hold the documents it wants.

Documents are dealt to files by ranges of doc_id and sorted within, so the
files in their order hold all documents in ascending order.  A task holds one
frame at a time.

Defined cases: a null or empty text has the end id alone; null ids come first;
repeated ids and rows are all written, ties in the order of a hash of their texts;
a very long text is encoded whole and gets a frame of its own; a vocabulary of more
than 65,536 entries is refused, since ids have two bytes; an empty table gives no
files and no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.storage import create, materialize, new_path, open_at
from quarry.llm.tokens import encoder

#: Plain bytes after which a frame ends, and text bytes of a file.
FRAME_BYTES, FILE_BYTES = 1 << 18, 32 << 20
#: Fixed values of the seekable format: its skippable frame, its footer, the flag for checksums.
SKIPPABLE_MAGIC, SEEK_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Of the document index: id, whether it is null, its frame, and how many ids it has.
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("n", "<u8")])
#: Rows of the index that are read at once.
BATCH_DOCS = 4096


class FrameWriter:
    """Appends documents to an open file."""

    def __init__(self, out):
        self.out, self.table, self.index = out, [], []
        self.pending, self.pending_bytes, self.tokens = [], 0, 0
        self.zstd = zstandard.ZstdCompressor(level=1, write_checksum=False)

    def _frame(self, plain: bytes) -> None:
        packed = self.zstd.compress(plain)
        self.out.write(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.pending:
            self._frame(b"".join(self.pending))
            self.pending, self.pending_bytes = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: two bytes each."""
        if self.pending_bytes + len(ids) > FRAME_BYTES:
            self._flush()
        self.pending.append(ids)
        self.pending_bytes += len(ids)
        self.tokens += len(ids) // 2
        self.index.append((doc_id or 0, doc_id is None, len(self.table), len(ids) // 2))

    def close(self) -> None:
        self._flush()
        self._frame(np.array(self.index, dtype=INDEX).tobytes())
        body = b"".join(struct.pack("<3I", *t) for t in self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<2I", SKIPPABLE_MAGIC, len(body)) + body)


class FrameReader:
    """Reads documents of a file; ``frames_read`` counts what was decompressed."""

    def __init__(self, uri: str):
        self.file, self.frames_read = open_at(uri), 0
        n, flags, magic = struct.unpack("<IBI", self._bytes(self.file.size() - 9, 9))
        if magic != SEEK_MAGIC or not flags & CHECKSUMS:
            raise ValueError(f"{uri} has no seek table with checksums")
        self.table = np.frombuffer(self._bytes(self.file.size() - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.index = np.frombuffer(self._frame(n - 1), INDEX)

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _frame(self, k: int) -> bytes:
        packed, plain, check = map(int, self.table[k])
        data = zstandard.ZstdDecompressor().decompress(self._bytes(int(self.starts[k]), packed), max_output_size=plain)
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        self.frames_read += 1
        return data

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in this file, and ids; of the wanted documents, or of all."""
        starts = np.concatenate([[0], np.cumsum(self.index["n"], dtype=np.int64)])
        frame, data, at = -1, b"", 0
        for k, (doc_id, null, of, n) in enumerate(self.index.tolist()):
            if of != frame:
                frame, data, at = of, None, 0
            if wanted is None or not null and doc_id in wanted:
                if data is None:
                    data = self._frame(frame)
                yield None if null else doc_id, int(starts[k]), np.frombuffer(data, "<u2", n, at)
            at += 2 * n

    def close(self) -> None:
        self.file.close()


def write_files(docs: DataFrame, vocabulary: str, end_id: int, drops_space: bool, folder: str) -> DataFrame:
    """Writes all documents; returns one row per file: part, uri, n_docs, n_tokens."""
    end = np.array([end_id], dtype="<u2").tobytes()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(vocabulary, drops_space)
        uri = f"{folder}/tokens-{part:06d}.zst"
        batches = (b for b in batches if b.num_rows)
        if (first := next(batches, None)) is None:
            return
        with create(uri) as out:
            writer = FrameWriter(out)
            for b in (x for some in ([first], batches) for x in some):
                ids = encode([t or "" for t in b.column(1).to_pylist()])
                for doc_id, x in zip(b.column(0).to_pylist(), ids, strict=True):
                    writer.add(doc_id, x + end)
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "n_docs": [len(writer.index)], "n_tokens": [writer.tokens]})

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    # Rows of one id, or of none, may go to several files, and so may equal rows, whose order is free.
    numbered = slim.withColumn("row", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(int(size // FILE_BYTES) + 1, "doc_id", "tie", "row").drop("row").sortWithinPartitions("doc_id", "tie", "text")
    return materialize(ranged.mapInArrow(write, "part long, uri string, n_docs long, n_tokens long"), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, read from the files."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader = FrameReader(uri)
                try:
                    some: list[tuple] = []
                    for doc_id, start, ids in reader.documents():
                        some.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(some) == BATCH_DOCS:
                            yield rows(some)
                            some = []
                    if some:
                        yield rows(some)
                finally:
                    reader.close()

    def rows(some: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    based = files.select("uri", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return based.repartition(max(1, files.count()), "uri").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int, drops_space: bool) -> DataFrame:
    return read_files(write_files(docs, vocabulary, end_id, drops_space, new_path(spark, "tokens")))
