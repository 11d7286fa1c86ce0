"""WARC archives, and the resolution of revisits.

``write_responses`` stores pages as response records, each a gzip member of its
own.  ``resolve`` shuffles the records' headers (never payloads) by payload
digest, and makes all records of a digest but one revisits of that one.
``write_resolved`` then copies the archives with fresh headers, fetching each
record by file and offset; a revisit has no payload.  ``read_records`` parses
the archives from their bytes alone, and ``follow_revisits`` joins revisits to
their original responses.

Defined cases: a null html is an empty payload, and empty payloads revisit each
other like any; of records with equal payloads the one with the largest page_id
is the response (null ids come last; of repeated ids one, by place in the
archives); repeated ids with different payloads are records of their own; a page
without url has its record's name as target; a very long html is held by its
task alone, as one record; an empty table gives no archives and no rows; further columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.skew import join_hot
from quarry.llm.storage import create, materialize, new_path, open_at

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages have no date of their own; a fixed one keeps archives repeatable.
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
HEADERS = "page_id long, url string, uri string, offset long, length long, payload_bytes long, payload_digest string"
PIECE = 1 << 16


def record_id(uri: str, offset: int) -> str:
    """Names a record by its place in the raw archives, so repeated page ids stay apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri}#{offset}')}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(kind: str, head: dict[str, object], block: bytes) -> bytes:
    """A record as a gzip member."""
    head = {"WARC-Type": kind, **head, "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + END) + z.flush()


def _block(payload: bytes | None, n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + (payload or b"")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a plain record."""
    head, _, rest = record.partition(END)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    n = int(headers["Content-Length"])
    if rest[n:] != END:
        raise ValueError("a record's length is wrong")
    return headers, rest[:n]


def payload_of(block: bytes) -> bytes:
    return block.partition(END)[2]


def _target(url: str | None, record: str) -> str:
    """A header needs a URI on one line; a page without one is named by its record."""
    return " ".join((url or "").split()) or record.strip("<>")


def _head(record: str, target: str, sum_: str, page_id: int | None) -> dict[str, object]:
    return {
        "WARC-Record-ID": record, "WARC-Date": DATE, "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{sum_}",
        "Content-Type": "application/http; msgtype=response", "X-Page-ID": page_id,
    }


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_HEADER_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("uri", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def write_responses(pages: DataFrame, folder: str) -> DataFrame:
    """One archive per task; returns the records' headers with file, offset and length."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/raw-{TaskContext.get().partitionId():06d}.warc.gz"
        batches = (b for b in batches if b.num_rows)
        if (first := next(batches, None)) is None:
            return
        with create(uri) as out:
            at = 0
            for b in (x for some in ([first], batches) for x in some):
                rows = []
                for page_id, url, payload in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    payload, record = payload or b"", record_id(uri, at)
                    sum_, url = digest(payload), _target(url, record)
                    member = _member("response", _head(record, url, sum_, page_id), _block(payload, len(payload)))
                    out.write(member)
                    rows.append((page_id, url, uri, at, len(member), len(payload), sum_))
                    at += len(member)
                yield _batch(rows, _HEADER_SCHEMA)

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode("html", "UTF-8").alias("payload"))
    return materialize(slim.mapInArrow(write, HEADERS), "warc-headers")


def resolve(headers: DataFrame) -> DataFrame:
    """Headers with the original of their payload: ``of`` (page_id, uri, offset, url); a response is its own."""
    place = F.struct(F.col("page_id").isNotNull().alias("named"), "page_id", "uri", "offset", "url")
    originals = headers.groupBy("payload_digest").agg(F.max(place).alias("of"))
    return join_hot(headers, materialize(originals, "warc-originals"), "payload_digest")


def write_resolved(resolved: DataFrame, folder: str) -> DataFrame:
    """Archives without repeated payloads, one for each raw archive; returns their names."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = source = out = opened = None
        at, done = 0, []
        for b in batches:
            for row in b.to_pylist():
                if row["uri"] != raw:
                    if opened:
                        opened.__exit__(None, None, None)
                        source.close()
                    raw, at = row["uri"], 0
                    name = f"{folder}/{raw.rpartition('/')[2].replace('raw-', 'resolved-')}"
                    source, opened = open_at(raw), create(name)
                    out = opened.__enter__()
                    done.append(name)
                of, own = row["of"], (row["uri"], row["offset"])
                head = _head(record_id(*own), row["url"], row["payload_digest"], row["page_id"])
                if (of["uri"], of["offset"]) == own:
                    source.seek(row["offset"])
                    _, block = parse(zlib.decompress(source.read(row["length"]), 31))
                    member = _member("response", head, block)
                else:
                    head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(of["uri"], of["offset"]), "WARC-Refers-To-Target-URI": of["url"], "WARC-Refers-To-Date": DATE}
                    member = _member("revisit", head, _block(None, row["payload_bytes"]))
                out.write(member)
                at += len(member)
        if opened:
            opened.__exit__(None, None, None)
            source.close()
            yield pa.RecordBatch.from_pydict({"uri": done})

    n_files = max(1, resolved.select("uri").distinct().count())
    ordered = resolved.repartition(n_files, "uri").sortWithinPartitions("uri", "offset")
    return materialize(ordered.mapInArrow(write, "uri string"), "warc-files")


def _members(uri: str) -> Iterator[bytes]:
    """The plain records of an archive, one gzip member after another."""
    source, rest = open_at(uri), b""
    try:
        while True:
            z, parts = zlib.decompressobj(31), []
            while not z.eof:
                data = rest or source.read(PIECE)
                if not data:
                    break
                parts.append(z.decompress(data))
                rest = z.unused_data
            if not parts:
                return
            if not z.eof:
                raise ValueError(f"{uri} ends within a record")
            yield b"".join(parts)
    finally:
        source.close()


_RECORD_SCHEMA = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string())])
RECORDS = "record_id string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to_id string"


def read_records(files: DataFrame) -> DataFrame:
    """One row per record of the archives; a revisit's payload is not in its file, so it has no length here."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = []
                for record in _members(uri):
                    h, block = parse(record)
                    page = int(h["X-Page-ID"]) if "X-Page-ID" in h else None
                    said = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response":
                        payload = payload_of(block)
                        if digest(payload) != said:
                            raise ValueError(f"a payload in {uri} does not match its digest")
                        rows.append((h["WARC-Record-ID"], page, "response", len(payload), said, None))
                    else:
                        rows.append((h["WARC-Record-ID"], page, "revisit", None, said, h["WARC-Refers-To"]))
                    if len(rows) == 2048:
                        yield _batch(rows, _RECORD_SCHEMA)
                        rows = []
                if rows:
                    yield _batch(rows, _RECORD_SCHEMA)

    return files.repartition(max(1, files.count()), "uri").mapInArrow(read, RECORDS)


def follow_revisits(records: DataFrame) -> DataFrame:
    """Records with the length of the full payload and the page that a revisit refers to; one original may have any number of revisits."""
    originals = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("of_page"), F.col("payload_bytes").alias("of_bytes"))
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes", "record_id")
    revisits = join_hot(revisits, originals, "refers_to_id")
    out = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    own = records.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*out)
    return own.unionByName(revisits.select("page_id", F.col("of_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("of_page").alias("refers_to")))


def deduplicate_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages to archives, resolved, and back."""
    folder = new_path(spark, "warc")
    files = write_resolved(resolve(write_responses(pages, f"{folder}/raw")), f"{folder}/resolved")
    return follow_revisits(materialize(read_records(files), "warc-records"))
