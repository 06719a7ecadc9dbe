"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with a group of whole WARC
records, closed by a seek table in a skippable frame (the public seekable format). The
index maps each record to its bundle, frame and offset in the frame; the frame's place in
the file comes from the seek table, so one record is read by decoding one frame.

Records with equal payloads are written once: the one with the smallest id is a response,
the others are revisits that refer to it. A task writes its own bundles under names of
its own; only the index rows of tasks that finished name a bundle, so a task that is lost
or run twice leaves nothing but an unnamed file.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh_path, materialize

FRAME_BYTES = 512 * 1024
BUNDLE_BYTES = 64 * 1024 * 1024
#: Payloads of fewer bytes are always written.
REVISIT_BYTES = 100
MAX_READERS = 20_000
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
_DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload."""
    kind = "response" if refers_to is None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", _DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size))]
    if kind == "revisit":
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    block = _HTTP + (payload if kind == "response" else b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers and block of the record at an offset, and where the next one starts."""
    stop = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:stop].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("no WARC record starts here")
    head = dict(x.split(": ", 1) for x in lines)
    begin, size = stop + 4, int(head["Content-Length"])
    if data[begin + size : begin + size + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record doesn't end where it says")
    return head, data[begin : begin + size], begin + size + 4


class BundleWriter:
    """Frames of records in a file, closed by the seek table."""

    def __init__(self, out, level: int = 3):
        self.out, self.level, self.frames, self.at = out, level, [], 0
        self.group: list[bytes] = []
        self.size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset in it of a record."""
        if self.size >= FRAME_BYTES:
            self._flush()
        place = (len(self.frames), self.size)
        self.group.append(data)
        self.size += len(data)
        return place

    def _flush(self) -> None:
        if self.group:
            packed = zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress(b"".join(self.group))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.at += len(packed)
            self.group, self.size = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


def seek_table(f) -> list[tuple[int, int]]:
    """(place, compressed size) of each frame, from the footer of an open bundle."""
    end = f.size()
    f.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    f.seek(end - 9 - n * entry)
    sizes = [struct.unpack_from("<I", x)[0] for x in [f.read(entry) for _ in range(n)]]
    places, at = [], 0
    for s in sizes:
        places.append((at, s))
        at += s
    return places


def read_frame(f, place: int, size: int) -> bytes:
    f.seek(place)
    return zstandard.ZstdDecompressor().decompress(f.read(size))


def open_bundle(path: str):
    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def read_record(path: str, frame: int, offset: int) -> tuple[dict, bytes]:
    """One record by its place in the index."""
    with open_bundle(path) as f:
        head, block, _ = parse(read_frame(f, *seek_table(f)[frame]), offset)
    return head, block


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to) of each row. Rows that tie with the
    smallest id of their payload are all responses; rows with a null id refer to it."""
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    first = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    # Written, so that the join deals both sides anew and splits a hot payload's rows.
    first = materialize(first.filter("n > 1").select("digest", "least"), "payloads")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "size", "digest", other.alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for each row of ``pages`` into bundles in ``folder`` (a path or URI
    that all executors can write) and return the index, a written table: page_id, bundle,
    frame, offset, length.

    A null payload is an empty one, a null url gives no target, a null id an empty name.
    Repeated rows give repeated records. An empty table gives no bundles. Other columns
    are ignored."""
    fs, name = pafs.FileSystem.from_uri(folder)
    fs.create_dir(name, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, name = pafs.FileSystem.from_uri(folder)
        writer, path = None, ""
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for k in range(b.num_rows):
                page_id, url, payload, size, digest, refers_to = (c[k].as_py() for c in b.columns)
                if writer is None:
                    file = f"{uuid.uuid4().hex}.warc.zst"
                    path = f"{folder}/{file}"
                    writer = BundleWriter(fs.open_output_stream(f"{name}/{file}", compression=None))
                data = record(page_id, url, payload, digest, size, refers_to)
                for out, x in zip(rows, (page_id, path, *writer.add(data), len(data)), strict=True):
                    out.append(x)
                if writer.at >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
            types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=["page_id", "bundle", "frame", "offset", "length"])
        if writer is not None:
            writer.close()

    rows = with_revisits(pages, id_col, url_col, payload_col)
    return materialize(rows.mapInArrow(run, "page_id long, bundle string, frame int, offset long, length long"), "warc-index")


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the bundles that an index names: page_id, url, record_type,
    refers_to, payload_bytes, payload_digest, payload (null for revisits). A response whose
    payload doesn't have the digest that its header gives raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                with open_bundle(path) as f:
                    for frame in seek_table(f):
                        data = read_frame(f, *frame)
                        rows, at = [], 0
                        while at < len(data):
                            head, block, at = parse(data, at)
                            rows.append(_row(head, block))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    bundles = index.select("bundle").distinct()
    # A row stands for a bundle of megabytes: dealt by number, as sizes of rows say nothing.
    tasks = max(1, min(bundles.count(), MAX_READERS))
    return bundles.repartition(tasks).mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def _row(head: dict, block: bytes) -> tuple:
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    kind, size, payload = head["WARC-Type"], int(head["X-Payload-Length"]), None
    refers_to = None
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
    else:
        refers_to = page_of(head["WARC-Refers-To"])
    return page_of(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, refers_to, size, digest, payload


def op1_warc(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    index = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM f
"""
