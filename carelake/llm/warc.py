"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about a megabyte. A bundle ends with a seek table in a skippable frame, and an index maps each
record's identifier to its bundle, its frame and its offset within the frame, so that one record costs one ranged read and one frame.
Captures whose payload was seen under a smaller identifier are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, shared_folder, staged

FRAME_BYTES, BUNDLE_BYTES, FRAMES_PER_TASK, LEVEL = 1 << 20, 256 << 20, 512, 3
#: Fixed values of the seekable format: skippable frame, footer, and of the archive format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id string, bundle string, frame int, frame_at long, frame_size long, at long, size long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{key}')}>"


def record(key: str | None, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit that names another record and carries none."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {DATE}"]
    if uri:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%20" for c in uri))
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Key: {refers_to}"]
    if key is not None:
        lines.append(f"X-Record-Key: {key}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"not a WARC record: {first[:40]}")
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


class Bundle:
    """A bundle that is being written; frames are closed when they are full, and the seek table at the end."""

    def __init__(self, folder: str):
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path)
        name = f"{uuid.uuid4().hex}.warc.zst"
        self.uri, self.out = f"{folder}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)
        self.frames: list[tuple[int, int]] = []
        self.pending, self.held, self.size, self.at = [], [], 0, 0

    def add(self, key: str | None, data: bytes) -> list[tuple]:
        """Index rows of the frame that this record closed, if it did."""
        self.held.append((key, self.size, len(data)))
        self.pending.append(data)
        self.size += len(data)
        return self.close_frame() if self.size >= FRAME_BYTES else []

    def close_frame(self) -> list[tuple]:
        if not self.pending:
            return []
        packed = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(b"".join(self.pending))
        self.out.write(packed)
        rows = [(key, self.uri, len(self.frames), self.at, len(packed), at, size) for key, at, size in self.held]
        self.frames.append((len(packed), self.size))
        self.at += len(packed)
        self.pending, self.held, self.size = [], [], 0
        return rows

    def finish(self) -> list[tuple]:
        rows = self.close_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        return rows


def seek_table(data: bytes) -> list[tuple[int, int]]:
    """(compressed, plain) sizes of a bundle's frames, from its last bytes."""
    count, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    entries = data[-9 - 8 * count : -9]
    return [struct.unpack_from("<II", entries, 8 * k) for k in range(count)]


def read_range(uri: str, at: int, size: int) -> bytes:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        f.seek(at)
        return f.read(size)


def fetch(uri: str, frame_at: int, frame_size: int, at: int, size: int) -> tuple[dict[str, str], bytes]:
    """One record by its index row."""
    plain = zstandard.ZstdDecompressor().decompress(read_range(uri, frame_at, frame_size))
    return next(records(plain[at : at + size]))


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes all rows of pages (page_id, url, html) to bundles in folder and returns their index, a table in the shared folder.

    Null html is an empty payload. Of rows with equal payloads of at least least_bytes bytes, those with the smallest page_id are responses and
    all others revisit it; null ids count as largest, and where no row has an id all are responses. A row that repeats the smallest id is the
    same capture and a response as well. Each attempt of a task writes bundles of its own; the index names those of attempts that succeeded.
    """
    limit_batches(pages.sparkSession)
    plain = pages.select("page_id", F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    plain = plain.withColumn("sum", F.sha1("payload"))
    first = staged(plain.groupBy("sum").agg(F.min("page_id").alias("first")), "payloads")
    revisit = (F.octet_length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = plain.join(first, "sum").select(F.col("page_id").cast("string"), "url", "payload", F.when(revisit, F.col("first").cast("string")).alias("refers_to"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None

        def table(out: list[tuple]) -> pa.RecordBatch:
            types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[f.split()[0] for f in INDEX.split(", ")])

        for batch in batches:
            out = []
            for key, uri, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle = bundle or Bundle(folder)
                out += bundle.add(key, record(key, uri, payload, refers_to))
                if bundle.at >= BUNDLE_BYTES:
                    out += bundle.finish()
                    bundle = None
            if out:
                yield table(out)
        if bundle and (out := bundle.finish()):
            yield table(out)

    return staged(rows.mapInArrow(put, INDEX), "archive-index")


def read(index: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records, from the bundles themselves, frame by frame."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = []
                for headers, block in records(zstandard.ZstdDecompressor().decompress(read_range(uri, at, size))):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.rsplit(b"Content-Length: ", 1)[1])
                    named = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if headers["WARC-Type"] == "response" and (len(payload) != length or digest(payload) != named):
                        raise ValueError(f"{uri}: the payload of {headers['WARC-Record-ID']} doesn't match its digest")
                    out.append((headers.get("X-Record-Key"), length, named, headers["WARC-Type"], headers.get("X-Refers-To-Key")))
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    frames = index.where("at = 0").select("bundle", "frame_at", "frame_size")
    # the rows are tiny and the frames aren't, so the number of tasks follows the frames
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, frames.count() // FRAMES_PER_TASK)
    frames = frames.repartition(tasks, F.xxhash64("bundle", "frame_at"))
    found = frames.mapInArrow(get, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages to bundles in the shared folder and returns what reading them back gives."""
    folder = f"{shared_folder(pages.sparkSession)}/archives/{uuid.uuid4().hex}"
    return read(write(pages, folder, least_bytes), pages.schema["page_id"].dataType.simpleString())
