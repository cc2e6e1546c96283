"""WARC archives in seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, read, spread

#: Uncompressed bytes after which a frame, and records after which a bundle ends.
FRAME_BYTES, BUNDLE_RECORDS = 1 << 18, 20_000
RUNS = 64
#: Bundles for each task that reads archives back.
BUNDLES = 4
# The seekable format: a skippable frame at the end holds the sizes of all frames before it.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX = "id string, bundle string, frame int, frame_at long, offset long, length long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(value: str | None) -> str:
    return "<urn:row:null>" if value is None else f"<urn:row:v:{quote(value, safe='')}>"


def _from_urn(urn: str) -> str | None:
    return None if urn == "<urn:row:null>" else unquote(urn[len("<urn:row:v:") : -1])


def record(row_id: str | None, uri: str | None, payload: bytes, refers_to: str | None = None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(row_id)), ("WARC-Date", DATE)]
    if uri is not None:
        head.append(("WARC-Target-URI", quote(uri, safe="%/:?&=#+,;@!$'()*~[]")))
    head += [("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("X-Payload-Bytes", str(len(payload)))]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    else:
        block += payload
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes | memoryview, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, end) of the record at an offset; ValueError if there is none."""
    data = bytes(data) if not isinstance(data, bytes) else data
    end = data.find(b"\r\n\r\n", at)
    if data[at : at + 10] != b"WARC/1.1\r\n" or end < 0:
        raise ValueError(f"no WARC record at {at}")
    headers = dict(line.split(": ", 1) for line in data[at + 10 : end].decode().split("\r\n"))
    start, size = end + 4, int(headers["Content-Length"])
    block = data[start : start + size]
    if len(block) != size or data[start + size : start + size + 4] != b"\r\n\r\n":
        raise ValueError(f"a broken WARC record at {at}")
    return headers, block[block.index(b"\r\n\r\n") + 4 :], start + size + 4


@dataclass
class BundleWriter:
    """Frames of whole records, then the seek table. add() returns (frame, frame's place, offset in the frame, length)."""

    out: object
    frame_bytes: int = FRAME_BYTES
    level: int = 3
    sizes: list[tuple[int, int]] = field(default_factory=list)
    _parts: list[bytes] = field(default_factory=list)
    _size: int = 0
    _at: int = 0

    def add(self, data: bytes) -> tuple[int, int, int, int]:
        if self._size and self._size + len(data) > self.frame_bytes:
            self._end_frame()
        place = (len(self.sizes), self._at, self._size, len(data))
        self._parts.append(data)
        self._size += len(data)
        return place

    def _end_frame(self) -> None:
        if self._parts:
            frame = zstandard.ZstdCompressor(level=self.level).compress(b"".join(self._parts))
            self.out.write(frame)
            self.sizes.append((len(frame), self._size))
            self._at += len(frame)
            self._parts, self._size = [], 0

    def close(self) -> None:
        self._end_frame()
        table = b"".join(struct.pack("<II", a, b) for a, b in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


def seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(place, compressed size, size) of each frame, read from the end of the file."""
    f.seek(size - 9)
    frames, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    f.seek(size - 9 - entry * frames)
    raw, out, at = f.read(entry * frames), [], 0
    for k in range(frames):
        a, b = struct.unpack_from("<II", raw, k * entry)
        out.append((at, a, b))
        at += a
    return out


def read_record(bundle: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its frame and the offset in it; reads the seek table and that frame only."""
    files, path = fs.FileSystem.from_uri(bundle)
    with files.open_input_file(path) as f:
        at, packed, size = seek_table(f, f.size())[frame]
        f.seek(at)
        data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=size)
    return parse_record(data, offset)[:2]


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + (path[5:] if path.startswith("file:") else path)


def _write(folder: str, bundle_records: int, frame_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        writer, name, rows, stream = None, "", [], None

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["id", "bundle", "frame", "frame_at", "offset", "length"])
            rows.clear()
            return out

        for batch in batches:
            for row_id, uri, html, ref in zip(*(batch.column(k) for k in range(4)), strict=True):
                if writer is None:
                    # a name of its own for each attempt: the index lists the files of those that ended well
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    stream = files.open_output_stream(f"{root}/{name}", compression=None)
                    writer = BundleWriter(stream, frame_bytes)
                ref, row_id = ref.as_py(), row_id.as_py()
                payload = (html.as_py() or "").encode()
                rows.append((row_id, f"{folder}/{name}", *writer.add(record(row_id, uri.as_py(), payload, ref, ref is not None))))
                if len(rows) >= bundle_records:
                    writer.close()
                    stream.close()
                    writer = None
                    yield flush()
        if writer is not None:
            writer.close()
            stream.close()
            yield flush()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every record of the bundles: a frame at a time, digests and sizes worked out from the payloads."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for bundle in batch.column(0).to_pylist():
            files, path = fs.FileSystem.from_uri(bundle)
            with files.open_input_file(path) as f:
                for at, packed, size in seek_table(f, f.size()):
                    f.seek(at)
                    data, k, out = unpack.decompress(f.read(packed), max_output_size=size), 0, []
                    while k < len(data):
                        h, payload, k = parse_record(data, k)
                        kind, digest, n = h["WARC-Type"], payload_digest(payload), len(payload)
                        if kind == "revisit":
                            digest, n = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Bytes"])
                        elif h["WARC-Payload-Digest"] != f"sha1:{digest}":
                            raise ValueError(f"{bundle}: the payload of {h['WARC-Record-ID']} has another digest")
                        out.append((_from_urn(h["WARC-Record-ID"]), n, digest, kind, _from_urn(h["WARC-Refers-To"]) if kind == "revisit" else None))
                    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _sha1(payload_col: str):
    return F.unhex(F.sha1(F.coalesce(F.col(payload_col), F.lit("")).cast("binary")))


def revisits(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """(id, digest, ref): rows whose payload, of at least least_bytes bytes, a row with a smaller id has; ref is the smallest id.

    The digests meet by (run, digest) first, so that a payload of a third of all rows meets in no task as a whole.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    slim = pages.select(F.col(id_col).alias("id"), F.octet_length(payload).alias("payload_bytes"), _sha1(payload_col).alias("digest"))
    slim = materialize(slim.where(F.col("payload_bytes") >= least_bytes).withColumn("run", spread("id", RUNS)), "payloads")
    first = slim.groupBy("run", "digest", "payload_bytes").agg(F.min("id").alias("ref"), F.count("*").alias("n"))
    best = first.groupBy("digest", "payload_bytes").agg(F.min("ref").alias("ref"), F.sum("n").alias("n")).where("n > 1")
    back = first.select("run", "digest", "payload_bytes").join(best, ["digest", "payload_bytes"])
    return slim.join(back, ["run", "digest", "payload_bytes"]).where("id <> ref").select("id", "digest", "ref").distinct()


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
    least_bytes: int = 0, bundle_records: int = BUNDLE_RECORDS, frame_bytes: int = FRAME_BYTES,
) -> DataFrame:
    """Writes a WARC record for every row into bundles in folder; returns the index, a table in the shared folder.

    A bundle (.warc.zst) is a row of independent Zstandard frames of whole records and a seek table at its end; the
    index maps id to bundle, frame, the frame's place, the record's offset in the frame's content and its length. Of
    rows with equal payloads of at least least_bytes bytes that with the smallest id is a response and the others
    revisit it. Null payloads are empty, a null id or uri is kept as such (a null id is never a revisit); rows that
    repeat an id are written each. An empty table gives an empty index and no bundle.
    """
    folder = _uri(folder)
    again = materialize(revisits(pages, id_col, payload_col, least_bytes), "revisits")
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.col(payload_col).alias("html"), _sha1(payload_col).alias("digest"))
    rows = rows.join(again, ["id", "digest"], "left").select(F.col("id").cast("string"), "uri", "html", F.col("ref").cast("string"))
    return materialize(rows.mapInArrow(_write(folder, bundle_records, frame_bytes), INDEX), "index")


def read_warc(index: DataFrame) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every record in the bundles of an index.

    The bundles are counted and dealt to tasks of about BUNDLES each; by their few bytes alone they would all go to one.
    An empty index gives an empty result.
    """
    bundles = materialize(index.select("bundle").distinct(), "bundles")
    return bundles.repartition(max(1, -(-bundles.count() // BUNDLES)), F.xxhash64("bundle")).mapInArrow(
        _read, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    index = write_warc(pages, new_path(spark, "warc"))
    kind = dict(pages.dtypes)["page_id"]
    return read_warc(index).select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
