"""WARC archives: writing, normalising monolithic gzip files, reading back.

Many tools gzip a whole WARC file as one stream, which has to be inflated from
its start for any record. ``normalise`` inflates each such stream once, writes
every record as a gzip member of its own, and writes a sidecar index of
(offset, length) beside the archive, so that any record can be read alone.

All three steps run one task per file and stream; a task holds one record.
Files are written under names that belong to one task attempt and are listed
in a manifest table; a file of a lost or repeated attempt is in no manifest
and is never read. Files are opened through pyarrow.fs, so the folder may be
any URI that pyarrow knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 1 << 20
LEVEL = 3  # gzip level
FILE_BYTES = 1 << 30  # a task starts another file beyond this many bytes of records
MANIFEST = "path string, records long, bytes long"
NORMALISED = "path string, index_path string, records long, bytes long"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def digest_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def mark_revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", payload_col: str = "payload") -> DataFrame:
    """Adds ``refers_to``: null for a response, else the id of its response.

    Of rows with equal payloads of at least ``min_bytes`` bytes that with the
    smallest id is the response. Equality is by SHA-1 and length. Rows with a
    null id are never referred to; if all rows of a payload have null ids, all
    are responses. Repeated ids with equal payloads are responses alike. The
    smallest ids are aggregated map-side, so a payload with a third of all
    rows is a hot key only in the join, which Spark splits.
    """
    rows = pages.withColumn("_digest", F.sha1(payload_col)).withColumn("_size", F.octet_length(payload_col))
    first = rows.groupBy("_digest", "_size").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = first.filter((F.col("_n") > 1) & (F.col("_size") >= min_bytes)).drop("_n")
    joined = rows.join(first, ["_digest", "_size"], "left")
    is_copy = F.coalesce(F.col(id_col) != F.col("_first"), F.col("_first").isNotNull())
    return joined.withColumn("refers_to", F.when(is_copy, F.col("_first"))).drop("_digest", "_size", "_first")


def _header(value: object) -> str:
    """A header value: control characters as percent escapes, so that no line break gets in."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(value))


def record_bytes(record_id: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """One WARC record. A revisit has the HTTP head of the full payload and no body."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if record_id is None else _header(record_id)}>",
        f"WARC-Target-URI: {_header(url or '')}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest_base32(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{_header(refers_to)}>",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _new_name(folder: str, ending: str) -> str:
    return f"{folder}/{uuid.uuid4().hex}{ending}"


def write_monolithic(records: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Write one archive (more beyond FILE_BYTES) per task, each one gzip stream;
    returns the manifest (path, records, bytes). Empty tasks write no file.

    ``records`` has the id, the url, ``payload`` (binary, not null) and ``refers_to``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        out = gz = None
        done: list[dict] = []
        for batch in batches:
            for key, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    done.append({"path": _new_name(folder, ".warc.gz"), "records": 0, "bytes": 0})
                    out = fs.open_output_stream(open_fs(done[-1]["path"])[1], compression=None)
                    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = record_bytes(key, url, payload, refers_to)
                out.write(gz.compress(data))
                done[-1]["records"] += 1
                done[-1]["bytes"] += len(data)
                if done[-1]["bytes"] >= FILE_BYTES:
                    out.write(gz.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(gz.flush())
            out.close()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    rows = records.select(id_col, url_col, "payload", "refers_to")
    return materialize(rows.mapInArrow(write, MANIFEST), "warc-manifest")


class Inflated:
    """Reads a gzip file (one member or many) as one stream of bytes."""

    def __init__(self, raw):
        self.raw, self.buffer, self.inflate, self.fed = raw, bytearray(), zlib.decompressobj(31), False

    def fill(self, n: int) -> bool:
        """Have at least ``n`` bytes in the buffer; False at the end of the file."""
        while len(self.buffer) < n:
            data = self.inflate.unused_data if self.inflate.eof else b""
            data = data or self.raw.read(BLOCK)
            if not data:
                if self.fed and not self.inflate.eof:
                    raise ValueError("truncated gzip stream")
                return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            self.fed = True
            self.buffer += self.inflate.decompress(data)
        return True

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError("truncated record")
        data = bytes(self.buffer[:n])
        del self.buffer[:n]
        return data

    def head(self) -> bytes | None:
        """Up to and with the next empty line; None at the end."""
        at, size = -1, 0
        while at < 0:
            at = self.buffer.find(b"\r\n\r\n", max(0, size - 3))
            if at < 0:
                size = len(self.buffer)
                if not self.fill(size + 1):
                    if size:
                        raise ValueError("truncated record head")
                    return None
        return self.take(at + 4)


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def stream_records(raw) -> Iterator[bytes]:
    """Every whole record of a gzipped archive, in order."""
    source = Inflated(raw)
    while (head := source.head()) is not None:
        rest = source.take(int(parse_head(head)["content-length"]) + 4)
        if not rest.endswith(b"\r\n\r\n"):
            raise ValueError("a record does not end where its length says")
        yield head + rest


def _one_file_per_task(manifest: DataFrame) -> DataFrame:
    n = manifest.count()
    return manifest.repartition(max(1, n))  # the rows name files; a handful of bytes each


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of ``manifest`` with a gzip member per record and a
    sidecar index (one JSON line per record: offset, length, type, id).

    The input may be one gzip stream or any number of members. Returns
    (path, index_path, records, bytes). A truncated or malformed archive
    raises. An empty manifest gives an empty one.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, source = open_fs(path)
                target = _new_name(folder, ".warc.gz")
                index = target.replace(".warc.gz", ".idx")
                to, place = open_fs(target)
                to.create_dir(place.rpartition("/")[0], recursive=True)
                offset = count = 0
                with (
                    fs.open_input_stream(source, compression=None) as raw,
                    to.open_output_stream(place, compression=None) as out,
                    to.open_output_stream(open_fs(index)[1], compression=None) as side,
                ):
                    for data in stream_records(raw):
                        gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = gz.compress(data) + gz.flush()
                        out.write(member)
                        about = parse_head(data[: data.index(b"\r\n\r\n") + 4])
                        entry = {"offset": offset, "length": len(member), "type": about["warc-type"], "id": about["warc-record-id"]}
                        side.write(json.dumps(entry).encode() + b"\n")
                        offset += len(member)
                        count += 1
                yield pa.RecordBatch.from_pylist([{"path": target, "index_path": index, "records": count, "bytes": offset}])

    return materialize(_one_file_per_task(manifest).mapInArrow(rewrite, NORMALISED), "warc-normalised")


def read_index(index_path: str) -> list[dict]:
    fs, at = open_fs(index_path)
    with fs.open_input_stream(at, compression=None) as f:
        return [json.loads(x) for x in f.read().splitlines()]


def read_record(raw, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Head fields and block of the record whose member lies at ``offset``."""
    raw.seek(offset)
    data = zlib.decompress(raw.read(length), 31)
    at = data.index(b"\r\n\r\n") + 4
    return parse_head(data[:at]), data[at:-4]


def _urn_id(value: str | None) -> str | None:
    value = (value or "")[len("<urn:page:") : -1]
    return value or None


def read_records(normalised: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of normalised archives, each read through the sidecar index.

    Columns: record_id, url, record_type, refers_to (text; null where none),
    payload_bytes, payload_digest (of the full payload, also for revisits) and
    payload (null for revisits, or if not asked for). A response whose payload
    does not have the digest and size in its head raises.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(c, pa.string()) for c in ("record_id", "url", "record_type", "refers_to")]
            + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
        )
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = open_fs(path)
                rows: list[dict] = []
                size = 0
                with fs.open_input_file(at) as raw:
                    for entry in read_index(index):
                        head, block = read_record(raw, entry["offset"], entry["length"])
                        http, _, body = block.partition(b"\r\n\r\n")
                        fields = dict(x.lower().split(b": ", 1) for x in http.split(b"\r\n")[1:])
                        n = int(fields[b"content-length"])
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        response = head["warc-type"] == "response"
                        if response and (len(body) != n or digest_base32(body) != digest):
                            raise ValueError(f"payload of {head['warc-record-id']} is not what its head says")
                        rows.append(
                            {
                                "record_id": _urn_id(head["warc-record-id"]),
                                "url": head["warc-target-uri"],
                                "record_type": head["warc-type"],
                                "refers_to": _urn_id(head.get("warc-refers-to")),
                                "payload_bytes": n,
                                "payload_digest": digest,
                                "payload": body if response and payloads else None,
                            }
                        )
                        size += len(body) if payloads else 200
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    out = "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    return _one_file_per_task(normalised.select("path", "index_path")).mapInArrow(read, out)


def archive(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as monolithic archives under ``folder`` and normalise them.

    One record per row, payload the html in UTF-8 (null: empty). Nulls in the
    url are an empty url. Returns the normalised manifest.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = mark_revisits(pages.select(id_col, url_col, payload.alias("payload")), min_bytes, id_col)
    return normalise(write_monolithic(rows, f"{folder}/raw", id_col, url_col), f"{folder}/normalised")
