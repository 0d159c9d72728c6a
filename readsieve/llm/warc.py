"""WARC archives: writing, normalising whole-file gzip streams, and reading by offset.

A crawler that compresses its output as one gzip stream leaves a file that can only be
read from its start. ``normalise`` inflates such a file once, rewrites every record as a
gzip member of its own and writes a sidecar index of their offsets, so that any record
can be read alone. The same pass can turn records into revisits of a record with the
same payload; the revisit keeps the digest and the length and names the other record.

Files lie in the folder that all executors share and are opened through Arrow's file
systems. A task names its files afresh, and only files in the written list of a
finished task are read, so lost executors and repeated tasks leave no half file in
use. Files pass through tasks as streams; memory holds a record at a time, and the
places of one file's records.

Pages without html (null or empty) have an empty payload. Pages without url have no
target. Pages without page_id are records too; they are response only where no page of
the same payload has an id. Rows that repeat a page_id get the same type. A stream that
is cut off or no gzip stream raises an error that names the file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readsieve.session import cut, fresh_path

FILE_BYTES = 64 << 20
CHUNK = 1 << 20
LEVEL = 6

# Fixed values of the format.
VERSION = "WARC/1.1"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ID_PREFIX = "urn:page:"
NO_ID = "none"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ------------------------------------------------------------------- records


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def to_bytes(self) -> bytes:
        headers = {**self.headers, "Content-Length": str(len(self.block))}
        head = "".join(f"{name}: {value}\r\n" for name, value in headers.items())
        return f"{VERSION}\r\n{head}\r\n".encode() + self.block + b"\r\n\r\n"

    @property
    def payload(self) -> bytes:
        """What follows the HTTP head."""
        return self.block[self.block.index(b"\r\n\r\n") + 4 :]


def _clean(value: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in value)


def _urn(page_id: int | None) -> str:
    return f"<{ID_PREFIX}{NO_ID if page_id is None else page_id}>"


def _page_id(urn: str) -> int | None:
    found = urn.strip("<>").removeprefix(ID_PREFIX)
    return None if found == NO_ID else int(found)


def page_record(page_id: int | None, url: str | None, html: str | None) -> Record:
    payload = (html or "").encode()
    headers = {"WARC-Type": "response", "WARC-Record-ID": _urn(page_id), "WARC-Date": DATE}
    if url is not None:
        headers["WARC-Target-URI"] = _clean(url)
    headers["WARC-Payload-Digest"] = f"sha1:{digest_of(payload)}"
    headers["X-Payload-Length"] = str(len(payload))
    headers["Content-Type"] = "application/http;msgtype=response"
    return Record(headers, HTTP_HEAD + payload)


def to_revisit(record: Record, refers_to: int) -> Record:
    """The record without its payload, which the record ``refers_to`` has."""
    headers = {**record.headers, "WARC-Type": "revisit", "WARC-Refers-To": _urn(refers_to), "WARC-Profile": PROFILE}
    return Record(headers, record.block[: record.block.index(b"\r\n\r\n") + 4])


class _Inflated:
    """Bytes of a gzip stream of one member or more, asked for in pieces."""

    def __init__(self, source: BinaryIO, name: str):
        self.source, self.name = source, name
        self.inflater = zlib.decompressobj(wbits=31)
        self.held, self.at, self.packed = bytearray(), 0, b""

    def _more(self) -> bool:
        """Inflate another piece; False at the end of the file."""
        while True:
            if not self.packed:
                self.packed = self.source.read(CHUNK)
                if not self.packed:
                    if not self.inflater.eof:
                        raise ValueError(f"gzip stream is cut off: {self.name}")
                    return False
            if self.inflater.eof:
                self.inflater = zlib.decompressobj(wbits=31)
            try:
                piece = self.inflater.decompress(self.packed, CHUNK)
            except zlib.error as error:
                raise ValueError(f"no gzip stream: {self.name}") from error
            self.packed = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            if piece:
                del self.held[: self.at]
                self.at = 0
                self.held += piece
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes through ``mark``; None at the end of the stream."""
        seen = 0
        while (found := self.held.find(mark, self.at + max(0, seen - len(mark)))) < 0:
            seen = len(self.held) - self.at
            if not self._more():
                if self.held[self.at :].strip():
                    raise ValueError(f"record is cut off: {self.name}")
                return None
        out = bytes(self.held[self.at : found + len(mark)])
        self.at = found + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self._more():
                raise ValueError(f"record is cut off: {self.name}")
        out = bytes(self.held[self.at : self.at + n])
        self.at += n
        return out


def read_records(source: BinaryIO, name: str) -> Iterator[Record]:
    """The records of a gzip stream in order."""
    stream = _Inflated(source, name)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode().strip("\r\n").split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        block = stream.take(int(headers.pop("Content-Length")))
        stream.take(4)
        yield Record(headers, block)


# ------------------------------------------------------------------- writing


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Archives that are one gzip stream each; returns (file, seq, page_id, digest) of their records."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        name, out, packer, size, seq = "", None, None, 0, 0

        def close() -> None:
            if out is not None:
                out.write(packer.flush())
                out.close()

        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(batch.column(i) for i in range(3))):
                record = page_record(page_id.as_py(), url.as_py(), html.as_py())
                data = record.to_bytes()
                if out is None or size > FILE_BYTES:
                    close()
                    name, size, seq = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, packer = system.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=31)
                out.write(packer.compress(data))
                rows.append((name, seq, page_id.as_py(), record.headers["WARC-Payload-Digest"].removeprefix("sha1:")))
                size += len(data)
                seq += 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                    names=["file", "seq", "page_id", "digest"],
                )
        close()

    schema = "file string, seq long, page_id long, digest string"
    return pages.select("page_id", "url", "html").mapInArrow(task, schema)


def revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """(file, seq, refers_to) of the records whose payload a record of a larger page_id has.

    Only payloads that occur more than once are joined, and only narrow rows.
    """
    shared = (
        records.groupBy(F.col("digest").alias("__d"))
        .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and refers_to is not null")
        .drop("n")
    )
    joined = records.join(shared, F.col("digest") == F.col("__d"))
    return joined.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("file", "seq", "refers_to")


def normalise(files: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each whole-file stream as members with a sidecar index.

    ``files`` has (file, changes): changes are (seq, refers_to) of records to be revisits,
    or null. Returns (archive, index, n_records) of what was written to ``target``.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from_system, from_base = opened(source)
        to_system, to_base = opened(target)
        to_system.create_dir(to_base, recursive=True)
        for batch in batches:
            for file, changes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                refers = {c["seq"]: c["refers_to"] for c in changes or []}
                name = f"{file.removesuffix('.warc.gz')}-{uuid.uuid4().hex}"
                archive, index, at, n = f"{name}.warc.gz", f"{name}.idx", 0, 0
                with (
                    from_system.open_input_stream(f"{from_base}/{file}", compression=None) as stream,
                    to_system.open_output_stream(f"{to_base}/{archive}", compression=None) as out,
                    to_system.open_output_stream(f"{to_base}/{index}", compression=None) as sidecar,
                ):
                    for n, record in enumerate(read_records(stream, file), 1):
                        if n - 1 in refers:
                            record = to_revisit(record, refers[n - 1])
                        member = zlib.compress(record.to_bytes(), LEVEL, wbits=31)
                        out.write(member)
                        entry = {"offset": at, "length": len(member), "id": record.headers["WARC-Record-ID"]}
                        sidecar.write(json.dumps(entry).encode() + b"\n")
                        at += len(member)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([archive]), pa.array([index]), pa.array([n])], names=["archive", "index", "n_records"]
                )

    return files.select("file", "changes").mapInArrow(task, "archive string, index string, n_records long")


def read_index(system: fs.FileSystem, path: str) -> Iterator[dict]:
    """The entries of a sidecar index in order."""
    held = b""
    with system.open_input_stream(path, compression=None) as stream:
        while piece := stream.read(CHUNK):
            *lines, held = (held + piece).split(b"\n")
            yield from map(json.loads, lines)


def read_member(file, offset: int, length: int, name: str) -> Record:
    """One record, from its own member."""
    file.seek(offset)
    return next(read_records(pa.BufferReader(file.read(length)), name))


def read_archives(written: DataFrame, folder: str) -> DataFrame:
    """A row for each record, each read by its offset; a response's digest is worked out again."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        for batch in batches:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with system.open_input_file(f"{base}/{archive}") as file:
                    for entry in read_index(system, f"{base}/{index}"):
                        rows.append(_described(read_member(file, entry["offset"], entry["length"], archive)))
                        if len(rows) >= 10_000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return written.select("archive", "index").mapInArrow(task, schema)


def _described(record: Record) -> tuple:
    headers = record.headers
    size, digest = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
    refers_to = None
    if headers["WARC-Type"] == "revisit":
        refers_to = _page_id(headers["WARC-Refers-To"])
    else:
        payload = record.payload
        if (len(payload), digest_of(payload)) != (size, digest):
            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    return _page_id(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"], refers_to


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """Write ``pages`` as normalised archives; returns (archive, index, n_records) and their folder."""
    spark = pages.sparkSession
    raw, final = fresh_path(spark, "warc-raw"), fresh_path(spark, "warc")
    records = cut(write_monolithic(pages, raw), "records")
    changes = revisits(records).groupBy("file").agg(
        F.collect_list(F.struct("seq", "refers_to")).alias("changes")  # no more than the records of one file
    )
    files = records.select("file").distinct().join(changes, "file", "left")
    n_files = max(1, records.select("file").distinct().count())
    return cut(normalise(files.repartition(n_files), raw, final), "archives"), final


def write_and_read(pages: DataFrame) -> DataFrame:
    written, folder = archive(pages)
    return read_archives(written.repartition(max(1, written.count())), folder)
