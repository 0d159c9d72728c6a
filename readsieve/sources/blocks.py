"""Blocked gzip: files of small members whose headers give their own sizes.

A member's header has an extra field ``BC`` with its size, so the members of a file can
be walked without inflating them, and a reader can begin at any of them. A file is cut
into ranges of packed bytes. Each range looks for the first member that begins in it and
walks to the range's end; only if the ranges of a file meet there without a gap, from its
first byte to its last, are they the file's members. Sizes at the members' ends add up to
where each range begins in the unpacked file.

Any other gzip file is one stream and can't be cut.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame

# The start of a member with an extra field, the name of the subfield with
# its size, the longest member, and the empty member that ends a file.
MAGIC = b"\x1f\x8b\x08\x04"
SIZE_FIELD = b"BC"
MEMBER_BYTES = 1 << 16
LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")

# Inflated bytes of a member that is written; its packed form is always shorter than the limit.
BLOCK = 0xFF00
# Packed bytes read at a time; a range may be no longer than a member.
_AHEAD = 4 * MEMBER_BYTES
_HEAD = 12  # bytes before the extra fields
_TAIL = 8  # checksum and unpacked size


def member_bytes(data: bytes, at: int = 0) -> int | None:
    """The size of the member that begins at ``at``, or None if none surely does."""
    if data[at : at + 4] != MAGIC or len(data) < at + _HEAD:
        return None
    (extra,) = struct.unpack_from("<H", data, at + 10)
    field, end = at + _HEAD, at + _HEAD + extra
    while field + 4 <= min(end, len(data)):
        (long,) = struct.unpack_from("<H", data, field + 2)
        if data[field : field + 2] == SIZE_FIELD and long == 2 and field + 6 <= len(data):
            return struct.unpack_from("<H", data, field + 4)[0] + 1
        field += 4 + long
    return None


def is_blocked(stream: BinaryIO) -> bool:
    """Does a file begin with such a member? Leaves the stream at its start."""
    head = stream.read(MEMBER_BYTES)
    stream.seek(0)
    return member_bytes(head) is not None


def inflate(member: bytes) -> bytes:
    return zlib.decompress(member, wbits=31)


def _members(stream: BinaryIO, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, member) from a member's start to the file's end, or to what is none."""
    stream.seek(at)
    held, begin = b"", 0
    while True:
        if len(held) - begin < MEMBER_BYTES:
            held, begin = held[begin:] + stream.read(_AHEAD), 0
        size = member_bytes(held, begin)
        if size is None or begin + size > len(held):
            return
        yield at, held[begin : begin + size]
        begin, at = begin + size, at + size


def walk(stream: BinaryIO, start: int, stop: int) -> tuple[int, int, int, bool | None]:
    """(first, end, unpacked, newline) of the members that begin in [start, stop).

    ``first`` and ``end`` are -1 if none does; ``newline`` tells whether their bytes end
    with one, None if they have no bytes. A place that looks like a member counts if the
    walk from it comes to another one, or to the end of the file.
    """
    stream.seek(start)
    seen = stream.read(2 * MEMBER_BYTES + len(MAGIC))
    at = 0 if start == 0 else seen.find(MAGIC)
    while 0 <= at < stop - start:
        size = member_bytes(seen, at)
        # The place after it begins a member, or nothing follows it.
        if size and (after := seen[at + size : at + size + 4]) in (MAGIC, b"") and (after or len(seen) == at + size):
            break
        at = seen.find(MAGIC, at + 1)
    if not 0 <= at < stop - start:
        return -1, -1, 0, None
    first = end = start + at
    unpacked, last = 0, None
    for place, member in _members(stream, first):
        if place >= stop:
            break
        (size,) = struct.unpack("<I", member[-4:])
        last = member if size else last
        unpacked, end = unpacked + size, place + len(member)
    return first, end, unpacked, None if last is None else inflate(last)[-1:] == b"\n"


class Unblocked(io.RawIOBase):
    """The unpacked bytes from a member's start on, as a raw stream."""

    def __init__(self, stream: BinaryIO, at: int = 0):
        self._found = _members(stream, at)
        self._held = memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self._held:
            entry = next(self._found, None)
            if entry is None:
                return 0
            self._held = memoryview(inflate(entry[1]))
        n = min(len(into), len(self._held))
        into[:n] = self._held[:n]
        self._held = self._held[n:]
        return n


def pack(data: bytes, level: int = 6) -> bytes:
    """One member of at most ``BLOCK`` bytes."""
    engine = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = engine.compress(data) + engine.flush()
    if len(body) + _HEAD + 6 + _TAIL > MEMBER_BYTES:  # stored as it is, which adds a few bytes only
        engine = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = engine.compress(data) + engine.flush()
    size = _HEAD + 6 + len(body) + _TAIL
    head = MAGIC + struct.pack("<IBBH", 0, 0, 255, 6) + SIZE_FIELD + struct.pack("<HH", 2, size - 1)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_blocked(
    rows: DataFrame, line: Column, folder: str, create: Callable[[str], BinaryIO], suffix: str = ".fastq.gz"
) -> list[str]:
    """One file for each task, of the lines of its rows; the paths of the files that count.

    A task that is run again writes another file, and only one of the two is in the list.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}{suffix}"
        held, out = bytearray(), None
        for batch in batches:
            for text in batch.column(0):
                held += text.as_py().encode() + b"\n"
                out = out or create(path)
                while len(held) >= BLOCK:
                    out.write(pack(bytes(held[:BLOCK])))
                    del held[:BLOCK]
        if out is None:
            return
        if held:
            out.write(pack(bytes(held)))
        out.write(LAST)
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    return [r["path"] for r in rows.select(line.alias("line")).mapInArrow(task, "path string").collect()]
