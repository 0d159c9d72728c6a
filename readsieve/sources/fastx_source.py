"""FASTA/FASTQ as a data source: ``spark.read.format("fastx")`` and ``readStream``.

``register(spark)`` makes the format known to a session and switches its filter pushdown
for Python sources on. Options: ``path`` (given to ``load``), ``glob`` for file names,
``layout`` (``any``, ``fasta``, ``four_line``), ``columns`` (a list with commas; others
are not built) and ``splitBytes``.

Rows are those of ``read_fastx``. A batch read plans one partition for each range of a
plain file with a declared layout and one for any other file; ``read_fastx`` also finds
the layout of large files and cuts blocked gzip. Filters that fix ``file`` or ``status``
are pushed down: the first leave files out of the plan, the second drop records before a
row is built.

A stream's offset is the modification time and name of the last file; a batch has the
files after one offset up to another, so a restart gives the same batches. A file that
shows up with a time before the offset is not seen.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
)

from readsieve.sources.fastx import ANY, FIELDS, PLAIN, SPLIT_BYTES, STREAM, _batches, _ddl, _open, _range_records

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
END = 1 << 62


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    stop: int
    kind: str

    def __init__(self, path: str, start: int, stop: int, kind: str):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop, self.kind = path, start, stop, kind


@dataclass(frozen=True)
class Listed:
    time: int
    path: str
    size: int


def list_files(path: str, glob: str | None) -> list[Listed]:
    """The files at ``path`` or directly in it, by name, hidden ones left out."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        files, at = pafs.LocalFileSystem(), "/" + (rest if scheme == "file" else path).lstrip("/")
        prefix = "file://"
    else:
        files, at = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        prefix = path[: len(path) - len(at)] if path.endswith(at) else f"{scheme}://"
    here = files.get_file_info(at)
    infos = [here] if here.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(at.rstrip("/")))
    return sorted(
        (
            Listed(info.mtime_ns or 0, prefix + info.path, info.size)
            for info in infos
            if info.type == pafs.FileType.File
            and not info.base_name.startswith((".", "_"))
            and (glob is None or fnmatch.fnmatchcase(info.base_name, glob))
        ),
        key=lambda f: f.path,
    )


class _Files:
    """What a read and a stream have in common: options, ranges and records."""

    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.glob = options["path"], options.get("glob")
        self.layout = options.get("layout", ANY)
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.columns = columns
        self.wanted: dict[str, set] = {}

    def ranges(self, files: Iterable[Listed]) -> list[FileRange]:
        found = []
        for f in files:
            with _open(f.path) as stream:
                whole = self.layout == ANY or stream.read(2) == b"\x1f\x8b"
            step, kind = (END, STREAM) if whole else (self.split_bytes, PLAIN)
            found += [FileRange(f.path, at, at + step, kind) for at in range(0, f.size, step)]
        return found

    def batches(self, part: FileRange) -> Iterator[pa.RecordBatch]:
        status = self.wanted.get("status")
        records = _range_records(part.path, part.start, part.stop, self.layout, part.kind)
        kept = ((part.path, r) for r in records if status is None or r[-1] in status)
        yield from _batches(kept, self.columns)


class FastxReader(_Files, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in ("file", "status"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[FileRange]:
        files, wanted = list_files(self.path, self.glob), self.wanted.get("file")
        return self.ranges(f for f in files if wanted is None or f.path in wanted)

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class FastxStreamReader(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((f.time, f.path) for f in list_files(self.path, self.glob)), default=(-1, ""))
        return {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        after, last = (start["time"], start["path"]), (end["time"], end["path"])
        return self.ranges(f for f in list_files(self.path, self.glob) if after < (f.time, f.path) <= last)

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def _columns(self) -> list[str]:
        given = self.options.get("columns")
        columns = [c.strip() for c in given.split(",")] if given else list(FIELDS)
        unknown = [c for c in columns if c not in FIELDS]
        if unknown:
            raise ValueError(f"no such columns: {unknown}; there are {FIELDS}")
        return columns

    def schema(self) -> str:
        return _ddl(self._columns())

    def reader(self, schema) -> FastxReader:
        return FastxReader(dict(self.options), self._columns())

    def streamReader(self, schema) -> FastxStreamReader:
        return FastxStreamReader(dict(self.options), self._columns())


def register(spark: SparkSession) -> None:
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(FastxSource)
