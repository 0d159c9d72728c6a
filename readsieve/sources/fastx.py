"""FASTA/FASTQ files as DataFrames.

Spark lists the files and cuts the work; a task turns bytes into records with
the small line reader below. Columns: ``file``, ``record_offset`` (byte offset
of the record's header in the unpacked file), ``name``, ``comment``, ``seq``,
``qual`` (NULL for FASTA) and ``status`` (``ok``, ``empty`` or ``truncated``).

Without a declared layout a record with damaged quality ends its file, and the
records before it stand. With one, a record is what its own lines say, so a damaged
record leaves the others alone. Either way the rows are the same for any file size
and wherever a file is cut.
"""

from __future__ import annotations

import gzip
import io
import re
from collections import deque
from collections.abc import Iterator, Sequence
from pathlib import Path
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readsieve.session import cut
from readsieve.sources.blocks import MEMBER_BYTES, Unblocked, is_blocked, walk

# Files up to this size arrive as one value, which is held several times over between Spark and
# the task; larger ones are opened by the task.
CONTENT_BYTES = 16 << 20
SPLIT_BYTES = 128 << 20
MAX_RANGE_TASKS = 100_000
_BATCH_BYTES = 8 << 20
_BATCH_ROWS = 10_000
_READ_BUFFER = 1 << 20
# What a task reads of the ranges that it is dealt, whose number may be far larger.
TASK_BYTES = 16 << 20

FIELDS = ("file", "record_offset", "name", "comment", "seq", "qual", "status")
FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

# How a large file is read: anywhere, at its members, or as one stream.
PLAIN = "plain"
BLOCKED = "blocked"
STREAM = "stream"

# Layouts a file may be declared to have, which allow splitting it.
ANY = "any"
FASTA = "fasta"
FOUR_LINE = "four_line"

_SPACE = re.compile(rb"[ \t\n\v\f\r]")
_HEADER = re.compile(rb"[>@]")


class _Lines:
    """Lines of a byte stream with their offsets, and a way to put lines back."""

    def __init__(self, stream: BinaryIO, offset: int = 0):
        self._stream = stream
        self._next = offset
        self._returned: deque[tuple[int, bytes]] = deque()

    def __iter__(self) -> _Lines:
        return self

    def __next__(self) -> tuple[int, bytes]:
        if self._returned:
            return self._returned.popleft()
        line = self._stream.readline()
        if not line:
            raise StopIteration
        at = self._next
        self._next += len(line)
        return at, line

    def put_back(self, lines: Sequence[tuple[int, bytes]]) -> None:
        self._returned.extendleft(reversed(lines))


def _extend(text: bytearray, line: bytes) -> None:
    """Append a line without its ending; one carriage return goes as well."""
    text += line.removesuffix(b"\n")
    if len(text) > 1 and len(line) > 1 and text.endswith(b"\r"):
        del text[-1]


def _split_header(text: bytes) -> tuple[bytes, bytes]:
    space = _SPACE.search(text)
    if space is None:
        return text, b""
    comment = bytearray()
    if space[0] != b"\n":
        _extend(comment, text[space.end() :])
    return text[: space.start()], bytes(comment)


def _starts_record(lines: _Lines, line: bytes, layout: str) -> bool:
    """Does this line surely start a record, seen from it and the lines after it?

    A FASTA file has ``>`` at the start of header lines only. In a four-line
    FASTQ file a quality line may start with ``@``, but the line two further on
    is then a sequence; after a header it is the ``+`` line.
    """
    if layout == FASTA:
        return line[:1] == b">"
    if line[:1] != b"@":
        return False
    ahead = [entry for _, entry in zip(range(2), lines)]
    lines.put_back(ahead)
    return len(ahead) == 2 and ahead[1][1][:1] == b"+"


def records(lines: _Lines) -> Iterator[tuple]:
    """``(offset, name, comment, seq, qual, status)`` of each record of a whole file."""
    header = None
    while True:
        if header is None:
            for at, line in lines:
                mark = _HEADER.search(line)
                if mark:
                    header = at + mark.start(), line[mark.start() :]
                    break
            else:
                return
        offset, line = header
        if len(line) == 1:
            return
        name, comment = _split_header(line[1:])
        header, plus, seq = None, None, bytearray()
        for at, line in lines:
            if line[:1] in (b">", b"@"):
                header = at, line
                break
            if line[:1] == b"+":
                plus = line
                break
            if line != b"\n":
                _extend(seq, line)
        qual, damaged = None, False
        if plus is not None:
            qual = bytearray()
            if plus.endswith(b"\n"):
                for _, line in lines:
                    _extend(qual, line)
                    if len(qual) >= len(seq):
                        break
            damaged = not plus.endswith(b"\n") or len(qual) != len(seq)
        status = "truncated" if damaged else "ok" if seq else "empty"
        yield offset, name, comment, bytes(seq), None if qual is None else bytes(qual), status
        if damaged:
            return


def _fasta_records(lines: _Lines, stop: int | None) -> Iterator[tuple]:
    """Records whose ``>`` lines begin before ``stop``; every other line is sequence."""
    header, seq = None, bytearray()
    for at, line in lines:
        if line[:1] != b">":
            if header is not None and line != b"\n":
                _extend(seq, line)
            continue
        if header is not None:
            yield *header, bytes(seq), None, "ok" if seq else "empty"
        if stop is not None and at >= stop:
            return
        header, seq = (at, *_split_header(line[1:])), bytearray()
    if header is not None:
        yield *header, bytes(seq), None, "ok" if seq else "empty"


def _four_line_records(lines: _Lines, stop: int | None, first: bool) -> Iterator[tuple]:
    """Records whose sure header lines begin before ``stop``.

    A record has the two lines after its header and then a quality line, as far as these
    are no sure headers themselves. A header with at most one line left in the file is a
    record without quality; it belongs to the reader of the record before it, or to the
    one that is ``first`` in the file.
    """
    left: deque[tuple[int, bytes]] | None = deque(maxlen=2) if first else None
    for at, line in lines:
        if not _starts_record(lines, line, FOUR_LINE):
            if left is not None:
                left.append((at, line))
            continue
        if stop is not None and at >= stop:
            return
        seq, qual = bytearray(), bytearray()
        ahead = next(lines)
        if _starts_record(lines, ahead[1], FOUR_LINE):
            lines.put_back([ahead])
            yield at, *_split_header(line[1:]), b"", b"", "truncated"
            left = deque(maxlen=2)
            continue
        _extend(seq, ahead[1])
        _, plus = next(lines)
        after = next(lines, None)
        if after is not None and _starts_record(lines, after[1], FOUR_LINE):
            lines.put_back([after])
        elif after is not None:
            _extend(qual, after[1])
        damaged = not plus.endswith(b"\n") or len(qual) != len(seq)
        status = "truncated" if damaged else "ok" if seq else "empty"
        yield at, *_split_header(line[1:]), bytes(seq), bytes(qual), status
        left = deque(maxlen=2)
    while left and left[0][1][:1] != b"@":
        left.popleft()
    if left and len(left[0][1]) > 1:
        seq = bytearray()
        for _, line in list(left)[1:]:
            _extend(seq, line)
        yield left[0][0], *_split_header(left[0][1][1:]), bytes(seq), None, "ok" if seq else "empty"


def laid_out_records(lines: _Lines, layout: str, stop: int | None = None, first: bool = True) -> Iterator[tuple]:
    """The same of a file, or of a byte range of it, that has a declared layout."""
    if layout == ANY:
        return records(lines)
    return _fasta_records(lines, stop) if layout == FASTA else _four_line_records(lines, stop, first)


def _open(uri: str) -> BinaryIO:
    """The file behind a URI as Spark writes it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return open(uri, "rb", buffering=_READ_BUFFER)
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb", buffering=_READ_BUFFER)
    filesystem, path = pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return io.BufferedReader(filesystem.open_input_file(path), _READ_BUFFER)


def _unpacked(stream: BinaryIO) -> BinaryIO:
    """The stream itself, or its gunzipped form if it starts like a gzip file."""
    magic = stream.read(2)
    stream.seek(0)
    return gzip.open(stream, "rb") if magic == b"\x1f\x8b" else stream


def create(uri: str) -> BinaryIO:
    """A new file behind a URI as Spark writes it."""
    scheme, colon, rest = uri.partition(":")
    local = uri if not colon or "/" in scheme else "/" + rest.lstrip("/") if scheme == "file" else None
    if local is not None:
        Path(local).parent.mkdir(parents=True, exist_ok=True)
        return open(local, "wb", buffering=_READ_BUFFER)
    filesystem, path = pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return filesystem.open_output_stream(path)


def _range_lines(stream: BinaryIO, kind: str, seek: int, start: int, inside: bool | None) -> _Lines:
    """The lines of a range from the first one that begins in it.

    ``start`` is where the range begins in the unpacked file, ``seek`` in the file itself;
    ``inside`` tells whether that is within a line (of a plain file it is looked up).
    """
    if kind == BLOCKED:
        # no more than the members that the range needs
        opened = io.BufferedReader(Unblocked(stream, seek), MEMBER_BYTES)
        return _Lines(opened, start + (len(opened.readline()) if inside else 0))
    if kind == STREAM:
        return _Lines(_unpacked(stream))
    stream.seek(max(start - 1, 0))
    return _Lines(stream, start - 1 + len(stream.readline()) if start else 0)


def _range_records(
    uri: str, start: int, stop: int, layout: str, kind: str = PLAIN, seek: int = 0, inside: bool | None = None
) -> Iterator[tuple]:
    """Records of a large file whose headers lie in ``[start, stop)`` of the unpacked bytes."""
    if layout == ANY and start:
        return  # the whole file belongs to the range that starts it
    with _open(uri) as stream:
        lines = _range_lines(stream, kind, seek, start, inside)
        yield from laid_out_records(lines, layout, stop, start == 0)


_ARROW = {
    "file": pa.string(),
    "record_offset": pa.int64(),
    "name": pa.string(),
    "comment": pa.string(),
    "seq": pa.string(),
    "qual": pa.string(),
    "status": pa.string(),
}
_SPARK = {"record_offset": "long"}
_BYTE_FIELDS = range(FIELDS.index("name"), FIELDS.index("qual") + 1)


def _text(value: bytes | None) -> str | None:
    """One character per byte, whatever the byte."""
    return None if value is None else value.decode("latin-1")


def _batches(found: Iterator[tuple[str, tuple]], columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size, with only the columns asked for."""
    at = [FIELDS.index(c) for c in columns]
    schema = pa.schema([(c, _ARROW[c]) for c in columns])
    rows: list[tuple] = []
    held = 0

    def packed() -> pa.RecordBatch:
        by_field = list(zip(*rows))
        values = []
        for i in at:
            field = by_field[i]
            values.append(pa.array([_text(v) for v in field] if i in _BYTE_FIELDS else field, schema.types[len(values)]))
        return pa.RecordBatch.from_arrays(values, schema=schema)

    for file, record in found:
        rows.append((file, *record))
        held += len(record[3])
        if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
            yield packed()
            rows, held = [], 0
    if rows:
        yield packed()


def _ddl(columns: Sequence[str]) -> str:
    return ", ".join(f"{c} {_SPARK.get(c, 'string')}" for c in columns)


def parse(files: DataFrame, columns: Sequence[str] = FIELDS, layout: str = ANY) -> DataFrame:
    """Records of files given as rows ``path, content`` (batch or streaming)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for path, content in zip(batch.column(0), batch.column(1)):
                    stream = _unpacked(io.BytesIO(content.as_py()))
                    for record in laid_out_records(_Lines(stream), layout):
                        yield path.as_py(), record

        yield from _batches(found(), columns)

    return files.select("path", F.col("content").cast("binary")).mapInArrow(run, _ddl(columns))


def _range_shape(uri: str, kind: str, seek: int, start: int, stop: int, inside: bool | None) -> tuple[bool, bool, int, int]:
    """What the lines of a range say about the file's layout.

    Could it be FASTA (no line of a FASTQ record); are its records whole four-line ones
    without a gap; the offset of the first of them; and where the last of them ends (-1
    for both if none begins here).
    """
    if kind == STREAM:
        return False, False, -1, -1
    with _open(uri) as stream:
        lines = _range_lines(stream, kind, seek, start, inside)
        fasta, four_line, first, end = True, True, -1, -1
        entry = next(lines, None)
        while entry is not None and entry[0] < stop and (fasta or four_line):
            at, line = entry
            fasta = fasta and line[:1] not in (b"@", b"+") and (at > 0 or line[:1] == b">")
            if four_line and _starts_record(lines, line, FOUR_LINE):
                four_line = at == end or (first < 0 and (start > 0 or at == 0))
                first = at if first < 0 else first
                seq, qual = bytearray(), bytearray()
                _extend(seq, next(lines)[1])
                next(lines)
                last = next(lines, (0, b""))
                _extend(qual, last[1])
                four_line = four_line and len(seq) == len(qual) and len(last[1]) > 0
                end, fasta = last[0] + len(last[1]), False
            elif first >= 0 or start == 0:
                four_line = False
            entry = next(lines, None)
        return fasta, four_line, first, end


# A range of a file: where it begins in the file, and where it begins and ends unpacked.
_RANGE = "path string, kind string, seek long, start long, stop long, inside boolean, length long"
_RANGE_FIELDS = ["path", "kind", "seek", "start", "stop", "inside"]


def _each(rows: DataFrame, columns: list[str], function, schema: str) -> DataFrame:
    """``function`` of the columns for every row, beside them; rows are few and each is much work."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.to_pylist()
            found = [(*r.values(), *function(*(r[c] for c in columns))) for r in given]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=names)

    return rows.mapInArrow(run, schema)


def _kind_of(uri: str) -> tuple[str]:
    with _open(uri) as stream:
        if stream.read(2) != b"\x1f\x8b":
            return (PLAIN,)
        stream.seek(0)
        return (BLOCKED,) if is_blocked(stream) else (STREAM,)


def _walked(uri: str, at: int, split_bytes: int) -> tuple[int, int, int, bool | None]:
    with _open(uri) as stream:
        return walk(stream, at, at + split_bytes)


def _tasks(files: DataFrame, split_bytes: int) -> tuple[int, int]:
    """How many tasks look at the files, and at their ranges.

    A few for each core, or as many as it takes for ``TASK_BYTES`` each: a task of its own for every
    range would cost more than to read it where ranges are small.
    """
    per_core = 4 * files.sparkSession.sparkContext.defaultParallelism
    found = files.agg(F.sum(F.ceil(F.col("length") / split_bytes)), F.count("*"), F.sum("length")).first()
    n_ranges, n_files, size = (int(x or 0) for x in found)
    enough = max(per_core, size // TASK_BYTES)
    return tuple(max(1, min(n, enough, MAX_RANGE_TASKS)) for n in (n_files, n_ranges))


def ranges(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The ranges that files given as rows ``path, length`` can be read in, each a row.

    Plain files are cut anywhere, blocked gzip files at their members, other gzip files
    not at all.
    """
    step = F.lit(split_bytes).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), step)
    n_files, n_ranges = _tasks(files, split_bytes)
    kinds = cut(
        _each(
            files.select("path", "length").repartition(n_files, "path"),
            ["path"],
            _kind_of,
            "path string, length long, kind string",
        ),
        "kinds",
    )
    none = F.lit(None).cast("boolean").alias("inside")
    at = F.col("at")
    plain = kinds.where(F.col("kind") == PLAIN).select("*", F.explode(starts).alias("at"))
    plain = plain.select("path", "kind", at.alias("seek"), at.alias("start"), (at + step).alias("stop"), none, "length")

    # dealt by range, so that the ranges of one large file are many tasks
    blocked = kinds.where(F.col("kind") == BLOCKED).select("path", "length", F.explode(starts).alias("at"))
    index = cut(
        _each(
            blocked.withColumn("split", step).repartition(n_ranges, "path", "at"),
            ["path", "at", "split"],
            _walked,
            "path string, length long, at long, split long, first long, end long, unpacked long, newline boolean",
        ),
        "members",
    )
    order = Window.partitionBy("path").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = index.where("first >= 0").select(
        "*",
        (F.coalesce(F.lead("first").over(order), F.col("length")) == F.col("end")).alias("meets"),
        F.coalesce(F.sum("unpacked").over(before), F.lit(0)).alias("start"),
        (~F.last("newline", ignorenulls=True).over(before)).alias("inside"),
    )
    whole = filled.groupBy("path").agg(
        (F.every("meets") & (F.min("first") == 0)).alias("whole"), F.sum("unpacked").alias("unpacked_length")
    )
    members = filled.join(whole.where("whole"), "path").select(
        "path",
        F.lit(BLOCKED).alias("kind"),
        F.col("first").alias("seek"),
        "start",
        (F.col("start") + F.col("unpacked")).alias("stop"),
        "inside",
        F.col("unpacked_length").alias("length"),
    )
    far = F.lit(1 << 62).cast("long")
    streams = kinds.where(F.col("kind") != PLAIN).join(whole.where("whole"), "path", "left_anti")
    zero = F.lit(0).cast("long")
    streams = streams.select("path", F.lit(STREAM).alias("kind"), zero.alias("seek"), zero.alias("start"), far.alias("stop"), none, "length")
    return plain.unionByName(members).unionByName(streams)


def _layouts(cuts: DataFrame, n_ranges: int) -> DataFrame:
    shaped = _each(
        cuts.repartition(n_ranges, "path", "start"),
        _RANGE_FIELDS,
        _range_shape,
        f"{_RANGE}, fasta boolean, four_line boolean, first long, end long",
    )
    order = Window.partitionBy("path").orderBy("start")
    filled = shaped.where("first >= 0").withColumn("next", F.coalesce(F.lead("first").over(order), F.col("length")))
    meets = filled.groupBy("path").agg(F.every(F.col("end") == F.col("next")).alias("meets"))
    whole = shaped.groupBy("path").agg(F.every("fasta").alias("fasta"), F.every("four_line").alias("four_line"))
    layout = F.when(F.col("four_line") & F.coalesce("meets", F.lit(False)), FOUR_LINE).when(F.col("fasta"), FASTA)
    return whole.join(meets, "path", "left").select("path", F.coalesce(layout, F.lit(ANY)).alias("layout"))


def layouts(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``path, layout`` of files given as rows ``path, length``.

    One pass over the ranges of all files. A file is ``four_line`` if the records of its
    ranges meet without a gap from its first byte to its last, ``fasta`` if it starts with
    a ``>`` line and has no line of a FASTQ record; read by that layout it has the same
    records as read in one go. Any other file is ``any``.
    """
    cuts = cut(ranges(files, split_bytes), "ranges")
    return _layouts(cuts, _tasks(files, split_bytes)[1])


def parse_large(
    files: DataFrame, columns: Sequence[str] = FIELDS, layout: str = ANY, split_bytes: int = SPLIT_BYTES
) -> DataFrame | None:
    """Records of files given as rows ``path, length``, opened by the tasks.

    A plain file is cut into byte ranges and a blocked gzip file at its members, and the
    ranges are read in parallel if the layout is declared or turns out to be regular;
    otherwise, and for any other gzip file, one task streams through the file. None when
    there are no files.
    """
    if not files.limit(1).count():
        return None
    cuts = cut(ranges(files, split_bytes), "ranges")
    n_ranges = _tasks(files, split_bytes)[1]
    laid = cuts.withColumn("layout", F.lit(layout))
    if layout == ANY:
        laid = cuts.join(_layouts(cuts, n_ranges), "path")
    laid = laid.where((F.col("layout") != ANY) | (F.col("start") == 0)).repartition(n_ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for uri, *cut_at in zip(*(batch.column(i).to_pylist() for i in range(7))):
                    for record in _range_records(uri, *cut_at):
                        yield uri, record

        yield from _batches(found(), columns)

    return laid.select("path", "start", "stop", "layout", "kind", "seek", "inside").mapInArrow(run, _ddl(columns))


def read_fastx(
    spark: SparkSession,
    path: str | list[str],
    *,
    glob: str | None = None,
    columns: Sequence[str] = FIELDS,
    layout: str = ANY,
    content_bytes: int = CONTENT_BYTES,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """All records of the files under ``path``, plain or gzipped.

    Files up to ``content_bytes`` come through Spark's own reader, one file per
    row; larger ones are opened by the tasks, which the size filter on the
    listing keeps apart without reading any content.
    """
    reader = spark.read.format("binaryFile")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    small = parse(files.where(F.col("length") <= content_bytes), columns, layout)
    large = parse_large(
        files.where(F.col("length") > content_bytes).select("path", "length"), columns, layout, split_bytes
    )
    return small if large is None else small.unionByName(large)


def render_fastq(name, comment, seq):
    """A four-line record as one string column, with constant quality."""
    qual = F.repeat(F.lit("I"), F.length(seq).cast("int"))
    return F.concat(F.lit("@"), name, F.lit(" "), comment, F.lit("\n"), seq, F.lit("\n+\n"), qual)
