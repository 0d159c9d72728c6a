import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from readsieve.sources import fastx
from readsieve.sources.fastx import ANY, FASTA, FOUR_LINE, read_fastx


def parse(data: bytes):
    return [r[1:] for r in fastx.records(fastx._Lines(io.BytesIO(data)))]


CASES = {
    "basic": (
        b"@r1 first\nACGT\n+\nIIII\n@r2\nGG\n+r2\nJJ\n",
        [(b"r1", b"first", b"ACGT", b"IIII", "ok"), (b"r2", b"", b"GG", b"JJ", "ok")],
    ),
    "multiline": (b"@r\nAC\nGT\n\n+\nII\nII\n", [(b"r", b"", b"ACGT", b"IIII", "ok")]),
    "quality starts with @": (
        b"@r1\nACGT\n+\n@III\n@r2\nAC\n+\n>@\n",
        [(b"r1", b"", b"ACGT", b"@III", "ok"), (b"r2", b"", b"AC", b">@", "ok")],
    ),
    "crlf": (b">r1 x y\r\nACGT\r\nAC\r\n>r2\r\nG\r\n", [(b"r1", b"x y", b"ACGTAC", None, "ok"), (b"r2", b"", b"G", None, "ok")]),
    "blank crlf lines": (b">r\r\n\r\nA\r\n\r\nC\r\n", [(b"r", b"", b"\rAC", None, "ok")]),
    "mixed": (
        b">f\nACG\n@q\nAC\n+\nII\n>g\nTT\n",
        [(b"f", b"", b"ACG", None, "ok"), (b"q", b"", b"AC", b"II", "ok"), (b"g", b"", b"TT", None, "ok")],
    ),
    "junk before": (b"junk\nmore >name c\nAC\n", [(b"name", b"c", b"AC", None, "ok")]),
    "junk between": (
        b"@a\nAC\n+\nII\n\nnoise\n@b\nGT\n+\nII",
        [(b"a", b"", b"AC", b"II", "ok"), (b"b", b"", b"GT", b"II", "ok")],
    ),
    "truncated ends the file": (
        b"@a\nAC\n+\nII\n@b\nACGT\n+\nII\n",
        [(b"a", b"", b"AC", b"II", "ok"), (b"b", b"", b"ACGT", b"II", "truncated")],
    ),
    "quality too long": (b"@b\nAC\n+\nIIII\n@c\nAC\n+\nII\n", [(b"b", b"", b"AC", b"IIII", "truncated")]),
    "no quality": (b"@b\nAC\n+", [(b"b", b"", b"AC", b"", "truncated")]),
    "empty": (b">e\n>f\nAC\n", [(b"e", b"", b"", None, "empty"), (b"f", b"", b"AC", None, "ok")]),
    "header only": (b">name", [(b"name", b"", b"", None, "empty")]),
    "lone mark": (b">", []),
    "nothing": (b"", []),
    "tab in header": (b">n\tc d\nAC\n", [(b"n", b"c d", b"AC", None, "ok")]),
    "pipes": (b">gi|1|x|\nAC", [(b"gi|1|x|", b"", b"AC", None, "ok")]),
}


@pytest.mark.parametrize("name", CASES)
def test_grammar(name):
    data, wanted = CASES[name]
    assert parse(data) == wanted


def test_offsets():
    data = b"x\n>a\nAC\n@b\nAC\n+\nII\n"
    assert [r[0] for r in fastx.records(fastx._Lines(io.BytesIO(data)))] == [2, 8]


def test_files(spark, tmp_path):
    (tmp_path / "a.fastq").write_bytes(CASES["basic"][0])
    (tmp_path / "b.fq").write_bytes(CASES["mixed"][0])
    (tmp_path / "c.txt").write_bytes(CASES["basic"][0])
    (tmp_path / "d.fastq.gz").write_bytes(gzip.compress(CASES["multiline"][0]))
    rows = read_fastx(spark, str(tmp_path), glob="*.{fastq,fq}").collect()
    assert sorted((r.file.rsplit("/")[-1], r.name) for r in rows) == [
        ("a.fastq", "r1"),
        ("a.fastq", "r2"),
        ("b.fq", "f"),
        ("b.fq", "g"),
        ("b.fq", "q"),
    ]
    assert {r.name: r.qual for r in rows}["f"] is None
    packed = read_fastx(spark, str(tmp_path / "d.fastq.gz")).collect()
    assert [(r.name, r.seq, r.qual) for r in packed] == [("r", "ACGT", "IIII")]
    streamed = read_fastx(spark, str(tmp_path / "d.fastq.gz"), content_bytes=0).collect()
    assert streamed == packed


def test_bytes_outside_ascii_keep_their_count(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">a\nAC\xff\xfeGT\n")
    row = read_fastx(spark, str(tmp_path)).first()
    assert len(row.seq) == 6


def test_chosen_columns(spark, tmp_path):
    (tmp_path / "a.fq").write_bytes(CASES["basic"][0])
    assert read_fastx(spark, str(tmp_path), columns=["seq"]).columns == ["seq"]


def four_line(rnd, n):
    out = []
    for i in range(n):
        size = rnd.randrange(1, 60)
        seq = "".join(rnd.choice("ACGTN") for _ in range(size))
        qual = "".join(rnd.choice("@+>I#\"") for _ in range(size))
        out.append(f"@read{i} c{i}\n{seq}\n+\n{qual}\n")
    return "".join(out).encode()


def fasta(rnd, n):
    out = []
    for i in range(n):
        lines = ["".join(rnd.choice("ACGT") for _ in range(20)) for _ in range(rnd.randrange(0, 5))]
        out.append("\n".join([f">s{i}", *lines]) + "\n")
    return "".join(out).encode()


@pytest.mark.parametrize("split", [1, 7, 64, 500, 10**9])
@pytest.mark.parametrize("layout", [FOUR_LINE, FASTA])
@pytest.mark.parametrize("tail", [b"", b"@last\nAC\n+\n@@", b"@last\nACG\n+\nI\n", b"@last\nAC\n", b"@last"])
def test_ranges_cover_a_file_once(tmp_path, split, layout, tail):
    rnd = random.Random(split)
    data = four_line(rnd, 40) + tail if layout == FOUR_LINE else fasta(rnd, 40)
    path = tmp_path / "x"
    path.write_bytes(data)
    whole = list(fastx.records(fastx._Lines(io.BytesIO(data))))
    parts = []
    for start in range(0, len(data), split):
        parts += fastx._range_records(f"file:{path}", start, start + split, layout)
    assert sorted(parts, key=lambda r: r[0]) == whole


def damaged(rnd, n):
    """Four-line records of which some lost lines or a part of one."""
    lines = four_line(rnd, n).splitlines(keepends=True)
    out = []
    for i in range(0, len(lines), 4):
        record = lines[i : i + 4]
        fault = rnd.randrange(8)
        if fault < 4:
            del record[fault]
        elif fault == 4:
            record[3] = record[3][1:]
        elif fault == 5:
            record[1] = b"\n"
        out += record
    return b"".join(out)


@pytest.mark.parametrize("seed", range(6))
def test_damaged_records_mean_the_same_at_any_size(spark, tmp_path, seed):
    rnd = random.Random(seed)
    data = damaged(rnd, 60) + rnd.choice([b"", b"@last\nAC\n", b"@last", b"@last\nACG\n+\nI"])
    path = tmp_path / "x.fastq"
    path.write_bytes(data)
    (tmp_path / "y.fastq.gz").write_bytes(gzip.compress(data))
    whole = list(fastx.laid_out_records(fastx._Lines(io.BytesIO(data)), FOUR_LINE))
    assert {"ok", "truncated"} <= {r[5] for r in whole}
    for split in (1, 13, 200, 10**9):
        parts = []
        for start in range(0, len(data), split):
            parts += fastx._range_records(f"file:{path}", start, start + split, FOUR_LINE)
        assert sorted(parts, key=lambda r: r[0]) == whole
    if seed < 2:
        wanted = sorted((r[0], r[1].decode(), r[5]) for r in whole)
        for content, split in ((1 << 20, 1 << 20), (0, 1 << 20), (0, 300)):
            found = read_fastx(spark, str(tmp_path), layout=FOUR_LINE, content_bytes=content, split_bytes=split)
            for name in ("x.fastq", "y.fastq.gz"):
                rows = found.where(F.col("file").endswith(name)).collect()
                assert sorted((r.record_offset, r.name, r.status) for r in rows) == wanted


@pytest.mark.parametrize("split", [50, 700, 1 << 20])
def test_layout_is_found_or_the_file_read_in_one_go(spark, tmp_path, split):
    rnd = random.Random(4)
    multi = b"".join(b"@m%d\nACGT\nAC\n+\nIIII\n@+\n" % i for i in range(30))
    contents = {
        "regular": (four_line(rnd, 50), FOUR_LINE),
        "no_end": (four_line(rnd, 20)[:-1], FOUR_LINE),
        "fasta": (fasta(rnd, 50), FASTA),
        "multi": (multi, ANY),
        "late_fault": (four_line(rnd, 50) + b"@x\nACGT\n+\nII\n" + four_line(rnd, 5), ANY),
        "blank": (four_line(rnd, 10) + b"\n" + four_line(rnd, 10), ANY),
        "junk": (b"junk\n" + fasta(rnd, 10), ANY),
        "mixed": (fasta(rnd, 10) + four_line(rnd, 10), ANY),
        "lines": (b"".join(b"+\n" for _ in range(40)), ANY),
    }
    for name, (data, _) in contents.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "packed").write_bytes(gzip.compress(contents["regular"][0]))
    listed = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    found = {r.path.rsplit("/")[-1]: r.layout for r in fastx.layouts(listed, split).collect()}
    assert found == {"packed": ANY, **{name: layout for name, (_, layout) in contents.items()}}
    rows = read_fastx(spark, str(tmp_path), content_bytes=0, split_bytes=split).collect()
    for name, (data, _) in contents.items():
        got = sorted((r.record_offset, r.name, r.seq, r.qual, r.status) for r in rows if r.file.endswith(f"/{name}"))
        text = lambda b: None if b is None else b.decode()
        assert got == [
            (r[0], text(r[1]), text(r[3]), text(r[4]), r[5]) for r in fastx.records(fastx._Lines(io.BytesIO(data)))
        ]


def test_a_damaged_record_leaves_the_next_one_alone():
    data = b"@a\nACGT\n+\n@b\nACG\n+\nIII\n@c\nAC\n+\nI\n@d\nA\n+\nI\n"
    found = [(r[1], r[4], r[5]) for r in fastx.laid_out_records(fastx._Lines(io.BytesIO(data)), FOUR_LINE)]
    assert found == [(b"a", b"", "truncated"), (b"b", b"III", "ok"), (b"c", b"I", "truncated"), (b"d", b"I", "ok")]


def test_names_with_odd_characters_are_opened(tmp_path):
    path = tmp_path / "a b?c#d%20.fastq"
    path.write_bytes(CASES["basic"][0])
    for uri in (str(path), f"file:{path}", f"file://{path}"):
        assert list(fastx._range_records(uri, 0, 1 << 20, ANY))


@pytest.mark.parametrize("layout", [FOUR_LINE, ANY])
def test_large_files(spark, tmp_path, layout):
    data = four_line(random.Random(9), 300)
    (tmp_path / "x.fastq").write_bytes(data)
    (tmp_path / "small.fastq").write_bytes(CASES["basic"][0])
    found = read_fastx(spark, str(tmp_path), content_bytes=1000, split_bytes=2000, layout=layout).collect()
    assert len(found) == 302
    assert {r.name: r.seq for r in found}["r1"] == "ACGT"
    assert all(r.status == "ok" for r in found)
