"""Blocked gzip: members, cuts, and records across them."""

import gzip
import io
import random

import pytest

from readsieve.sources import blocks, fastx
from readsieve.sources.fastx import ANY, FASTA, FOUR_LINE, read_fastx


def packed(data: bytes, rng: random.Random, least: int = 1, most: int = 400) -> bytes:
    out, at = b"", 0
    while at < len(data):
        n = rng.randint(least, most)
        out += blocks.pack(data[at : at + n])
        at += n
        if rng.random() < 0.1:
            out += blocks.pack(b"")
    return out + blocks.LAST


def fastq(rng, n):
    return b"".join(
        b"@r%d c\n%b\n+\n%b\n" % (i, (seq := bytes(rng.choices(b"ACGT", k=rng.randint(1, 300)))), b"@" * len(seq))
        for i in range(n)
    )


def test_members_are_gzip_and_round_trip():
    rng = random.Random(1)
    data = rng.randbytes(blocks.BLOCK)
    member = blocks.pack(data)
    assert blocks.member_bytes(member) == len(member) <= blocks.MEMBER_BYTES
    whole = packed(data, rng)
    assert gzip.decompress(whole) == data
    assert io.BufferedReader(blocks.Unblocked(io.BytesIO(whole))).read() == data
    assert gzip.decompress(blocks.LAST) == b"" and blocks.member_bytes(gzip.compress(data)) is None


@pytest.mark.parametrize("split", [1, 50, 777, 1 << 20])
def test_ranges_meet(split):
    """Random bytes that look like member starts don't mislead a walk."""
    rng = random.Random(split)
    data = b"".join(rng.choice([blocks.MAGIC, rng.randbytes(30), b"\n"]) for _ in range(300))
    whole = b"".join(blocks.pack(data[i : i + 700], level=0) for i in range(0, len(data), 700)) + blocks.LAST
    found = [blocks.walk(io.BytesIO(whole), at, at + split) for at in range(0, len(whole), split)]
    filled = [f for f in found if f[0] >= 0]
    assert filled[0][0] == 0 and filled[-1][1] == len(whole)
    assert all(a[1] == b[0] for a, b in zip(filled, filled[1:]))
    assert sum(f[2] for f in filled) == len(data)


@pytest.mark.parametrize("layout, kind", [(FOUR_LINE, "fastq"), (ANY, "fastq"), (ANY, "fasta"), (FASTA, "fasta"), (ANY, "mixed")])
def test_cut_files_have_the_rows_of_the_plain_file(spark, tmp_path, layout, kind):
    rng = random.Random(7)
    data = fastq(rng, 60)
    fasta = b"".join(b">f%d\n%b\n%b\n" % (i, b"AC" * rng.randint(0, 60), b"GT" * 9) for i in range(60))
    data = {"fastq": data, "fasta": fasta, "mixed": data + fasta}[kind]
    (tmp_path / "a.fq.gz").write_bytes(packed(data, rng))
    (tmp_path / "whole.fq.gz").write_bytes(gzip.compress(data))
    (tmp_path / "plain.fq").write_bytes(data)

    def rows(name, **options):
        found = read_fastx(spark, str(tmp_path / name), layout=layout, **options)
        return sorted((tuple(r[1:]) for r in found.collect()), key=repr)

    plain = rows("plain.fq", content_bytes=0)
    assert len(plain) == (120 if kind == "mixed" else 60)
    for split in (200, 3000):
        assert rows("a.fq.gz", content_bytes=0, split_bytes=split) == plain
    assert rows("whole.fq.gz", content_bytes=0, split_bytes=200) == plain == rows("a.fq.gz")


def test_a_damaged_file_is_one_stream(spark, tmp_path):
    """Bytes between members: the ranges don't meet, so the file isn't cut."""
    rng = random.Random(3)
    whole = packed(fastq(rng, 30), rng)
    damaged = tmp_path / "d.fq.gz"
    damaged.write_bytes(blocks.pack(fastq(rng, 1)) + gzip.compress(fastq(rng, 40)) + whole)
    listed = spark.createDataFrame([(f"file://{damaged}", damaged.stat().st_size)], "path string, length long")
    assert [r["kind"] for r in fastx.ranges(listed, 300).collect()] == ["stream"]
    assert read_fastx(spark, str(damaged), layout=FOUR_LINE, content_bytes=0, split_bytes=300).count() == 71


def test_one_file_is_many_tasks(spark, tmp_path):
    rng = random.Random(5)
    (tmp_path / "a.fq.gz").write_bytes(packed(fastq(rng, 200), rng))
    found = read_fastx(spark, str(tmp_path / "a.fq.gz"), content_bytes=0, split_bytes=2000, layout=FOUR_LINE)
    assert found.rdd.getNumPartitions() >= 8 and found.count() == 200


def test_many_small_ranges_are_few_tasks(spark, tmp_path):
    rng = random.Random(11)
    (tmp_path / "a.fq.gz").write_bytes(packed(fastq(rng, 400), rng))
    files = spark.createDataFrame([(str(tmp_path / "a.fq.gz"), (tmp_path / "a.fq.gz").stat().st_size)], "path string, length long")
    found = fastx.parse_large(files, split_bytes=100)
    assert fastx.ranges(files, 100).count() > 100 > found.rdd.getNumPartitions()
    assert found.where("status = 'ok'").count() == 400
    # members are read a few at a time
    read = []
    stream = io.BytesIO(b"".join(blocks.pack(rng.randbytes(blocks.BLOCK)) for _ in range(40)))
    taken = stream.read
    stream = type("Stream", (), {"seek": stream.seek, "read": lambda self, n: (read.append(n), taken(n))[1]})()
    next(blocks._members(stream, 0))
    assert sum(read) < 10 * blocks.MEMBER_BYTES
