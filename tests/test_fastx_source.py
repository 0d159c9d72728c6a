"""The registered format against the reader function."""

import gzip
import os
import random

import pytest

from readsieve.sources import fastx_source
from readsieve.sources.fastx import FIELDS, read_fastx
from tests.test_blocks import fastq


@pytest.fixture
def folder(spark, tmp_path):
    fastx_source.register(spark)
    rng = random.Random(1)
    for name, n in (("a.fq", 40), ("b.fq", 25), ("c.txt", 3)):
        (tmp_path / name).write_bytes(fastq(rng, n))
    (tmp_path / "d.fq").write_bytes(b"@cut\nACGT\n+\nII\n")
    (tmp_path / "e.fq.gz").write_bytes(gzip.compress(fastq(rng, 9)))
    return tmp_path


def rows(df):
    return sorted((("/" + r["file"].split(":")[-1].lstrip("/"), *r[1:]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("layout", ["any", "four_line"])
def test_rows_equal_the_reader(spark, folder, layout):
    source = spark.read.format("fastx").option("layout", layout).option("splitBytes", 700)
    for glob in ("*.fq", "*"):
        found = source.option("glob", glob).load(str(folder))
        assert found.columns == list(FIELDS)
        assert rows(found) == rows(read_fastx(spark, str(folder), glob=glob, layout=layout))
    many = source.option("glob", "a.fq").load(str(folder)).rdd.getNumPartitions()
    assert many == 1 if layout == "any" else many > 4


def test_columns_and_filters(spark, folder):
    found = spark.read.format("fastx").option("columns", "status,name,file").option("glob", "*.fq").load(f"file:{folder}")
    assert found.columns == ["status", "name", "file"]
    damaged = found.where("status = 'truncated'")
    assert [r["name"] for r in damaged.collect()] == ["cut"]
    file = found.where("name = 'cut'").first()["file"]
    one = found.where(f"file = '{file}' and status in ('ok', 'truncated') and name like 'c%'")
    assert one.count() == 1 and one.rdd.getNumPartitions() == 1
    assert found.where("status = 'ok' and status = 'empty'").count() == 0
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("fastx").option("columns", "nothing").load(str(folder)).count()


def test_stream_and_restart(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    for k, name in enumerate(("a.fq", "b.fq", "d.fq")):
        os.utime(folder / name, (1_000_000 + k, 1_000_000 + k))

    def run():
        stream = spark.readStream.format("fastx").option("glob", "*.fq").option("columns", "file,name").load(str(folder))
        writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/log")
        query = writer.trigger(availableNow=True).start(f"{out}/rows")
        query.awaitTermination(120)
        return spark.read.parquet(f"{out}/rows").count()

    assert run() == 66
    assert run() == 66
    (folder / "new.fq").write_bytes(fastq(random.Random(2), 5))
    assert run() == 71
