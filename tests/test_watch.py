import os
import time

import pytest

from readsieve.operators.bloom import BloomParams
from readsieve.operators.emission import KmerSpec
from readsieve.plans.screen import ScreenSpec, prepare
from readsieve.streaming import watch as module
from readsieve.streaming.watch import metrics, new_files, watch
from tests.test_screen import REFERENCES

SPEC = ScreenSpec(KmerSpec(7), 16, filter=BloomParams.of(1000, 0.001))


def fastq(name, seq):
    return f"@{name}\n{seq}\n+\n{'I' * len(seq)}\n"


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")


@pytest.fixture(scope="module")
def prepared(spark):
    white = spark.createDataFrame(list(enumerate(REFERENCES)), "ref long, seq string")
    return prepare(white, SPEC)


def drain(spark, prepared, folders, **options):
    source, out, log = folders
    query = watch(spark, str(source), prepared, SPEC, out=out, checkpoint=log, drain=True, **options)
    query.awaitTermination()
    if not os.path.exists(out):
        return []
    return sorted(r.name for r in spark.read.schema("name string").parquet(out).collect())


def test_each_new_file_once(spark, prepared, folders):
    source = folders[0]
    (source / "a.fastq").write_text(fastq("a", REFERENCES[0][:60]) + fastq("tiny", "ACGT"))
    (source / "b.txt").write_text(fastq("b", REFERENCES[0][:60]))
    (source / "c.FASTQ").write_text(fastq("c", REFERENCES[0][:60]))
    assert drain(spark, prepared, folders, include_existing=True) == ["a"]
    # an edit of a known file and a restart bring nothing new
    (source / "a.fastq").write_text(fastq("edited", REFERENCES[0][:60]))
    assert drain(spark, prepared, folders, include_existing=True) == ["a"]
    (source / "d.fq").write_text(fastq("d", REFERENCES[1][:60]))
    assert drain(spark, prepared, folders, include_existing=True) == ["a", "d"]
    row = spark.read.parquet(folders[1]).where("name = 'd'").first()
    assert (row.seq_len, row.containment) == (60, 1.0)


def test_existing_files_are_left_alone(spark, prepared, folders):
    source = folders[0]
    (source / "old.fastq").write_text(fastq("old", REFERENCES[0][:60]))
    os.utime(source / "old.fastq", (time.time() - 1000, time.time() - 1000))
    assert drain(spark, prepared, folders) == []
    (source / "new.fastq").write_text(fastq("new", REFERENCES[0][:60]))
    assert drain(spark, prepared, folders) == ["new"]


def test_damaged_file_keeps_its_good_reads(spark, prepared, folders):
    source = folders[0]
    good = fastq("good", REFERENCES[0][:60])
    (source / "x.fastq").write_text(good + "@bad\nACGTACGTACGT\n+\nII\n")
    assert drain(spark, prepared, folders, include_existing=True, max_files=1) == ["good"]


def test_large_files_are_opened_by_the_tasks(spark, prepared, folders):
    source = folders[0]
    (source / "small.fastq").write_text(fastq("small", REFERENCES[0][:60]))
    (source / "large.fastq").write_text("".join(fastq(f"r{i}", REFERENCES[0][i : i + 60]) for i in range(20)))
    names = drain(spark, prepared, folders, include_existing=True, content_bytes=500)
    assert names == sorted(["small", *(f"r{i}" for i in range(20))])


def test_source_is_a_stream_of_files(spark, folders):
    files = new_files(spark, str(folders[0]), checkpoint=folders[2], include_existing=True)
    assert files.isStreaming and files.columns == ["path", "modificationTime", "length", "content"]


def test_a_file_moved_into_place_is_new_however_old(spark, prepared, folders):
    source = folders[0]
    (source / "old.fastq").write_text(fastq("old", REFERENCES[0][:60]))
    assert drain(spark, prepared, folders) == []
    for name, age in (("hour", 3600), ("month", 30 * 86400)):
        outside = source.parent / f"{name}.fastq"
        outside.write_text(fastq(name, REFERENCES[0][:60]))
        os.utime(outside, (time.time() - age, time.time() - age))
        outside.rename(source / f"{name}.fastq")
        (source / f"{name}2.fastq").write_text(fastq(f"{name}2", REFERENCES[1][:60]))
        drain(spark, prepared, folders)
    assert drain(spark, prepared, folders) == ["hour", "hour2", "month", "month2"]


def test_whitelist_without_a_probe(spark, folders):
    white = spark.createDataFrame(list(enumerate(REFERENCES)), "ref long, seq string")
    spec = ScreenSpec(KmerSpec(15), 16, broadcast_values=0)
    large = prepare(white, spec)
    assert large.probe is None
    source, out, log = folders
    (source / "a.fastq").write_text(fastq("a", REFERENCES[0][:60]) + fastq("b", "ACGT" * 20))
    watch(spark, str(source), large, spec, out=out, checkpoint=log, drain=True, include_existing=True).awaitTermination()
    found = {r.name: r.containment for r in spark.read.parquet(out).collect()}
    assert found["a"] == 1.0 and found["b"] < 1.0


def test_reads_without_a_result_are_kept_apart(spark, prepared, folders):
    source = folders[0]
    good, short = fastq("good", REFERENCES[0][:60]), fastq("short", "ACGT")
    (source / "x.fastq").write_text(good + short + "@bad\nACGTACGTACGT\n+\nII\n" + fastq("next", REFERENCES[0][:60]))
    assert drain(spark, prepared, folders, include_existing=True, layout="four_line") == ["good", "next"]
    rows = spark.read.parquet(folders[1] + "-quarantine").collect()
    assert sorted((r.name, r.status) for r in rows) == [("bad", "truncated"), ("short", "short")]


def test_large_files_are_cut_by_layout(spark, prepared, folders):
    source = folders[0]
    (source / "large.fastq").write_text("".join(fastq(f"r{i:02}", REFERENCES[0][i : i + 60]) for i in range(30)))
    names = drain(spark, prepared, folders, include_existing=True, layout="four_line", content_bytes=0, split_bytes=400)
    assert names == [f"r{i:02}" for i in range(30)]


def test_counters_of_each_batch(spark, prepared, folders):
    source, out, _ = folders
    (source / "a.fastq").write_text(fastq("a", REFERENCES[0][:60]) + fastq("tiny", "ACGT"))
    drain(spark, prepared, folders, include_existing=True)
    # nothing but reads without a result, then a restart without new files
    (source / "b.fastq").write_text(fastq("tiny", "ACGT") + fastq("less", "AC"))
    drain(spark, prepared, folders, include_existing=True)
    # Spark's file source has no row for an empty file
    (source / "c.fastq").write_text("")
    drain(spark, prepared, folders, include_existing=True)
    drain(spark, prepared, folders, include_existing=True)
    rows = {r["batch"]: r for r in metrics(spark, out).collect()}
    assert sorted(rows) == [0, 1, 2]
    kept = [(r["files"], r["reads"], r["bases"], r["hits"], r["quarantined"]) for _, r in sorted(rows.items())]
    assert kept == [(1, 1, 60, 1, 1), (1, 0, 0, 0, 2), (0, 0, 0, 0, 0)]
    assert rows[0]["bytes"] == (source / "a.fastq").stat().st_size and all(r["seconds"] > 0 for r in rows.values())


def test_a_batch_is_listed_without_contents(spark, prepared, folders, monkeypatch):
    """Large files are never read as one value."""
    source = folders[0]
    (source / "a.fastq").write_text(fastq("a", REFERENCES[0][:60]))
    (source / "large.fastq").write_text("".join(fastq(f"r{i}", REFERENCES[0][i : i + 60]) for i in range(20)))
    lists = []
    read = module.read_batch
    monkeypatch.setattr(module, "read_batch", lambda batch, *rest: (lists.append(batch.columns), read(batch, *rest))[1])
    # Spark refuses to read longer files whole
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        names = drain(spark, prepared, folders, include_existing=True, content_bytes=500)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert names == sorted(["a", *(f"r{i}" for i in range(20))])
    assert lists == [["path", "length"]]


def test_names_that_look_like_patterns_are_names(spark, folders):
    for name in ("a[1]{x,y}*.fastq", "a1x.fastq", "b?.fq", "bc.fq"):
        (folders[0] / name).write_text(name)
    paths = [f"file:{folders[0]}/{n}" for n in ("a[1]{x,y}*.fastq", "b?.fq")]
    found = module._contents(spark, paths).collect()
    assert sorted(bytes(r["content"]).decode() for r in found) == ["a[1]{x,y}*.fastq", "b?.fq"]
