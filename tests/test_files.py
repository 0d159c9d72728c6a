import pytest
from pyspark.sql import functions as F

from readsieve.functions import files


@pytest.mark.parametrize(
    "path, wanted",
    [("/a/b.fastq", "fastq"), ("a.b.fq", "fq"), ("noext", ""), (".hidden", ""), ("a.", ""), ("/x.d/y", "d/y"), ("", "")],
)
def test_extension(spark, path, wanted):
    row = spark.createDataFrame([(path,)], "p string").select(
        files.extension(F.col("p")).alias("e"), files.is_read_file(F.col("p")).alias("r")
    )
    assert row.first().e == wanted
    assert row.first().r == (wanted in ("fastq", "fq"))


def test_event_kind(spark):
    cases = {
        files.CREATED | files.IS_FILE: "new_file",
        files.CREATED | files.IS_FILE | files.UPDATED: "new_file",
        files.REMOVED | files.IS_FILE: "deleted",
        files.CREATED | files.IS_DIR: "modified",
        files.UPDATED | files.IS_FILE: "modified",
        0: "modified",
    }
    rows = spark.createDataFrame([(f,) for f in cases], "f long").select("f", files.event_kind(F.col("f")).alias("k"))
    assert {r.f: r.k for r in rows.collect()} == cases
