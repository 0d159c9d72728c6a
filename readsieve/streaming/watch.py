"""Watch a directory: screen the reads of each new file, once."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readsieve.functions.files import is_read_file
from readsieve.plans.screen import ScreenSpec, Whitelist, quarantine, screen
from readsieve.session import scratch
from readsieve.sources.fastx import ANY, CONTENT_BYTES, FILE_SCHEMA, SPLIT_BYTES, parse, parse_large

READ_GLOB = "*.{fastq,fq}"
# Files of a batch unless told otherwise, so that a backlog is worked off in steps.
MAX_FILES = 1000
# The file source forgets, and then ignores, files much older than the newest; none is too old here.
_ANY_AGE = "36500d"
_RECORD_COLUMNS = ("file", "record_offset", "name", "seq", "status")
_ID_COLUMNS = ["file", "record_offset", "name"]
METRICS = "batch long, files long, bytes long, reads long, bases long, hits long, quarantined long, seconds double"


def present_at_start(spark: SparkSession, directory: str, checkpoint: str) -> DataFrame:
    """Paths (column ``known``) of the files that were there when this watch first started.

    Kept beside the checkpoint across restarts. Names, not times, tell a new file, so a
    file moved into place is new however old it is.
    """
    path = f"{checkpoint.rstrip('/')}-present"
    found = spark.read.format("binaryFile").schema(FILE_SCHEMA).load(directory).select(F.col("path").alias("known"))
    found.write.mode("ignore").parquet(path)
    return spark.read.schema("known string").parquet(path)


def new_files(
    spark: SparkSession,
    directory: str,
    *,
    checkpoint: str,
    include_existing: bool = False,
    glob: str = READ_GLOB,
    max_files: int | None = MAX_FILES,
) -> DataFrame:
    """Stream of files that appear in the directory; later edits are ignored.

    Of the file source's columns only those used later are read.
    """
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob)
    reader = reader.option("maxFileAge", _ANY_AGE)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.load(directory)
    if glob == READ_GLOB:
        files = files.where(is_read_file(F.col("path")))
    if not include_existing:
        known = present_at_start(spark, directory, checkpoint)
        files = files.join(known, files["path"] == known["known"], "left_anti")
    return files


def _contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, content`` of the files named, whose names are no patterns."""
    plain = [re.sub(r"([\\{}\[\]*?^])", r"\\\1", p) for p in paths]
    return spark.read.format("binaryFile").load(plain).select("path", "content")


def read_batch(files: DataFrame, layout: str, content_bytes: int, split_bytes: int) -> DataFrame:
    """Records of the files of one batch (rows ``path, length``): small ones by value, large ones opened by the tasks.

    The list of a batch comes without contents, as a batch has no filters that its source could use:
    it would bring every file whole, large ones too, each time it is looked at. Like the file source
    itself, the driver names the files of a batch.
    """
    spark, found = files.sparkSession, files.where(F.col("length") <= content_bytes)
    paths = [r["path"] for r in found.select("path").collect()]
    contents = _contents(spark, paths) if paths else spark.createDataFrame([], "path string, content binary")
    small = parse(contents, _RECORD_COLUMNS, layout)
    listed = files.where(F.col("length") > content_bytes).select("path", "length")
    large = parse_large(listed, _RECORD_COLUMNS, layout, split_bytes)
    return small if large is None else small.unionByName(large)


def watch(
    spark: SparkSession,
    directory: str,
    prepared: Whitelist,
    spec: ScreenSpec,
    *,
    out: str,
    checkpoint: str,
    include_existing: bool = False,
    glob: str = READ_GLOB,
    max_files: int | None = MAX_FILES,
    drain: bool = False,
    layout: str = ANY,
    content_bytes: int = CONTENT_BYTES,
    split_bytes: int = SPLIT_BYTES,
) -> StreamingQuery:
    """Start the stream: results go to ``out``, reads without a result to ``out-quarantine``.

    Both are parquet, a folder ``batch=N`` for each batch. The file source's log makes
    each file part of one batch, and a batch that is repeated after a restart replaces
    its folders, so each file counts exactly once. A batch is an ordinary screening
    run: any whitelist will do, and large files are cut if their ``layout`` is declared.
    ``out-metrics`` has one row of counters for each batch, in the same kind of folder; reads and
    quarantined ones are counted while they are written. Empty files count in no batch.
    With ``drain`` the query stops when the files present are done.
    """
    files = new_files(
        spark, directory, checkpoint=checkpoint, include_existing=include_existing, glob=glob, max_files=max_files
    )
    # without the contents, which each batch reads as it needs them
    listed = files.select("path", "length")
    base = out.rstrip("/")

    def run(batch: DataFrame, number: int) -> None:
        began = time.monotonic()
        screened, apart = Observation(), Observation()
        reads = read_batch(batch, layout, content_bytes, split_bytes)
        usable = reads.where(F.col("status") == "ok")
        with scratch(spark):
            results = screen(usable, prepared, spec, id_cols=_ID_COLUMNS)
            results = results.observe(
                screened,
                F.count(F.lit(1)).alias("reads"),
                F.sum("seq_len").alias("bases"),
                F.count_if(F.col("intersections") > 0).alias("hits"),
            )
            results.write.mode("overwrite").parquet(f"{base}/batch={number}")
        left_out = quarantine(reads, spec, id_cols=_ID_COLUMNS, status_col="status")
        left_out = left_out.observe(apart, F.count(F.lit(1)).alias("quarantined"))
        left_out.write.mode("overwrite").parquet(f"{base}-quarantine/batch={number}")
        files, size = batch.agg(F.count(F.lit(1)), F.sum("length")).first()
        got = screened.get
        row = (number, files, size or 0, got["reads"], got["bases"] or 0, got["hits"], apart.get["quarantined"])
        metrics = spark.createDataFrame([(*row, time.monotonic() - began)], METRICS).coalesce(1)
        metrics.write.mode("overwrite").parquet(f"{base}-metrics/batch={number}")

    writer = listed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if drain else writer.start()


def metrics(spark: SparkSession, out: str) -> DataFrame:
    """Counters of every batch that a watch with this ``out`` has finished, over restarts too."""
    return spark.read.schema(METRICS).parquet(f"{out.rstrip('/')}-metrics/*")
