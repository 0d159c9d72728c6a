"""Session helpers: spreading small inputs and cutting long lineages."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it.

    Only a session that is all on this machine and names none gets one made; on a
    cluster a folder of one machine would not be seen by the others.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="readsieve-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _path(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at, files = _path(spark, path)
        files.delete(at, True)


# Folders written since the innermost ``scratch`` of this thread or task began, if there is one.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that ``cut`` writes inside go at the end, when nothing reads them any more.

    The list belongs to the thread that entered; scratches of other threads that
    overlap have their own.
    """
    mine: list[str] = []
    outer = _written.set(mine)
    try:
        yield
    finally:
        _written.reset(outer)
        remove(spark, *mine)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, for tasks that open files themselves."""
    at, files = _path(spark, path)
    return files.makeQualified(at).toString()


def write_shared(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> str:
    """Write ``df`` to the shared folder, and say where."""
    path = fresh_path(df.sparkSession, name)
    written = _written.get()
    if written is not None:
        written.append(path)
    df.write.partitionBy(*by).parquet(path)
    return path


def cut(df: DataFrame, name: str = "cut", by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs
    no recomputation of what came before, and later uses share one run. Columns in
    ``by`` become folders, so that a filter on them reads no others."""
    path = write_shared(df, name, by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(scan: DataFrame) -> int:
    return int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


# A scan of more bytes than this is left as it is split.
SPREAD_BYTES = 256 << 20


# What a task gets of rows that each take much work.
DEAL_BYTES = 1 << 20


def deal(scan: DataFrame, part_bytes: int = DEAL_BYTES) -> DataFrame:
    """Deal out the rows of a scan in small parts, as many as its size asks for.

    For narrow tables with much work on each row. Splits of a file are no measure for that: those without
    the start of a row group have no rows, so the number of tasks that work would not grow with the input.
    """
    parts = max(2 * scan.sparkSession.sparkContext.defaultParallelism, math.ceil(_bytes(scan) / part_bytes))
    return scan.repartition(parts)


def spread(scan: DataFrame) -> DataFrame:
    """Deal out the rows of a small scan that has few splits for the session's cores.

    A small file that arrives as one split would otherwise be worked on by one task.
    Rows are dealt in turn, so that no key can make one part larger than the others.
    A large table passes through without a shuffle, whatever its number of splits.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if _bytes(scan) > SPREAD_BYTES:
        return scan
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(2 * cores)
