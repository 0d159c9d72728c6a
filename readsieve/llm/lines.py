"""Line dedup against levelled sorted runs of line hashes.

The store holds hashes of lines seen so far in runs: tables bucketed and sorted by
hash. A batch of documents is merged against the runs (they are bucketed, so only
the batch is shuffled): lines with a hash in a run are dropped, the others become a
run of level 0. When a level has ``fanout`` runs they are compacted into one of the
next level, so there are few runs however many batches came, and a hash is rewritten
once a level.

Batches go in by ascending doc_id, so a line that several documents hold stays in the
smallest doc_id. Within a batch the smallest doc_id with the hash counts as first.

**Hot lines.** A task sorts the hashes of its own documents first and lets one row for
each hash through; the other documents of the task are known to lose the line. A line
in a third of all documents is then as many rows as there are tasks.

A key is a line without ASCII white space at its ends and with A-Z in lower case; keys
under ``min_chars`` code points always stay. Null and empty texts are one empty line.
Rows without a doc_id keep all lines and own none. Rows that repeat a doc_id count as
one document. Extra columns pass through ``dedup`` untouched; ``text`` is replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from readsieve.llm.texts import BLANKS, ROWS_OUT, per_row, small_batches
from readsieve.session import cut, exists, fresh_path, remove

MIN_CHARS = 10
BATCHES = 4
FANOUT = 3
_VERSIONS = "version int, level int, run string, fresh boolean, buckets int"
HASH_BYTES = 16
ROWS_AT_ONCE = 512

_LOWER = {c: c + 32 for c in range(65, 91)}


def line_key(line: str) -> str:
    return line.strip(BLANKS).translate(_LOWER)


def line_hash(line: str, min_chars: int) -> bytes | None:
    """128 bits of the key, or None if it is too short to count."""
    key = line_key(line)
    return xxhash.xxh3_128_digest(key.encode()) if len(key) >= min_chars else None


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, doc_id, first): distinct for each document; first if no smaller doc_id of the task has h."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in batches:
            rows: list[bytes] = []
            ids: list[int] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = {line_hash(line, min_chars) for line in (text.as_py() or "").split("\n")} - {None}
                rows.extend(hashes)
                ids.extend([doc_id] * len(hashes))
            part = np.empty(len(ids), [("hi", ">u8"), ("lo", ">u8"), ("doc", "<i8")])
            both = np.frombuffer(b"".join(rows), ">u8").reshape(-1, 2)
            part["hi"], part["lo"], part["doc"] = both[:, 0], both[:, 1], ids
            found.append(part)
        if not found:
            return
        run = np.concatenate(found)
        run = run[np.lexsort((run["doc"], run["lo"], run["hi"]))]
        run = run[np.append(True, run[1:] != run[:-1])] if len(run) else run  # rows that repeat a doc_id
        new = np.ones(len(run), bool)
        new[1:] = (run["hi"][1:] != run["hi"][:-1]) | (run["lo"][1:] != run["lo"][:-1])
        for at in range(0, len(run), ROWS_OUT):
            part = run[at : at + ROWS_OUT]
            key = np.stack([part["hi"], part["lo"]], axis=1).astype(">u8").tobytes()
            h = pa.Array.from_buffers(
                pa.binary(HASH_BYTES), len(part), [None, pa.py_buffer(key)]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [h, pa.array(part["doc"].astype(np.int64)), pa.array(new[at : at + ROWS_OUT])],
                names=["h", "doc_id", "first"],
            )

    return (
        small_batches(docs.where("doc_id is not null"))
        .select("doc_id", "text")
        .mapInArrow(task, "h binary, doc_id long, first boolean")
    )


class LineStore:
    """Levels of runs of line hashes: bucketed tables in the shared folder.

    A store opened with a ``path`` is kept there: ``commit`` notes its runs, and a later
    job that opens the same path merges its batches against them. Without a path it lasts
    for one job. Runs of a job that didn't come to its commit are not part of the store.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark = spark
        self.fanout = fanout
        self.kept = path is not None
        self.path = path or fresh_path(spark, "line-store")
        # Tables need a database; its folder holds nothing.
        self.database = f"line_runs_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{self.path}/database'")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.version = 0
        self.left: list[str] = []
        if self.kept and exists(spark, f"{self.path}/versions"):
            self._open()

    def _open(self) -> None:
        noted = self.spark.read.schema(_VERSIONS).parquet(f"{self.path}/versions")
        self.version = noted.agg(F.max("version")).first()[0] or 0
        for r in noted.where(F.col("version") == self.version).orderBy("level", "run").collect():
            self.buckets = r["buckets"]
            columns = "h BINARY, doc_id BIGINT, fresh BOOLEAN" if r["fresh"] else "h BINARY"
            self.spark.sql(
                f"CREATE TABLE {self.database}.{r['run']} ({columns}) USING parquet"
                f" CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{r['run']}'"
            )
            while len(self.levels) <= r["level"]:
                self.levels.append([])
            self.levels[r["level"]].append(r["run"])

    def _write(self, rows: DataFrame) -> str:
        run = f"run_{uuid.uuid4().hex}"
        writer = rows.write.option("path", f"{self.path}/{run}").bucketBy(self.buckets, "h").sortBy("h")
        writer.saveAsTable(f"{self.database}.{run}")
        return run

    def _run(self, run: str) -> DataFrame:
        """Hashes of one run; batches keep theirs beside the lines that they lost."""
        rows = self.spark.table(f"{self.database}.{run}")
        return rows.where("fresh").select("h") if "fresh" in rows.columns else rows

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in the lines of one batch (h, doc_id); return the (h, doc_id) to be dropped."""
        rows = batch.withColumn("owner", F.min("doc_id").over(Window.partitionBy("h"))).dropDuplicates(["h", "doc_id"])
        seen = F.lit(False)
        for i, run in enumerate(r for level in self.levels for r in level):
            rows = rows.join(self._run(run).withColumn(f"in{i}", F.lit(True)), "h", "left")
            seen = seen | F.coalesce(F.col(f"in{i}"), F.lit(False))
        run = self._write(rows.select("h", "doc_id", (~seen & (F.col("doc_id") == F.col("owner"))).alias("fresh")))
        self._push(0, run)
        return self.spark.table(f"{self.database}.{run}").where("not fresh").select("h", "doc_id")

    def _push(self, level: int, run: str) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = reduce(DataFrame.union, [self._run(r) for r in self.levels[level]])
            self.left += self.levels[level]
            self.levels[level] = []
            self._push(level + 1, self._write(merged.repartition(self.buckets, "h")))

    def commit(self) -> None:
        """Note the runs; those that were compacted go, so nothing may read them any more."""
        self.version += 1
        noted = [
            (self.version, level, run, "fresh" in self.spark.table(f"{self.database}.{run}").columns, self.buckets)
            for level, runs in enumerate(self.levels)
            for run in runs
        ]
        rows = self.spark.createDataFrame(noted, _VERSIONS).coalesce(1)
        rows.write.mode("append").parquet(f"{self.path}/versions")
        remove(self.spark, *[f"{self.path}/{run}" for run in self.left])
        self.left = []

    def close(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")
        if not self.kept:
            remove(self.spark, self.path)


def _ranges(lines: DataFrame, batches: int) -> list[tuple[int | None, int | None]]:
    """Ascending ranges of doc_id, from (inclusive) and to (exclusive), that cover all."""
    steps = [i / batches for i in range(1, batches)]
    found = lines.select(F.percentile_approx("doc_id", steps).alias("at")).first()["at"] or []
    cuts = sorted(set(found))
    return list(zip([None, *cuts], [*cuts, None]))


def lost_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
    store_path: str | None = None,
) -> DataFrame:
    """(doc_id, lost): hashes of the lines each document loses, joined into one binary.

    With a ``store_path``, lines that earlier calls put into the store are lost too, and
    those of ``docs`` go into it: each crawl is one call.
    """
    lines = cut(hashed_lines(docs, min_chars), "lines")
    firsts = lines.where("first").select("h", "doc_id")
    store = LineStore(docs.sparkSession, store_path, fanout)
    try:
        lost = lines.where("not first").select("h", "doc_id")
        for least, end in _ranges(lines, batches):
            batch = firsts
            if least is not None:
                batch = batch.where(F.col("doc_id") >= least)
            if end is not None:
                batch = batch.where(F.col("doc_id") < end)
            lost = lost.unionByName(store.add(batch))
        whole = cut(lost.groupBy("doc_id").agg(F.collect_list("h").alias("lost")), "lost")
        if store.kept:
            store.commit()
    finally:
        store.close()
    return whole


def _with_lost(docs: DataFrame, **options) -> DataFrame:
    lost = lost_lines(docs, **options).withColumnRenamed("doc_id", "__lines_of")
    return docs.join(lost.withColumnRenamed("lost", "__lost"), F.col("doc_id") == F.col("__lines_of"), "left")


def kept_lines(text: str | None, lost: list[bytes] | None, min_chars: int) -> tuple[list[str], int]:
    """The lines that stay and the number of those that go."""
    lines = (text or "").split("\n")
    if not lost:
        return lines, 0
    gone = set(map(bytes, lost))
    kept = [line for line in lines if line_hash(line, min_chars) not in gone]
    return kept, len(lines) - len(kept)


DIGEST_SCHEMA = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("n_lines", LongType()),
        StructField("n_dropped", LongType()),
        StructField("kept_sha256", StringType()),
    ]
)


def dedup_digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row: lines, dropped lines and the digest of the text that stays."""

    def make():
        def row(doc_id, text, lost):
            kept, dropped = kept_lines(text, lost, min_chars)
            return doc_id, len(kept) + dropped, dropped, hashlib.sha256("\n".join(kept).encode()).hexdigest()

        return row

    joined = _with_lost(docs.select("doc_id", "text"), min_chars=min_chars)
    return per_row(joined, ["doc_id", "text", "__lost"], DIGEST_SCHEMA, make)


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, store_path: str | None = None) -> DataFrame:
    """``docs`` with the texts that stay; null texts stay null."""

    at, width = docs.columns.index("text"), len(docs.columns)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                columns = [batch.column(i) for i in range(width)]
                texts = []
                for text, lost in zip(columns[at], batch.column(width)):
                    text, lost = text.as_py(), lost.as_py()
                    texts.append("\n".join(kept_lines(text, lost, min_chars)[0]) if lost and text is not None else text)
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width])

    joined = _with_lost(docs, min_chars=min_chars, store_path=store_path).select(*docs.columns, "__lost")
    return small_batches(joined).mapInArrow(task, docs.schema)
