"""A whitelist that is kept and grows: versions of hashes and filter words in a folder.

**Runs.** Each version is a run: the hashes that no live version had, as a table bucketed and
sorted by hash, and the filter words of those hashes. New sequences are merged against the runs
by anti-joins; the runs are read where they lie and only the new hashes are shuffled. Sequences
of earlier versions are never read again.

**Log.** A version counts once its row in the log is written, which is the last thing ``grow``
does; a run that failed before leaves files that nothing refers to. ``reset`` and ``compact``
are rows as well. Version numbers are never used twice.

The folder must be one that all executors see. A store has one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readsieve.operators import bloom
from readsieve.operators.bloom import BloomParams
from readsieve.operators.emission import KmerSpec
from readsieve.operators.membership import Probe, exact_probe
from readsieve.operators.sketch import hashes_and_length
from readsieve.plans.screen import ScreenSpec, Whitelist
from readsieve.session import cut, exists, scratch

_LOG = "at long, action string, version int, run string, buckets int, bases long, made_with string"
_COLUMNS = "hash BIGINT, version INT"


@dataclass(frozen=True)
class Run:
    """Hashes and words of the versions up to ``version`` that no earlier run has."""

    version: int
    name: str
    bases: int


class KeptWhitelist:
    """An opened store. ``params`` adds a Bloom filter that is kept as well."""

    def __init__(self, spark: SparkSession, path: str, kmers: KmerSpec, params: BloomParams | None = None):
        self.spark, self.path, self.kmers, self.params = spark, path.rstrip("/"), kmers, params
        self.database = f"whitelist_{uuid.uuid4().hex}"
        self.made_with = f"{kmers} {params}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[Run] = []
        self.last = self.steps = 0
        rows = []
        if exists(spark, f"{self.path}/log"):
            rows = spark.read.schema(_LOG).parquet(f"{self.path}/log").orderBy("at").collect()
        for r in rows:
            if r["made_with"] != self.made_with:
                raise ValueError(f"the store was made with {r['made_with']}, not {self.made_with}")
            self._replay(r["action"], Run(r["version"], r["run"], r["bases"]))
            self.buckets, self.steps = r["buckets"], r["at"]
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{self.path}/database'")
        for run in self.runs:
            spark.sql(
                f"CREATE TABLE {self._table(run)} ({_COLUMNS}) USING parquet CLUSTERED BY (hash) SORTED BY (hash)"
                f" INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run.name}'"
            )

    def close(self) -> None:
        """Forget the tables' names; the folder stays."""
        self.spark.sql(f"DROP DATABASE {self.database} CASCADE")

    def _table(self, run: Run) -> str:
        return f"{self.database}.{run.name}"

    def _replay(self, action: str, run: Run) -> None:
        self.last = max(self.last, run.version)
        if action == "compact":
            self.runs = []
        if action == "reset":
            self.runs = [r for r in self.runs if r.version <= run.version]
        else:
            self.runs.append(run)

    def _log(self, action: str, run: Run) -> None:
        row = (self.steps + 1, action, run.version, run.name, self.buckets, run.bases, self.made_with)
        self.spark.createDataFrame([row], _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        self.steps += 1
        self._replay(action, run)

    def _write(self, rows: DataFrame, version: int, bases: int) -> Run:
        """``rows (hash, version)`` as a run that no log row names yet."""
        run = Run(version, f"run_{uuid.uuid4().hex}", bases)
        writer = rows.repartition(self.buckets, "hash").write.option("path", f"{self.path}/{run.name}")
        writer.bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(self._table(run))
        return run

    def grow(self, sequences: DataFrame, *, seq_col: str = "seq") -> int:
        """Merge sequences in; their hashes that are new make up the version that is returned.

        Nulls and sequences that emit nothing add nothing; a version may be empty.
        """
        version = self.last + 1
        with scratch(self.spark):
            found = cut(hashes_and_length(sequences, self.kmers, seq_col=seq_col), "grown")
            bases = int(found.where("hash IS NULL").agg(F.sum("bases")).first()[0] or 0)
            fresh = found.where("hash IS NOT NULL").select("hash").repartition(self.buckets, "hash")
            for old in self.runs:
                fresh = fresh.join(self.spark.table(self._table(old)), "hash", "left_anti")
            run = self._write(fresh.select("hash", F.lit(version).alias("version")), version, bases)
        if self.params is not None:
            rows = self.spark.table(self._table(run))
            bloom.bit_words(rows, self.params, self.kmers.k).write.parquet(f"{self.path}/{run.name}_words")
        self._log("grow", run)
        return version

    def reset(self, version: int = 0) -> None:
        """Drop the versions after ``version``. One inside a compacted run can't be gone back to."""
        if version and version not in [r.version for r in self.runs]:
            raise ValueError(f"no run ends with version {version}")
        self._log("reset", Run(version, "", 0))

    def compact(self) -> None:
        """All live runs as one, so that growing reads one table again; hashes keep their versions."""
        if len(self.runs) < 2:
            return
        run = self._write(self.hashes(), self.runs[-1].version, self.ref_length)
        if self.params is not None:
            self.words().write.parquet(f"{self.path}/{run.name}_words")
        self._log("compact", run)

    @property
    def ref_length(self) -> int:
        """Summed length of the sequences of the live versions."""
        return sum(r.bases for r in self.runs)

    def hashes(self) -> DataFrame:
        """``(hash, version)``: each hash once, with the version that brought it."""
        found = self.spark.createDataFrame([], _COLUMNS)
        for run in self.runs:
            found = found.unionByName(self.spark.table(self._table(run)))
        return found

    def words(self) -> DataFrame:
        """The filter of all live versions as ``(word, bits)``: the union of theirs."""
        if self.params is None:
            raise ValueError("the store keeps no filter")
        found = self.spark.createDataFrame([], "word bigint, bits bigint")
        for run in self.runs:
            found = found.unionByName(self.spark.read.schema(found.schema).parquet(f"{self.path}/{run.name}_words"))
        return found.groupBy("word").agg(F.bit_or("bits").alias("bits"))

    def prepared(self, spec: ScreenSpec) -> Whitelist:
        """What ``screen`` takes: a probe if the kept hashes or the filter are small enough, else the hashes."""
        if spec.kmers != self.kmers or spec.filter not in (None, self.params):
            raise ValueError("the store was made for other k-mers or another filter")
        hashes = self.hashes().select("hash")
        ref_length = self.ref_length if spec.ref_length is None else spec.ref_length
        probe = None
        if spec.filter is not None and spec.filter.bytes <= spec.broadcast_bytes:
            probe = Probe(filled=bloom.gather(self.words(), spec.filter, spec.broadcast_bytes), params=spec.filter)
        elif spec.filter is None and hashes.count() <= spec.broadcast_values:
            probe = exact_probe(hashes, spec.kmers)
        if probe is not None:
            return Whitelist(hashes, ref_length, probe, probe.holds_zero(spec.kmers))
        zero = self.spark.createDataFrame([(0,)], "hash bigint")
        if spec.filter is None:
            held = hashes.join(zero, "hash", "left_semi")
        else:
            held = bloom.members(zero, self.words(), spec.filter, spec.kmers.k)
        return Whitelist(hashes, ref_length, None, bool(held.take(1)))


@contextmanager
def kept(
    spark: SparkSession, path: str, kmers: KmerSpec, params: BloomParams | None = None
) -> Iterator[KeptWhitelist]:
    """The store at ``path``, made if there is none, closed at the end."""
    store = KeptWhitelist(spark, path, kmers, params)
    try:
        yield store
    finally:
        store.close()
