"""How many of a sketch's minima lie in a whitelist.

Two ways give the same counts:

* ``probe_hits`` - a whitelist of checked size goes to every task as a sorted
  array or as a Bloom filter; sketching and probing share one narrow stage.
* ``joined_hits`` - a whitelist of any size stays a DataFrame and is joined.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readsieve.operators import bloom
from readsieve.operators.bloom import BloomParams
from readsieve.operators.emission import KmerSpec
from readsieve.operators.sketch import SKETCH_SIZE, bounded, check_size, id_fields, per_row_minima, project

# Most hashes (8 bytes each) that are sent to every task.
BROADCAST_VALUES = 4_000_000
# A hash that would fill a good part of a join task is matched by broadcast: one with more
# than 1/share of all minima, the share following the number of shuffle partitions.
LEAST_SHARE = 1000
SHARE_PER_PARTITION = 4
MOST_TRACKED = 1_000_000


@dataclass(frozen=True)
class Probe:
    """A whitelist small enough to travel: exact values, or a filled filter."""

    values: np.ndarray | None = None
    filled: np.ndarray | None = None
    params: BloomParams | None = None

    def holds(self, values: np.ndarray, spec: KmerSpec) -> np.ndarray:
        if self.filled is not None:
            return bloom.check_array(spec.tagged(values), self.filled, self.params, spec.k)
        if len(self.values) == 0:
            return np.zeros(len(values), dtype=bool)
        at = np.searchsorted(self.values, values)
        return self.values[np.minimum(at, len(self.values) - 1)] == values

    def holds_zero(self, spec: KmerSpec) -> bool:
        """Is the padding of a short sketch (tagged hash 0) a member?"""
        return bool(self.holds(spec.values(np.zeros(1, dtype=np.int64)), spec)[0])


def domain_fits(spec: KmerSpec, limit: int) -> bool:
    """Are there no more canonical k-mers (and the sentinel) than ``limit``?"""
    palindromes = 0 if spec.k % 2 else 2**spec.k
    return (4**spec.k + palindromes) // 2 + 1 <= limit


def probe_of(tagged: np.ndarray, spec: KmerSpec, params: BloomParams | None) -> Probe:
    """Distinct hashes at hand as a probe: a filled filter if it has ``params``."""
    if params is None:
        return Probe(values=np.sort(spec.values(tagged)))
    return Probe(filled=bloom.fill_array(tagged, params, spec.k), params=params)


def exact_probe(hashes: DataFrame, spec: KmerSpec) -> Probe:
    """Distinct ``hashes``, of a number already checked, as a sorted array."""
    return probe_of(hashes.toPandas()["hash"].to_numpy(dtype=np.int64), spec, None)


def bloom_probe(hashes: DataFrame, spec: KmerSpec, params: BloomParams, limit: int = bloom.BROADCAST_BYTES) -> Probe:
    """Any number of ``hashes`` as a filled filter of checked size."""
    return Probe(filled=bloom.gather(bloom.bit_words(hashes, params, spec.k), params, limit), params=params)


def probe_hits(
    reads: DataFrame,
    spec: KmerSpec,
    size: int = SKETCH_SIZE,
    *,
    probe: Probe,
    id_cols: Sequence[str],
    seq_col: str = "seq",
) -> DataFrame:
    """Sketch and probe in one pass: ``seq_len``, ``n_minima``, ``matches`` per sequence.

    Narrow, and only three numbers per sequence leave the Python worker.
    """
    check_size(spec, size)
    n_ids = len(id_cols)
    schema = T.StructType(
        id_fields(reads, id_cols)
        + [
            T.StructField("seq_len", T.LongType()),
            T.StructField("n_minima", T.IntegerType()),
            T.StructField("matches", T.LongType()),
        ]
    )
    # plain arrays, so that a worker can read them without this package
    sent = reads.sparkSession.sparkContext.broadcast((probe.values, probe.filled))
    params = probe.params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, filled = sent.value
        local = Probe(values, filled, params)
        for batch in bounded(batches):
            keep, lengths, counts, value = per_row_minima(batch, spec, size)
            held = np.concatenate(([0], np.cumsum(local.holds(value, spec))))
            ends = np.cumsum(counts)
            taken = pa.array(keep)
            columns = [batch.column(i).take(taken) for i in range(n_ids)]
            columns += [
                pa.array(lengths),
                pa.array(counts.astype(np.int32)),
                pa.array(held[ends] - held[ends - counts]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return project(reads, id_cols, seq_col).mapInArrow(run, schema)


def sketch_hits(sketches: DataFrame, spec: KmerSpec, probe: Probe, *, id_cols: Sequence[str]) -> DataFrame:
    """The same columns from sketches at hand, probed where they lie."""
    n_ids = len(id_cols)
    schema = T.StructType(
        id_fields(sketches, id_cols)
        + [
            T.StructField("seq_len", T.LongType()),
            T.StructField("n_minima", T.IntegerType()),
            T.StructField("matches", T.LongType()),
        ]
    )
    sent = sketches.sparkSession.sparkContext.broadcast((probe.values, probe.filled))
    params = probe.params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, filled = sent.value
        local = Probe(values, filled, params)
        for batch in batches:
            lists = batch.column(n_ids + 2)
            ends = np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy()))
            held = np.append(0, np.cumsum(local.holds(spec.values(lists.flatten().to_numpy()), spec)))
            columns = [batch.column(i) for i in range(n_ids + 2)] + [pa.array(held[ends[1:]] - held[ends[:-1]])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return sketches.select(*id_cols, "seq_len", "n_minima", "minima").mapInArrow(run, schema)


def hot_share(spark: SparkSession) -> int:
    return max(LEAST_SHARE, SHARE_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_hashes(minima: DataFrame, total: int, share: int) -> list[int]:
    """Hashes that make up more than 1/share of all minima: fewer than ``share``.

    One pass with a frequency sketch per task and no shuffle of the hashes. It
    only decides which join a hash goes through, never what is counted.
    """
    tracked = min(10 * share, MOST_TRACKED)
    top = minima.select(F.expr(f"approx_top_k(hash, {min(share, tracked)}, {tracked})").alias("top"))
    frequent = top.select(F.explode("top").alias("t")).where(F.col("t.count") * share > total)
    return [r[0] for r in frequent.select("t.item").collect()]


def joined_hits(sketches: DataFrame, whitelist: DataFrame, *, id_cols: Sequence[str], row: str) -> DataFrame:
    """The same columns from sketches and a whitelist of distinct hashes, by joins.

    ``row`` numbers the sketches, so that sequences with the same ids stay apart.
    Both inputs are read more than once; write them out first (``session.cut``). A
    hash that many sequences share (copies, the sentinel) would pile up in one join
    task, so frequent hashes are matched by a broadcast of a checked number of rows,
    the others by a shuffled semi-join.
    """
    spark = sketches.sparkSession
    minima = sketches.select(row, F.explode("minima").alias("hash"))
    total = sketches.agg(F.sum("n_minima")).first()[0] or 0
    frequent = F.broadcast(_hash_frame(spark, hot_hashes(minima, total, hot_share(spark))))
    held = F.broadcast(_hash_frame(spark, [r[0] for r in whitelist.join(frequent, "hash", "left_semi").collect()]))
    cold = minima.join(frequent, "hash", "left_anti").join(whitelist.hint("shuffle_merge"), "hash", "left_semi")
    found = cold.unionByName(minima.join(held, "hash", "left_semi"))
    matches = found.groupBy(row).agg(F.count(F.lit(1)).alias("matches"))
    # sequences without a match stay
    return sketches.join(matches, row, "left").select(
        *id_cols, "seq_len", "n_minima", F.coalesce("matches", F.lit(0)).alias("matches")
    )


def _hash_frame(spark: SparkSession, hashes: list[int]) -> DataFrame:
    return spark.createDataFrame([(h,) for h in hashes], "hash long")
