"""Bottom-s (KMV) sketches and the hash sets they are taken from."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readsieve.operators.emission import (
    UNSIGNED_K,
    KmerSpec,
    batch_minima,
    bottom_values,
    emissions,
    string_codes,
)

SKETCH_SIZE = 128
# The dedupe table of compat mode holds fewer than this many minima.
COMPAT_SIZE_LIMIT = 256
# Sequence bytes handled at a time; a longer row comes alone. A byte may become a value of 8 bytes,
# with its row and its ids beside it and several copies on the way.
SLICE_BYTES = 1 << 20
# Values held at a time where those of all rows are wanted together.
VALUES_AT_ONCE = 4 << 20


def check_size(spec: KmerSpec, size: int) -> None:
    if size < 1 or (spec.compat and size >= COMPAT_SIZE_LIMIT):
        raise ValueError(f"sketch size {size} is out of range")


def project(reads: DataFrame, id_cols: Sequence[str], seq_col: str) -> DataFrame:
    """Only the columns the Arrow task needs, so that the scan reads no others."""
    return reads.select(*id_cols, seq_col).where(F.col(seq_col).isNotNull())


def id_fields(reads: DataFrame, id_cols: Sequence[str]) -> list[T.StructField]:
    return [reads.schema[c] for c in id_cols]


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``SLICE_BYTES`` of sequence (the last column)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1
        for start, end in zip(np.append(0, edges), np.append(edges, batch.num_rows)):
            yield batch.slice(int(start), int(end - start))


def per_row_minima(batch: pa.RecordBatch, spec: KmerSpec, size: int | None):
    """Rows that emit anything, their lengths, and their values in CSR form."""
    lengths, row, value = batch_minima(batch.column(batch.num_columns - 1), spec, size)
    counts = np.bincount(row, minlength=batch.num_rows)
    keep = np.flatnonzero(counts)
    return keep, lengths[keep], counts[keep], value


def sketch(
    reads: DataFrame, spec: KmerSpec, size: int = SKETCH_SIZE, *, id_cols: Sequence[str], seq_col: str = "seq"
) -> DataFrame:
    """One row per sequence that emits: length, number of minima, minima (largest first).

    Narrow: each Arrow batch is sketched where it was read, nothing is shuffled.
    From k = 28 the minima are unsigned numbers in a signed column.
    """
    check_size(spec, size)
    n_ids = len(id_cols)
    schema = T.StructType(
        id_fields(reads, id_cols)
        + [
            T.StructField("seq_len", T.LongType()),
            T.StructField("n_minima", T.IntegerType()),
            T.StructField("minima", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            keep, lengths, counts, value = per_row_minima(batch, spec, size)
            ends = np.cumsum(counts)
            # reverse each row's ascending run
            within = np.arange(len(value)) - np.repeat(ends - counts, counts)
            flip = np.repeat(ends - 1, counts) - within
            minima = pa.ListArray.from_arrays(
                pa.array(np.append(0, ends), type=pa.int32()), pa.array(spec.tagged(value[flip]))
            )
            taken = pa.array(keep)
            columns = [batch.column(i).take(taken) for i in range(n_ids)]
            columns += [pa.array(lengths), pa.array(counts.astype(np.int32)), minima]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return project(reads, id_cols, seq_col).mapInArrow(run, schema)


def emitted(reads: DataFrame, spec: KmerSpec, *, id_cols: Sequence[str], seq_col: str = "seq") -> DataFrame:
    """Distinct hashes each sequence emits, one row per (sequence, hash)."""
    n_ids = len(id_cols)
    schema = T.StructType(id_fields(reads, id_cols) + [T.StructField("hash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            keep, _, counts, value = per_row_minima(batch, spec, None)
            taken = pa.array(np.repeat(keep, counts))
            columns = [batch.column(i).take(taken) for i in range(n_ids)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spec.tagged(value))], names=schema.names)

    return project(reads, id_cols, seq_col).mapInArrow(run, schema)


def grouped_hashes(reads: DataFrame, spec: KmerSpec, *, keys: Sequence[str], seq_col: str = "seq") -> DataFrame:
    """Distinct hashes of each group of sequences, one row per (group, hash).

    A task reduces the rows of a slice that have the same keys to their distinct hashes at once, so what
    leaves it, and what it holds, depends on the slice's size and not on how many sequences repeat a hash.
    """
    schema = T.StructType(id_fields(reads, keys) + [T.StructField("hash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            ids = pa.Table.from_batches([batch.select(range(len(keys)))])
            at = ids.append_column("sketch_row", pa.array(np.arange(batch.num_rows)))
            groups = at.group_by(list(keys)).aggregate([("sketch_row", "list")])["sketch_row_list"]
            for group in groups.to_pylist():
                part = batch.column(len(keys)).take(pa.array(group))
                codes, offsets = string_codes(part, spec)
                first = [batch.column(i).slice(group[0], 1) for i in range(len(keys))]
                for value in _values(codes, offsets, spec):
                    columns = [c.take(pa.array(np.zeros(len(value), np.int64))) for c in first]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(spec.tagged(value))], names=schema.names)

    return project(reads, keys, seq_col).mapInArrow(run, schema).distinct()


def base_counts(
    reads: DataFrame, alphabet: str, *, id_cols: Sequence[str], seq_col: str = "seq"
) -> DataFrame:
    """How often each base occurs in a sequence: ``n_a, n_c, n_g, n_t`` and ``n_n``."""
    n_ids = len(id_cols)
    names = ["n_a", "n_c", "n_g", "n_t", "n_n"]
    schema = T.StructType(id_fields(reads, id_cols) + [T.StructField(n, T.LongType()) for n in names])
    spec = KmerSpec(1, alphabet=alphabet)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            codes, offsets = string_codes(batch.column(n_ids), spec)
            cell = np.repeat(np.arange(batch.num_rows) * len(names), np.diff(offsets)) + codes
            counts = np.bincount(cell, minlength=batch.num_rows * len(names)).reshape(-1, len(names))
            columns = [batch.column(i) for i in range(n_ids)] + [pa.array(c) for c in counts.T]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return project(reads, id_cols, seq_col).mapInArrow(run, schema)


def _values(codes: np.ndarray, offsets: np.ndarray, spec: KmerSpec) -> Iterator[np.ndarray]:
    """Values of all rows in parts of bounded size, distinct within a part."""

    def distinct(values: np.ndarray) -> np.ndarray:
        return bottom_values(np.zeros(len(values), np.int64), values, None, spec.value_bits)[1]

    kept: list[np.ndarray] = []
    held = 0
    for _, values in emissions(codes, offsets, spec):
        kept.append(distinct(values))
        held += len(kept[-1])
        if held >= VALUES_AT_ONCE:
            kept = [distinct(np.concatenate(kept))]
            held = len(kept[0])
            if 2 * held >= VALUES_AT_ONCE:
                yield kept.pop()
                held = 0
    if kept:
        yield distinct(np.concatenate(kept))


def _distinct(sequences: DataFrame, spec: KmerSpec, seq_col: str, name: str, finish) -> DataFrame:
    """Distinct values of all sequences.

    Tasks reduce what they read to parts of distinct values, whatever the length
    of a row, and ``distinct`` combines once more on the map side.
    """
    schema = T.StructType([T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            for value in _values(*string_codes(batch.column(0), spec), spec):
                yield pa.RecordBatch.from_arrays([pa.array(finish(value))], names=[name])

    return project(sequences, [], seq_col).mapInArrow(run, schema).distinct()


def distinct_hashes(sequences: DataFrame, spec: KmerSpec, *, seq_col: str = "seq") -> DataFrame:
    """Union of the hashes all sequences emit (column ``hash``)."""
    return _distinct(sequences, spec, seq_col, "hash", spec.tagged)


def hashes_and_length(sequences: DataFrame, spec: KmerSpec, *, seq_col: str = "seq") -> DataFrame:
    """The same union with the summed length of the sequences, from one pass.

    Rows ``hash, bases``: the row without a hash holds the length in ``bases``.
    """
    schema = T.StructType([T.StructField("hash", T.LongType()), T.StructField("bases", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            codes, offsets = string_codes(batch.column(0), spec)
            length = [pa.array([None], pa.int64()), pa.array([int(offsets[-1])])]
            yield pa.RecordBatch.from_arrays(length, names=schema.names)
            for value in _values(codes, offsets, spec):
                columns = [pa.array(spec.tagged(value)), pa.array(np.zeros(len(value), np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    pieces = project(sequences, [], seq_col).mapInArrow(run, schema)
    return pieces.groupBy("hash").agg(F.sum("bases").alias("bases"))


def canonical_codes(sequences: DataFrame, k: int, alphabet: str, *, seq_col: str = "seq") -> DataFrame:
    """Union of the canonical packed k-mers of all complete windows (column ``canonical``)."""
    spec = KmerSpec(k, False, alphabet, hashed=False)
    return _distinct(sequences, spec, seq_col, "canonical", lambda value: value.view(np.int64) - 1)


def minima_rows(sketches: DataFrame, *, id_cols: Sequence[str]) -> DataFrame:
    """One row per minimum, ``rank`` 0 for the largest."""
    return sketches.select(*id_cols, F.posexplode("minima").alias("rank", "hash"))


def _task_sketches(sketches: DataFrame, size: int, keys: Sequence[str]) -> DataFrame:
    """The s smallest of each group within each task; a group may come more than once."""
    schema = T.StructType(id_fields(sketches, keys) + [T.StructField("minima", T.ArrayType(T.LongType()))])
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def packed(types) -> pa.RecordBatch:
            columns = [pa.array([key[i] for key in held], types[i]) for i in range(n_keys)]
            ends = np.cumsum([0, *map(len, held.values())])
            flat = np.concatenate(list(held.values())).view(np.int64)
            columns.append(pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(flat)))
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        types = None
        for batch in batches:
            types = batch.schema.types
            groups: dict[tuple, list[np.ndarray]] = {}
            names = zip(*(batch.column(i).to_pylist() for i in range(n_keys))) if n_keys else [()] * batch.num_rows
            lists = batch.column(n_keys)
            flat = lists.flatten().to_numpy().view(np.uint64)
            ends = np.cumsum(np.append(0, pc.list_value_length(lists).fill_null(0).to_numpy()))
            for key, start, end in zip(names, ends[:-1], ends[1:]):
                groups.setdefault(key, []).append(flat[start:end])
            for key, parts in groups.items():
                before = [held[key]] if key in held else []
                held[key] = np.unique(np.concatenate(before + parts))[:size]
            if len(held) * size > VALUES_AT_ONCE:
                yield packed(types)
                held.clear()
        if held:
            yield packed(types)

    return sketches.select(*keys, "minima").mapInArrow(run, schema)


def merge(sketches: DataFrame, spec: KmerSpec, size: int = SKETCH_SIZE, *, keys: Sequence[str]) -> DataFrame:
    """Sketch of each group: the s smallest of its sequences' minima.

    A task keeps s rows for each of its groups before anything is shuffled, so the
    last step of a group sees at most tasks x s rows however many sequences it has.
    """
    pairs = _task_sketches(sketches, size, keys).select(*keys, F.explode("minima").alias("hash")).distinct()
    order = F.col("hash") if spec.k < UNSIGNED_K else F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    smallest = ranked.where(F.col("rank") <= size)
    packed = smallest.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "hash")), asc=False).alias("r"))
    return packed.select(*keys, F.size("r").alias("n_minima"), F.col("r.hash").alias("minima"))
