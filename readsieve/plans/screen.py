"""The screening query: which reads are contained in a whitelist, and how far."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readsieve.operators import bloom
from readsieve.operators.bloom import BloomParams
from readsieve.operators.containment import score
from readsieve.operators.emission import KmerSpec, batch_minima
from readsieve.operators.membership import (
    BROADCAST_VALUES,
    Probe,
    bloom_probe,
    domain_fits,
    exact_probe,
    joined_hits,
    probe_hits,
    probe_of,
    sketch_hits,
)
from readsieve.operators.sketch import SKETCH_SIZE, bounded, hashes_and_length, id_fields, sketch
from readsieve.session import cut

ROW = "sketch_row"


@dataclass(frozen=True)
class ScreenSpec:
    """Parameters of a screening run."""

    kmers: KmerSpec = field(default_factory=KmerSpec)
    size: int = SKETCH_SIZE
    fp_rate: float = 0.0
    # None: match the whitelist's hashes themselves
    filter: BloomParams | None = None
    # None: the summed length of the whitelist sequences
    ref_length: int | None = None
    # most hashes, and largest filter, that are sent to every task
    broadcast_values: int = BROADCAST_VALUES
    broadcast_bytes: int = bloom.BROADCAST_BYTES


@dataclass(frozen=True)
class Whitelist:
    """A prepared whitelist: a probe if one fits, else its written hashes; its length."""

    hashes: DataFrame | None
    ref_length: int
    probe: Probe | None
    holds_zero: bool


def prepare(whitelist: DataFrame, spec: ScreenSpec, *, seq_col: str = "seq") -> Whitelist:
    """Hash the whitelist in one pass, and turn it into a probe when its size allows.

    For small k there are too few k-mers to exceed the limit, so the hashes are
    gathered at once. Otherwise they are written out, and gathered only if they
    were counted and found few, or as a Bloom filter of checked size.
    """
    kmers, params = spec.kmers, spec.filter
    small_filter = params is None or params.bytes <= spec.broadcast_bytes
    found = hashes_and_length(whitelist, kmers, seq_col=seq_col)
    if small_filter and domain_fits(kmers, spec.broadcast_values):
        rows = found.toArrow()
        length = pc.sum(rows["bases"]).as_py()
        probe = probe_of(rows["hash"].drop_null().to_numpy(), kmers, params)
        hashes = None
    else:
        found = cut(found, "whitelist")
        length = found.where("hash IS NULL").agg(F.sum("bases")).first()[0]
        hashes = found.where("hash IS NOT NULL").select("hash")
        probe = None
        if params is not None and small_filter:
            probe = bloom_probe(hashes, kmers, params, spec.broadcast_bytes)
        elif params is None and hashes.count() <= spec.broadcast_values:
            probe = exact_probe(hashes, kmers)
    ref_length = int(length or 0) if spec.ref_length is None else spec.ref_length
    if probe is not None:
        return Whitelist(hashes, ref_length, probe, probe.holds_zero(kmers))
    if params is None:
        return Whitelist(hashes, ref_length, None, bool(hashes.where("hash = 0").take(1)))
    zero = hashes.sparkSession.range(1).select(F.lit(0).cast("long").alias("hash"))
    zero_held = bloom.members(zero, bloom.bit_words(hashes, params, kmers.k), params, kmers.k)
    return Whitelist(hashes, ref_length, None, bool(zero_held.take(1)))


def hits(
    reads: DataFrame, prepared: Whitelist, spec: ScreenSpec, *, id_cols: Sequence[str], seq_col: str = "seq"
) -> DataFrame:
    """Matches per read: one narrow stage if the whitelist has a probe.

    If not, only the hashes that the reads really have matter: those of them that are
    in the whitelist become a probe if they are few enough, and are joined if not.
    """
    if prepared.probe is not None:
        return probe_hits(reads, spec.kmers, spec.size, probe=prepared.probe, id_cols=id_cols, seq_col=seq_col)
    numbered = sketch(reads, spec.kmers, spec.size, id_cols=id_cols, seq_col=seq_col).withColumn(
        ROW, F.monotonically_increasing_id()
    )
    sketches = cut(numbered, "sketches")
    asked = sketches.select(F.explode("minima").alias("hash")).distinct()
    if spec.filter is not None:
        words = bloom.bit_words(prepared.hashes, spec.filter, spec.kmers.k)
        found = cut(bloom.members(asked, words, spec.filter, spec.kmers.k), "members")
    else:
        found = cut(asked.join(prepared.hashes, "hash", "left_semi"), "members")
    if found.count() <= spec.broadcast_values:
        return sketch_hits(sketches, spec.kmers, exact_probe(found, spec.kmers), id_cols=id_cols)
    return joined_hits(sketches, found, id_cols=id_cols, row=ROW)


def screen(
    reads: DataFrame,
    prepared: Whitelist,
    spec: ScreenSpec,
    *,
    id_cols: Sequence[str],
    seq_col: str = "seq",
) -> DataFrame:
    """``seq_len, n_minima, intersections, containment, jaccard`` per read.

    In compat mode the empty slots of a short sketch are probed as zeros, so
    they count whenever the whitelist holds 0. Reads that emit nothing (not
    longer than k) have no row; ``quarantine`` lists them.
    """
    counted = hits(reads, prepared, spec, id_cols=id_cols, seq_col=seq_col)
    return score(
        counted,
        k=spec.kmers.k,
        size=spec.size,
        fp_rate=spec.fp_rate,
        ref_length=prepared.ref_length,
        padding=spec.kmers.compat and prepared.holds_zero,
    )


def quarantine(
    reads: DataFrame,
    spec: ScreenSpec,
    *,
    id_cols: Sequence[str],
    seq_col: str = "seq",
    status_col: str | None = None,
) -> DataFrame:
    """``seq_len, status`` of every read for which ``screen`` has no row.

    With ``status_col`` those are the reads whose status is not ``ok`` and, of the
    others, those that emit nothing: ``null`` ones, ``short`` ones (no longer than k)
    and those without a usable k-mer (``no_kmers``). ``screen`` of the reads that are
    ``ok`` and this hold each read once between them.
    """
    status = F.lit("ok") if status_col is None else F.coalesce(F.col(status_col), F.lit("unknown"))
    null = F.col(seq_col).isNull()
    given = F.when((status == "ok") & null, F.lit("null")).otherwise(status)
    asked = reads.select(*id_cols, given.alias("status"), F.coalesce(seq_col, F.lit("")).alias("seq"))
    n_ids, kmers = len(id_cols), spec.kmers
    schema = T.StructType(
        id_fields(reads, id_cols) + [T.StructField("seq_len", T.LongType()), T.StructField("status", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            lengths, row, _ = batch_minima(batch.column(n_ids + 1), kmers, 1)
            silent = np.bincount(row, minlength=batch.num_rows) == 0
            status = batch.column(n_ids)
            fine = pc.equal(status, "ok").to_numpy(zero_copy_only=False)
            reason = np.where(lengths <= kmers.k, "short", "no_kmers")
            told = pc.if_else(pa.array(fine), pa.array(reason), status)
            kept = pa.array(np.flatnonzero(silent | ~fine))
            columns = [batch.column(i).take(kept) for i in range(n_ids)]
            columns += [pa.array(lengths).take(kept), told.take(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return asked.mapInArrow(run, schema)
