import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readsieve.functions.bases import DNA, runs
from readsieve.functions.hashing import canonical_kmer, kmer_code
from readsieve.functions.kmers import kmer_rows, valid_windows
from readsieve.operators import sketch as sketches_module
from readsieve.operators.emission import KmerSpec
from readsieve.operators.sketch import base_counts, canonical_codes, distinct_hashes, emitted, merge, minima_rows, sketch
from tests import model


def random_reads(n, seed=1, longest=400):
    rnd = random.Random(seed)
    return [(i, "".join(rnd.choice("acgtacgtacgtn") for _ in range(rnd.randrange(longest)))) for i in range(n)]


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame(random_reads(60), "id long, seq string").repartition(4)


@pytest.mark.parametrize("k, compat", [(3, True), (7, True), (7, False), (8, True), (15, True)])
def test_sketch_rows(spark, reads, k, compat):
    got = {r.id: r for r in sketch(reads, KmerSpec(k, compat), 16, id_cols=["id"]).collect()}
    for i, seq in random_reads(60):
        wanted = model.sketch(seq, k, 16, compat)
        if not wanted:
            assert i not in got
            continue
        assert got[i].minima == wanted
        assert got[i].n_minima == len(wanted)
        assert got[i].seq_len == len(seq)


def test_reference_vector(spark):
    one = spark.createDataFrame([("r", "actgactgactg")], "id string, seq string")
    assert sketch(one, KmerSpec(3), 4, id_cols=["id"]).first().minima == [14595, 9731, 7939, 6147]
    rows = minima_rows(sketch(one, KmerSpec(3), 4, id_cols=["id"]), id_cols=["id"]).orderBy("rank").collect()
    assert [(r.rank, r.hash) for r in rows] == [(0, 14595), (1, 9731), (2, 7939), (3, 6147)]


def test_only_needed_columns_are_read(spark, reads, tmp_path):
    reads.withColumn("extra", F.lit("x")).write.parquet(str(tmp_path / "reads"))
    scan = spark.read.parquet(str(tmp_path / "reads"))
    plan = sketch(scan, KmerSpec(7), id_cols=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "extra" not in plan
    assert "Exchange" not in plan


def test_size_limits(reads):
    for size in (0, 256):
        with pytest.raises(ValueError):
            sketch(reads, KmerSpec(7), size, id_cols=["id"])
    assert sketch(reads, KmerSpec(7, False), 300, id_cols=["id"]).count() > 0


def test_emitted_and_distinct(reads):
    wanted = {(i, h) for i, seq in random_reads(60) for h in model.emissions(seq, 7)}
    got = emitted(reads, KmerSpec(7), id_cols=["id"]).collect()
    assert len(got) == len(wanted)
    assert {(r.id, r.hash) for r in got} == wanted
    union = distinct_hashes(reads, KmerSpec(7)).collect()
    assert sorted(r.hash for r in union) == sorted({h for _, h in wanted})


@pytest.mark.parametrize("k", [4, 7, 15, 31])
def test_canonical_codes_both_ways(reads, k):
    arrow = {r.canonical for r in canonical_codes(reads, k, DNA).collect()}
    columns = kmer_rows(reads, k, DNA).select(kmer_code(canonical_kmer(F.col("kmer"))).alias("c")).distinct()
    assert arrow == {r.c for r in columns.collect()} and arrow


def test_merge_equals_sketch_of_the_union(spark, reads):
    grouped = reads.withColumn("g", F.when(F.col("id") < 40, 0).otherwise(F.col("id") % 3))
    sketches = sketch(grouped, KmerSpec(7), 16, id_cols=["id", "g"])
    got = {r.g: r.minima for r in merge(sketches, KmerSpec(7), 16, keys=["g"]).collect()}
    for g in got:
        members = [seq for i, seq in random_reads(60) if (0 if i < 40 else i % 3) == g]
        union = sorted({h for seq in members for h in model.emissions(seq, 7)})
        assert got[g] == union[:16][::-1]


def test_merge_ranks_before_its_shuffle(reads):
    sketches = sketch(reads.withColumn("g", F.lit(0)), KmerSpec(7), 16, id_cols=["id", "g"])
    plan = merge(sketches, KmerSpec(7), 16, keys=["g"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_unsigned_hashes(spark):
    seqs = [(i, s) for i, s in random_reads(20, seed=5) if len(s) > 40]
    rows = spark.createDataFrame([(i, s, 0) for i, s in seqs], "id long, seq string, g int")
    sketches = sketch(rows, KmerSpec(31), 8, id_cols=["id", "g"])
    got = {r.id: [h % 2**64 for h in r.minima] for r in sketches.collect()}
    for i, seq in seqs:
        assert got[i] == model.sketch(seq, 31, 8)
    union = sorted({h for _, seq in seqs for h in model.emissions(seq, 31)})
    merged = merge(sketches, KmerSpec(31), 8, keys=["g"]).first().minima
    assert [h % 2**64 for h in merged] == union[:8][::-1]


def test_column_kmers(spark):
    rows = spark.createDataFrame([("acgTUnacg",), ("",), ("nn",), ("ac",)], "seq string")
    assert sorted(r.kmer for r in kmer_rows(rows, 3, DNA).collect()) == ["acg", "acg", "cgt", "gtt"]
    assert {r.seq: r.n for r in rows.select("seq", valid_windows(F.col("seq"), 3, DNA).alias("n")).collect()} == {
        "acgTUnacg": 4,
        "": 0,
        "nn": 0,
        "ac": 0,
    }
    assert [r.r for r in rows.select(runs(F.col("seq"), DNA, 3).alias("r")).collect()] == [["acgTU", "acg"], [], [], []]


def test_base_counts(spark, reads):
    got = {r.id: (r.n_a, r.n_c, r.n_g, r.n_t, r.n_n) for r in base_counts(reads, DNA, id_cols=["id"]).collect()}
    assert got == {i: tuple(s.count(b) for b in "acgtn") for i, s in random_reads(60)}


def test_slices_change_nothing(spark, reads, monkeypatch):
    wanted = {tuple(r) for r in emitted(reads, KmerSpec(7), id_cols=["id"]).collect()}
    monkeypatch.setattr(sketches_module, "SLICE_BYTES", 100)
    assert {tuple(r) for r in emitted(reads, KmerSpec(7), id_cols=["id"]).collect()} == wanted
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 70, "", "c" * 250, "g", "t" * 99])], names=["seq"])
    parts = [b.column(0).to_pylist() for b in sketches_module.bounded(iter([batch]))]
    assert [x for p in parts for x in p] == batch.column(0).to_pylist() and len(parts) > 2


def test_hashes_of_groups_leave_a_task_once(spark):
    """Groups are reduced where they are read; null keys and null sequences as in ``emitted``."""
    rows = [(i % 3 if i % 4 else None, "s" if i % 2 else None, "acgtacgttgca" * (1 + i % 5) + "acgt"[i % 4] * 9) for i in range(300)]
    reads = spark.createDataFrame([*rows, (7, None, None), (8, "x", "ac")], "a int, b string, seq string").coalesce(1)
    for compat in (True, False):
        spec = KmerSpec(7, compat)
        wanted = emitted(reads, spec, id_cols=["a", "b"]).distinct()
        found = sketches_module.grouped_hashes(reads, spec, keys=["a", "b"])
        rows_of = lambda df: sorted(map(tuple, df.collect()), key=repr)
        assert found.columns == ["a", "b", "hash"] and rows_of(found) == rows_of(wanted)
