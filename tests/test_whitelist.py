import pytest

from readsieve.operators import bloom, sketch
from readsieve.operators.bloom import BloomParams
from readsieve.operators.emission import KmerSpec
from readsieve.plans.screen import ScreenSpec, prepare, screen
from readsieve.plans.whitelist import kept

SPEC = KmerSpec(7)
PARAMS = BloomParams.of(1000, 0.01)
FIRST = [("acgtacgtaccagt",), ("ttgacctgaacgt",), (None,), ("",)]
SECOND = [("acgtacgtaccagt",), ("ccgatnaggacctagga",)]
READS = [(1, "acgtacgtaccagt"), (2, "ccgataggacctagga"), (3, "gggggggggggg"), (4, "ttgacctgaacgtnn")]


def seqs(spark, rows):
    return spark.createDataFrame(rows, "seq string")


def held(store):
    return {r["hash"]: r["version"] for r in store.hashes().collect()}


def at_once(spark, rows):
    return {r["hash"] for r in sketch.distinct_hashes(seqs(spark, rows), SPEC).collect()}


def bits(words):
    return sorted((r["word"], r["bits"]) for r in words.collect())


def test_grown_equals_built_at_once(spark, tmp_path):
    path = f"{tmp_path}/store"
    with kept(spark, path, SPEC, PARAMS) as store:
        assert held(store) == {} and bits(store.words()) == []
        assert store.grow(seqs(spark, FIRST)) == 1
    with kept(spark, path, SPEC, PARAMS) as store:
        assert store.grow(seqs(spark, SECOND)) == 2
        found = held(store)
        assert set(found) == at_once(spark, FIRST + SECOND)
        assert {h for h, v in found.items() if v == 1} == at_once(spark, FIRST)
        whole = sketch.distinct_hashes(seqs(spark, FIRST + SECOND), SPEC)
        assert bits(store.words()) == bits(bloom.bit_words(whole, PARAMS, 7))
        assert store.ref_length == sum(len(s or "") for (s,) in FIRST + SECOND)
        # sequences that bring nothing new
        assert store.grow(seqs(spark, SECOND)) == 3 and held(store) == found
        assert store.grow(seqs(spark, [])) == 4 and held(store) == found


def test_growing_shuffles_only_the_new(spark, tmp_path):
    with kept(spark, f"{tmp_path}/store", SPEC) as store:
        store.grow(seqs(spark, FIRST))
        fresh = seqs(spark, SECOND).selectExpr("xxhash64(seq) AS hash").repartition(store.buckets, "hash").hint("merge")
        old = spark.table(store._table(store.runs[0]))
        plan = fresh.join(old, "hash", "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan


def test_reset_and_compact(spark, tmp_path):
    path = f"{tmp_path}/store"
    with kept(spark, path, SPEC, PARAMS) as store:
        store.grow(seqs(spark, FIRST))
        store.grow(seqs(spark, SECOND))
        store.reset(1)
        assert set(held(store)) == at_once(spark, FIRST)
        # numbers are not used again
        assert store.grow(seqs(spark, SECOND)) == 3
        before, words = held(store), bits(store.words())
        store.compact()
        assert len(store.runs) == 1
    with kept(spark, path, SPEC, PARAMS) as store:
        assert (held(store), bits(store.words())) == (before, words)
        assert sorted(set(before.values())) == [1, 3]
        with pytest.raises(ValueError):
            store.reset(1)
        store.reset()
        assert held(store) == {} and store.ref_length == 0
        assert store.grow(seqs(spark, FIRST)) == 4


def test_unfinished_versions_do_not_count(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/store"
    with kept(spark, path, SPEC) as store:
        store.grow(seqs(spark, FIRST))
        monkeypatch.setattr(store, "_log", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.grow(seqs(spark, SECOND))
    with kept(spark, path, SPEC) as store:
        assert set(held(store)) == at_once(spark, FIRST)
        assert store.grow(seqs(spark, SECOND)) == 2


def test_other_parameters_are_refused(spark, tmp_path):
    path = f"{tmp_path}/store"
    with kept(spark, path, SPEC) as store:
        store.grow(seqs(spark, FIRST))
        with pytest.raises(ValueError):
            store.prepared(ScreenSpec(KmerSpec(9)))
        with pytest.raises(ValueError):
            store.words()
    with pytest.raises(ValueError):
        with kept(spark, path, KmerSpec(9)):
            pass
    assert not [d for d in spark.catalog.listDatabases() if d.name.startswith("whitelist_")]


@pytest.mark.parametrize("limits", [{}, {"broadcast_values": 0, "broadcast_bytes": 0}])
@pytest.mark.parametrize("filtered", [None, PARAMS])
def test_screening_with_a_kept_whitelist(spark, tmp_path, filtered, limits):
    spec = ScreenSpec(SPEC, 16, filter=filtered, **limits)
    reads = spark.createDataFrame(READS, "id long, seq string")
    with kept(spark, f"{tmp_path}/store", SPEC, PARAMS) as store:
        store.grow(seqs(spark, FIRST))
        store.grow(seqs(spark, SECOND))
        got = screen(reads, store.prepared(spec), spec, id_cols=["id"]).orderBy("id").collect()
    wanted = screen(reads, prepare(seqs(spark, FIRST + SECOND), spec), spec, id_cols=["id"]).orderBy("id").collect()
    assert got == wanted and any(r["intersections"] for r in got)
