import math
import random

import pytest
from pyspark.sql import functions as F

from readsieve.operators import membership
from readsieve.operators.bloom import BloomParams
from readsieve.operators.containment import score
from readsieve.operators.emission import KmerSpec
from readsieve.plans.screen import ScreenSpec, prepare, quarantine, screen
from tests import model

K, SIZE = 7, 16


def genome(n, seed):
    rnd = random.Random(seed)
    return "".join(rnd.choice("acgt") for _ in range(n))


REFERENCES = [genome(600, 1), genome(300, 2)]


def make_reads():
    rnd = random.Random(3)
    reads = [REFERENCES[0][i : i + rnd.randrange(5, 90)] for i in range(0, 500, 17)]
    reads += [genome(rnd.randrange(4, 200), 100 + i) for i in range(20)]
    reads += ["nn" + genome(20, 50), "nnnnnnnnnn", REFERENCES[0]]
    # copies of one read that make up most rows
    reads += [REFERENCES[1][40:120]] * 80
    return list(enumerate(reads))


READS = make_reads()


def expected(spec: ScreenSpec, held):
    ref = spec.ref_length or sum(map(len, REFERENCES))
    rows = {}
    for i, seq in READS:
        minima = model.sketch(seq, K, SIZE, spec.kmers.compat)
        if not minima:
            continue
        slots = minima + [0] * (SIZE - len(minima)) if spec.kmers.compat else minima
        found = sum(held(h) for h in slots) - math.floor(spec.fp_rate * SIZE)
        c = found / SIZE
        q, r = len(seq) - K + 1, ref - K + 1
        rows[i] = (len(seq), len(minima), found, c, q * c / (q + r - q * c))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    reads = spark.createDataFrame(READS, "id long, seq string").repartition(6)
    white = spark.createDataFrame(list(enumerate(REFERENCES)), "ref long, seq string")
    sentinel = spark.createDataFrame([(0, REFERENCES[0]), (1, "nnnnnnnnn" + REFERENCES[1])], "ref long, seq string")
    return reads, white, sentinel


def result(tables, spec, white):
    reads, *_ = tables
    found = screen(reads, prepare(white, spec), spec, id_cols=["id"]).collect()
    assert len({r.id for r in found}) == len(found)
    return {r.id: (r.seq_len, r.n_minima, r.intersections, r.containment, r.jaccard) for r in found}


def whitelist_set(white, compat):
    return {h for _, s in white for h in (model.emissions(s, K) if compat else model.plain(s, K))}


@pytest.mark.parametrize("compat", [True, False])
@pytest.mark.parametrize("limit", [membership.BROADCAST_VALUES, 0])
@pytest.mark.parametrize("padded", [True, False])
def test_exact(tables, compat, limit, padded, monkeypatch):
    monkeypatch.setattr(membership, "LEAST_SHARE", 40)
    spec = ScreenSpec(KmerSpec(K, compat), SIZE, broadcast_values=limit, fp_rate=0.07)
    _, white, sentinel = tables
    chosen = sentinel if padded else white
    held = whitelist_set([(r.ref, r.seq) for r in chosen.collect()], compat)
    assert (0 in held) == (padded and compat)
    ref = sum(len(r.seq) for r in chosen.collect())
    spec_ref = ScreenSpec(spec.kmers, SIZE, ref_length=ref, fp_rate=0.07)
    assert result(tables, spec, chosen) == expected(spec_ref, lambda h: h in held)


@pytest.mark.parametrize("large", [False, True])
def test_bloom(tables, large):
    """A filter small enough to be wrong now and then, gathered or joined."""
    params = BloomParams.of(1000, 0.6)
    limit = {"broadcast_bytes": 10} if large else {}
    spec = ScreenSpec(KmerSpec(K, True), SIZE, filter=params, ref_length=18246, **limit)

    def positions(h):
        data = h.to_bytes(8, "little")[:K]
        a = model.murmur(data, 0x9747B28C)
        b = model.murmur(data, a)
        return [(a + i * b) % 2**32 % params.bits for i in range(params.hashes)]

    exact = whitelist_set(list(enumerate(REFERENCES)), True)
    bits = {p for h in exact for p in positions(h)}
    _, white, _ = tables
    got = result(tables, spec, white)
    assert got == expected(spec, lambda h: all(p in bits for p in positions(h)))
    assert got != expected(spec, lambda h: h in exact)


def test_whole_reference_is_contained(tables):
    reads, white, _ = tables
    one = white.where("ref = 0")
    spec = ScreenSpec(KmerSpec(K), SIZE)
    prepared = prepare(one, spec)
    row = screen(one, prepared, spec, id_cols=["ref"]).first()
    assert (row.containment, row.jaccard) == (1.0, 1.0)


def test_jaccard_may_pass_one(spark):
    row = spark.createDataFrame([(2000, 16, 16)], "seq_len long, n_minima int, matches long")
    got = score(row, k=K, size=SIZE, ref_length=1000).first()
    assert got.jaccard == 1994 / 994


def test_false_positive_correction_is_not_clamped(spark):
    row = spark.createDataFrame([(100, 16, 1)], "seq_len long, n_minima int, matches long")
    assert score(row, k=K, size=SIZE, fp_rate=0.25, ref_length=1000).first().intersections == -3


@pytest.mark.parametrize("limit", [membership.BROADCAST_VALUES, 0])
@pytest.mark.parametrize("params", [None, BloomParams.of(1000, 0.01)])
def test_empty_whitelist(tables, limit, params):
    reads, white, _ = tables
    spec = ScreenSpec(KmerSpec(K), SIZE, filter=params, broadcast_values=limit)
    for empty in (white.where("false"), white.where("ref > 99")):
        prepared = prepare(empty, spec)
        assert (prepared.ref_length, prepared.holds_zero) == (0, False)
    found = screen(reads, prepared, spec, id_cols=["id"])
    assert found.agg(F.sum("intersections")).first()[0] == 0


@pytest.mark.parametrize("params", [None, BloomParams.of(1000, 0.01)])
def test_large_k_is_counted_before_it_is_gathered(tables, params):
    reads, white, _ = tables
    spec = ScreenSpec(KmerSpec(15), SIZE, filter=params, broadcast_values=2000)
    prepared = prepare(white, spec)
    assert prepared.probe is not None and prepared.ref_length == 900
    whole = screen(white, prepared, spec, id_cols=["ref"]).collect()
    assert {r.containment for r in whole} == {1.0}


def test_probing_is_narrow(tables):
    reads, white, _ = tables
    spec = ScreenSpec(KmerSpec(K), SIZE)
    scan = reads.sparkSession.range(100).select("id", F.lit("acgtacagattaca").alias("seq"))
    plan = screen(scan, prepare(white, spec), spec, id_cols=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_quarantine(spark):
    rows = spark.createDataFrame(
        [
            ("a", "acgtacgtac", "ok"),
            ("b", "acgt", "ok"),
            ("c", "", "empty"),
            ("d", "acgtacgtacg", "truncated"),
            ("e", None, "ok"),
            ("f", None, None),
        ],
        "name string, seq string, status string",
    )
    found = quarantine(rows, ScreenSpec(KmerSpec(7)), id_cols=["name"], status_col="status")
    assert {(r.name, r.seq_len, r.status) for r in found.collect()} == {
        ("b", 4, "short"),
        ("c", 0, "empty"),
        ("d", 11, "truncated"),
        ("e", 0, "null"),
        ("f", 0, "unknown"),
    }


@pytest.mark.parametrize("kmers", [KmerSpec(7), KmerSpec(7, False), KmerSpec(4), KmerSpec(4, False)])
def test_each_read_is_screened_or_in_quarantine(spark, kmers):
    seqs = [None, "", "acgt", "acgtacg", "acgtacgtacgtacgt", "nnnnnnnnnnnnn", "ATATATATATATAT", "acgtnacgtnacgtn", "acg" * 30]
    reads = spark.createDataFrame([(i % 3, s) for i, s in enumerate(seqs * 2)], "id long, seq string")
    spec = ScreenSpec(kmers, SIZE)
    prepared = prepare(spark.createDataFrame([("acgtacgtacgt",)], "seq string"), spec)
    screened = [r.id for r in screen(reads, prepared, spec, id_cols=["id"]).collect()]
    left_out = [r.id for r in quarantine(reads, spec, id_cols=["id"]).collect()]
    assert sorted(screened + left_out) == sorted(i % 3 for i in range(2 * len(seqs)))
    assert len(left_out) >= 4


@pytest.mark.parametrize("params", [None, BloomParams.of(1000, 0.01)])
def test_reads_with_the_same_id_stay_apart(tables, params):
    """One row per read on every route, whatever the ids."""
    reads, white, _ = tables
    same = reads.withColumn("id", F.lit("x"))
    found = []
    for values, size in ((membership.BROADCAST_VALUES, 1 << 20), (membership.BROADCAST_VALUES, 0), (0, 0)):
        spec = ScreenSpec(KmerSpec(K), SIZE, filter=params, broadcast_values=values, broadcast_bytes=size)
        rows = screen(same, prepare(white, spec), spec, id_cols=["id"]).collect()
        found.append(sorted(map(tuple, rows)))
    assert found[0] == found[1] == found[2] and len(found[0]) > 100
