import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readsieve.functions.hashing import (
    BLOOM_SEED,
    canonical_kmer,
    hash64,
    hash64_array,
    kmer_code,
    murmur2,
    murmur2_array,
    tag,
)
from tests import model


@pytest.mark.parametrize("k", [1, 5, 7, 8, 9, 15, 16, 21, 27, 31])
def test_hash64_both_forms(spark, k):
    rnd = random.Random(k)
    codes = [0, 4**k - 1] + [rnd.randrange(4**k) for _ in range(200)]
    wanted = [model.mix(c, k) for c in codes]
    rows = spark.createDataFrame(list(enumerate(codes)), "i int, c long")
    got = rows.select("i", hash64(F.col("c"), k).alias("h")).orderBy("i").collect()
    assert [r.h for r in got] == wanted
    dtype = np.uint32 if k <= 16 else np.uint64
    assert hash64_array(np.array(codes, dtype=dtype), k).tolist() == wanted


def test_hash64_short_form():
    for k in (3, 7):
        m = 4**k - 1
        assert all(model.mix(x, k) == ((m - x) * 5565) & m for x in range(4**k))


def test_tag_and_canonical(spark):
    rows = spark.createDataFrame([("acgtaca",), ("tgtacgt",)], "kmer string")
    got = rows.select(tag(hash64(kmer_code(canonical_kmer(F.col("kmer"))), 7), 7).alias("h")).collect()
    assert {r.h for r in got} == {1543943}
    with pytest.raises(ValueError):
        tag(F.col("h"), 28)


def test_murmur_known_values():
    assert model.murmur(b"abcdefg", BLOOM_SEED) == 0xEB595499
    assert model.murmur(b"", BLOOM_SEED) == 0x106E08D9
    assert murmur2_array(np.array([1543943], dtype=np.uint64), 7, BLOOM_SEED)[0] == 0x26193940


@pytest.mark.parametrize("length", range(1, 9))
def test_murmur_both_forms(spark, length):
    rnd = random.Random(length)
    values = [0, 2**63 - 1, *(rnd.randrange(2**63) for _ in range(100))]
    wanted = [model.murmur(v.to_bytes(8, "little")[:length], BLOOM_SEED) for v in values]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v long")
    got = rows.select("i", murmur2(F.col("v"), length, F.lit(BLOOM_SEED)).alias("h")).orderBy("i").collect()
    assert [r.h for r in got] == wanted
    assert murmur2_array(np.array(values, dtype=np.uint64), length, BLOOM_SEED).tolist() == wanted
