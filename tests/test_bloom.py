import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readsieve.operators import bloom
from readsieve.operators.bloom import BloomParams
from tests import model


def test_sizing_known_values():
    p = BloomParams.of(1_000_000, 0.01)
    assert (p.bits, p.bytes, p.hashes) == (9_585_058, 1_198_133, 7)
    p = BloomParams.of(100_000, 0.001)
    assert (p.bits, p.bytes, p.hashes) == (1_437_758, 179_720, 10)
    assert p.bpe == pytest.approx(14.37758756605117, abs=1e-12)


@pytest.mark.parametrize("entries, error", [(999, 0.01), (1000, 0.0), (1000, 1.0)])
def test_sizing_refuses(entries, error):
    with pytest.raises(ValueError):
        BloomParams.of(entries, error)


def test_sizing_columns(spark):
    rows = spark.createDataFrame([(999,), (1000,), (123_457,)], "n long")
    got = {r.n: r for r in rows.select("n", *[c.alias(k) for k, c in bloom.params_columns(F.col("n"), 0.01).items()]).collect()}
    assert got[999].bits is None
    for n in (1000, 123_457):
        p = BloomParams.of(n, 0.01)
        assert (got[n].bits, got[n].bytes, got[n].hashes) == (p.bits, p.bytes, p.hashes)


POSITIONS = [
    (14595, 3, BloomParams.of(1_000_000, 0.01), [713551, 540698, 367845, 194992, 883451, 710598, 537745]),
    (
        1543943,
        7,
        BloomParams.of(100_000, 0.001),
        [822712, 1055467, 1288222, 83219, 315974, 548729, 397334, 630089, 862844, 1095599],
    ),
    (
        0,
        7,
        BloomParams.of(100_000, 0.001),
        [1060739, 1424085, 349673, 713019, 692215, 1055561, 1418907, 344495, 323691, 687037],
    ),
]


@pytest.mark.parametrize("value, k, params, wanted", POSITIONS)
def test_positions(spark, value, k, params, wanted):
    row = spark.createDataFrame([(value,)], "hash long")
    got = bloom.with_positions(row, params, k).orderBy("i").collect()
    assert [(r.hash, r.position) for r in got] == [(value, p) for p in wanted]


def keys(n, seed):
    rnd = random.Random(seed)
    return [rnd.randrange(2**54) for _ in range(n)]


@pytest.mark.parametrize("k", [2, 7, 8, 11])
def test_filled_filter(spark, k):
    params = BloomParams.of(1000, 0.05)
    held = keys(800, 1)
    words = bloom.bit_words(spark.createDataFrame([(h,) for h in held], "hash long"), params, k)
    filled = bloom.gather(words, params)
    assert len(filled) == params.bytes
    assert (filled == bloom.fill_array(np.array(held, dtype=np.int64), params, k)).all()

    bits = set()
    length = min(k, 8)

    def positions(h):
        data = h.to_bytes(8, "little")[:length]
        a = model.murmur(data, 0x9747B28C)
        b = model.murmur(data, a)
        return [(a + i * b) % 2**32 % params.bits for i in range(params.hashes)]

    for h in held:
        bits.update(positions(h))
    assert {i for i in range(params.bits) if filled[i >> 3] >> (i & 7) & 1} == bits

    asked = held[:50] + keys(3000, 2)
    wanted = [all(p in bits for p in positions(h)) for h in asked]
    got = bloom.check_array(np.array(asked, dtype=np.int64), filled, params, k)
    assert got.tolist() == wanted
    assert all(wanted[:50])
    distinct = spark.createDataFrame([(h,) for h in set(asked)], "hash long")
    joined = {r.hash for r in bloom.members(distinct, words, params, k).collect()}
    assert joined == {h for h, w in zip(asked, wanted) if w}


def test_empty_filter(spark):
    params = BloomParams.of(1000, 0.01)
    words = bloom.bit_words(spark.createDataFrame([], "hash long"), params, 7)
    filled = bloom.gather(words, params)
    assert not bloom.check_array(np.array([0, 5], dtype=np.int64), filled, params, 7).any()


def test_large_filters_are_not_gathered(spark):
    with pytest.raises(ValueError):
        bloom.gather(spark.createDataFrame([], "word long, bits long"), BloomParams.of(1000, 0.01), limit=100)
