import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from readsieve.llm import whitening

VECTORS = StructType(
    [
        StructField("vec_id", LongType()),
        StructField("embedding", ArrayType(FloatType())),
        StructField("label", IntegerType()),
        # Names that the operator uses for columns of its own.
        StructField("at", StringType()),
        StructField("x", StringType()),
        StructField("slab", StringType()),
    ]
)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "x", "s") for i, v in rows], VECTORS)


def brute(rows, k=4):
    """{vec_id: [(deviation, |whitened| by component)]}, n, explained; rows of one length after zeros."""
    sound = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in sound), default=0)
    xs = [(i, tuple([math.floor(256 * float(np.float32(c))) for c in v] + [0] * (width - len(v)))) for i, v in sound]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit, float) - mean
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = sum(values[:k] > 1e-12 * values[0])
    out = defaultdict(list)
    for i, x in xs:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        out[i].append((deviation, (np.array(x) - mean) @ axes[:, :k] / np.sqrt(values[:k])))
    return out, n, values[:k] / values.sum()


def compare(found, rows, k=4):
    expected, n, explained = brute(rows, k)
    by_row = defaultdict(list)
    for r in found:
        assert r["n"] == n and abs(r["identity_error"]) < 1e-4
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-8)
        by_row[r["vec_id"], r["component"]].append((r["deviation"], r["whitened"]))
    assert {i for i, _ in by_row} == set(expected) and len(found) == sum(map(len, expected.values())) * len(explained)
    signs = {}
    for (i, component), got in by_row.items():
        wanted = sorted((d, abs(w[component - 1])) for d, w in expected[i])
        for (d, w), (d2, w2) in zip(sorted((d, abs(w)) for d, w in got), wanted):
            assert d == d2 and w == pytest.approx(w2, abs=1e-8)
        if len(got) == 1 and abs(got[0][1]) > 1e-6:
            signs.setdefault(component, set()).add(got[0][1] * expected[i][0][1][component - 1] > 0)
    assert all(len(s) == 1 for s in signs.values())  # one sign for all rows


def random_rows(seed, n, width):
    rng = np.random.default_rng(seed)
    scale = np.linspace(0.5, 2, width)
    return [(i, (rng.normal(size=width) * scale).astype("float32").tolist()) for i in range(n)]


@pytest.mark.parametrize("slab, block", [(1 << 16, 512), (64, 16)])
def test_against_numpy(spark, monkeypatch, slab, block):
    monkeypatch.setattr(whitening, "SLAB_ROWS", slab)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    rows = random_rows(1, 300, 7)
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # a third of all rows are copies
    rows += [(5, rows[4][1]), (None, rows[0][1]), (7, None), (8, [1.0, None] + [0.0] * 5), (9, [math.nan] * 7)]
    rows += [(11, [math.inf] + [0.0] * 6), (12, [-0.0] * 7), (13, [0.0] * 7), (14, []), (15, [1.5, -2.5])]
    random.Random(2).shuffle(rows)
    compare(whitening.whiten(vectors(spark, rows).repartition(7)).collect(), rows)


def test_few_components(spark):
    rows = [(i, [float(i), 2.0 * i, 0.0]) for i in range(20)]
    found = whitening.whiten(vectors(spark, rows)).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 20
    compare(found, rows)


def test_tables_without_spread(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, []), (2, None)])).count() == 0


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [float(10 ** (i % 13)), 1.0 * i, 3.0e38]) for i in range(12)]
    found = {(r["vec_id"], r["component"]): r for r in whitening.whiten(vectors(spark, rows)).collect()}
    for i in range(12):
        x = [[min(math.floor(256 * float(np.float32(c))), 2**63 - 1) for c in v] for _, v in rows]
        deviation = sum((12 * c - sum(column)) ** 2 for c, column in zip(x[i], zip(*x)))
        assert found[i, 1]["deviation"] == (deviation if deviation < 2**63 else None)
