import math
import random

import numpy as np
import pytest

from readsieve.llm import negatives
from tests.llm.test_whitening import VECTORS, random_rows

NO_ID = float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "a", "x", "s") for i, v, label in rows], VECTORS)


def brute(rows, every=50, positives=5, top=3, low=50, high=95):
    sound = {
        (i, tuple(math.floor(256 * float(np.float32(c))) for c in v), label)
        for i, v, label in rows
        if label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)
    }
    out = []
    for i, x, label in sound:
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), NO_ID if j is None else j, own) for j, y, own in sound if j != i]
        scored.sort()
        for score, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 50 * -score <= 100 * -s[0] <= 95 * -score][:top]
            out += [(i, positive, r, s[1], -score, -s[0]) for r, s in enumerate(fits, 1)]
    return sorted(out)


def compare(found, rows, **more):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found.columns == names
    got = sorted(tuple(NO_ID if v is None else v for v in r) for r in found.collect())
    expected = brute(rows, **more)
    assert got == expected
    return len(got)


@pytest.mark.parametrize("shard, block", [(4096, 256), (40, 7)])
def test_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(negatives, "SHARD_ROWS", shard)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", block)
    rng = random.Random(1)
    rows = [(i, v, rng.choice([0, 0, 0, 1, 2, 7])) for i, v in random_rows(3, 400, 5)]
    rows += [(1000 + i, rows[3][1], rows[3][2] if i % 4 else 9) for i in range(200)]  # copies, ties
    rows += [(50, rows[4][1], 1), (50, rows[50][1], rows[50][2]), (None, rows[0][1], 0), (None, rows[0][1], 1)]
    rows += [(2050, None, 1), (2100, [1.0] * 5, None), (2150, [math.nan] * 5, 1), (2200, [1.0, None] + [0.0] * 3, 1)]
    rows += [(2250, [], 1), (2300, [1.5, -2.5], 2), (2350, [0.0] * 5, 2), (2400, [0.0] * 5, 1), (2450, [-1.0] * 5, 33)]
    rng.shuffle(rows)
    assert compare(negatives.mine(vectors(spark, rows).repartition(6)), rows) > 50


def test_small_tables(spark):
    assert negatives.mine(vectors(spark, [])).count() == 0
    assert negatives.mine(vectors(spark, [(0, [1.0], 1)])).count() == 0
    assert compare(negatives.mine(vectors(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)])), [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]) == 1


@pytest.mark.parametrize("scale, kind", [(2.0**16, np.int64), (2.0**21, object)])
def test_large_numbers(spark, scale, kind):
    """Products that doubles, and sums that 64 bits, might not hold."""
    rows = [(i, [c * scale if k else 3.0 for k, c in enumerate(v)], i % 3) for i, v in random_rows(4, 120, 4)]
    largest = max(abs(math.floor(256 * float(np.float32(c)))) for _, v, _ in rows for c in v)
    assert negatives.Exact(largest, 4).kind is kind
    assert compare(negatives.mine(vectors(spark, rows), every=10), rows, every=10) > 10


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [c * 2.0**40 for c in v], i % 3) for i, v in random_rows(4, 60, 4)]
    found = negatives.mine(vectors(spark, rows), every=10).collect()
    assert all(abs(r["positive_score"]) < 2**63 and r["negative_id"] % 3 != r["anchor_id"] % 3 for r in found)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.integers(-100, 100, (16, 4))
    x = centres[rng.integers(0, 16, 3000)] + rng.integers(-3, 4, (3000, 4))
    order = negatives.tiles(x)
    assert sorted(order.tolist()) == list(range(3000))
    exact = negatives.Exact(int(np.abs(x).max()), 4)
    packed = x[order].astype(exact.kind)
    tree = negatives.Tree(packed, np.arange(3000), np.zeros(3000, int))
    queries = packed[::500]
    for level, (least, most) in enumerate(tree.bounds(queries, exact)):
        each = negatives.LEAF * negatives.FANOUT**level
        for q, query in enumerate(queries):
            scores = (packed @ query).astype(int)
            for box in range(least.shape[1]):
                own = scores[box * each : (box + 1) * each]
                assert least[q, box] <= own.min() and own.max() <= most[q, box]
    bounds, vector, visited = tree.bounds(queries, exact), queries[0], []

    class Counting(negatives.Exact):
        def times(self, a, b):
            visited.append(len(a))
            return super().times(a, b)

    counting = Counting(int(np.abs(x).max()), 4)
    windows = [(-(10**9), 10**9), (0, 5000), (5, 4)]
    found = negatives.best_first(tree, bounds, 0, -1, lambda a, b: a <= b, windows, 5, counting, vector)
    scored = sorted(((-int(s), i) for i, s in enumerate(packed @ vector)))
    for got, (low, high) in zip(found, windows):
        assert got == [(-s, i) for s, i in scored if low <= -s <= high][:5]
    visited.clear()
    negatives.best_first(tree, bounds, 0, -1, lambda a, b: a <= b, windows[:1], 5, counting, vector)
    assert sum(visited) < len(packed) / 3
