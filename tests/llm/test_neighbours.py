import numpy as np
import pytest

from readsieve.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, id long, score double"


def table(spark, vectors):
    rows = [(i, v if v is None else [None if x is None else float(x) for x in v], 0, 7, 0.5) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, every, k):
    kept = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            kept[i] = np.array(v, np.float32).astype(np.float64)
    out = {}
    for q in kept:
        if q % every == 0:
            scores = [(-float(kept[q] @ v), i) for i, v in kept.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def check_exact(found, expected):
    assert found.keys() == {q for q, e in expected.items() if e}
    for q, rows in found.items():
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert [r[1] for r in rows] == [i for i, _ in expected[q]]
        assert np.allclose([r[2] for r in rows], [s for _, s in expected[q]], atol=1e-12)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    vectors = [(int(i), rng.normal(size=8).tolist()) for i in rng.permutation(90)]
    vectors += [(100 + i, vectors[0][1]) for i in range(40)]  # copies and ties
    odd = [(200, None), (220, []), (240, [0.0] * 8), (260, [1.0] * 7 + [None]), (280, [float("nan")] + [1.0] * 7)]
    odd += [(300, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (320, [1.0] * 3), (vectors[3][0], vectors[3][1])]
    found = neighbours.nearest(table(spark, vectors + odd).repartition(3), every=20, k=20)
    check_exact(answers(found), brute(vectors, 20, 20))


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_an_id_of_several_vectors_has_the_smallest(spark, parts):
    rng = np.random.default_rng(4)
    single = [(i, rng.normal(size=4).tolist()) for i in range(1, 40)]
    several = [(20, rng.normal(size=4).tolist()) for _ in range(8)] + [(7, [9.0] * 4), (0, [1.0, 0.0, 0.0, 2.0])]
    kept = dict(single + several[-1:])
    kept[20] = min([v for i, v in single + several if i == 20], key=lambda v: np.array(v, np.float32).tolist())
    kept[7] = min(dict(single)[7], [9.0] * 4)
    found = neighbours.nearest(table(spark, single + several).repartition(parts), every=20, k=20)
    check_exact(answers(found), brute(list(kept.items()), 20, 20))


def test_few_candidates_and_none(spark):
    vectors = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [-1.0, 0.0])]
    check_exact(answers(neighbours.nearest(table(spark, vectors), 20, 20)), brute(vectors, 20, 20))
    assert neighbours.nearest(table(spark, []), 20, 20).count() == 0
    assert neighbours.nearest(table(spark, [(0, [1.0, 2.0])]), 20, 20).count() == 0


def test_a_vector_that_a_third_of_the_rows_share(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(300)]
    check_exact(answers(neighbours.nearest(table(spark, vectors), 20, 20)), brute(vectors, 20, 20))


@pytest.mark.parametrize("unit", [True, False])
def test_recall_through_the_graph(spark, monkeypatch, unit):
    """Small leaves, so that blocks alone cannot answer and descent and search have to."""
    monkeypatch.setattr(neighbours, "LEAF", 100)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 24))
    x = centres[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 24))
    if unit:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    found = answers(neighbours.nearest(table(spark, vectors), 20, 20))
    expected = brute(vectors, 20, 20)
    assert found.keys() == expected.keys()
    hits = [len({r[1] for r in found[q]} & {i for i, _ in expected[q]}) / 20 for q in expected]
    assert np.mean(hits) >= 0.9
    for q, rows in found.items():
        assert all(len(rows) == 20 and a[2] >= b[2] for a, b in zip(rows, rows[1:]))


def test_descent_improves_the_graph(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 60)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 16))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").cache()
    exact = {(i, int(j)) for i in range(1200) for j in np.argsort(-(x @ x[i] - 1e9 * (np.arange(1200) == i)))[:10]}

    def recall(rounds):
        graph = neighbours.build_graph(nodes, degree=10, sample=8, rounds=rounds, trees=2)
        return len({(r["id"], r["nbr"]) for r in graph.collect()} & exact) / len(exact)

    first, last = recall(0), recall(6)
    assert first < 0.5 and last > first + 0.3, (first, last)


def test_best_keeps_each_pair_once():
    rows, cols = np.array([1, 1, 1, 2, 1]), np.array([5, 5, 6, 5, 7])
    keep = neighbours._best(rows, cols, np.array([3.0, 3.0, 4.0, 1.0, 2.0]), 2)
    assert sorted(zip(rows[keep].tolist(), cols[keep].tolist())) == [(1, 5), (1, 6), (2, 5)]
