import random

import numpy as np
import pytest

from readsieve.llm import ordinal
from tests.llm.fixtures import LABELS, TEXTS, documents, rows_of


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"word{rng.randint(0, 3000)}" for _ in range(rng.randint(20, 300))]
        kind = rng.choices(["clean", "toxic", "junk"], [7, 2, 2])[0]
        if kind == "toxic":
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moron,", "Trash."])
        if kind == "junk":
            words = [w.upper() + "!!" if i % 2 else w + "&&&" for w in words]
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return rows, labels


def test_held_out_documents(spark):
    rows, labels = corpus(1200, 1)
    docs = documents(spark, rows)
    known = spark.createDataFrame([x for x in labels if x[0] % 3], LABELS)
    model = ordinal.train(docs, known)
    assert sorted(model.thresholds) == model.thresholds and len(model.thresholds) == 2
    assert len(model.weights) < 3000  # sparse
    found = {r["doc_id"]: r for r in ordinal.score(docs, model).collect()}
    out = [x for x in labels if x[0] % 3 == 0]
    right = [found[i]["kept"] == (q == 1 and t == 0) for i, q, t in out]
    assert np.mean(right) > 0.97
    grades = {0: [], 1: [], 2: []}
    for i, q, t in out:
        grades[0 if not q else 1 if t else 2].append(found[i]["expected_grade"])
    assert np.mean(grades[0]) < np.mean(grades[1]) < np.mean(grades[2])


def test_slopes_are_those_of_the_loss():
    """Fitting without a penalty comes near the thresholds that shares alone give."""
    rng = np.random.default_rng(0)
    grades = rng.choice(3, 4000, p=[0.2, 0.3, 0.5])
    model = ordinal.fit([np.array([1])] * 4000, grades, 3, l1=1e3)  # the penalty keeps the weight at 0
    assert not model.weights
    shares = np.cumsum(np.bincount(grades, minlength=3) / 4000)[:-1]
    assert np.allclose(model.thresholds, np.log(shares / (1 - shares)), atol=0.02)


def test_weights_order_grades():
    rows = [np.array([1])] * 300 + [np.array([2])] * 300 + [np.array([3])] * 300
    grades = np.array([0] * 280 + [1] * 20 + [1] * 280 + [2] * 20 + [2] * 280 + [0] * 20)
    model = ordinal.fit(rows, grades, 3)
    w = [model.weights.get(i, 0.0) for i in (1, 2, 3)]
    assert w[0] < w[1] < w[2]
    assert all(model.tails(s)[0] >= model.tails(s)[1] for s in (-3.0, 0.0, 3.0))


def test_sample_is_bounded_and_deterministic(spark):
    rows, labels = corpus(300, 2)
    known = spark.createDataFrame(labels, LABELS)
    a = ordinal.train(documents(spark, rows), known, sample=100)
    b = ordinal.train(documents(spark, rows[::-1]).repartition(5), known.repartition(3), sample=100)
    assert a.weights == pytest.approx(b.weights) and a.thresholds == pytest.approx(b.thresholds)


@pytest.mark.parametrize("hot", ["clean", "poor"])
def test_repeated_doc_ids_count_once(spark, hot):
    rows, labels = corpus(150, 5)
    once = ordinal.train(documents(spark, rows), spark.createDataFrame(labels, LABELS), sample=100)
    # A tenth of the documents twice, one of them as most of the rows, with longer texts besides; some labels again.
    again = next(r for r, x in zip(rows, labels) if (x[1], x[2]) == ((1, 0) if hot == "clean" else (0, 0)))
    more = rows[::10] + [again] * 400 + [(i, t + " zzz", lang, s) for i, t, lang, s in rows[::7]]
    more += [(again[0], None, "en", "a")]
    better = [(i, 1, 0) for i, q, t in labels[::5] if not q or t]
    known = spark.createDataFrame(labels + labels[::3] + better, LABELS)
    twice = ordinal.train(documents(spark, rows + more).repartition(6), known, sample=100)
    assert twice.weights == pytest.approx(once.weights) and twice.thresholds == pytest.approx(once.thresholds)


def test_odd_rows(spark):
    rows, labels = corpus(200, 3)
    labels += [(None, 1, 0), (500, None, 0), (501, 1, None), (5, 0, 1), (9999, 1, 0)]
    model = ordinal.train(documents(spark, rows), spark.createDataFrame(labels, LABELS))
    found = ordinal.score(documents(spark), model)
    assert found.count() == len(TEXTS)
    for r in found.where("doc_id in (3, 4, 5)").collect():
        assert (r["expected_grade"], r["tail_prob"], r["kept"]) == (0.0, 0.0, False)
    assert all(0 <= r["tail_prob"] <= 1 for r in found.collect())
    assert rows_of(found) == rows_of(ordinal.score(documents(spark).repartition(4), model))
    assert ordinal.score(documents(spark, []), model).count() == 0


def test_without_labels_nothing_is_judged(spark):
    docs = documents(spark)
    assert ordinal.train(docs, spark.createDataFrame([], LABELS)) is None
    found = {r["doc_id"]: r for r in ordinal.score(docs, None).collect()}
    assert found[1]["kept"] and found[1]["tail_prob"] is None and not found[4]["kept"]


def test_select_keeps_all_columns(spark):
    docs = documents(spark)
    kept = ordinal.select(docs, None)
    assert kept.columns == docs.columns
    assert kept.count() == sum(bool((t or "").encode().split()) for _, t, _, _ in TEXTS)


def test_one_grade_only(spark):
    rows, labels = corpus(60, 4)
    model = ordinal.train(documents(spark, rows), spark.createDataFrame([(i, 1, 0) for i, _, _ in labels], LABELS))
    assert ordinal.score(documents(spark, rows), model).where("kept").count() == 60
