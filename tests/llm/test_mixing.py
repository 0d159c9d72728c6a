import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from readsieve.llm import mixing
from tests.llm.fixtures import TEXTS, documents, rows_of


def size_of(text):
    return len((text or "").encode().split())


def brute_targets(sizes):
    """{source: (source_size, target)} from (source, size) pairs."""
    total = defaultdict(int)
    for source, n in sizes:
        total[source] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share > 2 * total[s]}
        if not over:
            target.update({s: weight[s] * share for s in open_})
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= over
    return {s: (total[s], target.get(s, 0.0)) for s in order}


def corpus(seed, sources, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choices(sources, [3 ** min(k, 4) for k in range(len(sources))])[0]
        rows.append((i, "w " * int(rng.lognormvariate(3, 1.5)), "en", source))
    return rows


@pytest.mark.parametrize("seed, sources", [(1, ["a", "b", "c", "d", None]), (2, ["x"]), (3, ["é", "z", "Z", "", "a1", "a10", None])])
def test_targets_are_met(spark, seed, sources):
    rows = corpus(seed, sources, 900)
    found = mixing.mix(documents(spark, rows)).collect()
    expected = brute_targets([(s, size_of(t)) for _, t, _, s in rows])
    assert len(found) == len(rows)
    taken = defaultdict(int)
    for r in found:
        whole, target = expected[r["source"]]
        assert r["source_size"] == whole and r["target"] == pytest.approx(target, rel=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s, (_, target) in expected.items():
        assert taken[s] == pytest.approx(target, rel=0.01, abs=20)


def test_rates_solve_the_dual(spark):
    rows = corpus(4, ["a", "b", "c"], 500)
    sized = mixing.sizes(documents(spark, rows)).cache()
    goals = mixing.targets(sized)
    target = {r["source"]: r["target"] for r in goals.collect()}
    for r in mixing.multipliers(sized, goals).collect():
        sizes = [size_of(t) for _, t, _, s in rows if s == r["of"]]
        import math

        taken = sum(x * min(2.0, math.exp(min(r["lam"] * x / r["mean"], 700))) for x in sizes)
        assert taken == pytest.approx(target[r["of"]], rel=1e-8)


def test_segments_and_reruns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SEGMENT", 50)
    rows = corpus(5, ["a", "b", None], 700)
    first = mixing.mix(documents(spark, rows))
    again = mixing.mix(documents(spark, rows[::-1]).repartition(11))
    assert rows_of(first) == rows_of(again)
    expected = brute_targets([(s, size_of(t)) for _, t, _, s in rows])
    taken = defaultdict(int)
    for r in first.collect():
        taken[r["source"]] += r["taken"]
    for s, (_, target) in expected.items():
        assert taken[s] == pytest.approx(target, rel=0.02, abs=30)


def test_odd_rows(spark):
    found = mixing.mix(documents(spark))
    rows = found.collect()
    assert len(rows) == len(TEXTS)
    assert sorted(((r["doc_id"], r["size"]) for r in rows), key=repr) == sorted(
        ((i, size_of(t)) for i, t, _, _ in TEXTS), key=repr
    )
    assert mixing.mix(documents(spark, [])).count() == 0
    blank = mixing.mix(documents(spark, [(1, None, "en", "a"), (2, " ", "en", None)])).collect()
    assert {(r["target"], r["taken"], r["copies"]) for r in blank} == {(0.0, 0, 1)}


def repeated(rng, n):
    """A third of the rows under one id and size, a third without an id, others between."""
    rows = [(7, "w " * 10, "en", "a")] * (n // 3) + [(None, "w " * 10, "en", "a")] * (n // 3)
    rows += [(100 + i, "w " * rng.randint(0, 30), "en", rng.choice("abc")) for i in range(n // 3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "rows",
    [
        [(None, "w " * 10, "en", "a")] * 1000,
        [(7, "w " * 10, "en", "a")] * 1000 + [(i, "w " * 10, "en", "b") for i in range(20)],
        repeated(random.Random(3), 3000),
    ],
)
def test_rows_that_share_an_id_meet_the_target(spark, monkeypatch, rows):
    monkeypatch.setattr(mixing, "SEGMENT", 400)
    docs = documents(spark, rows)
    found = mixing.mix(docs).collect()
    assert rows_of(mixing.mix(docs.repartition(5))) == sorted(map(tuple, found), key=repr)
    goals = brute_targets([(s, size_of(t)) for _, t, _, s in rows])
    taken, applied = defaultdict(int), defaultdict(int)
    for r in found:
        taken[r["source"]] += r["taken"]
    for r in mixing.apply_mix(docs).collect():
        applied[r["source"]] += size_of(r["text"])
    assert len(found) == len(rows)
    for s, (_, target) in goals.items():
        assert taken[s] == pytest.approx(target, rel=0.01) and applied[s] == taken[s]


def test_rows_that_share_an_id_are_many_tasks(spark):
    rows = [(7, "w " * 10, "en", "a")] * 20_000
    small = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")  # so few rows would be put together again
    try:
        parts = mixing.mix(documents(spark, rows)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset(small)
    assert len(parts) > 2 and max(r["count"] for r in parts) < 15_000


def test_apply_mix(spark):
    docs = documents(spark)
    for clash in ("at", "number", "of_at", "segment", "a.b"):
        docs = docs.withColumn(clash, F.lit("x"))
    found = mixing.apply_mix(docs)
    assert found.columns == docs.columns
    copies, count = defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs).collect():
        copies[r["doc_id"], r["source"], r["size"]] += r["copies"]
    for r in found.collect():
        count[r["doc_id"], r["source"], size_of(r["text"])] += 1
    assert dict(count) == {k: n for k, n in copies.items() if n}
    assert mixing.apply_mix(documents(spark, [])).count() == 0
