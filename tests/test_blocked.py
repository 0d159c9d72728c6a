import pytest

from readsieve.operators import blocked
from readsieve.operators.blocked import BlockedParams


def of(spark, numbers):
    return spark.createDataFrame([(n,) for n in numbers], "hash long")


def test_sizing():
    for error in (0.05, 0.01, 0.001):
        params = BlockedParams.of(1_000_000, error)
        assert blocked.false_positive_rate(params.entries / params.blocks) <= error
        assert blocked.false_positive_rate(params.entries / (params.blocks - 10)) > 0.99 * error
    assert blocked.false_positive_rate(0) == 0
    # beyond what 32-bit positions reach
    assert BlockedParams.of(10**10, 0.01).bytes * 8 > 1 << 36
    for entries, error in ((0, 0.1), (10, 0.0), (10, 1.0)):
        with pytest.raises(ValueError):
            BlockedParams.of(entries, error)


@pytest.mark.parametrize("k", [7, 15])
@pytest.mark.parametrize("limit", [0, blocked.BROADCAST_BYTES])
def test_no_member_is_missed_and_the_rate_holds(spark, k, limit):
    n = 20_000
    params = BlockedParams.of(n, 0.02)
    # distinct in the bytes that make up a key
    numbers = spark.range(2 * n).selectExpr("id * 7919 + 13 AS hash")
    white, others = numbers.where(f"hash < {7919 * n}"), numbers.where(f"hash >= {7919 * n}")
    filled = blocked.blocks_of(white, params, k)
    assert blocked.members(white, filled, params, k, limit).count() == n
    wrong = blocked.members(others, filled, params, k, limit).count() / n
    assert 0.5 * params.error < wrong < 1.5 * params.error


def test_blocks_beyond_32_bits(spark):
    params = BlockedParams(10**12, 0.01, 10**11)
    white = of(spark, range(1, 2001))
    filled = blocked.blocks_of(white, params, 15)
    assert filled.selectExpr("max(block)").first()[0] > 1 << 36
    found = blocked.members(of(spark, [*range(1990, 2010), None]), filled, params, 15)
    assert sorted(r["hash"] for r in found.collect()) == list(range(1990, 2001))


def test_union_and_empty(spark):
    params = BlockedParams.of(100, 0.01)
    a, b, none = of(spark, range(50)), of(spark, range(40, 90)), of(spark, [])
    rows = lambda df: sorted(map(tuple, df.collect()))
    both = blocked.union(blocked.blocks_of(a, params, 15), blocked.blocks_of(b, params, 15))
    assert rows(both) == rows(blocked.blocks_of(of(spark, range(90)), params, 15))
    assert rows(blocked.union(both, blocked.blocks_of(none, params, 15))) == rows(both)
    assert blocked.members(a, blocked.blocks_of(none, params, 15), params, 15).count() == 0
    assert blocked.members(none, both, params, 15).count() == 0


def test_the_plan_stays_small_and_null_hashes_are_left_out(spark):
    """Filters that Spark infers must not write the nested hashes out."""
    params = BlockedParams.of(100, 0.01)
    filled = blocked.blocks_of(of(spark, [1, None, 2]), params, 7)
    assert filled.where("block IS NULL").count() == 0
    found = blocked.members(of(spark, [1, None]).distinct(), filled, params, 7)
    assert [r["hash"] for r in found.collect()] == [1]
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 30_000
