from pyspark.sql import functions as F

from readsieve.operators import theta

A, B, SHARED = 200_000, 90_000, 30_000


def pair(spark, lg=theta.LG):
    a = spark.range(A).selectExpr("'a' AS name", "id AS hash")
    b = spark.range(A - SHARED, A - SHARED + B).selectExpr("'b' AS name", "id AS hash")
    # repeats change nothing
    found = {r["name"]: bytes(r["theta"]) for r in theta.sketch_of(a.union(b).union(b), ["name"], lg=lg).collect()}
    return spark.createDataFrame([(found["a"], found["b"])], "a binary, b binary"), found


def test_estimates_within_the_stated_error(spark):
    whole = A + B - SHARED
    for lg in (10, 14):
        df, found = pair(spark, lg)
        assert all(len(t) < 8 * 2 ** (lg + 1) for t in found.values())
        sizes = {
            "a": (theta.count(F.col("a")), A, A),
            "shared": (theta.shared(F.col("a"), F.col("b")), SHARED, whole),
            "either": (theta.either(F.col("a"), F.col("b"), lg), whole, whole),
            "only": (theta.only(F.col("a"), F.col("b")), A - SHARED, whole),
        }
        for estimate, part, of in sizes.values():
            r = df.select(estimate.alias("e"), theta.error(F.lit(part), F.lit(of), lg).alias("x")).first()
            assert abs(r["e"] - part) <= r["x"] < 0.6 * of
        got = df.select(theta.jaccard(F.col("a"), F.col("b"), lg)).first()[0]
        assert abs(got - SHARED / whole) < 4 / 2 ** (lg / 2)


def test_small_sets_are_exact(spark):
    rows = [("x", 1), ("x", 2), ("x", 2), ("x", None), ("y", None), (None, 5)]
    df = theta.sketch_of(spark.createDataFrame(rows, "name string, hash long"), ["name"])
    assert {r[0]: r[1] for r in df.select("name", theta.count(F.col("theta"))).collect()} == {"x": 2, "y": 0, None: 1}
    assert df.select(theta.error(F.lit(2), F.lit(2))).first()[0] == 0.5
    assert theta.sketch_of(spark.createDataFrame([], "name string, hash long"), ["name"]).count() == 0


def test_merging_parts(spark):
    parts = spark.range(A).selectExpr("'a' AS name", "id % 7 AS part", "id AS hash")
    fine = theta.sketch_of(parts, ["name", "part"])
    got = theta.merged(fine, ["name"]).select(theta.count(F.col("theta")).alias("n")).first()["n"]
    assert abs(got - A) <= theta.DEVIATIONS * A / 2 ** (theta.LG / 2)
