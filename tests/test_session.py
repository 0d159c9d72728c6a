"""Scratch folders: each thread's go with it, and only those."""

import threading

from readsieve.session import cut, deal, exists, scratch


def test_overlapping_scratches_keep_apart(spark):
    """The first one writes after the second began, and ends last."""
    began, wrote, ended = (threading.Event() for _ in range(3))
    seen = {}

    def path_of(df):
        return df.inputFiles()[0].rsplit("/", 1)[0]

    def first():
        with scratch(spark):
            began.wait(60)
            mine = cut(spark.range(3), "first")
            seen["first"] = path_of(mine)
            wrote.set()
            ended.wait(60)
            seen["kept"] = mine.count()

    def second():
        with scratch(spark):
            began.set()
            seen["second"] = path_of(cut(spark.range(2), "second"))
            wrote.wait(60)
        ended.set()

    threads = [threading.Thread(target=t) for t in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen["kept"] == 3
    assert not exists(spark, seen["first"]) and not exists(spark, seen["second"])


def test_inner_scratch_leaves_the_outer_one(spark):
    with scratch(spark):
        outer = cut(spark.range(4), "outer")
        with scratch(spark):
            inner = cut(spark.range(5), "inner").inputFiles()[0]
        assert outer.count() == 4 and not exists(spark, inner)
    assert not exists(spark, outer.inputFiles()[0])


def test_deal_makes_more_parts_of_more_rows(spark, tmp_path):
    """One row group is many splits of which one has rows; parts are as many as the size asks for."""
    counts = []
    for n in (20_000, 200_000):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / str(n)))
        dealt = deal(spark.read.parquet(str(tmp_path / str(n))), 4000)
        sizes = [len(rows) for rows in dealt.rdd.glom().collect()]
        assert sum(sizes) == n and max(sizes) < 2 * n / len(sizes) + 100
        counts.append(len(sizes))
    assert counts[1] > 5 * counts[0]
