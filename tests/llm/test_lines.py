import hashlib
import os
import random
from collections import Counter

import pytest

from readsieve.llm import lines
from readsieve.session import exists
from tests.llm.fixtures import TEXTS, documents, rows_of

BLANKS = " \t\n\v\f\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, least=10):
    holders = {}
    for doc_id, text in rows:
        if doc_id is not None:
            for line in (text or "").split("\n"):
                holders.setdefault(key_of(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        all_lines = (text or "").split("\n")
        kept = [
            x
            for x in all_lines
            if doc_id is None
            or len(key_of(x)) < least
            or len(holders[key_of(x)]) < 2
            or min(holders[key_of(x)]) == doc_id
        ]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((doc_id, len(all_lines), len(all_lines) - len(kept), digest))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    found = lines.dedup_digests(documents(spark))
    assert rows_of(found) == brute([(i, t) for i, t, _, _ in TEXTS])
    assert lines.dedup_digests(documents(spark, [])).count() == 0


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2), (9, 3)])
def test_batches_and_compaction_change_nothing(spark, batches, fanout):
    rng = random.Random(batches)
    pool = [f"line number {i} of the pool" for i in range(40)] + ["THE hot line of all", "tiny"]
    rows = [
        (i, "\n".join(["the hot LINE of all ", *rng.choices(pool, k=rng.randint(0, 6))]), "en", "a")
        for i in rng.sample(range(1000), 120)
    ]
    docs = documents(spark, rows).repartition(7)
    lost = lines.lost_lines(docs, batches=batches, fanout=fanout)
    dropped = {r["doc_id"]: len(r["lost"]) for r in lost.collect()}
    holders = {}
    for i, text, _, _ in rows:
        for k in {key_of(x) for x in text.split("\n")}:
            if len(k) >= 10:
                holders.setdefault(k, []).append(i)
    expected = Counter(i for ids in holders.values() for i in ids if i != min(ids))
    assert dropped == dict(expected)


def test_compaction_keeps_few_runs(spark):
    store = lines.LineStore(spark, fanout=2)
    for i in range(5):
        batch = spark.createDataFrame([(bytes([i]) * 16, i), (b"\0" * 16, 100 + i)], "h binary, doc_id long")
        lost = sorted(r["doc_id"] for r in store.add(batch).collect())
        assert lost == ([100] if i == 0 else [100 + i])
    assert [len(level) for level in store.levels] == [1, 0, 1]
    store.close()
    assert not spark.catalog.databaseExists(store.database) and not exists(spark, store.path)


def test_a_store_outlives_its_job(spark, tmp_path):
    """A second crawl loses the lines of the first one, whatever its doc_ids."""
    path = f"file://{tmp_path}/lines"
    first = [(10 + i, f"line number {i}\nshared by all", "en", "a") for i in range(6)]
    second = [(i, f"line number {i + 4}\nshared by all\nonly line {i}", "en", "a") for i in range(6)]
    third = [(i, f"only line {i}\nquite new {i}", "en", "a") for i in range(6)]
    kept = []
    for rows in (first, second, third):
        found = lines.dedup(documents(spark, rows), store_path=path).collect()
        kept.append({r["doc_id"]: r["text"] for r in found})
    assert kept[0] == {10 + i: f"line number {i}" + "\nshared by all" * (i == 0) for i in range(6)}
    assert kept[1] == {i: f"line number {i + 4}\n" * (i > 1) + f"only line {i}" for i in range(6)}
    assert kept[2] == {i: f"quite new {i}" for i in range(6)}


def test_a_job_that_fails_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/lines"
    rows = [(1, "line of the first crawl", "en", "a")]
    lines.lost_lines(documents(spark, rows), store_path=path)

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(lines.LineStore, "commit", fail)
        lines.lost_lines(documents(spark, [(2, "line of the second crawl", "en", "a")]), store_path=path)
    assert not [d.name for d in spark.catalog.listDatabases() if d.name.startswith("line_runs")]
    again = [(3, "line of the second crawl\nline of the first crawl", "en", "a")]
    assert [r["text"] for r in lines.dedup(documents(spark, again), store_path=path).collect()] == ["line of the second crawl"]


def test_no_run_is_in_the_warehouse(spark):
    """Every machine of a cluster may have its own warehouse folder."""
    folder = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    lines.dedup_digests(documents(spark)).count()
    assert not [f for _, _, names in os.walk(folder) for f in names]


def test_dedup_replaces_the_text_only(spark):
    docs = documents(spark)
    found = lines.dedup(docs)
    assert found.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in found.where("doc_id is not null").collect()}
    assert texts[4] is None and texts[6] == "" and texts[7] == "short\nshort"
    assert texts[2] == ""
    assert [r["text"] for r in found.where("doc_id is null and text is not null").collect()] == [TEXTS[14][1]]
