"""Links of sketches against all pairs in plain Python."""

import glob
import random

import pytest

from readsieve.operators import overlap
from readsieve.session import shared_dir

SCHEMA = "doc_id long, minima array<long>, key string, hash long, class_id long"


def table(spark, rows):
    return spark.createDataFrame([(i, m, "x", 1, 2) for i, m in rows], SCHEMA)


def brute(rows, least):
    rows = [(i, m) for i, m in rows if m]
    out = []
    for at, (i, m) in enumerate(rows):
        others = [(set(m) & set(n), n) for other, (_, n) in enumerate(rows) if other != at]
        linked = [(len(c), n) for c, n in others if len(c) >= least]
        apart = {tuple(n): c for c, n in linked if n != m}
        ids = [j for j, n in rows if n == m and j is not None]
        out.append((i, min(ids) if ids else None, len(apart), len(linked), max(apart.values()) if apart else None))
    return sorted(out, key=repr)


def got(spark, rows, least):
    found = overlap.links(table(spark, rows), least, id_col="doc_id")
    assert found.columns == ["doc_id", "class_id", "n_classes", "n_links", "most_shared"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def made(rng, n):
    """Sketches with copies, near copies, hashes that most have, and negative hashes."""
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.2:
            m = rng.choice(rows)[1]
        elif rows and kind < 0.6:
            base = list(rng.choice(rows)[1])
            m = sorted({*rng.sample(base, max(1, len(base) - rng.randint(1, 8))), *rng.sample(range(5000), 3)}, reverse=True)
        else:
            m = sorted({*rng.sample(range(-3, 12), 8), *rng.sample(range(5000), rng.randint(0, 24))}, reverse=True)
        rows.append((i, m))
    return rows


@pytest.mark.parametrize("least", [1, 10, 20])
def test_links_equal_all_pairs(spark, least, monkeypatch):
    rows = made(random.Random(least), 150)
    # small blocks, so that hot hashes are split
    monkeypatch.setattr(overlap, "BLOCK", 7)
    assert got(spark, rows, least) == brute(rows, least)


def test_odd_rows(spark):
    m = list(range(20, 0, -1))
    rows = [(1, m), (1, m), (None, m), (2, None), (3, []), (None, [5, 4]), (4, [5, 4]), (1, m[:15])]
    assert got(spark, rows, 10) == brute(rows, 10)
    assert got(spark, [], 10) == []
    with pytest.raises(ValueError):
        overlap.links(table(spark, rows), 0, id_col="doc_id")


def test_pairs_of_classes(spark):
    m = list(range(20, 0, -1))
    rows = [(9, m), (4, m), (7, m[:15]), (8, [99])]
    found = overlap.overlaps(table(spark, rows), 15, id_col="doc_id").collect()
    assert sorted(map(tuple, found)) == [(4, 7, 15), (7, 4, 15)]


def test_a_hash_of_all_rows_is_split(spark):
    """A hash that every sketch has is indexed for none that shares it with others alone."""
    rows = [(i, [*range(1_000_000 + 20 * i, 1_000_000 + 20 * i + 19), 1]) for i in range(3000)]
    found = overlap.links(table(spark, rows).repartition(8), 2, id_col="doc_id")
    assert found.where("n_links <> 0").count() == 0 and found.count() == 3000


@pytest.mark.parametrize("dense", [0, 1 << 40])
@pytest.mark.parametrize("least", [1, 10, 20])
def test_index_and_blocks_find_the_same(spark, least, dense, monkeypatch):
    rows = made(random.Random(least + 5), 20)
    monkeypatch.setattr(overlap, "DENSE", dense)
    # so small that some blocks are empty
    monkeypatch.setattr(overlap, "BLOCK_ROWS", 2)
    assert got(spark, rows, least) == brute(rows, least)


def test_dense_sketches_are_compared_in_blocks(spark, monkeypatch):
    """Where most sketches share rare hashes, no pair of them becomes a row."""
    rng = random.Random(3)
    rows = [(i, sorted(rng.sample(range(300), 40), reverse=True)) for i in range(400)]
    rows += [(400 + i, m[1:]) for i, (_, m) in enumerate(rows[:50])]
    monkeypatch.setattr(overlap, "_met", None)
    assert got(spark, rows, 30) == brute(rows, 30)


def test_blocks_are_written_once(spark, monkeypatch):
    """No class is copied for each pair of blocks: what is written grows with the classes."""
    monkeypatch.setattr(overlap, "DENSE", 1 << 40)
    monkeypatch.setattr(overlap, "BLOCK_ROWS", 2)
    rows = made(random.Random(11), 30)
    classes = overlap.classes_of(table(spark, rows), id_col="doc_id")[0]
    before = set(glob.glob(f"{shared_dir(spark)}/*"))
    pairs = overlap.overlapping(classes, 10)
    assert "Repartition" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    (path,) = [p for p in set(glob.glob(f"{shared_dir(spark)}/*")) - before if "/blocks-" in p]
    assert spark.read.parquet(path).count() == len({tuple(m) for _, m in rows if len(m) >= 10})
    distinct = {tuple(m) for _, m in rows}
    shared = {(m, n): len({*m} & {*n}) for m in distinct for n in distinct if m != n}
    assert sorted(r["shared"] for r in pairs.collect()) == sorted(c for c in shared.values() if c >= 10)


def test_links_of_blocks_are_counted_where_they_are_found(spark, monkeypatch):
    """Near copies of one sketch make no row for each pair of them."""
    monkeypatch.setattr(overlap, "DENSE", 1 << 40)
    monkeypatch.setattr(overlap, "BLOCK_ROWS", 16)
    m = list(range(60, 0, -1))
    rows = [(i, [1000 + i, *m[:i], *m[i + 1 :]]) for i in range(60)] + [(60, m)] * 2
    monkeypatch.setattr(overlap, "overlapping", None)
    assert got(spark, rows, 50) == brute(rows, 50)


def test_blocks_of_unlike_sizes(spark, monkeypatch):
    """Sketches of one hash and of hundreds, hashes at both ends of their range, and none left out by the folded bits."""
    monkeypatch.setattr(overlap, "DENSE", 1 << 40)
    rng, ends = random.Random(4), [(1 << 63) - 1, -(1 << 63), 0, -1]
    rows = [(i, sorted({*rng.sample(range(700), rng.choice([1, 2, 30, 600])), *rng.sample(ends, i % 3)})) for i in range(40)]
    for least in (1, 3, 400):
        assert got(spark, rows, least) == brute(rows, least)


@pytest.mark.parametrize("least", [1, 10])
def test_few_hashes_are_counted_as_the_index_has_them(spark, least, monkeypatch):
    classes = overlap.classes_of(table(spark, made(random.Random(8), 60)), id_col="doc_id")[0]
    counts = overlap._counts(classes)
    ordered = overlap._rarest_first(classes, counts).where(f"size(hashes) >= {least}")
    rows = overlap._indexed(ordered, least).groupBy("at.hash").count().where("count > 1").collect()
    large = classes.where(f"size(minima) >= {least}")
    found = overlap._indexed_known(large, counts, least).where("n > 1").collect()
    assert sorted(r["count"] for r in rows) == sorted(r["n"] for r in found) and rows
    # dense sketches of few hashes are planned without a row for each hash of a class, with the same links
    monkeypatch.setattr(overlap, "DENSE", 1 << 40)
    monkeypatch.setattr(overlap, "_rarest_first", None)
    assert overlap._planned(classes, least).indexed is None
    monkeypatch.undo()
    monkeypatch.setattr(overlap, "_KNOWN", 0)
    assert got(spark, made(random.Random(8), 60), least) == brute(made(random.Random(8), 60), least)
