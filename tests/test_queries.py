"""Every registered query against its SQL, on the smallest tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry_points
from readsieve.plans.oracles import ORACLES
from readsieve.plans.queries import QUERIES
from tests import model

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = entry_points.queries()[name](spark, SF).toPandas()
    wanted = duck.execute(entry_points.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert len(got) > 0
    assert rows(got) == rows(wanted)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES) <= set(entry_points.queries())


def test_even_k_against_the_model(spark):
    """The palindrome rule once more, against the step-by-step model."""
    got = {r.doc_id: r for r in entry_points.queries()["sketch_summary_even_k"](spark, SF).collect()}
    letters = {c: "acgt"[i % 4] for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    for d in docs:
        seq = "".join(letters.get(c.lower() if c.isascii() else c, "n") for c in d.text)
        minima = model.sketch(seq, 8, 128)
        if not minima:
            assert d.doc_id not in got
            continue
        r = got[d.doc_id]
        assert (r.seq_len, r.n_minima, r.largest, r.total) == (len(seq), len(minima), minima[0], sum(minima))


def test_entry(spark):
    found = entry_points.entry(spark)
    assert found.columns == ["doc_id", "seq_len", "n_minima", "intersections", "containment", "jaccard"]
    assert found.count() > 0
