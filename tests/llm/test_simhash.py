import random
from itertools import combinations

import numpy as np
import xxhash

from readsieve.llm import simhash, texts
from tests.llm.fixtures import TEXTS, documents

BLANKS = " \t\n\v\f\r"


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """{index: smallest index reachable}."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_fingerprints(monkeypatch):
    for block in (5, 64, 1 << 20):
        monkeypatch.setattr(texts.blocks, "__defaults__", (block,))
        for _, text, _, _ in TEXTS:
            assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint("one TWO") == brute_fingerprint("one two") != 0


def test_every_anchor_is_a_code_word_within_one():
    rng = np.random.default_rng(1)
    halves = rng.integers(0, 1 << 32, 500, np.uint32)
    home = simhash._to_anchor(halves)
    assert (simhash._syndromes(home) == 0).all()
    assert (np.bitwise_count(home ^ halves) <= 1).all()
    # Halves one bit apart meet at the home of either.
    for bit in range(32):
        other = simhash._to_anchor(halves ^ np.uint32(1 << bit))
        found, _ = simhash.anchors_near(halves)
        assert (found == other[:, None]).any(axis=1).all()
        assert (np.bitwise_count(other ^ halves) <= 2).all()


def near(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def test_links_give_the_groups_of_brute_force(spark):
    rng = random.Random(5)
    fps = [0, 7, (1 << 64) - 1]
    for _ in range(60):
        centre = rng.getrandbits(64)
        fps.append(centre)
        for _ in range(rng.randint(0, 6)):
            centre = near(rng, centre, rng.randint(1, 4))
            fps.append(centre)
    big = rng.getrandbits(64)
    fps += [near(rng, big, rng.randint(0, 2)) for _ in range(300)]
    fps = list(dict.fromkeys(fps))
    classes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long").repartition(5)
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(classes)).collect()}
    roots = brute_components(fps)
    groups, expected = {}, {}
    for f, r in zip(fps, roots):
        groups.setdefault(found.get(simhash._signed(f), simhash._signed(f)), set()).add(f)
        expected.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_long_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(-40, 40)] + [(100, 101), (5, 5)], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.components(chain).collect()}
    assert found == {**{i: -40 for i in range(-40, 41)}, 100: 100, 101: 100}


def test_no_links(spark):
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_table(spark):
    found = simhash.near_duplicates(documents(spark)).collect()
    assert len(found) == len(TEXTS)
    fps = [brute_fingerprint(t) for _, t, _, _ in TEXTS]
    roots = brute_components(fps)
    least = {}
    for (doc_id, *_), r in zip(TEXTS, roots):
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    expected = sorted(
        ((i, simhash._signed(f), least.get(r)) for (i, *_), f, r in zip(TEXTS, fps, roots)), key=repr
    )
    assert sorted(map(tuple, found), key=repr) == expected
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_hex_digits(spark):
    df = spark.createDataFrame([(simhash._signed(0xF00000000000000A),), (10,), (0,)], "fp long")
    found = [r[0] for r in df.select(simhash.hex_digits(df["fp"])).collect()]
    assert found == ["f00000000000000a", "000000000000000a", "0" * 16]


def test_one_of_each(spark):
    docs = documents(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    assert 1 in ids and 6 not in ids and 3 in ids and 4 not in ids and ids.count(13) == 2
    assert kept.where("doc_id is null").count() == 2
