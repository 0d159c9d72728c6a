import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from readsieve.llm import packing
from tests.llm.fixtures import TEXTS, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ straße ﬁ Ǻ ́ x",
    "a\x1cb\x85c\xa0d　e f it's 'S 12345 ½ <|endoftext|> <|endoftext|>x",
    "é ́ẹ́ 각 힣 \t\x0b\x0c\r\n\n 'll 'LL '' '",
]


def check(pieces, expected, capacity=2048):
    """Pieces (doc_id, start, length, crc32, doc_tokens, sequence, offset) against
    [(doc_id, ids)]: every id in one piece, sequences without gaps; returns the padding."""
    wanted, by_doc, by_sequence = defaultdict(list), defaultdict(list), defaultdict(list)
    for doc_id, ids in expected:
        wanted[doc_id].append(np.array(ids, "<u4"))
    for doc_id, start, length, crc, tokens, sequence, offset in pieces:
        assert length > 0
        by_doc[doc_id].append((start, length, crc, tokens))
        by_sequence[sequence].append((offset, length))
    assert by_doc.keys() == wanted.keys()
    for doc_id, texts in wanted.items():
        if len(texts) == 1:
            (ids,), at = texts, 0
            for start, length, crc, tokens in sorted(by_doc[doc_id]):
                assert (start, tokens) == (at, len(ids)) and crc == zlib.crc32(ids[start : start + length].tobytes())
                at += length
            assert at == len(ids)
        else:  # rows that share a doc_id
            assert sum(p[1] for p in by_doc[doc_id]) == sum(map(len, texts))
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def rows_of(pieces):
    for r in pieces.collect():
        yield (r["doc_id"], r["start"], r["length"], zlib.crc32(r["ids"]), r["doc_tokens"], r["sequence_id"], r["offset"])


def ids_of(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in texts]


@pytest.mark.parametrize("capacity", [2048, 64, 3, 1])
def test_pieces(spark, capacity):
    rows = TEXTS + [(100 + i, t, "en", "a") for i, t in enumerate(ODD)]
    tokenizer = packing.read_tokenizer(spark, PATH)
    pieces = packing.pack(documents(spark, rows).repartition(5), tokenizer, capacity)
    found = list(rows_of(pieces))
    assert check(found, ids_of((i, t) for i, t, _, _ in rows), capacity) == 0
    whole = packing.sequences(pieces).collect()
    assert sum(r["n_tokens"] for r in whole) == sum(p[2] for p in found)
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole)


def test_one_hot_length_in_many_shares(spark):
    rows = [(i, "word " * (7 if i % 3 else 40 + i % 11), "en", "a") for i in range(600)]
    pieces = packing.pack(documents(spark, rows).repartition(9), packing.read_tokenizer(spark, PATH), 64)
    assert check(list(rows_of(pieces)), ids_of((i, t) for i, t, _, _ in rows), 64) == 0


def test_empty_table(spark):
    assert packing.pack(documents(spark, []), packing.read_tokenizer(spark, PATH)).count() == 0


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("capacity", [2, 16, 64, 2048])
def test_plan_covers_every_rest_once(seed, capacity):
    rng = random.Random(seed)
    histogram = {rng.randint(1, capacity - 1): rng.randint(1, 50) for _ in range(rng.randint(1, capacity))}
    placed = packing.plan(histogram, capacity)
    by_sequence = defaultdict(list)
    for size, n in histogram.items():
        for rank in range(n):
            at = 0
            for start, length, sequence, offset in placed.of(size, rank):
                assert start == at and length > 0
                by_sequence[sequence].append((offset, length))
                at += length
            assert at == size
    total = sum(s * n for s, n in histogram.items())
    lengths = []
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        lengths.append(at)
    left = total % capacity
    assert sorted(lengths) == sorted([capacity] * (total // capacity) + [1 << b for b in range(11) if left >> b & 1])


def test_shortest_pack_first():
    """The pack with the most space takes the next rest; packs alike are one pattern."""
    packs = packing.shortest_pack_first({10: 1000, 6: 1000, 3: 500}, 16)
    assert [(p.count, p.space, [s for s, _ in p.contents]) for p in packs] == [
        (1000, 0, [10, 6]),
        (100, 1, [3, 3, 3, 3, 3]),
    ]


def test_plan_does_not_grow_with_the_documents():
    small = {s: 1 + 2048 // s for s in range(1, 2048)}
    big = {s: n * 1_000_003 for s, n in small.items()}
    sizes = [sum(map(len, packing.plan(h).ranks.values())) for h in (small, big)]
    assert sizes[1] < 3 * sizes[0]
