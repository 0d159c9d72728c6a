import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from readsieve.llm import bpe
from tests.llm.fixtures import TEXTS, documents

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks(spark):
    return bpe.read_ranks(spark, PATH)


@pytest.fixture(scope="module")
def coders(ranks):
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Bpe(ranks, public_tokenizers.PATTERN), known


@given(st.text(alphabet="abcdeéñ漢字😀 AB'st\n\t\r\x1c\x85　½_-=!0 ", max_size=80))
@settings(max_examples=400, deadline=None)
def test_same_ids_as_the_library(coders, text):
    own, known = coders
    assert own.encode(text) == known.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_blocks_and_long_pieces(coders, monkeypatch):
    own, known = coders
    text = ("some  words\n\n and more, " * 50 + "x" * 3000 + "  ab" * 100) * 2
    expected = known.encode_ordinary(text)
    for size in (1, 7, 100, 1 << 18):
        monkeypatch.setattr(bpe, "CUT_CHARS", size)
        assert own.encode(text) == expected


def test_memory_is_bounded(coders, monkeypatch):
    own, known = coders
    monkeypatch.setattr(bpe, "PIECES_KEPT", 3)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 3)
    own.pairs.clear()
    text = "unusualwordings hyperboles abracadabras zyzzyvas qwertyuiops"
    assert own.encode(text) == known.encode_ordinary(text)
    own.memo.clear()
    own.memo.old.clear()
    for _ in range(3):
        assert own.encode(text) == known.encode_ordinary(text)
        assert len(own.memo) <= 3 and len(own.memo.old) <= 3 and len(own.pairs) <= 3


def test_unreachable_tokens_stand_for_whole_pieces_only():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257}  # nothing merges into xyz
    own = bpe.Bpe(ranks, r"\S+|\s+")
    assert own.unreachable == {b"xyz"}
    assert own.encode("xyz") == [257]
    assert own.encode("xyzab") == [ord("x"), ord("y"), ord("z"), 256]


def test_bytes_must_have_tokens():
    with pytest.raises(ValueError):
        bpe.Bpe({b"a": 0}, ".")


def test_digests(spark, ranks, coders):
    found = bpe.encode_digests(documents(spark), ranks, public_tokenizers.PATTERN).collect()
    expected = []
    for doc_id, text, _, _ in TEXTS:
        ids = coders[1].encode_ordinary(text or "")
        packed = np.array(ids, "<u4").tobytes()
        whole = hashlib.sha256((text or "").encode()).hexdigest()
        expected.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), whole))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert bpe.encode_digests(documents(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


def test_ids(spark, ranks, coders):
    for row in bpe.encode_ids(documents(spark).where("doc_id < 14"), ranks, public_tokenizers.PATTERN).collect():
        text = next(t for i, t, _, _ in TEXTS if i == row["doc_id"])
        assert row["ids"] == coders[1].encode_ordinary(text or "")
