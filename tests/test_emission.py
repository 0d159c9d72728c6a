import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readsieve.operators import emission
from readsieve.operators.emission import KmerSpec, batch_minima
from tests import model


def minima(seqs, spec, size=None, array=None):
    lengths, row, value = batch_minima(array if array is not None else pa.array(seqs), spec, size)
    tagged = spec.tagged(value).view(np.uint64)
    return list(lengths), [[int(t) for t in tagged[row == i]] for i in range(len(seqs))]


VECTORS = [
    ("acgtaca", []),
    ("acgtacag", [3406087]),
    ("acgtacaN", [1543943]),
    ("Nacgtacag", [1543943, 3406087]),
    ("acgtacagattaca", [95239, 460551, 521991, 742919, 1121031, 3051271, 3406087]),
]


@pytest.mark.parametrize("seq, expected", VECTORS)
def test_known_values_k7(seq, expected):
    assert minima([seq], KmerSpec(7))[1] == [expected]


def test_known_values_other_k():
    assert model.emissions("actgactgactg", 3) == [14595, 7939, 9731, 6147, 14595, 7939, 9731, 6147, 14595]
    assert minima(["actgactgactg"], KmerSpec(3), 4)[1] == [[6147, 7939, 9731, 14595]]
    assert minima(["aacgttaacgtt"], KmerSpec(4))[1] == [[30468, 54532]]
    assert minima(["NNNNNNNNNNacgtacgtt"], KmerSpec(7))[1][0][0] == 0


sequences = st.lists(st.text(alphabet="acgtACGTuUN-", max_size=90), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(sequences, st.integers(1, 31), st.sampled_from([None, 1, 5, 128]), st.booleans())
def test_against_the_model(seqs, k, size, compat):
    lengths, found = minima(seqs, KmerSpec(k, compat), size)
    assert lengths == [len(s) for s in seqs]
    for seq, got in zip(seqs, found):
        wanted = sorted(set(model.emissions(seq, k)) if compat else model.plain(seq, k))
        assert got == (wanted if size is None else wanted[:size])


@pytest.mark.parametrize("block", [33, 64, 100])
@pytest.mark.parametrize("k", [1, 2, 4, 7, 8, 15, 16, 21, 30, 31])
def test_rows_longer_than_a_block(monkeypatch, block, k):
    monkeypatch.setattr(emission, "BLOCK_BASES", block)
    rnd = random.Random(block * 100 + k)
    for share in (0, 0.02, 0.3):
        seqs = [
            "".join("N" if rnd.random() < share else rnd.choice("acgt") for _ in range(rnd.choice([0, k, 50, 700])))
            for _ in range(12)
        ]
        for compat in (True, False):
            for size in (None, 20):
                found = minima(seqs, KmerSpec(k, compat), size)[1]
                for seq, got in zip(seqs, found):
                    wanted = sorted(set(model.emissions(seq, k)) if compat else model.plain(seq, k))
                    assert got == (wanted if size is None else wanted[:size])


def test_case_and_uracil():
    assert minima(["acgttgcaacgt"], KmerSpec(5))[1] == minima(["ACGUuGCAACGU"], KmerSpec(5))[1]


def test_sliced_null_and_wide_arrays():
    seqs = ["acgtacagattaca", "ttgacca", "gattacagattaca"]
    whole = minima(seqs, KmerSpec(3))[1]
    sliced = pa.array(["zz", *seqs, "aa"]).slice(1, 3)
    assert minima(seqs, KmerSpec(3), array=sliced)[1] == whole
    assert minima(seqs, KmerSpec(3), array=pa.array(seqs, pa.large_string()))[1] == whole
    assert minima(["", ""], KmerSpec(3), array=pa.array(["", ""]))[1] == [[], []]


def test_multibyte_characters_are_one_position():
    spec = KmerSpec(3, alphabet="text")
    lengths, found = minima(["abcdéfgh€ij🙂klmn", "abcd.fgh.ij.klmn"], spec)
    assert lengths == [16, 16]
    assert found[0] == found[1]


def test_plain_mode_is_strand_neutral():
    seq = "gattacaggctaacgtnacgatcgg"
    turned = seq[::-1].translate(str.maketrans("acgt", "tgca"))
    a, b = minima([seq, turned], KmerSpec(7, False))[1]
    assert a == b


def test_value_round_trip():
    for k in (7, 15, 27, 28, 31):
        spec = KmerSpec(k)
        values = np.array([0, 1, 2, 4**7 - 1], dtype=np.uint64)
        if k >= emission.UNSIGNED_K:
            values = np.array([0, k, 256 + k], dtype=np.uint64)
        assert (spec.values(spec.tagged(values)) == values).all()


@pytest.mark.parametrize("k", [0, 32])
def test_k_out_of_range(k):
    with pytest.raises(ValueError):
        KmerSpec(k)
