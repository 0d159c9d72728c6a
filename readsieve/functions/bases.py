"""Base alphabets: how characters become the 2-bit codes 0..3.

Two alphabets exist. ``DNA`` reads A, C, G, T/U in either case (and the raw
bytes 0..3 as themselves). ``TEXT`` lets any prose column act as a sequence:
the letters a..z cycle through a, c, g, t. Every other character is ambiguous.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

DNA = "dna"
TEXT = "text"

AMBIGUOUS = 4
# UTF-8 continuation bytes belong to the character before them: no position.
CONTINUATION = 5

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CYCLE = ("acgt" * 7)[:26]


def code_table(alphabet: str) -> np.ndarray:
    """256-entry byte -> code table used inside the Arrow tasks."""
    table = np.full(256, AMBIGUOUS, dtype=np.uint8)
    table[0x80:0xC0] = CONTINUATION
    if alphabet == DNA:
        table[0:4] = range(4)
        for code, letters in enumerate(("aA", "cC", "gG", "tTuU")):
            for letter in letters:
                table[ord(letter)] = code
    elif alphabet == TEXT:
        for i, letter in enumerate(_LETTERS):
            table[ord(letter)] = table[ord(letter.upper())] = i % 4
    else:
        raise ValueError(f"unknown alphabet {alphabet!r}")
    return table


def spell(col: Column, alphabet: str) -> Column:
    """Base characters as lower-case ``acgt``; all others stay as they are."""
    if alphabet == TEXT:
        return F.translate(col, _LETTERS + _LETTERS.upper(), _CYCLE * 2)
    return F.translate(col, "ACGTUu", "acgttt")


def to_bases(col: Column, alphabet: str = TEXT) -> Column:
    """The sequence in lower-case ``acgt``, one ``n`` per ambiguous character."""
    return F.regexp_replace(spell(col, alphabet), "[^acgt]", "n")


def runs(col: Column, alphabet: str, shortest: int = 1) -> Column:
    """Stretches of at least ``shortest`` bases between ambiguous characters, as they are."""
    base = "[A-Za-z]" if alphabet == TEXT else "[ACGTUacgtu]"
    return F.regexp_extract_all(col, F.lit(f"{base}{{{shortest},}}+"), 0)


def reverse_complement(bases: Column) -> Column:
    """Reverse complement of a lower-case base string; ``n`` stays ``n``."""
    return F.translate(F.reverse(bases), "acgt", "tgca")
