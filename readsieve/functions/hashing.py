"""Hash functions, once as Catalyst expressions and once for NumPy arrays.

The Column forms are safe under ANSI mode: each operand is masked before it is
added or multiplied, so nothing overflows a signed 64-bit integer.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the k-mer hash, per step: factor, what is taken off, right fold.
MIX = ((2**21 - 1, 1, 24), (265, 0, 14), (21, 0, 28), (2**31 + 1, 0, 0))

# Fixed values of MurmurHash2 (32 bit) and the filter's first seed.
MURMUR_M = 0x5BD1E995
MURMUR_R = 24
BLOOM_SEED = 0x9747B28C

_U32 = 0xFFFFFFFF


def key_length(k: int) -> int:
    """Bytes of the little-endian hash that make up a filter key."""
    return min(k, 8)


# ---------------------------------------------------------------- k-mer codes


def canonical_kmer(kmer: Column) -> Column:
    """The k-mer or its reverse complement, whichever sorts first.

    Letters sort like their codes, so this is also the smaller packed value.
    """
    return F.least(kmer, F.translate(F.reverse(kmer), "acgt", "tgca"))


def kmer_code(kmer: Column) -> Column:
    """2-bit packed value of a lower-case acgt k-mer (k <= 31)."""
    return F.conv(F.translate(kmer, "acgt", "0123"), 4, 10).cast("long")


# --------------------------------------------------------------------- hash64


def hash64(code: Column, k: int) -> Column:
    """Invertible integer mix of a packed k-mer, within 2k bits.

    Written with one product per step where that stays below 2^63, because an
    expression that names its input several times grows with every step.
    """
    mask = F.lit((1 << (2 * k)) - 1)

    def keep(c: Column) -> Column:
        return c.bitwiseAND(mask)

    def times(c: Column, factor: int) -> Column:
        if 2 * k + factor.bit_length() <= 63:
            return keep(c * F.lit(factor))
        total = None
        for n in range(factor.bit_length()):
            if factor >> n & 1:
                part = keep(F.shiftleft(c, n))
                total = part if total is None else keep(total + part)
        return total

    # x * (2^n - 1) - 1 is the sum of the complement and x * 2^n
    n = MIX[0][0].bit_length()
    x = keep(keep(F.bitwise_not(code)) + keep(F.shiftleft(code, n)))
    x = x.bitwiseXOR(F.shiftright(x, MIX[0][2]))
    for factor, _, shift in MIX[1:]:
        x = times(x, factor)
        if shift:
            x = x.bitwiseXOR(F.shiftright(x, shift))
    return x


def tag(hashed: Column, k: int) -> Column:
    """Hash with the k-mer span in its low byte."""
    if k > 27:
        raise ValueError("tagged hashes leave the signed 64-bit range above k = 27")
    return F.shiftleft(hashed, 8).bitwiseOR(F.lit(k).cast("long"))


def hash64_array(code: np.ndarray, k: int) -> np.ndarray:
    """``hash64`` over an unsigned array; exact in 32 bits while 2k <= 32.

    Products may wrap: what is lost lies above the 2k bits that are kept.
    """
    t = code.dtype.type
    mask = t((1 << (2 * k)) - 1)
    x = code
    for factor, less, shift in MIX:
        x = (x * t(factor) - t(less)) & mask
        if shift:
            x ^= x >> t(shift)
    return x


# ---------------------------------------------------------------- MurmurHash2


def murmur2(value: Column, length: int, seed: Column) -> Column:
    """MurmurHash2 of the first ``length`` (1..8) little-endian bytes of a long."""
    m = F.lit(MURMUR_M)
    word = F.lit(_U32)

    def times_m(c: Column) -> Column:
        return (c * m).bitwiseAND(word)

    def fold(c: Column, n: int) -> Column:
        return c.bitwiseXOR(F.shiftright(c, n))

    h = seed.bitwiseXOR(F.lit(length).cast("long"))
    for block in range(length // 4):
        k = F.shiftrightunsigned(value, 32 * block).bitwiseAND(word)
        h = times_m(h).bitwiseXOR(times_m(fold(times_m(k), MURMUR_R)))
    tail = length % 4
    if tail:
        rest = F.shiftrightunsigned(value, 32 * (length // 4))
        h = times_m(h.bitwiseXOR(rest.bitwiseAND(F.lit((1 << (8 * tail)) - 1).cast("long"))))
    return fold(times_m(fold(h, 13)), 15)


def murmur2_array(value: np.ndarray, length: int, seed) -> np.ndarray:
    """``murmur2`` over a uint64 array; ``seed`` is one number or a uint32 array."""
    u = np.uint32
    m = u(MURMUR_M)
    h = np.broadcast_to(np.asarray(seed, dtype=u) ^ u(length), value.shape).copy()
    for block in range(length // 4):
        k = ((value >> np.uint64(32 * block)) & np.uint64(_U32)).astype(u)
        k *= m
        k ^= k >> u(MURMUR_R)
        k *= m
        h *= m
        h ^= k
    tail = length % 4
    if tail:
        rest = value >> np.uint64(32 * (length // 4))
        h ^= (rest & np.uint64((1 << (8 * tail)) - 1)).astype(u)
        h *= m
    h ^= h >> u(13)
    h *= m
    h ^= h >> u(15)
    return h
