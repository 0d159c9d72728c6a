"""Blocked Bloom filters: all probes of a hash lie in one block of a cache line.

**Layout.** A block has eight words of 64 bits. Murmur2 of a hash gives two numbers that choose the
block, and two more that choose one bit in each word. The filter is a table of one row for a
block in use, so a hash is looked up by one join row, whatever the number of probes, and the number
of blocks is a 63-bit number: a filter may have more bits than the 2^32 of the plain one.

**Size.** Blocks fill unevenly: their numbers of hashes are Poisson distributed. The number of
blocks is the smallest whose expected rate of false positives over that distribution is within the error.

**Probing.** Filters of checked size are broadcast as rows; others are joined on the block. Hashes spread
evenly over the blocks, so no block is hot; asked hashes are distinct.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readsieve.functions.hashing import key_length, murmur2
from readsieve.operators.bloom import BROADCAST_BYTES, key_hashes

WORDS = 8
WORD_BITS = 64
BLOCK_BYTES = WORDS * WORD_BITS // 8
_WORD = 0xFFFFFFFF
_NAMES = [f"w{j}" for j in range(WORDS)]


def false_positive_rate(load: float) -> float:
    """Expected rate of a filter with ``load`` hashes a block on average."""
    if load <= 0:
        return 0.0
    rate, n = 0.0, 0
    log_p = -load
    # beyond twelve deviations nothing is left to add
    last = int(load + 12 * math.sqrt(load) + 20)
    while n <= last:
        rate += math.exp(log_p) * (1 - (1 - 1 / WORD_BITS) ** n) ** WORDS
        n += 1
        log_p += math.log(load / n)
    return rate


@dataclass(frozen=True)
class BlockedParams:
    """Size of a filter for ``entries`` hashes at false-positive rate ``error``."""

    entries: int
    error: float
    blocks: int

    @classmethod
    def of(cls, entries: int, error: float) -> BlockedParams:
        if entries < 1 or not 0 < error < 1:
            raise ValueError("a filter needs entries and 0 < error < 1")
        low, high = 0.0, 512.0
        for _ in range(60):
            load = (low + high) / 2
            low, high = (load, high) if false_positive_rate(load) <= error else (low, load)
        if low <= 0 or entries / low >= 1 << 62:
            raise ValueError(f"no filter of this layout has an error of {error}")
        return cls(entries, error, max(1, math.ceil(entries / low)))

    @property
    def bytes(self) -> int:
        return self.blocks * BLOCK_BYTES


def with_block(hashes: DataFrame, params: BlockedParams, k: int) -> DataFrame:
    """``hash, block, c, d``: the block, and the two numbers that bits are made of (d is odd); NULL hashes are left out.

    The numbers are built on a column that can't be NULL: for others Spark infers ``IS NOT NULL`` and pushes
    it down with the nested hashes written out, 150 KB of plan whose generated code does not compile.
    """
    length = key_length(k)
    key = F.coalesce(F.col("hash"), F.lit(0).cast("long"))
    keys = hashes.where("hash IS NOT NULL").select("hash", key.alias("key"))
    first, _ = key_hashes(F.col("key"), k)
    keys = keys.select("*", first.alias("a"))
    for seed, name in (("a", "b"), ("b", "c"), ("c", "d")):
        keys = keys.select("*", murmur2(F.col("key"), length, F.col(seed)).alias(name))
    block = (F.shiftleft("a", 31) + F.shiftright("b", 1)) % F.lit(params.blocks).cast("long")
    block = F.coalesce(block, F.lit(0).cast("long"))
    return keys.select("hash", block.alias("block"), "c", F.col("d").bitwiseOR(F.lit(1)).alias("d"))


def bit_of(j: int) -> Column:
    """The bit (0 to 63) of word ``j``: the top six of a 32-bit number."""
    at = (F.col("c") + (F.lit(j) * F.col("d")).bitwiseAND(F.lit(_WORD))).bitwiseAND(F.lit(_WORD))
    return F.shiftright(at, 26).cast("int")


def _masks() -> list[Column]:
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, bit_of(j)) for j in range(WORDS)]


def blocks_of(hashes: DataFrame, params: BlockedParams, k: int) -> DataFrame:
    """The filter: ``block`` and its words ``w0`` to ``w7``, for blocks in use. ``bit_or`` combines before the shuffle."""
    keyed = with_block(hashes, params, k)
    marked = keyed.select("block", *[m.alias(n) for m, n in zip(_masks(), _NAMES)])
    return marked.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in _NAMES])


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """The filter of both sets of hashes; both must have the same parameters."""
    return left.unionByName(right).groupBy("block").agg(*[F.bit_or(n).alias(n) for n in _NAMES])


def members(
    hashes: DataFrame, filled: DataFrame, params: BlockedParams, k: int, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Those of the distinct ``hashes`` whose bits are all set (NULL hashes are not)."""
    asked = with_block(hashes, params, k)
    side = F.broadcast(filled) if params.bytes <= limit else filled
    held = [F.col(n).bitwiseAND(m) != 0 for n, m in zip(_NAMES, _masks())]
    hit = held[0]
    for test in held[1:]:
        hit = hit & test
    return asked.join(side, "block").where(hit).select("hash")
