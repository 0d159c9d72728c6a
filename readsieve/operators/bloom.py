"""Bloom filters over tagged hashes: sizing, bit positions, building, probing."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readsieve.functions.hashing import BLOOM_SEED, key_length, murmur2, murmur2_array

# Fixed values of the sizing rule: ln(2)^2 and ln(2) as it spells them.
LN2_SQUARED = 0.480453013918201
LN2 = 0.693147180559945
MIN_ENTRIES = 1000
MAX_BITS = 1 << 32

# A filter above this many bytes is not gathered on the driver.
BROADCAST_BYTES = 32 << 20
_PROBE_CHUNK = 1 << 16


@dataclass(frozen=True)
class BloomParams:
    """Sizing of a filter for ``entries`` keys at false-positive rate ``error``."""

    entries: int
    error: float
    bpe: float
    bits: int
    bytes: int
    hashes: int

    @classmethod
    def of(cls, entries: int, error: float) -> BloomParams:
        if entries < MIN_ENTRIES or not 0 < error < 1:
            raise ValueError(f"a filter needs >= {MIN_ENTRIES} entries and 0 < error < 1")
        bpe = -(math.log(error) / LN2_SQUARED)
        bits = int(entries * bpe)
        if bits > MAX_BITS:
            raise ValueError(f"positions are 32-bit numbers; {bits} bits are too many")
        return cls(entries, error, bpe, bits, -(-bits // 8), math.ceil(LN2 * bpe))


def params_columns(entries: Column, error: float) -> dict[str, Column]:
    """The same sizing as columns; NULL where it is refused."""
    usable = entries >= MIN_ENTRIES
    bpe = -(F.log(F.lit(error)) / F.lit(LN2_SQUARED))
    bits = F.floor(entries.cast("double") * bpe).cast("long")
    return {
        "bpe": F.when(usable, bpe),
        "bits": F.when(usable, bits),
        "bytes": F.when(usable, F.ceil(bits / 8).cast("long")),
        "hashes": F.when(usable, F.ceil(F.lit(LN2) * bpe).cast("long")),
    }


def key_hashes(value: Column, k: int) -> tuple[Column, Column]:
    """The two hashes that positions are made of."""
    length = key_length(k)
    a = murmur2(value, length, F.lit(BLOOM_SEED))
    return a, murmur2(value, length, a)


def with_positions(hashes: DataFrame, params: BloomParams, k: int) -> DataFrame:
    """One row per hash and probe: ``i`` counts the probes, ``position`` is the bit.

    The two hashes are columns of their own, so that the second is built on the
    first's value and not on its expression.
    """
    first, _ = key_hashes(F.col("hash"), k)
    second = murmur2(F.col("hash"), key_length(k), F.col("a"))
    keys = hashes.select("hash", first.alias("a")).select("hash", "a", second.alias("b"))
    steps = F.sequence(F.lit(0).cast("long"), F.lit(params.hashes - 1).cast("long"))
    word = F.lit(0xFFFFFFFF)
    at = (F.col("a") + (F.col("i") * F.col("b")).bitwiseAND(word)).bitwiseAND(word) % F.lit(params.bits).cast("long")
    return keys.select("hash", "a", "b", F.explode(steps).alias("i")).select("hash", "i", at.alias("position"))


def bit_words(hashes: DataFrame, params: BloomParams, k: int) -> DataFrame:
    """The filter as rows: 32-bit ``word`` index and the ``bits`` set in it.

    ``bit_or`` combines on the map side, so one word never holds up a task.
    """
    at = with_positions(hashes, params, k)
    bit = F.expr("shiftleft(1L, cast(position % 32 as int))")
    word = F.shiftright("position", 5)
    return at.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def gather(words: DataFrame, params: BloomParams, limit: int = BROADCAST_BYTES) -> np.ndarray:
    """The filter's bytes on the driver; refused above ``limit`` bytes."""
    if params.bytes > limit:
        raise ValueError(f"a filter of {params.bytes} bytes is too large to gather")
    rows = words.toPandas()
    filled = np.zeros(-(-params.bytes // 4), dtype="<u4")
    filled[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).astype("<u4")
    return filled.view(np.uint8)[: params.bytes]


def fill_array(tagged: np.ndarray, params: BloomParams, k: int) -> np.ndarray:
    """The filter's bytes from keys at hand."""
    bits = np.zeros(params.bits, dtype=bool)
    a, b = _key_arrays(tagged, k)
    for i in range(params.hashes):
        bits[(a + np.uint32(i) * b) % np.uint32(params.bits)] = True
    return np.packbits(bits, bitorder="little")


def _key_arrays(tagged: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keys = tagged.view(np.uint64)
    a = murmur2_array(keys, key_length(k), BLOOM_SEED)
    return a, murmur2_array(keys, key_length(k), a)


def check_array(tagged: np.ndarray, filled: np.ndarray, params: BloomParams, k: int) -> np.ndarray:
    """Which keys the filter holds (NumPy form, used inside the tasks)."""
    held = np.zeros(len(tagged), dtype=bool)
    for at in range(0, len(tagged), _PROBE_CHUNK):
        a, b = _key_arrays(tagged[at : at + _PROBE_CHUNK], k)
        alive = np.arange(len(a))
        for i in range(params.hashes):
            p = (a[alive] + np.uint32(i) * b[alive]) % np.uint32(params.bits)
            alive = alive[(filled[p >> np.uint32(3)] >> (p & np.uint32(7)).astype(np.uint8)) & 1 == 1]
        held[at + alive] = True
    return held


def members(hashes: DataFrame, words: DataFrame, params: BloomParams, k: int) -> DataFrame:
    """Those of the distinct ``hashes`` whose bits are all set, as a join on words.

    For filters of any size: neither side is gathered.
    """
    probes = with_positions(hashes, params, k)
    hit = F.expr("shiftright(bits, cast(position % 32 as int)) & 1") == 1
    return (
        probes.withColumn("word", F.shiftright("position", 5))
        .join(words, "word")
        .where(hit)
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == params.hashes)
        .select("hash")
    )
