"""K-mer emission over Arrow string buffers (NumPy, runs inside Spark tasks).

``emissions`` walks the bytes of a whole Arrow batch in blocks of bounded size,
never one row at a time for odd k, and yields ``(row, value)`` arrays. A value
is an order-keeping form of the tagged hash: 0 stands for the sentinel that a
sequence without an early complete k-mer emits, ``hash + 1`` for every other
hash. From k = 28 the tagged hash itself is used.

What a sequence of length L emits, with 0-based end positions i, ``W(i)`` for
"the k characters ending at i are all bases" and ``H(i)`` for their hash:

* compat: H(i) for k <= i < L where W(i); H(k-1) when W(k-1) but not W(k);
  the sentinel when neither holds. Nothing when L <= k.
* plain: H(i) for every i where W(i).

Even k differs in compat mode: k-mers equal to their own reverse complement
emit nothing and do not count towards the k bases a run needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from readsieve.functions.bases import AMBIGUOUS, CONTINUATION, DNA, code_table
from readsieve.functions.hashing import hash64_array

BLOCK_BASES = 1 << 17
MAX_K = 31
# From here on a tagged hash no longer fits a signed 64-bit integer.
UNSIGNED_K = 28


@dataclass(frozen=True)
class KmerSpec:
    """K-mer size, emission mode and alphabet; without ``hashed`` the codes themselves."""

    k: int = 7
    compat: bool = True
    alphabet: str = DNA
    hashed: bool = True

    def __post_init__(self):
        if not 1 <= self.k <= MAX_K:
            raise ValueError(f"k must be within 1..{MAX_K}, got {self.k}")
        code_table(self.alphabet)

    @property
    def value_bits(self) -> int:
        return 64 if self.hashed and self.k >= UNSIGNED_K else 2 * self.k + 1

    def tagged(self, values: np.ndarray) -> np.ndarray:
        """Values -> tagged hashes as signed 64-bit integers."""
        v = values.astype(np.uint64)
        if self.k < UNSIGNED_K:
            v = np.where(v == 0, v, ((v - np.uint64(1)) << np.uint64(8)) | np.uint64(self.k))
        return v.view(np.int64)

    def values(self, tagged: np.ndarray) -> np.ndarray:
        """Tagged hashes -> values; the inverse of ``tagged``."""
        v = np.asarray(tagged, dtype=np.int64).view(np.uint64)
        if self.k < UNSIGNED_K:
            v = np.where(v == 0, v, (v >> np.uint64(8)) + np.uint64(1))
        return v


def string_codes(column: pa.Array, spec: KmerSpec) -> tuple[np.ndarray, np.ndarray]:
    """Base codes of all rows back to back, and the rows' n + 1 offsets."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        width = np.int64
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=width)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.empty(0, dtype=np.uint8), offsets - offsets[0]
    raw = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    codes = code_table(spec.alphabet)[raw]
    if raw.max() >= 0x80:
        inner = codes == CONTINUATION
        dropped = np.concatenate(([0], np.cumsum(inner)))
        codes = codes[~inner]
        offsets = offsets - dropped[offsets]
    return codes, offsets


def emissions(codes: np.ndarray, offsets: np.ndarray, spec: KmerSpec) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, value)`` arrays of everything the rows emit, block by block."""
    if spec.k % 2 == 0 and spec.compat:
        return _emissions_even(codes, offsets, spec)
    return _emissions_windows(codes, offsets, spec)


# ------------------------------------------------- window form: odd k, or plain


def _pieces(offsets: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Groups of row numbers and bounds that together hold about one block.

    A row longer than a block comes alone, in pieces that share k - 1 bases.
    """
    lengths = np.diff(offsets)
    long_rows = np.flatnonzero(lengths > BLOCK_BASES)
    edges = np.concatenate(([-1], long_rows, [len(lengths)]))
    for before, after in zip(edges[:-1], edges[1:]):
        if before >= 0:
            start, end = offsets[before], offsets[before + 1]
            for at in range(start, end - k + 1, BLOCK_BASES):
                stop = min(at + BLOCK_BASES + k - 1, end)
                yield np.array([before]), np.array([at, stop]), at == start
        rows = np.arange(before + 1, after)
        if len(rows):
            group = (offsets[rows + 1] - offsets[rows[0]]) // BLOCK_BASES
            for part in np.split(rows, np.flatnonzero(np.diff(group)) + 1):
                yield part, offsets[part[0] : part[-1] + 2], True


def _join(left, right, n_left: int, n_right: int):
    """Packed windows of n_left bases followed by packed windows of n_right."""
    fw_l, rc_l = left
    fw_r, rc_r = right
    size = len(fw_l) - n_right
    t = fw_l.dtype.type
    fw = (fw_l[:size] << t(2 * n_right)) | fw_r[n_left : n_left + size]
    rc = (rc_r[n_left : n_left + size] << t(2 * n_left)) | rc_l[:size]
    return fw, rc


def packed_windows(fw_digits: np.ndarray, rc_digits: np.ndarray, k: int):
    """Packed forward and reverse-complement values of every k-window, by doubling."""
    power, n_power, done, n_done, left = (fw_digits, rc_digits), 1, None, 0, k
    while left:
        if left & 1:
            done = power if done is None else _join(done, power, n_done, n_power)
            n_done += n_power
        left >>= 1
        if left:
            power = _join(power, power, n_power, n_power)
            n_power *= 2
    return done


def _window_type(k: int):
    return np.uint16 if k <= 8 else np.uint32 if k <= 16 else np.uint64


def canonical_windows(codes: np.ndarray, k: int) -> np.ndarray:
    """Canonical packed value of every k-window."""
    dtype = _window_type(k)
    digits = (codes & np.uint8(3)).astype(dtype)
    return np.minimum(*packed_windows(digits, digits ^ dtype(3), k))


def _hash_values(canonical: np.ndarray, spec: KmerSpec) -> np.ndarray:
    wide = canonical.astype(np.uint32 if spec.k <= 15 else np.uint64)
    if not spec.hashed:
        return wide + wide.dtype.type(1)
    hashed = hash64_array(wide, spec.k)
    if spec.k >= UNSIGNED_K:
        return (hashed << np.uint64(8)) | np.uint64(spec.k)
    return hashed + hashed.dtype.type(1)


def _emissions_windows(codes, offsets, spec):
    k = spec.k
    for rows, bounds, head in _pieces(offsets, k):
        block = codes[bounds[0] : bounds[-1]]
        if len(block) < k:
            continue
        bad = np.concatenate(([0], np.cumsum(block >= AMBIGUOUS, dtype=np.int32)))
        ok = bad[k:] == bad[:-k]
        starts, ends = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
        # windows that would run over the end of their row
        over = (ends[:-1, None] - np.arange(1, k)).ravel()
        ok[over[(over >= 0) & (over < len(ok))]] = False
        sentinel = np.empty(0, dtype=np.int64)
        if spec.compat and head:
            short = ends - starts <= k
            lone = starts[short & (ends - starts == k)]
            ok[lone] = False
            at = starts[~short]
            first, second = ok[at], ok[at + 1]
            ok[at] = first & ~second
            sentinel = rows[~short][~first & ~second]
        index = np.flatnonzero(ok)
        row = np.repeat(rows, ends - starts)[index]
        value = _hash_values(canonical_windows(block, k)[index], spec)
        if len(sentinel):
            row = np.concatenate((row, sentinel))
            value = np.concatenate((value, np.zeros(len(sentinel), dtype=value.dtype)))
        yield row, value


# ---------------------------------------------------- even k in compat mode


@dataclass
class _Carry:
    """What one piece of a long row hands to the next."""

    fw: np.ndarray  # digits of the last k - 1 bases; absent ones are zero in both strands
    rc: np.ndarray
    seen: int = 0
    run: int = 0
    latest: np.uint64 = np.uint64(0)
    settled: bool = False


def _start(k: int) -> _Carry:
    absent = np.zeros(k - 1, dtype=_window_type(k))
    return _Carry(absent, absent)


def _emissions_even(codes, offsets, spec):
    """A run's length depends on the palindromes in it, so pieces of a row are chained."""
    k = spec.k
    filled = np.flatnonzero(np.diff(offsets))
    edges = np.append(offsets[filled], offsets[-1])
    for rows, bounds, _ in _pieces(edges, 1):
        row, start = rows[0], bounds[0]
        if edges[row + 1] - edges[row] <= BLOCK_BASES:
            local, value = _even_block(codes[start : bounds[-1]], bounds - start, spec, _start(k))
            yield filled[rows[local]], value
            continue
        if start == edges[row]:
            carry = _start(k)
        _, value = _even_block(codes[start : bounds[-1]], bounds - start, spec, carry)
        yield np.full(len(value), filled[row]), value


def _even_block(block, bounds, spec, carry):
    """``(row, value)`` of whole rows, or of the next piece of the row in ``carry``."""
    k, dtype = spec.k, _window_type(spec.k)
    n, starts, lengths = len(bounds) - 1, bounds[:-1], np.diff(bounds)
    local = np.repeat(np.arange(n), lengths)
    is_base = block < AMBIGUOUS
    digits = block[is_base].astype(dtype)
    # the bases of each row behind k - 1 digits from before it
    at = np.arange(len(digits)) + local[is_base] * (k - 1)
    fw_digits = np.zeros(len(digits) + n * (k - 1), dtype=dtype)
    rc_digits = fw_digits.copy()
    fw_digits[at + k - 1], rc_digits[at + k - 1] = digits, digits ^ dtype(3)
    fw_digits[: k - 1], rc_digits[: k - 1] = carry.fw, carry.rc
    counts = np.zeros(len(block), dtype=bool)
    fw = rc = digits
    if len(digits):
        fw, rc = (packed[at] for packed in packed_windows(fw_digits, rc_digits, k))
        counts[is_base] = fw != rc
    emitting = (np.arange(len(block)) - np.repeat(starts, lengths) + carry.seen >= k) & (counts | ~is_base)

    # bases counted since the row's start or its latest ambiguous character
    counted = np.cumsum(counts)
    before = np.repeat(counted[starts] - counts[starts], lengths)
    reset = np.maximum.accumulate(np.where(is_base, 0, counted))
    runs = counted - np.maximum(reset, before)
    if carry.run:
        runs[np.logical_and.accumulate(is_base)] += carry.run
    fresh = counts & (runs >= k)
    updates = np.flatnonzero(fresh)
    chosen = fresh[is_base]
    value = _hash_values(np.minimum(fw[chosen], rc[chosen]), spec).astype(np.uint64)
    out = emitting[updates]
    row, picked = local[updates[out]], value[out]

    emits = np.flatnonzero(emitting)
    if not carry.settled and len(emits):
        # a row's first emission repeats the latest hash when it has none of its own
        first = emits[np.minimum(np.searchsorted(emits, starts), len(emits) - 1)]
        stale = np.flatnonzero((first >= starts) & (first < bounds[1:]) & ~fresh[first])
        earlier = np.searchsorted(updates, first[stale]) - 1
        known = earlier >= 0
        known[known] = updates[earlier[known]] >= starts[stale[known]]
        repeated = np.full(len(stale), carry.latest)
        repeated[known] = value[earlier[known]]
        row, picked = np.concatenate((row, stale)), np.concatenate((picked, repeated))

    carry.fw, carry.rc = fw_digits[len(digits) :][: k - 1], rc_digits[len(digits) :][: k - 1]
    carry.seen += len(block)
    carry.run = int(runs[-1])
    carry.latest = value[-1] if len(value) else carry.latest
    carry.settled = carry.settled or len(emits) > 0
    return row, picked


# --------------------------------------------------------- per-row reductions


def bottom_values(rows: np.ndarray, values: np.ndarray, size: int | None, bits: int):
    """Distinct (row, value) pairs in order, the ``size`` smallest of each row."""
    if len(rows) == 0:
        return rows.astype(np.int64), values.astype(np.uint64)
    low = int(rows.min())
    span = int(rows.max()) - low + 1
    local = rows - low
    if bits < 32 and span << bits <= 32 * len(rows):
        present = np.zeros(span << bits, dtype=bool)
        present[(local << bits) | values.astype(np.int64)] = True
        hit = np.flatnonzero(present)
        row, value = hit >> bits, (hit & ((1 << bits) - 1)).astype(np.uint64)
    elif bits + span.bit_length() < 64:
        key = (local.astype(np.uint64) << np.uint64(bits)) | values.astype(np.uint64)
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        row = (key >> np.uint64(bits)).astype(np.int64)
        value = key & np.uint64((1 << bits) - 1)
    else:
        value = values.astype(np.uint64)
        order = np.lexsort((value, local))
        row, value = local[order], value[order]
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])))
        row, value = row[new], value[new]
    if size is not None:
        begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        rank = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
        row, value = row[rank < size], value[rank < size]
    return row + low, value


def batch_minima(column: pa.Array, spec: KmerSpec, size: int | None):
    """Distinct emitted values of every row of an Arrow string column.

    Returns the rows' lengths in characters and ``(row, value)`` in ascending
    order, at most ``size`` per row. Memory is bounded by the block size and
    the number of values kept, not by the length of a row.
    """
    codes, offsets = string_codes(column, spec)
    lengths = np.diff(offsets)
    bits = spec.value_bits
    split_rows = bool((lengths > BLOCK_BASES).any())
    kept, held, compact_at = [], 0, 4 * BLOCK_BASES

    def compacted():
        row = np.concatenate([k[0] for k in kept])
        return bottom_values(row, np.concatenate([k[1] for k in kept]), size, bits)

    for rows, values in emissions(codes, offsets, spec):
        kept.append(bottom_values(rows, values, size, bits))
        held += len(kept[-1][0])
        if split_rows and held > compact_at:
            kept = [compacted()]
            held = len(kept[0][0])
            compact_at = max(4 * BLOCK_BASES, 2 * held)
    if not kept:
        return lengths, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    if split_rows:
        return lengths, *compacted()
    return lengths, np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])
