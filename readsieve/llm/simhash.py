"""Near duplicates by SimHash, found at anchor points of a covering code.

**Fingerprints.** 64 bits from the XXH64 of all three-word shingles, repeats included.

**Anchors.** Two fingerprints that differ in at most three bits differ in at most one
bit in their left or in their right half. In each half the anchors are the words of a
covering code: the perfect Hamming code of length 31 on the upper 31 bits (covering
radius 1) and all values of the last bit. A half has its home anchor within distance 1,
and a half that differs from it in one bit lies within 1 + 1 of that anchor. So each
fingerprint is copied to every anchor within 2, about 2 x 32 of them, and is compared
at an anchor with those that have their home there. With 2^27 anchors a half, rows that
meet without being alike are rare at any size.

**Groups.** Equal fingerprints are one class from the start, so copies cost nothing.
An anchor gives the links of a spanning forest instead of all its pairs, and rows of an
anchor are compared in blocks. Components of the links come from repeated large-star
and small-star steps, each written to the shared folder.

Null and blank texts have fingerprint zero and are linked like any other. Rows that
repeat a doc_id keep their rows. Rows without a doc_id get a component only if their
class has one. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from readsieve.llm.texts import ROWS_OUT, per_row, words_of
from readsieve.session import cut

SHINGLE = 3
SEED = 42
DISTANCE = 3
COMPARED_AT_ONCE = 1 << 22

FINGERPRINT_SCHEMA = StructType([StructField("doc_id", LongType()), StructField("fp", LongType(), False)])


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number."""
    ones, n, held = np.zeros(64, np.int64), 0, []
    for words in words_of((text or "").encode().lower()):
        words = held + words
        if len(words) >= SHINGLE:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - SHINGLE + 1].tolist()
            ends = ends[SHINGLE - 1 :].tolist()
            hashes = np.fromiter(
                (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts)
            )
            for at in range(0, len(hashes), ROWS_OUT):
                part = hashes[at : at + ROWS_OUT].astype(">u8").view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
            n += len(hashes)
        held = words[-(SHINGLE - 1) :]
    if not n and held:
        ones = np.unpackbits(np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], ">u8").view(np.uint8))
        n = 1
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits in a signed number."""
    return per_row(
        docs, ["doc_id", "text"], FINGERPRINT_SCHEMA, lambda: lambda doc_id, text: (doc_id, _signed(fingerprint(text)))
    )


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ------------------------------------------------------------------- anchors

_BITS = np.uint32(1) << np.arange(1, 32, dtype=np.uint32)  # coordinate i of the code is bit i


def _syndromes(halves: np.ndarray) -> np.ndarray:
    """XOR of the coordinates (1 to 31) that are set; the bit at that place leads to the code word."""
    out = np.zeros(len(halves), np.uint32)
    for i in range(1, 32):
        out ^= ((halves >> np.uint32(i)) & np.uint32(1)) * np.uint32(i)
    return out


def _to_anchor(halves: np.ndarray) -> np.ndarray:
    s = _syndromes(halves)
    return np.where(s == 0, halves, halves ^ (np.uint32(1) << s)).astype(np.uint32)


def anchors_near(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 32-bit halves, the anchors within 2 (a row each; repeats possible), home anchor first.

    A half one bit away from x has its own home: those of x and of its 32 neighbours are
    all the anchors at which something within one bit of x can be at home.
    """
    near = [_to_anchor(halves)]
    for bit in [np.uint32(1), *_BITS]:
        near.append(_to_anchor(halves ^ bit))
    found = np.stack(near, axis=1)
    fresh = np.ones(found.shape, bool)
    order = np.argsort(found, axis=1, kind="stable")
    ranked = np.take_along_axis(found, order, axis=1)
    np.put_along_axis(fresh, order[:, 1:], ranked[:, 1:] != ranked[:, :-1], axis=1)
    return found, fresh


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(values), 4096):
            part = values[at : at + 4096]
            for side, shift in ((0, 32), (1, 0)):
                found, fresh = anchors_near(((part >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                row, col = np.nonzero(fresh)
                anchor = (found[row, col].astype(np.int64) << 1) | side
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(part[row].view(np.int64)), pa.array(found[row, 0] == found[row, col])],
                    names=["anchor", "fp", "home"],
                )


class _Forest:
    """Links that join what is not joined yet."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of every pair; unsigned, as signed numbers would lose their top bit."""
    return np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :])


def _links_at(fps: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links between those at home at one anchor and all that are copied to it."""
    own = np.flatnonzero(home)
    if not len(own) or len(fps) < 2:
        return
    forest = _Forest(len(fps))
    step = max(1, COMPARED_AT_ONCE // len(fps))
    for at in range(0, len(own), step):
        rows = own[at : at + step]
        a, b = np.nonzero(_differ(fps[rows], fps) <= DISTANCE)
        for x, y in zip(rows[a].tolist(), b.tolist()):
            if x != y and forest.join(x, y):
                yield int(fps[x]), int(fps[y])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by anchor; an anchor may pass from one batch into the next."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    found: list[tuple[int, int]] = []

    def drain(final: bool) -> Iterator[pa.RecordBatch]:
        if found and (final or len(found) >= ROWS_OUT):
            ends = np.array(found, np.int64)
            found.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    def close() -> None:
        if held:
            fps = np.concatenate([h[1] for h in held])
            found.extend(_links_at(fps, np.concatenate([h[2] for h in held])))
            held.clear()

    for batch in batches:
        anchor = batch.column(0).to_numpy()
        fps = batch.column(1).to_numpy()
        home = batch.column(2).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if held and held[0][0] != anchor[start]:
                close()
            held.append((int(anchor[start]), fps[start:end], home[start:end]))
        yield from drain(False)
    close()
    yield from drain(True)


def links(classes: DataFrame) -> DataFrame:
    """(a, b): fingerprints within the distance, enough of them to join each group."""
    copies = classes.select("fp").mapInArrow(_replicas, "anchor long, fp long, home boolean")
    # A lone fingerprint at an anchor is compared with nothing, but that shows only once they meet.
    met = copies.repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(_compare, "a long, b long").distinct()


# ---------------------------------------------------------------- components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node it reaches.

    Large-star links each node's larger neighbours to its smallest one, small-star its
    smaller ones; both together reach stars in a few rounds. Each round is written to
    the shared folder. Neighbours are never gathered: a node's smallest one is an
    aggregate and is joined back to the links.
    """
    now = cut(_directed(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))).distinct(), "links")
    before = _state(now)
    while True:
        now = cut(_small_star(_large_star(now)), "links")
        after = _state(now)
        if after == before:
            break
        before = after
    # The stars: u is larger than v, and v is the root.
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _directed(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node."""
    return edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _state(edges: DataFrame) -> tuple:
    row = edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v"), F.col("u")).toDF("u", "v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.where("v > u").join(least, "u")
    return _directed(larger.select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    others = moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _directed(others.union(least.select("u", F.col("m").alias("v")))).distinct()


# -------------------------------------------------------------------- result


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reachable."""
    printed = cut(fingerprints(docs), "fingerprints")
    classes = cut(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    rooted = cut(components(cut(links(classes), "links")), "components")
    named = classes.join(rooted, classes["fp"] == rooted["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = cut(named.join(least, "root").select("fp", "component_id"), "classes")
    return printed.join(of_class, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that a group has beside its smallest doc_id.

    The rows of a doc_id stay or go together; rows without a doc_id stay.
    """
    found = near_duplicates(docs)
    first = F.max(F.col("doc_id") == F.col("component_id"))
    spare = found.groupBy(F.col("doc_id").alias("__spare")).agg(first.alias("first")).where("not first")
    return docs.join(cut(spare.select("__spare"), "spare"), F.col("doc_id") == F.col("__spare"), "left_anti")
