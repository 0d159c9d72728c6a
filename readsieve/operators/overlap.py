"""Sketches that share many hashes: a join by an inverted index of minima.

**Classes.** Equal sketches are one class; copies are counted, never paired.

**Index.** The hashes of a class are put in one order for all, the rarest first. Two sketches that
share ``least`` hashes share one among all but the last ``least - 1`` of each, so only those are
indexed, and of those only hashes that a second class has. Common hashes stand last and are seldom indexed.

**Split of hot hashes.** A hash in more than ``BLOCK`` classes is dealt over as many groups as it has
blocks: one side of the join lies in one of them, the other in all.

**Count.** Where two classes meet, their shared hashes are counted exactly, and the pair is kept at its
rarest shared hash only. Nothing but pairs that share ``least`` or more leaves the join.

**Dense sketches.** How often classes would meet in the index is counted first. Where that is more than one
in ``DENSE`` of all pairs, as with short k-mers, classes are written once, in blocks by their largest hash, and tasks
read any two blocks from there: nothing is copied for each pair of blocks. Two sketches can share ``least`` hashes only
if each has so many up to the other's largest one, which leaves out blocks and rows whose hashes lie apart. For the
rest, hashes are folded to ``FOLDS`` bits, each the parity of those it stands for: two such words differ in no more bits
than the sketches in hashes, so one count of bits leaves only pairs that may be links. Those are counted exactly. Both
ways find the same pairs; the work of the second grows with the square of the classes, what it writes with the classes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readsieve.session import cut, qualified, write_shared

BLOCK = 256
# A meeting in the index costs as much as comparing so many pairs by their bits, or more.
DENSE = 128
# Up to so many hashes the tasks know the order of all.
_KNOWN = 1 << 18
# Bits of a folded sketch, in words of 64; pairs are compared by the first words, and those left by the others.
FOLDS = 256
_SHIFT = np.uint64(65 - FOLDS.bit_length())
_FIRST = 3
# Classes of a block, and their hashes.
BLOCK_ROWS = 16384
_BLOCK_HASHES = 1 << 21
# Rows folded at once, rows and columns of the pairs compared at once, and hashes of the pairs counted at once.
_FOLDED = 1024
_TILE = 64
_WIDE = 4096
_HASHES_AT_ONCE = 1 << 20
# Pairs that one task compares, and links it holds before they leave.
_PAIRS_A_TASK = 1 << 30
_LINKS_HELD = 1 << 16
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def classes_of(sketches: DataFrame, *, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``(key, class_id, n_members, minima)`` of equal sketches, and ``(id, key)`` of every row.

    ``class_id`` is the smallest id; ids may be null or repeat. Rows without a sketch are in neither.
    """
    key = F.md5(F.array_join(F.col("minima").cast("array<string>"), ","))
    rows = sketches.where(F.size("minima") > 0).select(F.col(id_col), key.alias("key"), "minima")
    found = rows.groupBy("key").agg(
        F.min(id_col).alias("class_id"), F.count(F.lit(1)).alias("n_members"), F.first("minima").alias("minima")
    )
    return found, rows.select(id_col, "key")


def _counts(classes: DataFrame) -> DataFrame:
    """``(hash, n_classes)`` of every hash."""
    return cut(classes.select(F.explode("minima").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_classes")))


def _rarest_first(classes: DataFrame, counts: DataFrame) -> DataFrame:
    """``(key, hashes)``: ``(n_classes, hash)`` of every hash of a class, in the order of both."""
    pairs = classes.select("key", F.explode("minima").alias("hash"))
    total = counts.agg(F.sum("n_classes")).first()[0] or 0
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # at most 4 x tasks hashes are in so many classes
    hot = F.col("n_classes") > max(1, total // (4 * tasks))
    spread = pairs.join(F.broadcast(counts.where(hot)), "hash", "left")
    known = spread.where("n_classes is not null")
    rest = spread.where("n_classes is null").drop("n_classes").join(counts.where(~hot), "hash")
    counted = known.unionByName(rest)
    return counted.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n_classes", "hash"))).alias("hashes"))


def _indexed(ordered: DataFrame, least: int) -> DataFrame:
    """``(key, minima, at)`` of the hashes of each class that are indexed, ``at`` one of its ``hashes``."""
    return ordered.select(
        "key",
        F.col("hashes.hash").alias("minima"),
        F.explode(F.slice("hashes", 1, F.size("hashes") - (least - 1))).alias("at"),
    ).where("at.n_classes > 1")


def _indexed_known(classes: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """``(rank, n)``: how many classes the index would have of a hash, by tasks that know the order of all hashes."""
    known = counts.sort("hash").toArrow()
    hashes, places = known["hash"].to_numpy(), np.empty(known.num_rows, np.int32)
    places[np.lexsort((hashes, known["n_classes"].to_numpy()))] = np.arange(known.num_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hashes), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, _FOLDED):
                lists = batch.column("minima").slice(start, _FOLDED)
                sizes, flat = pc.list_value_length(lists).to_numpy(), pc.list_flatten(lists).to_numpy()
                row, ranks = np.repeat(np.arange(len(sizes)), sizes), places[np.searchsorted(hashes, flat)]
                ranks = ranks[np.lexsort((ranks, row))]
                behind = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
                total += np.bincount(ranks[behind >= least], minlength=len(hashes))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["rank", "n"])

    found = classes.select("minima").mapInArrow(run, "rank long, n long")
    return found.groupBy("rank").agg(F.sum("n").alias("n"))


def _met(indexed: DataFrame, least: int) -> DataFrame:
    """Pairs ``(key, other, shared)`` with key < other, by a join on the indexed hashes."""
    blocks = F.ceil(F.col("at.n_classes") / BLOCK).cast("int")
    left = indexed.select(
        F.col("at.hash").alias("hash"), F.pmod(F.xxhash64("key"), blocks).cast("int").alias("block"), "key", "minima"
    )
    right = indexed.select(
        F.col("at.hash").alias("hash"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
        F.col("key").alias("other"),
        F.col("minima").alias("others"),
    )
    common = F.array_intersect("minima", "others")
    met = left.join(right, ["hash", "block"]).where(F.col("key") < F.col("other"))
    kept = met.where((F.get(common, F.lit(0)) == F.col("hash")) & (F.size(common) >= least))
    return kept.select("key", "other", F.size(common).alias("shared"))


class _Rows(NamedTuple):
    """Classes of a block: hashes of a row ascend, its largest is repeated behind; word i of all rows' bits is ``bits[i]``."""

    keys: pa.Array
    members: np.ndarray
    sizes: np.ndarray
    hashes: np.ndarray
    bits: np.ndarray


def _read(path: str, folders: Sequence[int]) -> pa.Table:
    """The rows of some folders of ``_blocks``."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        files, at = pafs.LocalFileSystem(), "/" + (rest if scheme == "file" else path).lstrip("/")
    else:
        files, at = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    named = [f"{at}/block={folder}" for folder in folders]
    how = {"columns": ["key", "n_members", "minima"], "filesystem": files, "partitioning": None, "use_threads": False}
    return pa.concat_tables([pq.read_table(folder, **how) for folder in named])


def _rows(table: pa.Table) -> _Rows:
    lists = table["minima"].combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    n, width = len(sizes), int(sizes.max())
    hashes, bits = np.empty((n, width), np.int64), np.empty((FOLDS // 64, n), np.uint64)
    for start in range(0, n, _FOLDED):
        part = sizes[start : start + _FOLDED]
        flat, row = pc.list_flatten(lists.slice(start, _FOLDED)).to_numpy(), np.repeat(np.arange(len(part)), part)
        some = hashes[start : start + _FOLDED]
        some[:] = np.iinfo(np.int64).max
        some[row, np.arange(len(flat)) - np.repeat(np.cumsum(part) - part, part)] = flat
        some.sort(axis=1)
        last = some[np.arange(len(part)), part - 1]
        np.copyto(some, last[:, None], where=np.arange(width) >= part[:, None])
        fold = ((flat.view(np.uint64) * _GOLDEN) >> _SHIFT).astype(np.int64)
        odd = (np.bincount(row * FOLDS + fold, minlength=len(part) * FOLDS) & 1).astype(np.uint8)
        bits[:, start : start + _FOLDED] = np.packbits(odd.reshape(-1, FOLDS), axis=1).view(np.uint64).T
    return _Rows(table["key"].combine_chunks(), table["n_members"].to_numpy(), sizes, hashes, bits)


def _candidates(left: _Rows, right: _Rows, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of rows that may be links: as many bits differ as hashes may, or fewer."""
    kind = np.uint8 if left.sizes.max() + right.sizes.max() - 2 * least < 256 else np.uint16
    tops, lows = left.hashes[:, -1], right.hashes[:, least - 1]
    by_top, by_low = np.argsort(tops), np.argsort(lows)
    lows, bits, others = lows[by_low], right.bits[:, by_low], (right.sizes - least).astype(kind)[by_low]
    words, ones = np.empty((_TILE, _WIDE), np.uint64), np.empty((_TILE, _WIDE), np.uint8)
    total, most = np.empty((_TILE, _WIDE), kind), np.empty((_TILE, _WIDE), kind)
    for at in range(0, len(by_top), _TILE):
        rows = by_top[at : at + _TILE]
        mine, spare = left.bits[:, rows], (left.sizes[rows] - least).astype(kind)
        # beyond these, the sketches of the right side begin too high
        end = int(np.searchsorted(lows, tops[rows[-1]], side="right"))
        for start in range(0, end, _WIDE):
            stop = min(start + _WIDE, end)
            w, c, t, m = (x[: len(rows), : stop - start] for x in (words, ones, total, most))
            t[:] = 0
            for i in range(_FIRST):
                np.bitwise_xor(mine[i][:, None], bits[i, start:stop], out=w)
                np.bitwise_count(w, out=c)
                np.add(t, c, out=t)
            np.add(spare[:, None], others[start:stop], out=m)
            x, y = np.nonzero(t <= m)
            if len(x):
                rest = np.bitwise_count(mine[_FIRST:, x] ^ bits[_FIRST:, start + y]).sum(axis=0, dtype=np.int64)
                kept = t[x, y] + rest <= m[x, y]
                yield rows[x[kept]], by_low[start + y[kept]]


def _links(left: _Rows, right: _Rows, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, row, shared)`` arrays of linked rows, of two blocks or, if both are the same, of two of one."""
    at_once = max(1, _HASHES_AT_ONCE // (left.hashes.shape[1] + right.hashes.shape[1]))
    for a, b in _candidates(left, right, least):
        if left is right:
            a, b = a[a < b], b[a < b]
        for start in range(0, len(a), at_once):
            x, y = a[start : start + at_once], b[start : start + at_once]
            both = np.concatenate((left.hashes[x], right.hashes[y]), axis=1)
            both.sort(axis=1)
            distinct = 1 + np.count_nonzero(both[:, 1:] != both[:, :-1], axis=1)
            shared = left.sizes[x] + right.sizes[y] - distinct
            kept = shared >= least
            yield x[kept], y[kept], shared[kept]


def _pairs(left: _Rows, rights: Iterator[_Rows], least: int) -> Iterator[pa.RecordBatch]:
    """``(key, other, shared)`` with key < other."""

    def batch(right: _Rows, held: list) -> pa.RecordBatch:
        x, y, shared = (np.concatenate(part) for part in zip(*held))
        one, two = left.keys.take(pa.array(x)), right.keys.take(pa.array(y))
        first = pc.less(one, two)
        pair = [pc.if_else(first, one, two), pc.if_else(first, two, one), pa.array(shared.astype(np.int32))]
        return pa.RecordBatch.from_arrays(pair, names=["key", "other", "shared"])

    for right in rights:
        held: list = []
        for link in _links(left, right, least):
            held.append(link)
            if sum(len(part[0]) for part in held) >= _LINKS_HELD:
                yield batch(right, held)
                held = []
        if held:
            yield batch(right, held)


def _tallies(left: _Rows, rights: Iterator[_Rows], least: int) -> Iterator[pa.RecordBatch]:
    """``(key, n_classes, n_others, most_shared)`` of the links of a class with the blocks of a task."""

    def add(tally: np.ndarray, at: np.ndarray, others: np.ndarray, shared: np.ndarray) -> None:
        np.add.at(tally[0], at, 1)
        np.add.at(tally[1], at, others)
        np.maximum.at(tally[2], at, shared)

    def batch(rows: _Rows, tally: np.ndarray) -> pa.RecordBatch:
        linked = np.flatnonzero(tally[0])
        columns = [rows.keys.take(pa.array(linked)), *(pa.array(part[linked]) for part in tally)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "n_classes", "n_others", "most_shared"])

    mine = np.zeros((3, len(left.sizes)), np.int64)
    for right in rights:
        theirs = mine if right is left else np.zeros((3, len(right.sizes)), np.int64)
        for x, y, shared in _links(left, right, least):
            add(mine, x, right.members[y], shared)
            add(theirs, y, left.members[x], shared)
        if right is not left:
            yield batch(right, theirs)
    yield batch(left, mine)


def _blocks(classes: DataFrame, n: int, n_hashes: int, least: int) -> tuple[str, list[tuple[list[int], int, int, int]]]:
    """Write classes in blocks by their largest hash; the path, and folders, rows, lowest and largest hash of each block.

    The lowest hash is that which the fewest hashes of a sketch reach that it must share.
    """
    cores = classes.sparkSession.sparkContext.defaultParallelism
    wanted = max(math.ceil(n / BLOCK_ROWS), math.ceil(n_hashes / _BLOCK_HASHES), min(math.ceil(n / 1024), 4 * cores), 1)
    rising = F.sort_array("minima")
    low, top = F.element_at(rising, least).alias("low"), F.element_at(rising, -1).alias("top")
    dealt = classes.select("key", "n_members", "minima", low, top).repartitionByRange(wanted, "top", "key")
    path = write_shared(dealt.withColumn("block", F.spark_partition_id()), "blocks", by=("block",))
    written = classes.sparkSession.read.schema("block int, low long, top long").parquet(path)
    found = written.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("top").alias("top"))
    blocks: list[tuple[list[int], int, int, int]] = []
    for folder, rows, low, top in sorted(map(tuple, found.collect())):
        if blocks and blocks[-1][1] + rows <= math.ceil(n / wanted):
            folders, held, lowest, highest = blocks.pop()
            blocks.append(([*folders, folder], held + rows, min(lowest, low), max(highest, top)))
        else:
            blocks.append(([folder], rows, low, top))
    return path, blocks


def _compared(
    classes: DataFrame,
    n: int,
    n_hashes: int,
    least: int,
    found: Callable[[_Rows, Iterator[_Rows], int], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """What ``found`` makes of any two of ``n`` classes that may be links, block by block."""
    spark = classes.sparkSession
    written, blocks = _blocks(classes, n, n_hashes, least)
    path = qualified(spark, written)
    met = [
        [j for j in range(i, len(blocks)) if blocks[j][2] <= blocks[i][3] and blocks[i][2] <= blocks[j][3]]
        for i in range(len(blocks))
    ]
    work = [[blocks[i][1] * blocks[j][1] for j in others] for i, others in enumerate(met)]
    share = min(_PAIRS_A_TASK, sum(map(sum, work)) // (4 * spark.sparkContext.defaultParallelism) + 1)
    tasks: list[tuple[int, list[int]]] = []
    for i, others in enumerate(met):
        parts = np.cumsum(work[i]) // share
        tasks += [(i, [j for j, at in zip(others, parts) if at == part]) for part in np.unique(parts)]
    folders = [block[0] for block in blocks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in chain.from_iterable(batch.column("id").to_pylist() for batch in batches):
            i, others = tasks[task]
            left = _rows(_read(path, folders[i]))
            yield from found(left, (left if j == i else _rows(_read(path, folders[j])) for j in others), least)

    return spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(run, schema)


class _Plan(NamedTuple):
    """Classes that can be linked, how many, their hashes, and the index of them if that is the shorter way."""

    classes: DataFrame
    n: int
    n_hashes: int
    indexed: DataFrame | None


def _planned(classes: DataFrame, least: int) -> _Plan:
    if least < 1:
        raise ValueError("least must be 1 or more")
    large, counts = classes.where(F.size("minima") >= least), _counts(classes)
    n, n_hashes = large.agg(F.count(F.lit(1)), F.sum(F.size("minima"))).first()

    def dense(times: DataFrame) -> bool:
        meetings = times.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
        return meetings * DENSE > n * (n - 1) / 2

    # few hashes are ordered in the tasks, without a row for each hash of a class
    few = counts.count() <= _KNOWN
    if few and dense(_indexed_known(large, counts, least)):
        return _Plan(large, n, n_hashes, None)
    ordered = cut(_rarest_first(classes, counts).where(F.size("hashes") >= least), "ordered")
    indexed = _indexed(ordered, least)
    if not few and dense(indexed.groupBy("at.hash").agg(F.count(F.lit(1)).alias("n"))):
        return _Plan(large, n, n_hashes, None)
    return _Plan(large, n, n_hashes or 0, indexed)


def _both_ways(pairs: DataFrame) -> DataFrame:
    ways = F.array(F.struct("key", "other"), F.struct(F.col("other").alias("key"), F.col("key").alias("other")))
    return pairs.select(F.explode(ways).alias("way"), "shared").select("way.key", "way.other", "shared")


def overlapping(classes: DataFrame, least: int) -> DataFrame:
    """``(key, other, shared)``, both ways round, of classes that share ``least`` hashes or more."""
    plan = _planned(classes, least)
    if plan.indexed is not None:
        return _both_ways(_met(plan.indexed, least))
    schema = "key string, other string, shared int"
    return _both_ways(_compared(plan.classes, plan.n, plan.n_hashes, least, _pairs, schema))


def _totals(classes: DataFrame, least: int) -> DataFrame:
    """``(key, n_classes, n_others, most_shared)`` of classes that are linked: other classes, their members, shared hashes."""
    plan = _planned(classes, least)
    if plan.indexed is not None:
        sizes = classes.select(F.col("key").alias("other"), F.col("n_members").alias("others"))
        met = _both_ways(_met(plan.indexed, least)).join(sizes, "other")
        parts = met.select("key", F.lit(1).alias("n_classes"), F.col("others").alias("n_others"), F.col("shared").alias("most_shared"))
    else:
        schema = "key string, n_classes long, n_others long, most_shared long"
        parts = _compared(plan.classes, plan.n, plan.n_hashes, least, _tallies, schema)
    return parts.groupBy("key").agg(
        F.sum("n_classes").alias("n_classes"), F.sum("n_others").alias("n_others"), F.max("most_shared").alias("most_shared")
    )


def overlaps(sketches: DataFrame, least: int, *, id_col: str) -> DataFrame:
    """Pairs of class representatives ``(class_id, other_class_id, shared)``, both ways round."""
    classes = cut(classes_of(sketches, id_col=id_col)[0])
    names = classes.select("key", "class_id")
    pairs = overlapping(classes, least).join(names, "key")
    others = names.select(F.col("key").alias("other"), F.col("class_id").alias("other_class_id"))
    return pairs.join(others, "other").select("class_id", "other_class_id", "shared")


def links(sketches: DataFrame, least: int, *, id_col: str) -> DataFrame:
    """One row for each sketch: its class, and with how many it shares ``least`` hashes or more.

    ``n_classes`` counts other classes, ``n_links`` rows (copies among them, not the row itself),
    ``most_shared`` the hashes shared with the nearest other class (NULL if there is none).
    A sketch of fewer hashes than ``least`` is linked with nothing, its copies included.
    """
    found, members = classes_of(sketches, id_col=id_col)
    classes = cut(found)
    copies = F.when(F.size("minima") >= least, F.col("n_members") - 1).otherwise(F.lit(0))
    counted = classes.select("key", "class_id", copies.alias("copies")).join(_totals(classes, least), "key", "left").select(
        "key",
        "class_id",
        F.coalesce("n_classes", F.lit(0)).cast("long").alias("n_classes"),
        (F.coalesce("n_others", F.lit(0)) + F.col("copies")).cast("long").alias("n_links"),
        F.col("most_shared").cast("long").alias("most_shared"),
    )
    return members.join(counted, "key").select(id_col, "class_id", "n_classes", "n_links", "most_shared")
