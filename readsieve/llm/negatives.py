"""Hard negatives by best-first search in R-trees packed by sort-tile-recursive.

Vectors are whole numbers, floor(256 c), and a score is their inner product. For each
anchor and each of its first positives (rows of the same label), the negatives are the
first rows of other labels whose score lies between ``low`` and ``high`` per cent of the
positive's score.

**Index.** Rows are tiled by label and by the coordinate that varies most (a range
partitioning), and each tile by further coordinates in turn, down to leaves of ``LEAF``
rows. A stretch of at most ``SHARD_ROWS`` rows is a shard: a packed tree whose boxes are
the minima and maxima of each coordinate and of the label.

**Search.** A box gives an interval for each coordinate's product, and their sums bound
the scores in it from both sides. A queue takes boxes with the best possible score
first and leaves out those outside the score windows or without a wanted label; it ends
when those left are strictly below the last score that counts. All windows of an anchor
share one queue. Anchors meet the
shards in blocks of ``BLOCK_ANCHORS``: for positives only the shards that hold one of
their labels. What the shards found is merged by anchor. The search is exact.

**Copies.** Of rows with the same vector and label only the first few by vec_id can be
among the first, so the others are not indexed; a vector with very many copies is a few
rows. They are anchors all the same.

Rows with a null label, a null vector or null or non-finite entries take no part. Rows
alike in vec_id, vector and label are one row; a row is no partner of another with its
vec_id. Rows without a vec_id are no anchors and come last among ties. Vectors of
different lengths are taken as if zeros followed the shorter ones. Scores beyond 64 bits
are the nearest 64-bit number. Negative positive scores leave no window. An empty table
gives no rows. Columns other than ``vec_id``, ``embedding`` and ``label`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType

from readsieve.llm.texts import batch_of, struct
from readsieve.llm.whitening import whole_numbers
from readsieve.session import cut

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
SHARD_ROWS = 4_096
BLOCK_ANCHORS = 256
LEAF = 32
FANOUT = 16
FIRST_OPENED, MORE_OPENED = 8, 4  # boxes opened at once, and how much more the next time
TILED = 3  # coordinates that a shard is tiled by
NO_ID = (1 << 63) - 1

_L, _LS = LongType(), ArrayType(LongType())
MOMENTS = struct(i=IntegerType(), n=_L, total=DoubleType(), squares=DoubleType(), largest=_L)
SHARD = struct(part=IntegerType(), shard=_L, labels=_LS, ids=_LS, row_labels=_LS, x=BinaryType())
BLOCK = struct(block=_L, labels=_LS, keys=_LS, ids=_LS, row_labels=_LS, x=BinaryType(), bounds=ArrayType(_LS))
HITS = struct(key=_L, bound=_L, id=_L, score=_L)


# ----------------------------------------------------------------- the tree


def tiles(x: np.ndarray, leaf: int = LEAF, coordinates: int = TILED) -> np.ndarray:
    """The order of the rows in which every ``leaf`` of them are a tile: sorted by one
    coordinate, cut into slices, each slice by the next coordinate, and so on."""
    axes = np.argsort(-x.astype(float).var(0), kind="stable")[:coordinates] if len(x) else []

    def order(rows: np.ndarray, axes: np.ndarray) -> np.ndarray:
        pages = -(-len(rows) // leaf)
        if pages <= 1 or not len(axes):
            return rows
        rows = rows[np.argsort(x[rows, axes[0]], kind="stable")]
        slices = max(1, round(pages ** (1 / len(axes))))
        each = -(-pages // slices) * leaf
        return np.concatenate([order(rows[i : i + each], axes[1:]) for i in range(0, len(rows), each)])

    return order(np.arange(len(x)), axes)


class Exact:
    """Inner products of whole numbers of at most ``largest``, in the cheapest exact way."""

    def __init__(self, largest: int, width: int):
        most = largest * largest * max(width, 1)
        self.kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object

    def numbers(self, data: bytes, rows: int) -> np.ndarray:
        x = np.frombuffer(data, np.int64)
        return x.reshape(rows, -1).astype(self.kind)

    def times(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        product = a @ b
        if self.kind is object:
            product = np.clip(product, -NO_ID, NO_ID)
        return product.astype(np.int64)


class Tree:
    """Boxes over rows in packed order, level by level from the leaves to the root."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.x, self.ids, self.labels = x, ids, labels
        starts = np.arange(0, len(x), LEAF)
        self.levels = [
            (
                np.minimum.reduceat(x, starts),
                np.maximum.reduceat(x, starts),
                np.minimum.reduceat(labels, starts),
                np.maximum.reduceat(labels, starts),
            )
        ]
        while len(self.levels[-1][0]) > 1:
            low, high, least, most = self.levels[-1]
            starts = np.arange(0, len(low), FANOUT)
            self.levels.append(
                (
                    np.minimum.reduceat(low, starts),
                    np.maximum.reduceat(high, starts),
                    np.minimum.reduceat(least, starts),
                    np.maximum.reduceat(most, starts),
                )
            )

    def bounds(self, queries: np.ndarray, exact: Exact) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level, the least and the largest possible score of each query in each box."""
        above, below = np.maximum(queries, 0), np.minimum(queries, 0)
        return [
            (
                exact.times(above, low.T) + exact.times(below, high.T),
                exact.times(above, high.T) + exact.times(below, low.T),
            )
            for low, high, _, _ in self.levels
        ]


def best_first(tree, bounds, query, own_id, wanted, windows, top, exact, vector):
    """For each window (low, high) the first ``top`` (score, id) with low <= score <= high,
    higher scores and then smaller ids first.

    The queue holds boxes that some window still needs: their scores can lie in it, and
    not strictly below its last score that counts. The best boxes are opened first, a
    few at the start and then more at a time, so that a shard that can't be pruned costs
    few steps. ``wanted(least, most)`` tells which boxes can hold a wanted label, and
    which rows do."""
    lows, highs = (np.array(w, np.int64) for w in zip(*windows))
    scores = [np.empty(0, np.int64)] * len(windows)
    ids = [np.empty(0, np.int64)] * len(windows)
    levels = np.array([len(tree.levels) - 1])
    boxes, opened = np.array([0]), FIRST_OPENED
    least, most = (b[query] for b in bounds[-1])
    while True:
        # Windows that a box can still add to, and the best score that it can add.
        needed = (most >= lows[:, None]) & (least <= highs[:, None])
        best = np.where(needed, np.minimum(most, highs[:, None]), -NO_ID).max(0)
        open_ = needed.any(0)
        if not open_.all():
            levels, boxes, least, most, best = (v[open_] for v in (levels, boxes, least, most, best))
        if not len(boxes):
            break
        order = np.argsort(-best, kind="stable")
        now, later = order[:opened], order[opened:]
        queue = [(levels[later], boxes[later], least[later], most[later])]
        for level in np.unique(levels[now]).tolist():
            mine = boxes[now][levels[now] == level]
            each, n = (FANOUT, len(tree.levels[level - 1][0])) if level else (LEAF, len(tree.x))
            inside = (mine[:, None] * each + np.arange(each)).ravel()
            inside = inside[inside < n]
            if level:
                inside = inside[wanted(tree.levels[level - 1][2][inside], tree.levels[level - 1][3][inside])]
                queue.append((np.full(len(inside), level - 1), inside, *(b[query, inside] for b in bounds[level - 1])))
                continue
            opened *= MORE_OPENED
            inside = inside[wanted(tree.labels[inside], tree.labels[inside]) & (tree.ids[inside] != own_id)]
            found = exact.times(tree.x[inside], vector)
            for w in range(len(windows)):
                fits = np.flatnonzero((found >= lows[w]) & (found <= highs[w]))
                if len(fits):
                    all_scores = np.concatenate([scores[w], found[fits]])
                    all_ids = np.concatenate([ids[w], tree.ids[inside[fits]]])
                    first = np.lexsort((all_ids, -all_scores))[:top]
                    scores[w], ids[w] = all_scores[first], all_ids[first]
                    if len(first) == top:
                        lows[w] = scores[w][-1]
        levels, boxes, least, most = (np.concatenate(v) for v in zip(*queue))
    return [list(zip(s.tolist(), i.tolist())) for s, i in zip(scores, ids)]


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest score between ``low`` and ``high`` per cent of the positive's."""
    return -((-low * positive) // 100), (high * positive) // 100


def _search(largest: int, width: int, top: int, same: bool, low: int, high: int):
    """Blocks of anchors against shards: hits of the same label, or of others within the window."""
    exact, schema = Exact(largest, width), to_arrow_schema(HITS)

    def group(blocks: pa.Table, shards: pa.Table) -> pa.Table:
        hits = []
        for shard in shards.to_pylist():
            ids, labels = np.array(shard["ids"]), np.array(shard["row_labels"])
            tree = Tree(exact.numbers(shard["x"], len(ids)), ids, labels)
            for block in blocks.to_pylist():
                queries = exact.numbers(block["x"], len(block["keys"]))
                bounds = tree.bounds(queries, exact)
                for q, (key, own, label) in enumerate(zip(block["keys"], block["ids"], block["row_labels"])):
                    if same:
                        wanted = lambda least, most: (least <= label) & (label <= most)
                    else:
                        wanted = lambda least, most: (least != label) | (most != label)
                    windows = [(-NO_ID, NO_ID) if same else window(b, low, high) for b in block["bounds"][q]]
                    found = best_first(tree, bounds, q, own, wanted, windows, top, exact, queries[q])
                    hits += [(key, b, i, score) for b, own_hits in zip(block["bounds"][q], found) for score, i in own_hits]
        return pa.Table.from_batches([batch_of(hits, schema)], schema)

    return group


# ------------------------------------------------------------ shards and blocks


def _integers(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def moments(rows: DataFrame) -> tuple[int, int]:
    """(coordinate that varies most, largest absolute value)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _integers(batch.column(0))
                f = x.astype(float)
                most = np.maximum(x.max(0), -np.maximum(x.min(0), -NO_ID))
                columns = zip(f.sum(0).tolist(), (f * f).sum(0).tolist(), most.tolist())
                yield batch_of([(i, len(x), *c) for i, c in enumerate(columns)], to_arrow_schema(MOMENTS))

    sums = rows.select("x").mapInArrow(task, MOMENTS).groupBy("i")
    spread = (F.sum("squares") - F.sum("total") * F.sum("total") / F.sum("n")) / F.sum("n")
    seen = sums.agg(spread.alias("spread"), F.max("largest").alias("largest")).collect()  # a row for each coordinate
    if not seen:
        return 0, 0
    return min(seen, key=lambda r: (-r["spread"], r["i"]))["i"], max(r["largest"] for r in seen)


def _stretches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """A task's rows, at most ``size`` at a time."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            held.append(part)
            n, batch = n + part.num_rows, batch.slice(part.num_rows)
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def shards(rows: DataFrame, axis: int) -> DataFrame:
    """Packed stretches of the rows, in tiles by label and the coordinate ``axis``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(struct(**{f.name: f.dataType for f in SHARD if f.name not in ("part", "shard")}))
        for stretch in _stretches(batches, SHARD_ROWS):
            stretch = stretch.combine_chunks().to_batches()[0]
            ids, labels = (stretch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x = _integers(stretch.column(2))
            order = np.concatenate([(own := np.flatnonzero(labels == v))[tiles(x[own])] for v in np.unique(labels)])
            row = (np.unique(labels).tolist(), ids[order].tolist(), labels[order].tolist(), x[order].tobytes())
            yield batch_of([row], schema)

    parts = max(1, -(-rows.count() // SHARD_ROWS))
    first = F.coalesce(F.get("x", F.lit(axis)), F.lit(0))
    tiled = rows.select("id", "label", "x").repartitionByRange(parts, "label", first, F.xxhash64("id", "x"))
    packed = tiled.sortWithinPartitions("label", first, "id").mapInArrow(task, "labels array<long>, ids array<long>, row_labels array<long>, x binary")
    key = F.monotonically_increasing_id()
    return packed.select(F.shiftright(key, 33).cast("int").alias("part"), key.alias("shard"), "*")


def blocks(anchors: DataFrame) -> DataFrame:
    """Anchors (key, id, label, x, bounds) in blocks, neighbours by label."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(struct(**{f.name: f.dataType for f in BLOCK if f.name != "block"}))
        for stretch in _stretches(batches, BLOCK_ANCHORS):
            stretch = stretch.combine_chunks().to_batches()[0]
            keys, ids, labels = (stretch.column(i).to_pylist() for i in range(3))
            x = _integers(stretch.column(3)).tobytes()
            yield batch_of([(sorted(set(labels)), keys, ids, labels, x, stretch.column(4).to_pylist())], schema)

    parts = max(1, -(-anchors.count() // BLOCK_ANCHORS))
    near = anchors.select("key", "id", "label", "x", "bounds").repartitionByRange(parts, "label", "key")
    schema = struct(**{f.name: f.dataType for f in BLOCK if f.name != "block"})
    packed = near.sortWithinPartitions("label", "key").mapInArrow(task, schema)
    return packed.select(F.monotonically_increasing_id().alias("block"), "*")


def _meet(blocks: DataFrame, shards: DataFrame, same: bool, largest: int, width: int, top: int, low: int, high: int) -> DataFrame:
    """Hits of every block of anchors in every shard that can have some."""
    ours, theirs = blocks.select("block", "labels"), shards.select("part", "shard", "labels")
    if same:
        by_label = theirs.select("shard", F.explode("labels").alias("label"))
        pairs = ours.select("block", F.explode("labels").alias("label")).join(by_label, "label").select("block", "shard")
        pairs = pairs.distinct()
    else:
        # Every block meets the shards of every part, but for those with its only label.
        parts = shards.agg(F.max("part")).first()[0]
        dealt = ours.select("block", F.col("labels").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(parts or 0))).alias("part"))
        only = (F.size("own") == 1) & (F.col("own") == F.col("labels"))
        pairs = dealt.join(theirs, "part").where(~only).select("block", "shard")
    pairs = cut(pairs, "pairs")
    left = pairs.join(blocks.drop("labels"), "block").groupBy("block", "shard")
    again = pairs.select(F.col("block").alias("of_block"), F.col("shard").alias("of_shard"))
    own = shards.select(F.col("shard").alias("of_shard"), "ids", "row_labels", "x")
    right = again.join(own, "of_shard").groupBy("of_block", "of_shard")
    return left.cogroup(right).applyInArrow(_search(largest, width, top, same, low, high), HITS)


def _first(hits: DataFrame, top: int, *group: str) -> DataFrame:
    """The first hits of each group, with their ranks."""
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def mine(
    embeddings: DataFrame,
    every: int = 50,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors,
    the rows whose vec_id is divisible by ``every``."""
    labelled = embeddings.where(F.col("label").isNotNull())
    rows = whole_numbers(labelled, F.col("label").cast("long").alias("label"))
    rows = rows.withColumn("id", F.coalesce("vec_id", F.lit(NO_ID)))
    rows = cut(rows.dropDuplicates(["id", "label", "x"]), "rows")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    x = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    rows = rows.select("vec_id", "id", "label", x.alias("x"))
    copies = Window.partitionBy("x", "label").orderBy("id")
    kept = max(positives + 1, negatives + 1)
    few = rows.withColumn("turn", F.row_number().over(copies)).where(F.col("turn") <= kept)
    few = cut(few.select("id", "label", "x"), "indexed")
    axis, largest = moments(rows)
    packed = cut(shards(few, axis), "shards")

    # Keys tell anchors apart that share a vec_id.
    anchors = rows.where(F.col("vec_id") % every == 0).select("id", "label", "x")
    anchors = cut(anchors.withColumn("key", F.monotonically_increasing_id()), "anchors")
    no_bound = F.array(F.lit(None).cast("long"))
    found = _meet(cut(blocks(anchors.withColumn("bounds", no_bound)), "blocks"), packed, True, largest, width, positives, low, high)
    near = cut(_first(found, positives, "key").select("key", F.col("id").alias("positive_id"), F.col("score").alias("bound")), "positives")
    windows = near.groupBy("key").agg(F.array_sort(F.collect_set("bound")).alias("bounds"))
    bounded = cut(blocks(anchors.join(windows, "key")), "blocks")
    found = _meet(bounded, packed, False, largest, width, negatives, low, high)
    hard = _first(found, negatives, "key", "bound")
    return (
        near.join(hard, ["key", "bound"])
        .join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
        .select(
            "anchor_id",
            F.nullif("positive_id", F.lit(NO_ID)).alias("positive_id"),
            "rank",
            F.nullif("id", F.lit(NO_ID)).alias("negative_id"),
            F.col("bound").alias("positive_score"),
            F.col("score").alias("negative_score"),
        )
    )
