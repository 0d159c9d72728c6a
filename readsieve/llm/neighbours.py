"""Approximate nearest neighbours by NN-descent and greedy graph search.

**Classes.** Equal vectors are one node, so a vector with thousands of copies is one
vector to search; the answers name its members afterwards.

**Graph.** Every node keeps its ``degree`` nearest nodes found so far, by inner product.
The first neighbours come from blocks of about ``LEAF`` nodes that random hyperplane
trees cut (trees are grown on a bounded sample of ``TREE_SAMPLE`` vectors; a part that is
too large, as where many vectors are almost alike, is dealt out by hash). There are two trees at least: blocks
of one tree have no link between them that a descent could follow. Then rounds of NN-descent join each
node's neighbours, forward and reverse, with the vectors and compare the neighbours of a
node with each other, at least one of the two being new: neighbours of neighbours. A
round samples ``sample`` links of each kind for a node, which bounds its join, hubs
included. Rounds stop when few links change.

**Search.** A query starts at its own node and expands the best nodes of its beam that
are not expanded yet, all queries at once in a few rounds of joins with the graph.
Every row is indexed; recall is measured against brute force in the tests.

Vectors that are null, empty, zero or hold null or non-finite components take no part.
Scores are inner products in double precision of the original vectors. Vectors of
different lengths do not meet: only those of the most common length (the smaller on a
tie) take part. Rows that repeat a vec_id are one row, with the smallest of their vectors (component
by component, a shorter one before those it begins), which is taken before lengths are counted. Ties go
to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readsieve.session import cut

LEAF = 1_000
TREES = 6
TREE_SAMPLE = 20_000
DEGREE = 48
SAMPLE = 20
ROUNDS = 12
LEAST_CHANGE = 0.05
EXPANDED = 32
SEARCH_ROUNDS = 3
BEAM = 100
MOST_MET = 4096  # far above the links that a node is sampled

EDGES = "id long, nbr long, score double"


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part, as floats if they are floats, else as doubles."""
    v = F.col("embedding")
    if rows.schema["embedding"].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    fit = rows.where("vec_id is not null and embedding is not null and size(embedding) > 0").where(~bad & some)
    return fit.groupBy("vec_id").agg(F.min(v).alias("embedding"))


def _of_one_length(rows: DataFrame) -> DataFrame:
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == common["n"]) if common else rows


# ------------------------------------------------------------ hyperplane trees


class Tree:
    """Hyperplanes that halve a sample ``depth`` times, and the number of blocks that each part needs."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int, n: int):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.planes = rng.normal(size=(depth, sample.shape[1]))
        self.cuts = np.zeros((depth, 1 << max(depth - 1, 0)))
        parts = np.zeros(len(sample), np.int64)
        for level in range(depth):
            along = sample @ self.planes[level]
            for part in np.unique(parts):
                self.cuts[level, part] = np.median(along[parts == part])
            parts = 2 * parts + (along > self.cuts[level, parts])
        # Vectors too much alike, or too many for the depth, leave large parts.
        share = np.bincount(parts, minlength=1 << depth) / max(len(sample), 1)
        self.blocks = np.maximum(1, np.ceil(share * n / (2 * LEAF))).astype(np.int64)

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        parts = np.zeros(len(vectors), np.int64)
        for level in range(self.depth):
            parts = 2 * parts + (vectors @ self.planes[level] > self.cuts[level, parts])
        return parts


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _blocks(nodes: DataFrame, trees: list[Tree]) -> DataFrame:
    """(block, id, embedding): every node once for each tree; large parts are dealt out by hash."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, vectors = batch.column(0), _matrix(batch.column(1))
                dealt = (ids.to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                for i, tree in enumerate(trees):
                    leaf = tree.leaf(vectors)
                    block = ((leaf * len(trees) + i) << 31) + dealt % tree.blocks[leaf]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block), ids, batch.column(1)], names=["block", "id", "embedding"]
                    )

    kind = nodes.schema["embedding"].dataType.simpleString()
    return nodes.select("id", "embedding").mapInArrow(task, f"block long, id long, embedding {kind}")


def _best(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Places of each row's ``most`` best scores, each pair once."""
    order = np.lexsort((cols, rows))
    r, c = rows[order], cols[order]
    once = np.ones(len(r), bool)
    once[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    order = order[once]
    order = order[np.lexsort((-scores[order], rows[order]))]
    r = rows[order]
    start = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
    rank = np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r))))
    return order[rank < most]


def _edges(ids: np.ndarray, nbrs: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(nbrs), pa.array(scores)], names=["id", "nbr", "score"])


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows with the same first column together, from batches sorted by it, ``most`` at a time."""
    held: list[pa.RecordBatch] = []
    n_held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if held and held[0].column(0)[0].as_py() != keys[start]:
                yield pa.concat_batches(held)
                held, n_held = [], 0
            while start < end:
                size = min(end - start, most - n_held)
                held.append(batch.slice(start, size))
                start, n_held = start + size, n_held + size
                if n_held == most:
                    yield pa.concat_batches(held)
                    held, n_held = [], 0
    if held:
        yield pa.concat_batches(held)


def _in_block(most: int):
    """Each node's best within its block."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 8 * LEAF):
            ids, vectors = group.column(1).to_numpy(), _matrix(group.column(2))
            n = len(ids)
            if n < 2:
                continue
            k = min(most, n - 1)
            for at in range(0, n, 512):
                scores = vectors[at : at + 512] @ vectors.T
                rows = np.arange(len(scores))
                scores[rows, at + rows] = -np.inf
                best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                yield _edges(
                    np.repeat(ids[at : at + 512], k),
                    ids[best].ravel(),
                    np.take_along_axis(scores, best, axis=1).ravel(),
                )

    return task


# ---------------------------------------------------------------- NN-descent


def _nearest(edges: DataFrame, degree: int) -> DataFrame:
    """The best ``degree`` neighbours of each node; a neighbour known before is not new."""
    dealt = edges.repartition("id")
    once = dealt.groupBy("id", "nbr").agg(F.max("score").alias("score"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "nbr"))
    return once.withColumn("rank", rank).where(F.col("rank") <= degree).drop("rank")


def _sampled(links: DataFrame, by: str, other: str, sample: int, seed: int) -> DataFrame:
    """(v, u, new): at most ``sample`` new and old links of each node, drawn by hash."""
    turn = F.row_number().over(Window.partitionBy(by, "new").orderBy(F.xxhash64("id", "nbr", F.lit(seed))))
    return links.withColumn("turn", turn).where(F.col("turn") <= sample).select(F.col(by).alias("v"), F.col(other).alias("u"), "new")


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node v, compare its sampled neighbours; keep what beats a node's worst link."""
    held: list[tuple[np.ndarray, ...]] = []
    n_held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, n_held
        if held:
            ids, nbrs, scores = (np.concatenate([h[i] for h in held]) for i in range(3))
            keep = _best(ids, nbrs, scores, DEGREE)
            yield _edges(ids[keep], nbrs[keep], scores[keep])
            held, n_held = [], 0

    for group in _groups(batches, MOST_MET):
        u = group.column(1).to_numpy()
        new = group.column(2).to_numpy(zero_copy_only=False)
        worst = group.column(3).to_numpy(zero_copy_only=False)
        order = np.lexsort((~new, u))
        order = order[np.concatenate(([True], u[order][1:] != u[order][:-1]))]
        u, new, worst = u[order], new[order], worst[order]
        vectors = _matrix(group.column(4))[order]
        fresh = np.flatnonzero(new)
        if not len(fresh) or len(u) < 2:
            continue
        scores = vectors[fresh] @ vectors.T
        apart = u[fresh][:, None] != u[None, :]
        a, b = np.nonzero(apart & (scores > worst[fresh][:, None]))
        c, d = np.nonzero(apart & (scores > worst[None, :]))
        held.append((np.concatenate((u[fresh[a]], u[d])), np.concatenate((u[b], u[fresh[c]])), np.concatenate((scores[a, b], scores[c, d]))))
        n_held += len(a) + len(c)
        if n_held > 1 << 20:
            yield from flush()
    yield from flush()


def build_graph(
    nodes: DataFrame, degree: int = DEGREE, sample: int = SAMPLE, rounds: int = ROUNDS, trees: int = TREES
) -> DataFrame:
    """(id, nbr, score, new): the neighbour graph of ``nodes`` (id, embedding)."""
    n = nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    # A tree splits its sample down to 8 rows; what is larger on all rows is dealt out by hash.
    grown = min(depth, int(np.log2(TREE_SAMPLE / 8)))
    rows = nodes.orderBy(F.xxhash64("id"), "id").limit(TREE_SAMPLE if depth else 1).collect()
    if not rows:
        return cut(nodes.selectExpr("id", "id AS nbr", "0.0D AS score", "true AS new").where("false"), "graph")
    vectors = np.array([r["embedding"] for r in rows])
    planted = [Tree(vectors, grown, seed, n) for seed in range(trees if depth else 1)]
    blocks = _blocks(nodes, planted).repartition("block").sortWithinPartitions("block")
    first = blocks.mapInArrow(_in_block(degree), EDGES).withColumn("new", F.lit(True))
    graph = cut(_nearest(first, degree), "graph")
    for turn in range(rounds if depth else 0):
        graph, changed = _descend(graph, nodes, degree, sample, turn)
        if changed <= LEAST_CHANGE * n * degree:
            break
    return graph


def _descend(graph: DataFrame, nodes: DataFrame, degree: int, sample: int, turn: int) -> tuple[DataFrame, int]:
    """One round; returns the graph and how many of its links are new."""
    forward = cut(_sampled(graph, "id", "nbr", sample, turn), "sampled")
    reverse = _sampled(graph, "nbr", "id", sample, turn + 1000)
    links = forward.unionByName(reverse)
    worst = graph.groupBy("id").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    reach = F.when(F.col("n") < degree, F.lit(float("-inf"))).otherwise(F.col("worst"))
    known = nodes.join(worst, "id", "left").select(
        F.col("id").alias("u"), F.coalesce(reach, F.lit(float("-inf"))).alias("worst"), "embedding"
    )
    met = links.join(known, "u").select("v", "u", "new", "worst", "embedding")
    found = met.repartition("v").sortWithinPartitions("v").mapInArrow(_local_join, EDGES)
    # What has been sampled forward has been compared and is new no longer.
    used = forward.where("new").select(F.col("v").alias("id"), F.col("u").alias("nbr"), F.lit(True).alias("used"))
    before = graph.join(used, ["id", "nbr"], "left").select(
        "id", "nbr", "score", (F.col("new") & F.col("used").isNull()).alias("new")
    )
    after = cut(_nearest(before.unionByName(found.withColumn("new", F.lit(True))), degree), "graph")
    return after, after.where("new").count()


# -------------------------------------------------------------------- search


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, nbr, vector of the query, vector of the candidate) to inner products in double precision."""
    for batch in batches:
        if batch.num_rows:
            scores = np.einsum("ij,ij->i", _matrix(batch.column(2)), _matrix(batch.column(3)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores)], names=["id", "nbr", "score"]
            )


def search(
    graph: DataFrame,
    nodes: DataFrame,
    queries: DataFrame,
    expanded: int = EXPANDED,
    rounds: int = SEARCH_ROUNDS,
    beam: int = BEAM,
) -> DataFrame:
    """(id, nbr, score): the beam of each node of ``queries`` (id) when the search ends."""
    # A link leads both ways.
    ways = cut(
        graph.select("id", "nbr").union(graph.select("nbr", "id")).distinct(),
        "ways",
    )
    own = queries.select("id").distinct()
    vectors = nodes.select(F.col("id").alias("nbr"), F.col("embedding").alias("there"))
    asked = cut(own.join(nodes, "id").select("id", F.col("embedding").alias("here")), "asked")
    seen = cut(
        graph.join(own, "id", "left_semi").select("id", "nbr", "score", F.lit(False).alias("done")), "beam"
    )
    best = Window.partitionBy("id").orderBy(F.desc("score"), "nbr")
    for _ in range(rounds):
        ranked = seen.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= beam)
        opened = F.sum(F.when(~F.col("done"), 1).otherwise(0)).over(best.rowsBetween(Window.unboundedPreceding, 0))
        state = cut(
            ranked.withColumn("now", ~F.col("done") & (opened <= expanded)).drop("rank"), "beam"
        )
        frontier = state.where("now").select(F.col("id").alias("q"), F.col("nbr").alias("at"))
        reached = (
            frontier.join(ways, F.col("at") == ways["id"])
            .select(F.col("q").alias("id"), "nbr")
            .where("id != nbr")
            .distinct()
            .join(state.select("id", "nbr"), ["id", "nbr"], "left_anti")
        )
        scored = (
            reached.join(vectors, "nbr").join(asked, "id").select("id", "nbr", "here", "there").mapInArrow(_score, EDGES)
        )
        closed = state.select("id", "nbr", "score", (F.col("done") | F.col("now")).alias("done"))
        fresh = scored.withColumn("done", F.lit(False))
        merged = closed.unionByName(fresh)
        seen = cut(merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= beam).drop("rank"), "beam")
    return seen.select("id", "nbr", "score")


def nearest(rows: DataFrame, every: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each row whose id ``every`` divides."""
    valid = cut(_of_one_length(cut(usable(rows), "vectors")), "vectors")
    of_class = valid.groupBy("embedding").agg(F.min("vec_id").alias("id"))
    nodes = cut(of_class.select("id", "embedding"), "nodes")
    member = cut(
        valid.join(nodes, "embedding").select("id", "vec_id"), "members"
    )
    graph = build_graph(nodes)
    asked = member.where(F.col("vec_id") % every == 0)
    asked_nodes = cut(asked.select("id").distinct(), "asked")
    found = search(graph, nodes, asked_nodes)
    # A query's own class counts too, for the other rows with the same vector.
    own = asked_nodes.join(nodes, "id").select(
        "id", F.col("id").alias("nbr"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x).alias("score")
    )
    beam = found.unionByName(own)
    # More than k + 1 members of a class are never needed; the smallest ids come first.
    turn = F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))
    few = cut(member.withColumn("turn", turn).where(F.col("turn") <= k + 1).drop("turn"), "few")
    in_class = few.select(F.col("id").alias("nbr"), "vec_id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))
    lists = cut(beam.join(in_class, "nbr").withColumn("turn", rank).where(F.col("turn") <= k + 1), "lists")
    each = asked.select("id", F.col("vec_id").alias("query_id")).join(
        lists.select("id", "vec_id", "score"), "id"
    ).where("query_id != vec_id")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
