"""Whitening of embeddings with distributed block matrices.

Entries become whole numbers, floor(256 c). The fit list holds each distinct vector
once; its mean is taken off before anything is multiplied. The centred rows are indexed
into blocks of ``BLOCK_ROWS`` rows, the blocks times their transposes are the scatter,
whose eigenvectors a local routine finds (it has one row and column for each dimension),
and the blocks of all rows times the whitening matrix are the projected rows.

**Slabs.** Every slab of ``SLAB_ROWS`` rows is a block matrix of its own, since a block
product deals a tall matrix to the square root of its partitions only. A slab bounds what
a task holds, slabs are worked on a few at a time, and their scatters add up.

**Rows.** A row's index is the number of rows before its task's share plus its place in
the share, so the driver sees one number for each share. A distinct vector goes into
the fit at the index of its first row, and rows left out are empty: no row of the result
is found by its vector, and a vector with very many copies is no hot key.

Rows whose vector is null or holds null or non-finite entries are left out. Vectors of
different lengths are taken as if zeros followed the shorter ones; empty vectors are all
zeros. Entries beyond 64 bits are the nearest 64-bit number; a deviation that 64 bits
cannot hold is null. Components along which the vectors don't vary (eigenvalues within
rounding of zero) cannot be scaled to one and are left out, so one distinct vector gives
no rows, as does an empty table. Repeated rows and null ids are rows of their own. Columns
other than ``vec_id`` and ``embedding`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, IntegerType, LongType

from readsieve.llm.texts import batch_of, struct
from readsieve.session import cut, fresh_path

SCALE = 256
BLOCK_ROWS = 512
BLOCKS_A_TASK = 8
SLAB_ROWS = 1 << 16
SLABS_AT_A_TIME = 8
COMPONENTS = 4
LEAST_VARIANCE = 1e-12  # of the largest one; less is rounding
SHARE_BITS = 33  # of monotonically_increasing_id: the place in the share
TOTALS = struct(i=IntegerType(), total=DecimalType(38, 0))
CENTRED = struct(at=LongType(), vec_id=LongType(), deviation=LongType(), centred=ArrayType(DoubleType()))


def whole_numbers(embeddings: DataFrame, *others: Column) -> DataFrame:
    """(vec_id, x) and others: rows that take part, with their entries as whole numbers."""
    value = F.col("embedding")
    sound = value.isNotNull() & F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(value, lambda c: F.floor(c.cast("double") * SCALE))
    return embeddings.where(sound).select("vec_id", x.alias("x"), *others)


def indexed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``at``, counting from 0 without gaps, and vectors of one length."""
    held = cut(rows.withColumn("at", F.monotonically_increasing_id()), "rows")
    share = F.shiftright("at", SHARE_BITS)
    seen = held.groupBy(share.alias("share")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"))
    shares, before, width = [], 0, 0
    for r in sorted(seen.collect()):  # a row for each task's share
        shares.append((r["share"], before))
        before, width = before + r["n"], max(width, r["width"])
    offsets = held.sparkSession.createDataFrame(shares, "share long, before long")
    x = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    place = F.col("at").bitwiseAND((1 << SHARE_BITS) - 1)
    return held.join(F.broadcast(offsets), share == F.col("share")).select(
        "vec_id", x.alias("x"), (F.col("before") + place).alias("at")
    )


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def totals(rows: DataFrame) -> list[int]:
    """The sum of each dimension, exactly."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                # Sums of the upper and the lower halves of the numbers don't overflow.
                upper, lower = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
                total = total + upper.astype(object) * (1 << 32) + lower.astype(object)
        if isinstance(total, np.ndarray):
            schema = to_arrow_schema(TOTALS)
            yield batch_of([(i, Decimal(int(v))) for i, v in enumerate(total)], schema)

    sums = rows.select("x").mapInArrow(task, TOTALS).groupBy("i").agg(F.sum("total").alias("total"))
    return [int(r["total"]) for r in sums.orderBy("i").collect()]


def centre(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """(at, vec_id, deviation, centred, slab): x - S/n, and the sum of (n x - S)^2."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean = np.array([s / n for s in sums])
        largest = max(map(abs, sums), default=0)
        for batch in batches:
            x = _matrix(batch.column(2))
            apart = n * int(max(x.max(initial=0), -int(x.min(initial=0)))) + largest
            kind = np.int64 if apart * apart * max(len(sums), 1) < 1 << 63 else object
            off = x.astype(kind) * n - np.array(sums, kind)
            squares = pa.array([v if v < 1 << 63 else None for v in (off * off).sum(1).tolist()], pa.int64())
            flat = pa.array((x - mean).ravel())
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(sums))
            columns = [batch.column(0), batch.column(1), squares, pa.ListArray.from_arrays(ends, flat)]
            yield pa.RecordBatch.from_arrays(columns, names=CENTRED.names)

    return (
        rows.select("at", "vec_id", "x")
        .mapInArrow(task, CENTRED)
        .withColumn("slab", F.floor(F.col("at") / SLAB_ROWS).cast("int"))
    )


def _blocks(centred: DataFrame, slab: int, n: int, width: int) -> BlockMatrix:
    """A slab's rows as blocks, all columns in each."""
    rows = min(SLAB_ROWS, n - slab * SLAB_ROWS)
    own = centred.where(F.col("slab") == slab).select(
        (F.col("at") - slab * SLAB_ROWS).alias("index"), array_to_vector("centred").alias("vector")
    )
    own = MLUtils.convertVectorColumnsFromML(own.repartition(-(-rows // BLOCK_ROWS)), "vector")
    java = callMLlibFunc("createIndexedRowMatrix", own, rows, width)
    return IndexedRowMatrix(java).toBlockMatrix(BLOCK_ROWS, width)


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix, the blocks dealt to tasks along the rows."""
    width = blocks.numCols()
    splits = -(-blocks.numRows() // (BLOCK_ROWS * BLOCKS_A_TASK))
    left, right = blocks.transpose(), blocks
    # Only the call behind multiply() takes the number of splits.
    java = left._java_matrix_wrapper._java_model.multiply(right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, width, width).toLocalMatrix().toArray()


def _each_slab(slabs: list[int], work):
    with ThreadPoolExecutor(SLABS_AT_A_TIME) as pool:
        return list(pool.map(work, slabs))


@dataclass(frozen=True)
class Whitening:
    """``axes``: a column for each component, a unit eigenvector over the root of its eigenvalue."""

    axes: np.ndarray
    explained: list[float]


def fit(covariance: np.ndarray, components: int = COMPONENTS) -> Whitening:
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = [i for i in range(min(components, len(values))) if values[i] > LEAST_VARIANCE * values[0] > 0]
    return Whitening(vectors[:, kept] / np.sqrt(values[kept]), [float(values[i] / np.trace(covariance)) for i in kept])


def _project(spark: SparkSession, centred: DataFrame, slabs: list[int], n: int, axes: np.ndarray) -> DataFrame:
    """(at, y): blocks times the axes."""
    width, k = axes.shape
    block = Matrices.dense(width, k, axes.ravel(order="F").tolist())
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), width, k, width, k)
    path = fresh_path(spark, "projected")

    def work(slab: int) -> None:
        product = _blocks(centred, slab, n, width).multiply(right).toIndexedRowMatrix()
        rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
        rows = MLUtils.convertVectorColumnsToML(rows, "vector")
        at = (F.col("index") + slab * SLAB_ROWS).alias("at")
        rows.select(at, vector_to_array("vector").alias("y")).write.parquet(f"{path}/slab={slab}")

    _each_slab(slabs, work)
    return spark.read.parquet(path).select("at", "y")


def _identity_error(projected: DataFrame, firsts: DataFrame, n: int, k: int) -> float:
    """The largest difference of the fit list's covariance after whitening from the identity."""
    y = projected.join(firsts.select("at"), "at", "left_semi").select(*[F.col("y")[i].alias(f"y{i}") for i in range(k)])
    mean = y.agg(*[(F.sum(f"y{i}") / n).alias(f"y{i}") for i in range(k)]).first()
    off = [F.col(f"y{i}") - mean[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    covariance = y.agg(*[(F.sum(off[i] * off[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(covariance, pairs))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every row and component."""
    spark = embeddings.sparkSession
    rows = indexed(whole_numbers(embeddings))
    firsts = cut(rows.groupBy("x").agg(F.min("at").alias("at")), "firsts")
    n, sums = firsts.count(), totals(firsts)
    all_rows = cut(centre(rows, n, sums), "centred", by=("slab",))
    slabs = {r["slab"]: r["count"] for r in all_rows.groupBy("slab").count().collect()}
    whole, width = sum(slabs.values()), len(sums)
    covariance = np.zeros((width, width))
    if width:
        listed = cut(centre(firsts.withColumn("vec_id", F.lit(None).cast("long")), n, sums), "listed", by=("slab",))
        used = [r["slab"] for r in listed.select("slab").distinct().collect()]
        covariance = sum(_each_slab(used, lambda s: scatter(_blocks(listed, s, whole, width)))) / n
    found = fit(covariance, components)
    k = len(found.explained)
    if k:
        projected = _project(spark, all_rows, sorted(slabs), whole, found.axes)
        error = _identity_error(projected, firsts, n, k)
    else:
        projected, error = spark.createDataFrame([], "at long, y array<double>"), None
    explained = F.element_at(F.array(*map(F.lit, found.explained or [None])).cast("array<double>"), F.col("component"))
    return (
        all_rows.select("at", "vec_id", "deviation")
        .join(projected, "at")
        .select("vec_id", "deviation", F.posexplode("y").alias("i", "whitened"))
        .select("vec_id", "deviation", "whitened", (F.col("i") + 1).alias("component"))
        .select(
            "vec_id",
            "component",
            F.lit(n).cast("long").alias("n"),
            "deviation",
            "whitened",
            explained.alias("explained"),
            F.lit(error).cast("double").alias("identity_error"),
        )
    )
