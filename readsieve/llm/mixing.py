"""Mixing sources to target weights by entropy balancing.

**Targets.** Sources in code-point order, null last, share ``BUDGET`` times all words by
the repeating weights; no target passes ``CAP`` times its source's words, and what is
over is shared again by weight.

**Rates.** Of all rates that meet the token constraints, one for each source, and stay
within [0, CAP], the balanced ones are closest to one in relative entropy. They are
exponential tilts: a document of size x in source s has rate min(CAP, exp(lambda_s x /
mean_s)), where the multipliers lambda solve the convex dual. Newton steps on the dual
run as Spark aggregations over a table of (source, size, number of documents), which
is exact and small; the step for each source is kept in a bracket that only shrinks.

**Copies.** Rates are rounded to copies in segments of about ``SEGMENT`` documents,
each a fixed share of a source, so a hot source is many tasks and a rerun deals alike. A
segment rounds from large documents to small ones and carries what is over to the next
document; the smallest settle the rest.

**Rows alike.** Rows that share doc_id, source and size are counted, numbered and dealt
to segments in runs of ``RUN`` numbers, so very many of them are many tasks, and each is
rounded by itself: of n such rows as many get one more copy as the rates ask for.

Sizes count words ``[^\\x20\\x09-\\x0D]+``; null and empty texts have size 0, take no
words and keep one copy. Sources that consist of empty texts have target 0. Repeated
rows and rows without a doc_id are rows of their own. An empty table gives no rows.
Other columns are not read by ``mix`` and pass through ``apply_mix`` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from readsieve.llm.texts import per_row, struct, words_of
from readsieve.session import cut

# The weights of the sources in turn, the share of all words, the limit.
WEIGHTS = [3.0, 1.0, 2.0]
BUDGET = 1.5
CAP = 2.0

SEGMENT = 2_000
RUN = 250
SHARE_BITS = 33  # of monotonically_increasing_id: the place in a task's share
TOLERANCE = 1e-9
ROUNDS = 25
STEPS_A_ROUND = 4  # between two written states

SIZE_SCHEMA = struct(doc_id=LongType(), source=StringType(), size=LongType())


def sizes(docs: DataFrame, *keys: str) -> DataFrame:
    """(doc_id, source, size) and keys, whole numbers that pass through."""

    def size(doc_id, source, text, *keys):
        return doc_id, source, sum(map(len, words_of((text or "").encode()))), *keys

    schema = StructType([*SIZE_SCHEMA, *struct(**{k: LongType() for k in keys})])
    return per_row(docs, ["doc_id", "source", "text", *keys], schema, lambda: size)


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, n_docs, target): a row for each source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # One row for each source, the dimension of the dual, is put in order.
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn % len(WEIGHTS) + 1).cast("int"))
    open_ = F.col("target").isNull()
    now = cut(sources.select("*", weight.alias("weight"), F.lit(None).cast("double").alias("target")), "targets")
    while True:
        # What is left to share, and the weights that still share it.
        left = now.agg(
            (BUDGET * F.sum("source_size") - F.coalesce(F.sum("target"), F.lit(0.0))).alias("room"),
            F.sum(F.when(open_, F.col("weight"))).alias("weights"),
        ).first()
        if not left["weights"]:
            return now.drop("weight")
        share = F.col("weight") * (left["room"] / left["weights"])
        limit = CAP * F.col("source_size")
        if not now.where(open_ & (share > limit)).limit(1).count():
            return now.withColumn("target", F.coalesce("target", share)).drop("weight")
        now = cut(now.withColumn("target", F.when(open_ & (share > limit), limit).otherwise(F.col("target"))), "targets")


def _same(a: str, b: str = "source"):
    return F.col(a).eqNullSafe(F.col(b))


def multipliers(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(of, lam, mean): the multiplier of each source that has words, by Newton steps on the dual.

    With f(lam) the words taken, the step is on log f, which is convex while nothing is
    at the cap; a step out of the bracket, which the cap can cause, becomes its middle.
    """
    counts = cut(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    least = counts.groupBy("source").agg(F.min("size").alias("least")).withColumnRenamed("source", "__s")
    mean = F.col("source_size") / F.col("n_docs")
    start = (
        goals.where("source_size > 0")
        .join(least, _same("__s"))
        .select(
            F.col("source").alias("of"),
            "target",
            mean.alias("mean"),
            F.lit(0.0).alias("lam"),
            F.lit(None).cast("double").alias("low"),
            # Here every document of the source is at the cap.
            (F.lit(math.log(CAP)) * mean / F.col("least")).alias("high"),
            F.lit(False).alias("done"),
        )
    )
    state = cut(start, "multipliers")
    for _ in range(ROUNDS):
        if not state.where("not done").limit(1).count():
            break
        for _ in range(STEPS_A_ROUND):
            state = _newton(counts, state)
        state = cut(state, "multipliers")
    return state.select("of", "lam", "mean")


def _newton(counts: DataFrame, state: DataFrame) -> DataFrame:
    """One step for every source that is not done."""
    lam, size = F.col("lam"), F.col("size")
    tilt = F.exp(F.least(lam * size / F.col("mean"), F.lit(700.0)))
    taken = F.col("n") * size * F.least(tilt, F.lit(CAP))
    slope = F.when(tilt < CAP, F.col("n") * size * size / F.col("mean") * tilt).otherwise(0.0)
    same = ["target", "mean", "lam", "low", "high", "done"]
    now = (
        counts.join(state, _same("of"))
        .groupBy("of")
        .agg(F.sum(taken).alias("f"), F.sum(slope).alias("df"), *[F.first(c).alias(c) for c in same])
    )
    f, target, low, high = (F.col(c) for c in ("f", "target", "low", "high"))
    now = now.withColumns(
        {
            "low": F.when(~F.col("done") & (f < target), lam).otherwise(low),
            "high": F.when(~F.col("done") & (f > target), lam).otherwise(high),
        }
    )
    step = lam - F.log(f / target) * f / F.col("df")
    inside = (F.col("df") > 0) & (low.isNull() | (step > low)) & (step < high)
    # While there is no lower bound the function is convex to the left, where steps never pass the root.
    middle = F.when(low.isNull(), 2 * high - 1).otherwise((low + high) / 2)
    close = (F.abs(f - target) <= TOLERANCE * target) | F.coalesce(high - low <= 1e-12 * (1 + F.abs(high)), F.lit(False))
    done = F.col("done") | close
    return now.select(
        "of",
        "target",
        "mean",
        F.when(done, lam).when(inside, step).otherwise(middle).alias("lam"),
        "low",
        "high",
        done.alias("done"),
    )


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment, then size from large to small; copies that follow the rates."""
    segment, wanted, given = None, 0.0, 0
    for batch in batches:
        named = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        keys, size, rate = (named[n].to_pylist() for n in ("segment", "size", "rate"))
        copies = np.ones(len(size), np.int64)
        for i, (key, x, r) in enumerate(zip(keys, size, rate)):
            if key != segment:
                segment, wanted, given = key, 0.0, 0
            if x:
                wanted += r * x
                # The number of copies that comes nearest to the rates of all so far.
                best = math.floor((wanted - given) / x + 0.5)
                copies[i] = min(max(best, 0), int(CAP))
                given += x * int(copies[i])
        names = [n for n in named if n not in ("segment", "rate")]
        yield pa.RecordBatch.from_arrays([*(named[n] for n in names), pa.array(copies)], names=[*names, "copies"])


MIXED = "doc_id long, source string, size long, number long, source_size long, target double, copies long"


def _mix(sized: DataFrame) -> DataFrame:
    """The rows of ``mix`` with the numbers, from 0, of rows alike."""
    goals = cut(targets(sized), "targets")
    found = multipliers(sized, goals)
    plan = cut(
        goals.join(found, _same("of"), "left").select(
            F.col("source").alias("of"), "source_size", "n_docs", "target", F.round("lam", 9).alias("lam"), "mean"
        ),
        "plan",
    )
    rate = F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(700.0))), F.lit(CAP))
    segments = F.ceil(F.col("n_docs") / SEGMENT)
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    rated = alike.join(plan, _same("of")).select(
        "doc_id",
        "source",
        "size",
        "n",
        "source_size",
        "target",
        F.coalesce(F.round(rate, 9), F.lit(1.0)).alias("rate"),
        "n_docs",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN))).alias("run"),
    )
    dealt = rated.withColumn(
        "segment", F.xxhash64(F.struct("source"), F.pmod(F.xxhash64("doc_id", "run"), segments))
    ).repartition("segment")
    first = F.col("run") * RUN
    last = F.least(F.col("n"), first + RUN) - 1
    order = ["segment", F.col("size").desc(), F.xxhash64("doc_id"), "doc_id", "number"]
    numbered = dealt.withColumn("number", F.explode(F.sequence(first, last))).sortWithinPartitions(*order)
    columns = ["doc_id", "source", "size", "number", "source_size", "target", "rate", "segment"]
    return numbered.select(*columns).mapInArrow(_round, MIXED)


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row."""
    mixed = _mix(cut(sizes(docs), "sizes"))
    return mixed.drop("number").withColumn("taken", F.col("copies") * F.col("size"))


def _numbered(held: DataFrame) -> DataFrame:
    """(at, doc_id, source, size, number): rows alike are numbered within a task's share,
    after those of the shares before."""
    alike = ["doc_id", "source", "size"]
    sized = sizes(held, "at").withColumn("share", F.shiftright("at", SHARE_BITS))
    sized = cut(
        sized.withColumn("place", F.row_number().over(Window.partitionBy("share", *alike).orderBy("at")) - 1), "numbered"
    )
    counts = sized.groupBy("share", *alike).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*alike).orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        *[F.col(c).alias(f"of_{c}") for c in ("share", *alike)], F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    joined = sized.join(before, (F.col("share") == F.col("of_share")) & _alike())
    return joined.select("at", *alike, (F.col("before") + F.col("place")).alias("number"))


def _alike():
    return _same("doc_id", "of_doc_id") & _same("source", "of_source") & (F.col("size") == F.col("of_size"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    held = cut(docs.select(row, F.monotonically_increasing_id().alias("at")), "held")
    columns = ("doc_id", "source", "text")
    numbered = cut(_numbered(held.select("at", *[F.col(f"row.{c}").alias(c) for c in columns])), "numbered")
    mixed = _mix(numbered.select("doc_id", "source", "size")).select(
        F.col("doc_id").alias("of_doc_id"),
        F.col("source").alias("of_source"),
        F.col("size").alias("of_size"),
        F.col("number").alias("of_number"),
        "copies",
    )
    taken = numbered.join(mixed, _alike() & (F.col("number") == F.col("of_number"))).where("copies > 0")
    taken = taken.select(F.col("at").alias("of_at"), "copies")
    copied = held.join(taken, F.col("at") == F.col("of_at"))
    return copied.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    )
