"""Quality classifier: ordinal regression with cumulative links on graded ratings.

One set of weights on hashed text serves all grades; ordered thresholds cut the score
into grades: P(grade <= k) = sigmoid(threshold[k] - score). The expected grade and the
probability of the top grade select documents.

Grades come from the labels: 0 for poor quality, 1 for good quality that is toxic,
2 for good and clean. Features are hashes of words (in lower case, outer punctuation
off), of their first 4, 5 and 6 characters, and of word shapes in coarse shares, each
present or absent.

The model is fitted on a bounded sample: the ``sample`` labelled documents with the
smallest hash of their doc_id (documented bound, 4,000 by default), one row for each:
of several labels the lowest grade, of several texts the smallest. An L1 penalty makes
the weights sparse, so the model is small whatever the number of hash buckets, and rare
words weigh nothing. Every document is then scored over its whole text.

Texts without words (null and empty ones too) have grade 0 and are not kept. Labels
with nulls are not used; without any usable label nothing is judged: all documents with
words are kept, with null scores. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from readsieve.llm.texts import per_row, small_batches, words_of

SAMPLE = 4_000
BITS = 30
LEAST_DOCS = 3
RELAXED = 0.005
THRESHOLD = 0.8  # of the probability of the top grade
WORDS_KEPT = 50_000
LONG_WORD = 64
BEGINNINGS = (4, 5, 6)

_EDGES = b".,;:!?\"'()[]{}|&#*$%<>"
_SYMBOLS = frozenset(b"#*$%&|<>")


def _bucket(token: bytes) -> int:
    return xxhash.xxh32_intdigest(token) & ((1 << BITS) - 1)


def _shape(word: bytes) -> int:
    """0 plain, 1 with symbols, 2 shouted, 3 with digits, 4 very long."""
    if _SYMBOLS.intersection(word):
        return 1
    text = word.decode(errors="replace")
    if len(text) > 1 and text.isupper():
        return 2
    if any(map(str.isdigit, text)):
        return 3
    return 4 if len(text) > 24 else 0


def _share(part: int, whole: int) -> int:
    """Part of a whole in five steps: none, to 2 %, to 10 %, to 30 %, more."""
    return (part > 0) + (50 * part > whole) + (10 * part > whole) + (10 * part > 3 * whole)


def _word_buckets(word: bytes) -> tuple[int, ...]:
    """Buckets of a word without outer punctuation and of its beginnings, which endings don't change."""
    bare = word.strip(_EDGES).decode(errors="replace").lower()
    found = {_bucket(bare.encode())} | {_bucket(f"\0begins {bare[:n]}".encode()) for n in BEGINNINGS if len(bare) > n}
    return tuple(found)


class _Words(dict):
    """(buckets, shape) of words seen before; emptied when full."""

    def __missing__(self, word: bytes) -> tuple[tuple[int, ...], int]:
        kind = _word_buckets(word), _shape(word)
        if len(word) <= LONG_WORD:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = kind
        return kind


def buckets_of(text: str | None, memo: _Words) -> set[int]:
    """The hashed features that a text has; none if it has no word."""
    counts: Counter[bytes] = Counter()
    for words in words_of((text or "").encode()):
        counts.update(words)
    if not counts:
        return set()
    shapes = [0] * 5
    found = set()
    for word, n in counts.items():
        buckets, shape = memo[word]
        found.update(buckets)
        shapes[shape] += n
    total = sum(shapes)
    for shape, n in enumerate(shapes[1:], 1):
        found.add(_bucket(b"\0shape %d %d" % (shape, _share(n, total))))
    # How often a word comes back, as a power of two.
    found.add(_bucket(b"\0repeats %d" % (total // len(counts)).bit_length()))
    return found


# --------------------------------------------------------------------- model


@dataclass
class OrdinalModel:
    """Sparse weights by bucket and ascending thresholds, one fewer than grades."""

    weights: dict[int, float]
    thresholds: list[float]

    def tails(self, score: float) -> list[float]:
        """P(grade > k) for each threshold k."""
        return [float(1 / (1 + np.exp(np.clip(t - score, -500, 500)))) for t in self.thresholds]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(
    rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l1: float = 1.5, rounds: int = 400, rate: float = 0.3
) -> OrdinalModel:
    """Proximal gradient steps, scaled for each coordinate, on the mean log loss.

    ``rows`` hold the buckets of each document. The L1 penalty of a bucket grows as the
    square root of the number of its documents, as chance does, so that ``l1`` says how far
    beyond chance a bucket has to be for a weight. A second half of the rounds fits the
    chosen weights with little of the penalty, which would else keep them small. Buckets in under ``LEAST_DOCS`` documents
    of the sample are left out.
    """
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    names, column, found = np.unique(flat, return_inverse=True, return_counts=True)
    use = found >= LEAST_DOCS
    place = np.cumsum(use) - 1
    row = np.repeat(np.arange(len(rows)), lengths)[use[column]]
    column = place[column[use[column]]]
    names = names[use]
    penalty = l1 * np.sqrt(found[use]) / max(len(rows), 1)

    n = len(rows)
    shares = (np.bincount(grades, minlength=n_grades) + 1) / (n + n_grades)
    below = np.cumsum(shares)[:-1]
    first = np.log(below[0] / (1 - below[0]))
    gaps = np.log(np.maximum(np.diff(np.log(below / (1 - below))), 1e-3))
    w, past_w = np.zeros(len(names)), np.full(len(names), 1e-8)
    cuts = np.concatenate(([first], gaps))
    past_cuts = np.full(len(cuts), 1e-8)
    kept = np.ones(len(names), bool)
    for turn in range(2 * rounds):
        if turn == rounds:  # the penalty has chosen; now the chosen weights get their size
            kept = w != 0
            penalty = RELAXED * penalty
            past_w[:], past_cuts[:] = 1e-8, 1e-8
            row, column = row[kept[column]], column[kept[column]]
        thresholds = np.cumsum(np.concatenate(([cuts[0]], np.exp(cuts[1:]))))
        edges = np.concatenate(([-np.inf], thresholds, [np.inf]))
        score = np.bincount(row, weights=w[column], minlength=n)
        with np.errstate(invalid="ignore"):
            upper = np.where(grades == n_grades - 1, 1.0, _sigmoid(edges[grades + 1] - score))
            lower = np.where(grades == 0, 0.0, _sigmoid(edges[grades] - score))
        p = np.maximum(upper - lower, 1e-12)
        at_upper, at_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
        slope = (at_upper - at_lower) / n  # of the loss by the score
        of_w = np.bincount(column, weights=slope[row], minlength=len(names))
        of_edge = np.zeros(n_grades + 1)
        np.add.at(of_edge, grades + 1, -at_upper / n)
        np.add.at(of_edge, grades, at_lower / n)
        of_thresholds = of_edge[1:-1]
        later = np.cumsum(of_thresholds[::-1])[::-1]
        of_cuts = np.concatenate(([later[0]], later[1:] * np.exp(cuts[1:])))
        past_w += of_w**2
        past_cuts += of_cuts**2
        step = rate / np.sqrt(past_w)
        w = w - step * of_w
        w = np.where(kept, np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0), 0)
        cuts = cuts - 0.1 * of_cuts / np.sqrt(past_cuts)
    thresholds = np.cumsum(np.concatenate(([cuts[0]], np.exp(cuts[1:]))))
    found = np.flatnonzero(w)
    return OrdinalModel(dict(zip(names[found].tolist(), w[found].tolist())), thresholds.tolist())


# --------------------------------------------------------------------- Spark

N_GRADES = 3


def grade(quality: Column, toxic: Column) -> Column:
    """0 poor, 1 good but toxic, 2 good and clean."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(quality == 0, 0).when(toxic == 1, 1).otherwise(2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel | None:
    """Fit on at most ``sample`` labelled documents; None if there is none."""
    graded = labels.select(F.col("doc_id").alias("__of"), grade(F.col("quality"), F.col("toxic")).alias("__grade"))
    chosen = (
        graded.where("__of is not null and __grade is not null")
        .groupBy("__of")
        .agg(F.min("__grade").alias("__grade"))
        .orderBy(F.xxhash64("__of"), "__of")
        .limit(sample)
    )

    def make():
        memo = _Words()
        return lambda text, g: (g, np.array(sorted(buckets_of(text, memo)), "<u4").tobytes())

    schema = StructType([StructField("grade", LongType()), StructField("buckets", BinaryType())])
    # Bounded by ``sample`` rows, as each doc_id has one; its rows meet after a minimum in each task.
    of_sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__of"))
    of_sample = of_sample.groupBy("__of", "__grade").agg(F.min("text").alias("text"))
    rows = sorted((r["grade"], bytes(r["buckets"])) for r in per_row(of_sample, ["text", "__grade"], schema, make).collect())
    rows = [(g, np.frombuffer(b, "<u4").astype(np.int64)) for g, b in rows if b]
    if not rows:
        return None
    return fit([b for _, b in rows], np.array([g for g, _ in rows], np.int64), N_GRADES)


def _judge(model: OrdinalModel | None, threshold: float) -> Callable[[], Callable[[str | None], tuple]]:
    """Makes, in a task, the function from a text to (expected grade, tail probability, kept)."""

    def make():
        memo = _Words()
        weight = model.weights.get if model else None

        def judge(text: str | None) -> tuple[float | None, float | None, bool]:
            found = buckets_of(text, memo)
            if not found:
                return 0.0, 0.0, False
            if model is None:
                return None, None, True
            # In fixed order, so that a text has one score wherever it is worked out.
            tails = model.tails(sum(sorted(filter(None, map(weight, found)))))
            return sum(tails), tails[-1], tails[-1] >= threshold

        return judge

    return make


SCORE_SCHEMA = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("expected_grade", DoubleType()),
        StructField("tail_prob", DoubleType()),
        StructField("kept", BooleanType()),
    ]
)


def score(docs: DataFrame, model: OrdinalModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """Expected grade, probability of the top grade and verdict for every document."""
    judging = _judge(model, threshold)

    def make():
        judge = judging()
        return lambda doc_id, text: (doc_id, *judge(text))

    return per_row(docs, ["doc_id", "text"], SCORE_SCHEMA, make)


def select(docs: DataFrame, model: OrdinalModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with all their columns."""
    judging = _judge(model, threshold)

    at = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = judging()
        for batch in batches:
            yield batch.filter(pa.array([judge(t.as_py())[2] for t in batch.column(at)], pa.bool_()))

    return small_batches(docs).mapInArrow(task, docs.schema)
