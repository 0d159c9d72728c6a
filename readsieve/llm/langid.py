"""Language identification from character n-grams.

Sparse multinomial logistic regression on TF-IDF weights of hashed 1- to 3-grams of
letters, trained with follow-the-regularised-leader under an elastic-net penalty (L1
leaves most weights at nought), then a temperature fitted on part of the sample turns
the scores into calibrated probabilities.

Document frequencies are counted over *all* training documents. The weights are fitted
on a bounded sample: for each language those with the smallest hash of their doc_id,
``SAMPLE`` documents at most altogether but ``LEAST_PER_LANG`` for each language.

Neither language nor source nor doc_id is an input of a prediction. Texts that are null
or have no letter are ``und`` with score 0, and so is everything if there is nothing
to learn from. Whole texts are read, in blocks; repeated rows get the same answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from readsieve.llm.texts import per_row

BITS = 15
BUCKETS = 1 << BITS
ORDERS = 3
SAMPLE = 6_000
LEAST_PER_LANG = 50
BLOCK_CHARS = 1 << 19
UNKNOWN = "und"

_FACTOR = np.uint32(0x9E3779B1)


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point: itself if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    letters = [c for c in range(0x110000) if chr(c).isalpha()]
    table[letters] = letters
    return table


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The buckets in which n-grams of a text fall and their counts; None if it has no letter."""
    text = text or ""
    counts = np.zeros(BUCKETS, np.int64)
    tail = np.full(1, 32, np.uint32)  # the text begins with a border
    seen = False
    for at in range(0, len(text), BLOCK_CHARS):
        points = np.frombuffer(text[at : at + BLOCK_CHARS].lower().encode("utf-32-le"), "<u4")
        fresh = _letters()[points]
        letters = fresh != 32
        seen = seen or bool(letters.any())
        # One space stands for all that is between two letters.
        before = np.concatenate((tail[-1:] != 32, letters[:-1]))
        codes = np.concatenate((tail, fresh[letters | before]))
        for order in range(1, ORDERS + 1):
            start = max(len(tail), order - 1)
            n = len(codes) - start
            if n <= 0:
                continue
            hashed = np.full(n, order, np.uint32)
            for i in range(start - order + 1, start + 1):
                hashed = (hashed ^ codes[i : i + n]) * _FACTOR
            hashed ^= hashed >> np.uint32(15)
            counts += np.bincount((hashed * _FACTOR) >> np.uint32(32 - BITS), minlength=BUCKETS)
        tail = codes[-(ORDERS - 1) :]
    if not seen:
        return None
    at = np.flatnonzero(counts)
    return at, counts[at]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _training(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull())


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """How many texts there are with a letter, and in how many of them each bucket occurs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts = ngram_counts(text.as_py())
                if counts is not None:
                    found[counts[0]] += 1
                    n += 1
        found[-1] = n
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["bucket", "n"])

    parts = docs.select("text").mapInArrow(task, "bucket long, n long")
    found = np.zeros(BUCKETS + 1, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS + 1 rows at most
        found[row["bucket"]] = row["n"]
    return int(found[-1]), found[:-1]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """TF-IDF weights of the buckets ``at``, of length one."""
        values = np.log1p(counts) * self.idf[at]
        return values / np.sqrt((values * values).sum())

    def scores(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        values = self.vector(at, counts)
        return values @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text) if self.languages else None
        if counts is None:
            return UNKNOWN, 0.0
        p = softmax(self.scores(*counts) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(
    model: LanguageModel,
    rows: list[tuple[np.ndarray, np.ndarray]],
    answers: np.ndarray,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.05,
    l2: float = 0.01,
    epochs: int = 4,
) -> None:
    """Follow the regularised leader, coordinate by coordinate, one document at a time."""
    k = len(model.languages)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def leader(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    # The last coordinate is the bias.
    vectors = [(np.append(at.astype(np.int64), BUCKETS), np.append(model.vector(at, counts), 1.0)) for at, counts in rows]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, values = vectors[i]
            w = leader(at)
            p = softmax(values @ w)
            p[answers[i]] -= 1
            g = values[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = leader(np.arange(BUCKETS + 1))
    model.weights, model.bias = w[:-1], w[-1]


def fit_temperature(model: LanguageModel, rows: list[tuple[np.ndarray, np.ndarray]], answers: np.ndarray) -> None:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not rows:
        return
    scores = np.stack([model.scores(*row) for row in rows])

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(rows)), answers], 1e-12)).mean())

    low, high, golden = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    model.temperature = float(np.exp((low + high) / 2))


def train(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Learn from the documents that are not held out."""
    known = _training(docs)
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    model = LanguageModel(languages, np.zeros(BUCKETS), np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)))
    if not languages:
        return model
    n, df = document_frequencies(known)
    model.idf = np.log((1 + n) / (1 + df)) + 1

    each = max(LEAST_PER_LANG, sample // len(languages))
    turn = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    pairs = known.select("doc_id", "lang").distinct()
    chosen = (
        pairs.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= each)
    ).select(F.col("doc_id").alias("__of"), F.col("lang").alias("__lang"))

    def make():
        def row(doc_id, text, lang):
            at, counts = ngram_counts(text) or (np.zeros(0), np.zeros(0))
            return doc_id, lang, at.astype("<u2").tobytes(), counts.astype("<u4").tobytes()

        return row

    schema = StructType(
        [
            StructField("doc_id", LongType()),
            StructField("lang", StringType()),
            StructField("at", BinaryType()),
            StructField("counts", BinaryType()),
        ]
    )
    # Bounded by ``each`` rows for a language: a doc_id has one row in it, with its smallest text.
    mine = (F.col("doc_id") == F.col("__of")) & (F.col("lang") == F.col("__lang"))
    of_sample = known.select("doc_id", "text", "lang").join(F.broadcast(chosen), mine)
    of_sample = of_sample.groupBy("doc_id", "__lang").agg(F.min("text").alias("text"))
    found = per_row(of_sample, ["doc_id", "text", "__lang"], schema, make).collect()
    found = sorted((r for r in found if r["at"]), key=lambda r: (r["doc_id"], r["lang"], bytes(r["at"])))
    rows, answers = [], []
    for r in found:
        rows.append((np.frombuffer(r["at"], "<u2"), np.frombuffer(r["counts"], "<u4")))
        answers.append(languages.index(r["lang"]))
    answers = np.array(answers, np.int64)
    fold = np.arange(len(rows)) % 5 == 4
    fit_ftrl(model, [r for r, f in zip(rows, fold) if not f], answers[~fold])
    fit_temperature(model, [r for r, f in zip(rows, fold) if f], answers[fold])
    return model


PREDICTION_SCHEMA = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("held_out", BooleanType()),
        StructField("lang_pred", StringType()),
        StructField("score", DoubleType()),
    ]
)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size for each language

    def make():
        model = shared.value
        return lambda doc_id, out, text: (doc_id, out, *model.predict(text))

    named = docs.select("doc_id", held_out().alias("__out"), "text")
    return per_row(named, ["doc_id", "__out", "text"], PREDICTION_SCHEMA, make)
