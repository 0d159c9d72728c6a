"""Quality rules joined by weak supervision.

Each rule votes good (1), bad (0) or abstains (-1) on a document. The true class is
hidden; expectation-maximisation estimates from the votes of *all* documents how
often each rule is right on either class, and how common the classes are. The
posterior probability of "good" then replaces the demand that all rules pass.

A vote pattern is one of 3^rules, so the counts of patterns are all that the
estimation needs: one pass over the texts, one aggregation, and a table of at most
3^7 rows on the driver whatever the size of the corpus.

Null and empty texts have no words and fail the base test. Repeated rows are judged
alike. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from readsieve.llm.texts import BLANKS, per_row, words_of
from readsieve.session import cut

# Characters counted as symbols.
SYMBOLS = "#*$%&|<>"

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"]
FEATURE_SCHEMA = StructType([StructField("doc_id", LongType())] + [StructField(f, LongType(), False) for f in FEATURES])

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def text_features(text: str | None) -> tuple[int, ...]:
    """The counts named in ``FEATURES``."""
    text = text or ""
    data = text.encode()
    seen: dict[bytes, int] = {}
    coded = [
        np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) for words in words_of(data)
    ]
    ids = np.concatenate(coded)
    blank = sum(text.count(c) for c in BLANKS)
    lines = text.split("\n")
    known: set[str] = set()
    n_dup = 0
    if len(lines) > 1:
        for line in lines:
            if line.strip(BLANKS):
                n_dup += line in known
                known.add(line)
    return (
        len(ids),
        len(text) - blank,
        sum(text.count(c) for c in SYMBOLS),
        n_dup,
        _in_repeats(ids, len(seen)),
        len(lines),
        len(data) - len(data.translate(None, _UPPER)),
        len(data) - len(data.translate(None, _LETTERS)),
    )


def _in_repeats(ids: np.ndarray, kinds: int) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    pair = ids[:-2] * kinds + ids[1:-1]
    if kinds >= 1 << 20:  # three numbers would not fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair * kinds + ids[2:]
    _, which, counts = np.unique(window, return_inverse=True, return_counts=True)
    repeated = counts[which] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(repeated)] |= repeated
    return int(covered.sum())


def features(docs: DataFrame) -> DataFrame:
    return per_row(docs, ["doc_id", "text"], FEATURE_SCHEMA, lambda: lambda doc_id, text: (doc_id, *text_features(text)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def votes() -> dict[str, Column]:
    """The rules. Between their two limits they abstain."""
    words, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    return {
        "symbols": _vote(10 * F.col("n_symbols") > words, 50 * F.col("n_symbols") <= words),
        "symbol_density": _vote(50 * F.col("n_symbols") > chars, 200 * F.col("n_symbols") <= chars),
        "repeats": _vote(100 * F.col("n_repeat_words") > 30 * words, 100 * F.col("n_repeat_words") <= 10 * words),
        "dup_lines": _vote(100 * F.col("n_dup_lines") > 60 * lines, 100 * F.col("n_dup_lines") <= 10 * lines),
        "word_length": _vote((2 * chars < 5 * words) | (chars > 12 * words), (chars >= 3 * words) & (chars <= 9 * words)),
        "length": _vote(words < 50, words >= 80),
        "shouting": _vote(
            100 * F.col("n_upper") > 30 * F.col("n_letters"), 100 * F.col("n_upper") <= 15 * F.col("n_letters")
        ),
    }


@dataclass
class LabelModel:
    """What expectation-maximisation found: the share of good documents, and for each
    rule how often its vote is right on good and on bad ones."""

    prior: float
    right_on_good: list[float]
    right_on_bad: list[float]
    rounds: int = field(default=0)


def _likelihood(patterns: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each pattern's votes, given good and given bad."""
    if_good = np.where(patterns == 1, np.log(good), np.where(patterns == 0, np.log1p(-good), 0.0)).sum(axis=1)
    if_bad = np.where(patterns == 0, np.log(bad), np.where(patterns == 1, np.log1p(-bad), 0.0)).sum(axis=1)
    return if_good, if_bad


def posterior(model: LabelModel, patterns: np.ndarray) -> np.ndarray:
    if_good, if_bad = _likelihood(patterns, np.array(model.right_on_good), np.array(model.right_on_bad))
    odds = if_bad - if_good + np.log1p(-model.prior) - np.log(model.prior)
    return 1 / (1 + np.exp(np.clip(odds, -500, 500)))


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, tolerance: float = 1e-9) -> LabelModel:
    """Estimate the model from the patterns (rows of -1, 0, 1) and how often each occurs.

    To begin with, a good document is taken to pass most rules and a bad one to break a
    good part of them, since a rule looks for one fault among several; that tells the two
    classes apart. A few imagined votes keep the estimates inside (0, 1).
    """
    n_rules = patterns.shape[1]
    model = LabelModel(0.9, [0.95] * n_rules, [0.4] * n_rules)
    if not counts.sum():
        return model
    for n in range(1, rounds + 1):
        good = counts * posterior(model, patterns)
        bad = counts - good
        new = LabelModel(
            float(np.clip((good.sum() + 1) / (counts.sum() + 2), 1e-6, 1 - 1e-6)),
            [
                float((good[patterns[:, j] == 1].sum() + 9.5) / (good[patterns[:, j] >= 0].sum() + 10))
                for j in range(n_rules)
            ],
            [
                float((bad[patterns[:, j] == 0].sum() + 4) / (bad[patterns[:, j] >= 0].sum() + 10))
                for j in range(n_rules)
            ],
            n,
        )
        moved = np.abs(
            np.array([new.prior, *new.right_on_good, *new.right_on_bad])
            - np.array([model.prior, *model.right_on_good, *model.right_on_bad])
        ).max()
        model = new
        if moved < tolerance:
            break
    return model


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Features, votes, posterior and verdict of every document."""
    spark = docs.sparkSession
    rules = votes()
    names = [f"vote_{name}" for name in rules]
    voted = cut(
        features(docs).select("*", *[v.cast("int").alias(n) for n, v in zip(names, rules.values())]), "votes"
    )
    found = voted.groupBy(*names).count().collect()  # at most 3 ** len(rules) rows
    patterns = np.array([list(r)[:-1] for r in found], int).reshape(-1, len(names))
    model = fit(patterns, np.array([r["count"] for r in found], float))
    table = spark.createDataFrame(
        [(*map(int, p), float(q)) for p, q in zip(patterns, posterior(model, patterns))],
        ", ".join(f"{n} int" for n in names) + ", posterior double",
    )
    return voted.join(F.broadcast(table), names).select(
        "doc_id",
        *FEATURES[:5],
        base_failed().alias("base_failed"),
        (~base_failed() & (F.col("posterior") >= threshold)).alias("kept"),
        "posterior",
        *names,
    )
