"""From raw documents to token ids: five stages over the whole corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the ``docs`` of the next one; all but the last keep the
columns of ``docs``. What a stage decides takes effect: rejected documents, repeated
lines and spare copies are gone, and the mix repeats or drops documents.

Nulls, empty texts and empty tables pass through as the operators define it. A column
``n_chars`` follows the text where lines are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readsieve.llm import bpe, lines, mixing, ordinal, simhash
from readsieve.session import cut
from readsieve.sources.tables import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labels, takes for top grade."""
    return ordinal.select(docs, ordinal.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that a smaller doc_id has."""
    kept = lines.dedup(docs)
    return kept.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType)) if "n_chars" in kept.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the balanced mix of sources takes them."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document, and of the bytes decoded from them."""
    return bpe.encode_digests(docs, bpe.read_ranks(spark, public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("encode", encode),
]

# The classifier, the balanced rates and the merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
