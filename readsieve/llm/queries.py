"""The operators of this folder as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readsieve.llm import bpe, langid, lines, mixing, negatives, neighbours, ordinal, packing, rules, secrets, simhash, warc, whitening
from readsieve.sources.tables import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PACKED_VOCABULARY = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]


def op1_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return langid.predict(docs, langid.train(docs))


def op2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"), every=20, k=20)


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.judge(table(spark, sf, "documents"))


def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.write_and_read(table(spark, sf, "pages"))


def op6_bpe(spark: SparkSession, sf: str) -> DataFrame:
    ranks = bpe.read_ranks(spark, public_tokenizers.path(VOCABULARY))
    return bpe.encode_digests(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)


def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.hex_digits(found["fp"]).alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.dedup_digests(table(spark, sf, "documents"))


def op9_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.find(table(spark, sf, "documents"))


def op10_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return ordinal.score(docs, ordinal.train(docs, table(spark, sf, "labels")))


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf, "embeddings").withColumn("label", moved), every=50)


def op13_packing(spark: SparkSession, sf: str) -> DataFrame:
    tokenizer = packing.read_tokenizer(spark, public_tokenizers.path(PACKED_VOCABULARY))
    pieces = packing.pack(table(spark, sf, "documents"), tokenizer)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES: dict[str, Query] = {
    "op1_language": op1_language,
    "op2_neighbours": op2_neighbours,
    "op3_mixing": op3_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc": op5_warc,
    "op6_bpe": op6_bpe,
    "op7_simhash": op7_simhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_secrets": op9_secrets,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_whitening": op11_whitening,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_packing": op13_packing,
}
