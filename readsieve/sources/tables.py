"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readsieve.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def columns_of(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Chosen columns of a table, spread over the cores."""
    return spread(table(spark, folder, name).select(*columns))
